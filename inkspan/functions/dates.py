"""Mail dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone names of RFC 2822, section 4.3, with their offsets.
ZONES = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EDT": "-0400", "EST": "-0500", "CDT": "-0500", "CST": "-0600",
    "MDT": "-0600", "MST": "-0700", "PDT": "-0700", "PST": "-0800",
}


def parse_mail_date(header: Column) -> Column:
    """RFC 2822 date with a zone as a UTC timestamp; null when it cannot be read or has no zone."""
    plain = F.trim(F.regexp_replace(header, r"\([^()]*\)|^\s*[A-Za-z]{3,9}\s*,", ""))
    plain = F.regexp_replace(plain, r"\s+", " ")
    zone = F.regexp_extract(plain, r" ([A-Za-z]+)$", 1)
    names = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    named = F.try_element_at(names, F.upper(zone))
    numeric = F.when(zone == "", plain).otherwise(
        F.concat(F.regexp_replace(plain, r"[A-Za-z]+$", ""), named)
    )
    with_seconds = F.regexp_replace(numeric, r" (\d{1,2}:\d{2}) ", " $1:00 ")
    return F.try_to_timestamp(with_seconds, F.lit("d MMM yyyy H:mm:ss Z"))
