"""People's names: cleaning, middle names, and where a matched part lies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an initial (one ASCII letter with an optional period and space) or any period.
INITIALS = r"(?U)(\b[A-Za-z]\.? ?\b)|\."


def clean_name(name: Column) -> Column:
    """Name without initials and periods, trimmed."""
    return F.regexp_replace(F.regexp_replace(name, INITIALS, ""), r"(?U)^\s+|\s+$", "")


def name_parts(name: Column) -> Column:
    """Parts between whitespace; empty for a blank name."""
    trimmed = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"(?U)\s+"))


def middle_name_count(name: Column) -> Column:
    return F.greatest(F.size(name_parts(name)) - 2, F.lit(0))


def without_middle_names(name: Column) -> Column:
    """First and last part; a name of one part stays as it is."""
    parts = name_parts(name)
    return F.when(
        F.size(parts) > 1, F.concat_ws(" ", F.element_at(parts, 1), F.element_at(parts, -1))
    ).otherwise(name)


def part_start(part: Column, name: Column) -> Column:
    """0-based start of the part inside the original name, -1 when cleaning changed it away."""
    return F.when(part == "", F.lit(-1)).otherwise(
        F.call_function("locate", F.lower(part), F.lower(name)) - 1
    )
