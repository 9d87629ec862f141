"""HTML to text with a chain of native regex replacements."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public table of named references; a no-break space becomes a space. The usual ones stand first, as a map is
# looked up from its beginning.
USUAL = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
NAMED = {**USUAL, **{name: chr(code) for name, code in name2codepoint.items() if name not in USUAL}}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

DROPPED = [
    r"(?is)<!--.*?-->",
    r"(?is)<script\b[^>]*>.*?</script\b[^>]*>",
    r"(?is)<style\b[^>]*>.*?</style\b[^>]*>",
    r"(?is)<head\b[^>]*>.*?</head\b[^>]*>",
]


def html_title(html: Column) -> Column:
    return decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def _character(reference: Column) -> Column:
    """What one reference stands for; unknown names and impossible numbers stay as they are."""
    body = F.substring(reference, F.lit(2), F.length(reference) - 2)
    name = F.element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), body)
    number = F.when(
        body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 9), 16, 10).cast("int")
    ).when(body.startswith("#"), F.substring(body, 2, 9).cast("int"))
    real = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.coalesce(F.when(real, char), name, reference)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, each once: ``&amp;lt;`` becomes ``&lt;``."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    gaps = F.split(text, REFERENCE, -1)
    plain = F.concat(F.transform(found, _character), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(gaps, plain, lambda g, c: F.concat(g, c)), "")
    return F.when(F.contains(text, F.lit("&")) & (F.size(found) > 0), joined).otherwise(text)


def html_text(html: Column) -> Column:
    """Visible text: comments, scripts, styles and head dropped, tags become spaces."""
    text = html
    for pattern in DROPPED:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_entities(text), r"[ \t\r\n]+", " "))
