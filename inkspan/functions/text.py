"""Tokens, pieces of long texts, and match offsets, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Analyzer: lower-cased runs of letters, marks, digits and underscore.
WORD = r"[\p{L}\p{M}\p{N}_]+"
BETWEEN = r"[^\p{L}\p{M}\p{N}_]+"

# A text longer than this is cut into pieces before it is tokenized, so that no array holds all
# tokens of a 50 MB document. A cut never falls inside a word and nothing is left out.
PIECE_CHARS = 4096


def word_list(text: Column) -> Column:
    """All tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pieces_of(text: Column, size: int = PIECE_CHARS) -> Column:
    """The text as an array of pieces of about ``size`` characters that end at word ends."""
    cut = r"(?s).{%d}[\p{L}\p{M}\p{N}_]*|.+" % size
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(cut), F.lit(0))
    )


# A fold that appends copies what it has so far, so running sums are folded in runs of this length.
RUN = 256


def _runs(values: Column) -> Column:
    """The array cut into runs; an empty array has none."""
    count = F.ceil(F.size(values) / RUN).cast("int")
    starts = F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), F.lit(1), count)
    return F.transform(starts, lambda k: F.slice(values, k * RUN + 1, F.lit(RUN)))


def _fold_sums(values: Column, base: Column) -> Column:
    """Sums before each value, from ``base`` on, by one appending fold."""
    start = F.struct(base.alias("at"), F.array().cast("array<int>").alias("sums"))
    return F.aggregate(
        values,
        start,
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["sums"], acc["at"]).alias("sums")),
        lambda acc: acc["sums"],
    )


def sums_before(values: Column) -> Column:
    """For each int of the array the sum of those before it, in time that is linear up to very long arrays."""
    runs = _runs(values)
    totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + x))
    return F.flatten(F.zip_with(runs, _fold_sums(totals, F.lit(0)), _fold_sums))


def text_pieces(
    df: DataFrame,
    keys: list[str],
    text: str = "text",
    size: int = PIECE_CHARS,
) -> DataFrame:
    """One row per piece: keys, piece_no, piece, char_base and token_base (both 0-based)."""
    cut = df.select(*keys, pieces_of(F.col(text), size).alias("_pieces"))
    many = F.size("_pieces") > 1
    none = F.array().cast("array<int>")
    measured = cut.select(
        *keys,
        "_pieces",
        F.when(many, F.transform("_pieces", lambda p: F.length(p))).otherwise(none).alias("_chars"),
        F.when(many, F.transform("_pieces", lambda p: F.regexp_count(p, F.lit(WORD))))
        .otherwise(none)
        .alias("_words"),
    )
    bases = measured.select(
        *keys, "_pieces", sums_before(F.col("_chars")).alias("_chars"), sums_before(F.col("_words")).alias("_words")
    )
    parts = F.transform(
        "_pieces",
        lambda p, i: F.struct(
            i.alias("piece_no"),
            p.alias("piece"),
            F.coalesce(F.get("_chars", i), F.lit(0)).alias("char_base"),
            F.coalesce(F.get("_words", i), F.lit(0)).alias("token_base"),
        ),
    )
    return bases.select(*keys, F.inline(parts))


def token_table(
    df: DataFrame, keys: list[str], text: str = "text", size: int = PIECE_CHARS
) -> DataFrame:
    """One row per token: keys, token, pos (0-based position in the text)."""
    return text_pieces(df, keys, text, size).select(
        *keys, "token_base", F.posexplode(word_list(F.col("piece"))).alias("_at", "token")
    ).select(*keys, "token", (F.col("token_base") + F.col("_at")).alias("pos"))


def _last(words: Column, count: int) -> Column:
    return F.slice(words, F.greatest(F.size(words) - count, F.lit(0)) + 1, F.lit(count))


def word_runs(
    df: DataFrame,
    keys: list[str],
    carry: int,
    text: str = "text",
    words: Callable[[Column, Column], Column] = lambda piece, before: word_list(piece),
    size: int = PIECE_CHARS,
    counted: bool = False,
) -> DataFrame:
    """One row per piece: keys, words, lead and is_last. No array holds the words of a long text.

    ``words`` makes the words of a piece, from the piece and the number of words before it (0 unless ``counted``). The first
    ``lead`` of the words, ``carry`` at most, are the last ones of the pieces before.
    """
    none, nothing = F.array().cast("array<int>"), F.array().cast("array<string>")
    cut = df.select(*keys, pieces_of(F.col(text), size).alias("_pieces"))
    many = F.size("_pieces") > 1
    sizes = F.when(many & F.lit(counted), F.transform("_pieces", lambda p: F.regexp_count(p, F.lit(WORD)))).otherwise(none)
    based = cut.select(*keys, "_pieces", sums_before(sizes).alias("_bases"))

    def base(i: Column) -> Column:
        return F.coalesce(F.get("_bases", i), F.lit(0))

    # without words to hand on a piece's words are made once
    tails = F.when(many, F.transform("_pieces", lambda p, i: _last(words(p, base(i)), carry) if carry else nothing))
    ended = based.select(*keys, "_pieces", "_bases", F.coalesce(tails, F.array(nothing)).alias("_tails"))
    placed = ended.select(
        *keys, "_pieces", "_bases",
        F.flatten("_tails").alias("_ends"), sums_before(F.transform("_tails", lambda t: F.size(t))).alias("_before"),
    )
    parts = F.transform(
        "_pieces",
        lambda p, i: F.struct(
            p.alias("_piece"),
            base(i).alias("_base"),
            F.slice(
                "_ends", F.greatest(F.get("_before", i) - carry, F.lit(0)) + 1, F.least(F.get("_before", i), F.lit(carry))
            ).alias("_lead"),
            (i == F.size("_pieces") - 1).alias("is_last"),
        ),
    )
    return placed.select(*keys, F.inline(parts)).select(
        *keys,
        F.concat("_lead", words(F.col("_piece"), F.col("_base"))).alias("words"),
        F.size("_lead").alias("lead"),
        "is_last",
    )


def grams_of(words: Column, size: int, lead: Column) -> Column:
    """Runs of ``size`` words joined by blanks, but for those within the first ``lead`` words."""
    first = F.greatest(lead - (size - 2), F.lit(1))
    last = F.size(words) - (size - 1)
    runs = F.transform(F.sequence(first, last), lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
    return F.when(last >= first, runs).otherwise(F.array().cast("array<string>"))


def token_bag(
    df: DataFrame, keys: list[str], text: str = "text", size: int = PIECE_CHARS
) -> DataFrame:
    """Tokens without positions, each at most once per piece: keys, token. No shuffle."""
    pieces = df.select(*keys, F.explode(pieces_of(F.col(text), size)).alias("piece"))
    return pieces.select(*keys, F.explode(F.array_distinct(word_list(F.col("piece")))).alias("token"))


def match_spans(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<start,end,occurrence>>`` with exact code-point offsets.

    The gaps between matches come from splitting on the same pattern, so a match is placed by
    summing lengths; looking the matched text up again could find an earlier, unbounded copy.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # Start of each match: the gaps and matches before it, and the gap right before it.
    steps = F.zip_with(
        found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"))
    )
    before = sums_before(F.transform(steps, lambda s: s["g"] + F.length(s["m"])))
    return F.zip_with(
        steps,
        before,
        lambda s, at: F.struct(
            (at + s["g"]).alias("start"), (at + s["g"] + F.length(s["m"])).alias("end"), s["m"].alias("occurrence")
        ),
    )


def spans_table(df: DataFrame, keys: list[str], pattern: str, text: str = "text") -> DataFrame:
    """One row per match: keys, start, end, occurrence. Texts without a match cost one pass."""
    hit = df.filter(F.col(text).rlike(pattern))
    return hit.select(*keys, F.inline(match_spans(F.col(text), pattern)))


def extract(text: Column, pattern: Column) -> Column:
    """First match of a pattern that itself is a column."""
    return F.call_function("regexp_extract", text, pattern, F.lit(0))


def snippet(text: Column, pattern: Column, before: int, after: int) -> Column:
    """The first match of a pattern with up to ``before``/``after`` characters around it."""
    window = F.concat(
        F.lit(r"(?s).{0,%d}(?:" % before), pattern, F.lit(r").{0,%d}" % after)
    )
    return extract(text, window)
