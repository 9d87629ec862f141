"""Phrase collocations per language, mined by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. Two
polynomials over bytes give each word a 64-bit hash and a check value; prefix sums of polynomials over the words'
hashes then give the fingerprint of every n-gram by one subtraction. The language is part of it.

Counting goes level by level. An n-gram can be frequent only if both its (n-1)-grams are, so a bit table of the
frequent fingerprints of the level below (fixed largest size) keeps most others out of the shuffle. What is shuffled are
fingerprints with counts and one occurrence pointer (document and word), added up per batch and per task before.

A fingerprint stands for one phrase if all its occurrences have one check value; those with several are counted again
by the words themselves. Frequent phrases, and only they, are read from the text at their pointer, which has to give
the same fingerprint again.

A candidate's score is ``floor(10**6 * a * a / (l * r))`` of its lowest-scoring cut, in exact decimals.

Defined cases: a null text has no words, a null language is ``und``. Rows that repeat an id count as documents of their own.
A null document id is a document below all others. Extra columns are not read. Empty tables give no phrases.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.frames import bounded_batches, id_filter, key_or_least, parts, stage
from inkspan.llm.wordhash import mix, text_bytes

LONGEST, LEAST_COUNT, COVERED = 3, 10, 50
TOP = 2_000
CHUNK = 1 << 18  # bytes hashed at once
PART_BYTES = 2_500_000  # of texts worked on at once, but for longer ones
TABLE_BITS = 26  # of the largest bit table: 8 MB
SALTS = 16  # parts of a language ranked apart before all are
UNKNOWN = "und"

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_BASE = 0xD6E8FEB86659FD93
_WORTH = np.random.default_rng(20_250_311).integers(1, 1 << 64, (2, 256), dtype=_U)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = SEPARATOR.copy()
BLANK[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(max(count, 1), base, _U)
    out[0] = 1
    return np.cumprod(out)


@cache
def _chunk_powers(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a byte base and of its inverse modulo 2**64."""
    return _powers(_BASES[k], CHUNK), _powers(pow(_BASES[k], -1, 1 << 64), CHUNK)


class Words:
    """Words of a batch: start and end byte, piece they stand in, hash and check value."""

    def __init__(self, texts: pa.Array) -> None:
        data, self.offsets = text_bytes(texts)
        self.data = LOWER[data]
        blank = BLANK[data]
        rows, stops = self.offsets[:-1], self.offsets[1:]
        filled = stops > rows
        first, last = ~blank, ~blank
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        first[rows[filled]] = ~blank[rows[filled]]
        last[stops[filled] - 1] = ~blank[stops[filled] - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row_ptr = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.row_ptr))
        self.hash, self.check = (mix(self._hash(k)) for k in range(2))
        cuts = np.cumsum(SEPARATOR[data], dtype=np.int32)[self.start] if len(self.start) else self.start
        fresh = np.ones(len(self.start), bool)
        fresh[1:] = (cuts[1:] != cuts[:-1]) | (self.row[1:] != self.row[:-1])
        self.piece = np.cumsum(fresh, dtype=np.int32)

    def _hash(self, k: int) -> np.ndarray:
        """Polynomial of each word's bytes, from prefix sums over a chunk; a word across chunks is put together."""
        out = np.zeros(len(self.start), _U)
        power, inverse = _chunk_powers(k)
        for low in range(0, len(self.data), CHUNK):
            high = min(low + CHUNK, len(self.data))
            a, b = np.searchsorted(self.end, low, "right"), np.searchsorted(self.start, high)
            if a == b:
                continue
            begin = np.maximum(self.start[a:b], low) - low
            stop = np.minimum(self.end[a:b], high) - low
            sums = np.zeros(high - low + 1, _U)
            np.cumsum(_WORTH[k][self.data[low:high]] * power[: high - low], out=sums[1:])
            part = (sums[stop] - sums[begin]) * inverse[begin]
            if self.start[a] < low:
                part[:1] *= _U(pow(_BASES[k], int(low - self.start[a]), 1 << 64))
            out[a:b] += part
        return out

    def phrases(self, at: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Words from the places ``at``, joined by spaces."""
        whole = self.data.tobytes()
        stop = self.end[at + size - 1].tolist()
        return [b" ".join(whole[a:b].split()) for a, b in zip(self.start[at].tolist(), stop, strict=True)]


class Grams:
    """Fingerprints and check values of all n-grams of a batch. ``bits`` of a fingerprint are kept (fewer only to test)."""

    def __init__(self, texts: pa.Array, langs: pa.Array, bits: int = 64) -> None:
        self.words = words = Words(texts)
        named = langs.dictionary_encode()
        salts = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in named.dictionary.to_pylist()]
        self.lang = np.frombuffer(b"".join(salts), "<u8").astype(_U)[named.indices.to_numpy()] if salts else np.zeros(0, _U)
        self.shift = _U(64 - bits)
        count = len(words.start)
        inverse = _powers(pow(_WORD_BASE, -1, 1 << 64), count + 1)
        power = _powers(_WORD_BASE, count + 1)
        self.inverse, self.sums = inverse, []
        for values in (words.hash, words.check):
            sums = np.zeros(count + 1, _U)
            np.cumsum(values * power[:count], out=sums[1:])
            self.sums.append(sums)

    def places(self, size: int) -> np.ndarray:
        """Words at which an n-gram of ``size`` words begins."""
        piece = self.words.piece
        return np.flatnonzero(piece[: max(0, len(piece) - size + 1)] == piece[size - 1 :])

    def of(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        own = self.lang[self.words.row[at]] + _U(size)
        both = [(s[at + size] - s[at]) * self.inverse[at] for s in self.sums]
        return mix(mix(own) ^ both[0]) >> self.shift, mix(mix(own) + both[1])


def keyed(docs: DataFrame, id_column: str, text_column: str, lang_column: str) -> DataFrame:
    return docs.select(
        key_or_least(id_column).alias("doc"),
        F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )


def bit_table(found: DataFrame) -> bytes:
    """Bits of the fingerprints: about 16 for each, 2**TABLE_BITS at most, whatever their number. The driver gets only these."""
    rows = max(1, found.count())
    bits = min(TABLE_BITS, max(16, (16 * rows - 1).bit_length()))
    bit = F.shiftrightunsigned(F.xxhash64("fp"), 64 - bits)
    words = found.groupBy(F.shiftrightunsigned(bit, 6).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")
    )
    table = np.zeros(1 << (bits - 6), np.int64)
    got = words.toArrow()
    table[got["at"].to_numpy()] = got["bits"].to_numpy()
    return table.tobytes()


def _xxhash64(values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of long values with its default seed, on an array."""
    one, two, three, four, five = (
        _U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
    )  # fixed values of the hash

    def turn(x, by):
        return (x << _U(by)) | (x >> _U(64 - by))

    with np.errstate(over="ignore"):
        out = _U(42) + five + _U(8)
        out = out ^ (turn(values * two, 31) * one)
        out = turn(out, 27) * one + four
        out = (out ^ (out >> _U(33))) * two
        out = (out ^ (out >> _U(29))) * three
        return out ^ (out >> _U(32))


def _among(table: bytes, fingerprints: np.ndarray) -> np.ndarray:
    bytes_ = np.frombuffer(table, np.uint8)
    bits = (8 * len(table)).bit_length() - 1
    at = (_xxhash64(fingerprints) >> _U(64 - bits)).astype(np.int64)
    return (bytes_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def counted(docs: DataFrame, size: int, below: bytes | None, bits: int = 64) -> DataFrame:
    """Per batch and fingerprint of ``size`` words: fp, checked, n, doc, at. For single words also the empty phrase of each
    language (at -1), whose count is that of all words."""
    shared = docs.sparkSession.sparkContext.broadcast(below)  # at most 2**TABLE_BITS bits

    def run(batches):
        for batch in parts(batches, "text", PART_BYTES):
            grams = Grams(batch.column("text"), batch.column("lang"), bits)
            doc, words = batch.column("doc").to_numpy(), grams.words
            at = grams.places(size)
            if shared.value is not None:
                starts = grams.places(size - 1)
                usable = np.zeros(len(words.start) + 1, bool)
                usable[starts] = _among(shared.value, grams.of(starts, size - 1)[0])
                at = at[usable[at] & usable[at + 1]]
            fp, check = grams.of(at, size)
            checked = (check >> _U(33)).astype(np.int32)
            order = np.argsort(fp, kind="stable")
            fp, checked, at = fp[order], checked[order], at[order]
            fresh = np.ones(len(fp), bool)
            fresh[1:] = (fp[1:] != fp[:-1]) | (checked[1:] != checked[:-1])
            head = np.flatnonzero(fresh)
            n = np.diff(np.append(head, len(fp)))
            row = words.row[at[head]]
            place = at[head] - words.row_ptr[row]
            if size == 1:
                own = np.diff(words.row_ptr)
                kinds, first, which = np.unique(grams.lang, return_index=True, return_inverse=True)
                fp = np.append(fp[head], mix(kinds) >> grams.shift)
                checked = np.append(checked[head], np.full(len(kinds), -1, np.int32))  # that of no other phrase
                n = np.append(n, np.bincount(which, own, len(kinds)).astype(np.int64))
                row, place = np.append(row, first), np.append(place, np.full(len(kinds), -1))
            else:
                fp, checked = fp[head], checked[head]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp.view(np.int64)), pa.array(checked), pa.array(n), pa.array(doc[row]), pa.array(place.astype(np.int32))],
                ["fp", "checked", "n", "doc", "at"],
            )

    return docs.mapInArrow(run, "fp long, checked int, n long, doc long, at int")


def frequent(rows: DataFrame, least: int) -> DataFrame:
    """Fingerprints counted ``least`` times: fp, f, doc and at (one occurrence), alike (all check values are one)."""
    found = rows.groupBy("fp").agg(
        F.sum("n").alias("f"), F.first("doc").alias("doc"), F.first("at").alias("at"),
        F.min("checked").alias("low"), F.max("checked").alias("high"),
    ).filter(F.col("f") >= least)
    return found.select("fp", "f", "doc", "at", (F.col("low") == F.col("high")).alias("alike"))


def phrases_at(docs: DataFrame, found: DataFrame, bits: int = 64) -> DataFrame:
    """lang, size, phrase and f of the fingerprints in ``found`` (fp, f, doc, at, size), read from the text at their pointers."""
    pointers = stage(
        found.groupBy("doc").agg(F.collect_list(F.struct("fp", "f", "at", "size")).alias("wanted")), "pointers"
    )  # at most as many in a row as the document has phrases

    def run(batches):
        for batch in parts(batches, "text", PART_BYTES):
            grams = Grams(batch.column("text"), batch.column("lang"), bits)
            ptr, wanted = grams.words.row_ptr, batch.column("wanted")
            row = np.repeat(np.arange(len(batch)), wanted.value_lengths().to_numpy())
            fp, f, at, size = (wanted.flatten().field(c).to_numpy() for c in ("fp", "f", "at", "size"))
            # A row that repeats the id with another text may be shorter, or have other words there.
            start, size = ptr[row] + np.maximum(at, 0), np.where(at < 0, 0, size)
            fits = start + size <= ptr[row + 1]
            for k in np.unique(size[fits]):
                mine = np.flatnonzero(fits & (size == k))
                got = grams.of(start[mine], int(k))[0] if k else mix(grams.lang[row[mine]]) >> grams.shift
                fits[mine] = got.view(np.int64) == fp[mine]
            hit = np.flatnonzero(fits)
            full = hit[size[hit] > 0]
            phrases = np.full(len(fp), b"", object)
            phrases[full] = grams.words.phrases(start[full], size[full])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").take(pa.array(row[hit])), pa.array(fp[hit]), pa.array(size[hit].astype(np.int32)),
                    pa.array(phrases[hit].tolist(), pa.binary()), pa.array(f[hit]),
                ],
                ["lang", "fp", "size", "phrase", "f"],
            )

    joined = docs.filter(id_filter(pointers, "doc")(F.col("doc"))).join(pointers, "doc")
    read = joined.select("lang", "text", "wanted").mapInArrow(run, "lang string, fp long, size int, phrase binary, f long")
    read = read.withColumn("phrase", F.col("phrase").cast("string"))
    return read.groupBy("size", "fp").agg(  # rows that repeat an id read the same phrase again
        F.min("lang").alias("lang"), F.min("phrase").alias("phrase"), F.min("f").alias("f")
    ).select("lang", "size", "phrase", "f")


def recounted(docs: DataFrame, mixed: DataFrame, sizes: list[int], least: int, bits: int = 64) -> DataFrame:
    """lang, size, phrase and f of the phrases behind the fingerprints ``mixed`` (fp, size), counted by their words."""
    tables = {size: bit_table(mixed.filter(F.col("size") == size)) for size in sizes}
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        for batch in parts(batches, "text", PART_BYTES):
            grams = Grams(batch.column("text"), batch.column("lang"), bits)
            words, langs, seen = grams.words, batch.column("lang").to_pylist(), {}
            for size, table in shared.value.items():
                at = grams.places(size)
                fp = grams.of(at, size)[0]
                hit = _among(table, fp)
                found = words.phrases(at[hit], np.full(len(at[hit]), size))
                for phrase, value, row in zip(found, fp[hit].view(np.int64).tolist(), words.row[at[hit]], strict=True):
                    key = (langs[row], size, value, phrase)
                    seen[key] = seen.get(key, 0) + 1
            if 1 in shared.value:
                salts = (mix(grams.lang) >> grams.shift).view(np.int64).tolist()
                for k, n in enumerate(np.diff(words.row_ptr).tolist()):
                    key = (langs[k], 0, salts[k], b"")
                    seen[key] = seen.get(key, 0) + n
            rows = [(*key, n) for key, n in seen.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(5)]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "size", "fp", "phrase", "n"]
            )

    rows = docs.mapInArrow(run, "lang string, size int, fp long, phrase binary, n long")
    # A single-word fingerprint may share its value with an empty phrase, so both sizes are looked up under 1.
    wanted = mixed.select(F.col("size").alias("_size"), F.col("fp").alias("_fp")).distinct()
    level = F.greatest("size", F.lit(1))
    exact = rows.join(wanted, (rows["fp"] == wanted["_fp"]) & (level == wanted["_size"]), "left_semi")
    return (
        exact.groupBy("lang", "size", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))
        .filter(F.col("f") >= least)
    )


def frequent_phrases(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST_COUNT,
    bits: int = 64,
) -> DataFrame:
    """lang, size, phrase, f: all phrases of 1 to ``longest`` words that stand at least ``least`` times in a language.

    The phrase of no words counts all words of the language. The returned table is staged.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_column, text_column, lang_column)
    below, found = None, None
    for size in range(1, longest + 1):
        level = stage(frequent(counted(rows, size, below, bits), least), f"grams-{size}").withColumn("size", F.lit(size))
        below = bit_table(level) if size < longest else None
        found = level if found is None else found.union(level)
    # The size of an empty phrase is 0 from its pointer.
    out = phrases_at(rows, found.filter("alike").withColumn("size", F.when(F.col("at") < 0, 0).otherwise(F.col("size"))), bits)
    mixed = stage(found.filter("NOT alike").select("size", "fp"), "mixed")
    sizes = sorted(r["size"] for r in mixed.select("size").distinct().collect())  # at most ``longest``
    if sizes:
        out = out.union(recounted(rows, mixed, sizes, least, bits).select("lang", "size", "phrase", "f"))
    return stage(out, "phrases")


def collocations(phrases: DataFrame, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The ``top`` candidates of each language: lang, rank, phrase, a, l, r, n, score."""
    named = phrases.filter("size > 0").select("lang", "phrase", "f")
    totals = phrases.filter("size = 0").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")

    def run(begin, count):
        return F.array_join(F.slice(words, begin, count), " ")

    found = phrases.filter("size >= 2")
    cuts = found.select(
        "lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).withColumns({"first": run(F.lit(1), F.col("k")), "rest": run(F.col("k") + 1, F.col("size") - F.col("k"))})
    left = named.select(F.col("lang"), F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = named.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = "decimal(14,0)"  # counts below 10**14: products stay within 38 digits
    a, left_f, right_f = (F.col(c).cast(exact) for c in ("a", "l", "r"))
    above, beneath = F.lit(1_000_000).cast("decimal(7,0)") * a * a, left_f * right_f
    scored = (
        cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
        .withColumns({"_above": above, "_beneath": beneath}).withColumn("score", F.expr("_above div _beneath"))
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    longer = found.filter("size >= 3").select("lang", "phrase", "f", "size")
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda count: F.transform(F.sequence(F.lit(1), F.col("size") - count + 1), lambda begin: run(begin, count)),
    ))
    inside = longer.select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = kept.withColumn("_place", F.row_number().over(part)).filter(F.col("_place") <= top).drop("_place")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
