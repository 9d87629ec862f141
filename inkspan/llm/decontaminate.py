"""Passages of test items in documents, by pigeonhole edit matching over words.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased; punctuation does not count.
An item of ``n`` words may differ in ``e = floor(rate * n)`` words (substituted, missing or added).
It is split into ``e + 1`` pieces: at most ``e`` edits leave one piece intact, so looking for exact
pieces loses nothing. Places where pieces of an item stand are joined to stretches of words where they overlap, and
each stretch is verified with Myers' bit-parallel distance.

Pieces are found in one pass over the texts with a bit table of fixed size that lets through every
true piece and few others; a join on the piece's hash decides, and one on the item brings its words to
the stretches. Items are never collected.

Defined cases: null texts, and items without words, match nothing. Repeated rows give the same links
once. Ids are integers. A null document id is a document of its own, a null item id an item of its own. Rows that repeat
a document id are judged each by its own text; links carry the id. Rows that repeat an item id are patterns of one
item. Documents may carry further columns of any name; they are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.frames import bounded_batches, fresh_name, id_filter, key_or_least, stage, text_tag
from inkspan.llm.wordhash import NOT_ALNUM, char_index, grams, mix, words_of

RATE = 0.15
BITS = 24  # of the bit table: 2 MB

def budget(n_words: np.ndarray | int, rate: float) -> np.ndarray | int:
    return np.floor(np.asarray(n_words) * rate + 1e-9).astype(int)


def split_points(n_words: int, parts: int) -> list[int]:
    """Word offsets of ``parts`` pieces whose lengths differ by one at most, and the end."""
    return [n_words * k // parts for k in range(parts + 1)]


def _piece_hash(gram: np.ndarray, length: int) -> np.ndarray:
    return mix(gram + np.uint64(length))


def _keyed(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return items.select(key_or_least(id_column).alias("item"), F.col(text_column).cast("string").alias("text"))


def pieces(items: DataFrame, id_column: str, text_column: str, rate: float = RATE) -> DataFrame:
    """One row per piece: piece (hash), length, item, offset, budget and size (words of the item)."""
    bounded_batches(items.sparkSession)

    def run(batches):
        for batch in batches:
            words = words_of(batch.column("text"), NOT_ALNUM)
            rows = []
            for item, a, b in zip(batch.column("item").to_pylist(), words.row_ptr, words.row_ptr[1:], strict=False):
                if a == b:
                    continue
                own, edits = words.hash[a:b], int(budget(b - a, rate))
                cuts = split_points(int(b - a), edits + 1)
                for start, end in zip(cuts, cuts[1:], strict=False):
                    piece = int(_piece_hash(grams(own[start:end], end - start), end - start).view(np.int64)[0])
                    rows.append((piece, end - start, item, start, edits, int(b - a)))
            names = ["piece", "length", "item", "offset", "budget", "size"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    keyed = _keyed(items, id_column, text_column)
    return keyed.mapInArrow(run, "piece long, length int, item long, offset int, budget int, size int")


def patterns(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """item and words (hashes), without repeats."""
    bounded_batches(items.sparkSession)

    def run(batches):
        for batch in batches:
            words = words_of(batch.column("text"), NOT_ALNUM)
            listed = pa.ListArray.from_arrays(pa.array(words.row_ptr.astype(np.int32)), pa.array(words.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item"), listed], ["item", "words"])

    return _keyed(items, id_column, text_column).mapInArrow(run, "item long, words array<long>").distinct()


def bit_table(found: DataFrame) -> bytes:
    """Bits of all pieces' hashes: 2**BITS, whatever their number. Made by an aggregate of at most 2**(BITS - 6) rows."""
    bit = F.shiftrightunsigned("piece", 64 - BITS)
    words = found.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")
    )
    table = np.zeros(1 << (BITS - 6), np.int64)
    rows = words.toArrow()
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return table.tobytes()


def piece_hits(docs: DataFrame, table: bytes, lengths: list[int]) -> DataFrame:
    """Places that may hold a piece: piece, doc, tag, pos (in words). Needs columns doc, tag and text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            words = words_of(batch.column("text"), NOT_ALNUM)
            ids, tags, row = batch.column("doc").to_numpy(), batch.column("tag").to_numpy(), words.row
            for length in lengths:
                seeds = _piece_hash(grams(words.hash, length), length)
                at = (seeds >> np.uint64(64 - BITS)).astype(np.int64)
                hit = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                hit = hit[row[hit] == row[hit + length - 1]]
                if len(hit):
                    of = row[hit]
                    pos = (hit - words.row_ptr[of]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seeds[hit].view(np.int64)), pa.array(ids[of]), pa.array(tags[of]), pa.array(pos)],
                        ["piece", "doc", "tag", "pos"],
                    )

    return docs.mapInArrow(run, "piece long, doc long, tag long, pos int")


def myers(pattern: list[int], text: list[int], anchored: bool = False) -> list[int]:
    """Edit distance of ``pattern`` to the best run of ``text`` ending at each place.

    The bit vectors are integers as long as the pattern. ``anchored``: to the whole text up to there.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for k, symbol in enumerate(pattern):
        where[symbol] = where.get(symbol, 0) | 1 << k
    plus, minus, score, out = full, 0, m, []
    for symbol in text:
        eq = where.get(symbol, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | anchored) & full
        down = down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        out.append(score)
    return out


def best_place(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """Least distance and the first run of words (start, end) that has it."""
    scores = myers(pattern, text)
    distance = min(scores)
    end = scores.index(distance) + 1
    back = myers(pattern[::-1], text[:end][::-1], anchored=True)
    length = back.index(distance) + 1 if distance in back else 0
    return distance, end - length, end


def stretches(places: list[dict], total: int) -> list[tuple[int, int, int]]:
    """item, first and last word (exclusive) of what has to be verified in a text of ``total`` words.

    A place needs the words an item there may cover; overlapping stretches of an item are joined.
    """
    found = []
    for place in sorted(places, key=lambda p: (p["item"], p["at"] - p["budget"])):
        low = max(0, place["at"] - place["budget"])
        high = min(total, place["at"] + place["size"] + place["budget"])
        if found and found[-1][0] == place["item"] and low <= found[-1][2]:
            found[-1] = (place["item"], found[-1][1], max(high, found[-1][2]))
        else:
            found.append((place["item"], low, high))
    return found


REGION = "doc long, tag long, item long, region array<long>, starts array<int>, ends array<int>"


def _regions(batches):
    """The words of each stretch with their places in code points. Rows come with doc, tag, text and places."""
    for batch in batches:
        words = words_of(batch.column("text"), NOT_ALNUM)
        chars = char_index(words.data, words.offsets)
        gaps = np.append(np.flatnonzero(NOT_ALNUM[words.data]), len(words.data))
        stop = np.minimum(gaps[np.searchsorted(gaps, words.start)], words.offsets[words.row + 1])
        keys = [batch.column(c).to_pylist() for c in ("doc", "tag", "places")]
        rows = []
        for k, (doc, tag, places) in enumerate(zip(*keys, strict=True)):
            a, base = words.row_ptr[k], chars[words.offsets[k]]
            for item, low, high in stretches(places, int(words.row_ptr[k + 1] - a)):
                part = slice(a + low, a + high)
                starts, ends = chars[words.start[part]] - base, chars[stop[part]] - base
                rows.append((doc, tag, item, words.hash[part].view(np.int64), starts.astype(np.int32), ends.astype(np.int32)))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["doc", "tag", "item", "region", "starts", "ends"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


FOUND = "doc long, tag long, item long, distance int, budget int, n_words int, start int, end int"


def _verify(rate: float):
    def run(batches):
        names = ["doc", "tag", "item", "distance", "budget", "n_words", "start", "end"]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                pattern, region = row["words"], row["region"]
                edits = int(budget(len(pattern), rate))
                if not pattern or len(region) < len(pattern) - edits:
                    continue
                distance, first, last = best_place(pattern, region)
                if distance <= edits and last > first:
                    place = row["starts"][first], row["ends"][last - 1]
                    rows.append((row["doc"], row["tag"], row["item"], distance, edits, len(pattern), *place))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _found(
    docs: DataFrame, items: DataFrame, id_column: str, text_column: str, item_column: str, item_text: str, rate: float
) -> DataFrame:
    """Every verified stretch: doc, tag (of the text), item, distance, budget, n_words, start, end."""
    bounded_batches(docs.sparkSession)
    split = stage(pieces(items, item_column, item_text, rate), "pieces")
    lengths = sorted(r[0] for r in split.select("length").distinct().collect())  # few: items of n words have two
    texts = docs.select(
        key_or_least(id_column).alias("doc"), text_tag(text_column).alias("tag"), F.col(text_column).cast("string").alias("text")
    )
    hits = piece_hits(texts, bit_table(split), lengths)
    places = (
        hits.join(split, "piece")
        .select("doc", "tag", "item", (F.col("pos") - F.col("offset")).alias("at"), "budget", "size")
        .groupBy("doc", "tag")
        .agg(F.collect_set(F.struct("item", "at", "budget", "size")).alias("places"))  # numbers only, of one text
    )
    # Staged, so that the join with the texts is planned with the real size of this side; texts without
    # a piece are mostly kept out of the join.
    places = stage(places, "places")
    wanted = texts.filter(id_filter(places, "doc")(F.col("doc"))).join(places, ["doc", "tag"])
    regions = wanted.select("doc", "tag", "text", "places").mapInArrow(_regions, REGION)
    told = patterns(items, item_column, item_text)
    return regions.join(stage(told, "patterns"), "item").mapInArrow(_verify(rate), FOUND)


def links(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
) -> DataFrame:
    """One row per document and item found in it: doc, item, distance, budget, n_words, start, end (code points).

    The place is the first with the least distance. The returned table is staged.
    """
    found = _found(docs, items, id_column, text_column, item_column, item_text, rate)
    one = found.groupBy("doc", "item").agg(
        F.min(F.struct("distance", "start", "end", "budget", "n_words")).alias("best")
    )
    named = one.select("doc", "item", "best.distance", "best.budget", "best.n_words", "best.start", "best.end")
    return stage(named, "links")


def clean(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
) -> DataFrame:
    """The documents that hold no item; of rows that repeat an id only those go whose own text holds one."""
    found = _found(docs, items, id_column, text_column, item_column, item_text, rate).select("doc", "tag").distinct()
    doc, tag = fresh_name(docs, "_doc"), fresh_name(docs, "_tag")
    found = stage(found, "holding").select(F.col("doc").alias(doc), F.col("tag").alias(tag))
    keyed = docs.withColumns({doc: key_or_least(id_column), tag: text_tag(text_column)})
    return keyed.join(found, [doc, tag], "left_anti").select(docs.columns)
