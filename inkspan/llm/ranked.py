"""Ranked lexical search over all documents by hashed max-sketches.

Terms are runs of digits, ASCII letters and non-ASCII characters, A-Z lower-cased. A term in a document has the impact
``(10**9 * tf) div (1000 * tf + 8 * m)``; a query's score of a document sums weight times impact over its terms.

A document's sketch folds its terms' impacts into ``WIDTH`` hashed coordinates and keeps the largest of each. A term's
impact is at most its coordinate's, so looking up a query's terms in the sketch gives an upper bound of the score.
For one document the impact grows with tf alone, so the sketch holds the largest tf of each coordinate that is
not zero, and one pass over the texts makes it, before lengths and counts of the whole corpus are known.

Queries are looked up in blocks of bounded size: a pass over the sketches gives each task's rows the bounds for all
queries of a block by array operations. Rescoring goes down the bounds: first the ``FIRST`` best bounds of each query are
scored exactly from the whole texts, which gives a threshold, the score of its k-th best; then every document whose bound
reaches the threshold is scored, so that none is missed however loose the bounds are. Documents of one text have equal
scores, so of equal texts only the k smallest ids can be in the result and the others are not scored.

Defined cases: null or empty texts, and those without terms, are not counted and not found. Rows that repeat an item
id are one item with the terms of all; a null item id is an item of its own. Rows that repeat a document id are
documents of their own; a null id comes before all others. Extra columns are not read. Documents without a common term
with an item, or with terms of no weight only, are not listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkspan.llm.frames import LEAST, bounded_batches, id_filter, key_or_least, stage
from inkspan.llm.wordhash import NOT_ALNUM, words_of

WIDTH = 1 << 14  # coordinates of a sketch
TOP = 10
FIRST = 32  # documents of each query scored for the threshold
BLOCK_TERMS = 1 << 16  # terms of the queries looked up in one pass, about
TABLE_BITS = 23  # of the bit table of query terms: 1 MB

_U = np.uint64


def _place(terms: np.ndarray, width: int) -> np.ndarray:
    """Coordinate of each term in a sketch of ``width`` (a power of 2, 2**16 at most): its hash's first bits."""
    return (terms >> _U(65 - width.bit_length())).astype(np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_factor(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """``100 - 90 + (90 * n * N) div L``; beyond 64 bits in Python's integers."""
    if 90 * int(np.max(n, initial=0)) * documents < 1 << 63:
        return 10 + 90 * n * documents // terms
    return 10 + np.array([90 * int(x) * documents // terms for x in n], np.int64)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(key_or_least(id_column).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, term and tf of the distinct terms of each row, in order; and the terms of each row with repeats."""
    words = words_of(texts, NOT_ALNUM)
    row = words.row
    order = np.lexsort((words.hash, row))
    row, term = row[order], words.hash[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    head = np.flatnonzero(fresh)
    return row[head], term[head], np.diff(np.append(head, len(row))), np.diff(words.row_ptr)


def _packed(values: np.ndarray, ptr: np.ndarray, kind: str) -> pa.Array:
    data = values.astype(kind)
    return pa.Array.from_buffers(
        pa.large_binary(), len(ptr) - 1, [None, pa.py_buffer((ptr * data.itemsize).astype(np.int64)), pa.py_buffer(data.tobytes())]
    ).cast(pa.binary())


def query_terms(items: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item and term (hash): the distinct terms of each item."""
    bounded_batches(items.sparkSession)

    def run(batches):
        for batch in batches:
            row, term, _, _ = _counted(batch.column("text"))
            ids = batch.column("item").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(term.view(np.int64))], ["item", "term"])

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = items.select(key_or_least(item_column).alias("item"), text.alias("text"))
    return keyed.mapInArrow(run, "item long, term long").distinct()


def term_table(terms: DataFrame) -> bytes:
    """2**TABLE_BITS bits of the query terms, whatever their number."""
    bit = F.shiftrightunsigned("term", 64 - TABLE_BITS)
    words = terms.groupBy(F.shiftrightunsigned(bit, 6).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")
    )
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    got = words.toArrow()
    table[got["at"].to_numpy()] = got["bits"].to_numpy()
    return table.tobytes()


SKETCH = "doc long, tag long, n long, places binary, tfs binary, terms array<long>, dfs array<long>"


def sketch(texts: DataFrame, table: bytes, width: int = WIDTH) -> DataFrame:
    """One row per document with terms: doc, tag, n and the sketch (places, tfs).

    Besides, one row per batch with n 0: query terms of its documents (by ``table``, so a few others too) and in how
    many documents of the batch each stands.
    """
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            row, term, tf, total = _counted(batch.column("text"))
            spot = _place(term, width)
            # Largest tf of each (row, coordinate); terms are in order of their hash, hence of coordinates as well.
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (spot[1:] != spot[:-1])
            head = np.flatnonzero(fresh)
            most = np.maximum.reduceat(tf, head) if len(head) else tf
            some = np.flatnonzero(total)
            ptr = np.concatenate([[0], np.cumsum(np.bincount(row[head], minlength=len(batch))[some])])
            at = (term >> _U(64 - TABLE_BITS)).astype(np.int64)
            asked, dfs = np.unique(term[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1], return_counts=True)
            doc, tag = batch.column("doc").to_numpy()[some], batch.column("tag").to_numpy()[some]
            kind, none = pa.list_(pa.int64()), pa.nulls(len(some), pa.list_(pa.int64()))
            names = ["doc", "tag", "n", "places", "tfs", "terms", "dfs"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc), pa.array(tag), pa.array(total[some].astype(np.int64)),
                    _packed(spot[head], ptr, "<u2"), _packed(most, ptr, "<u4"), none, none,
                ],
                names,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0]), pa.array([0]), pa.array([0]), pa.array([b""]), pa.array([b""]),
                    pa.array([asked.view(np.int64)], kind), pa.array([dfs], kind),
                ],
                names,
            )

    return texts.mapInArrow(run, SKETCH)


class Block:
    """The queries looked up in one pass: items, their terms with weights, and the same by coordinate."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, width: int = WIDTH) -> None:
        order = np.lexsort((term, item))
        item, self.term, self.weight = item[order], term[order], weight[order]
        self.items, first = np.unique(item, return_index=True)
        self.ptr = np.append(first, len(item))
        spot = _place(self.term, width)
        used = np.unique(spot)
        self.column = np.full(width, -1, np.int64)
        self.column[used] = np.arange(len(used))
        self.width = len(used)
        self.columns = self.column[spot]

    def bounds(self, row: np.ndarray, spot: np.ndarray, impacts: np.ndarray, rows: int):
        """For each query (number, upper bounds of ``rows`` documents)."""
        column = self.column[spot]
        asked = column >= 0
        table = np.zeros((self.width, rows))
        table[column[asked], row[asked]] = impacts[asked]
        for k in range(len(self.items)):
            part = slice(self.ptr[k], self.ptr[k + 1])
            yield k, self.weight[part].astype(float) @ table[self.columns[part]]


def _binary(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed rows, and where each row begins."""
    _, ptr, data = column.buffers()
    size = np.dtype(kind).itemsize
    at = np.frombuffer(ptr, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, kind, (at[-1] - at[0]) // size, at[0]) if at[-1] > at[0] else np.zeros(0, kind)
    return values.astype(np.int64), (at - at[0]) // size


PAIR = "query int, bound long, doc long, tag long"


def looked_up(
    sketches: DataFrame, block: Block, documents: int, terms: int, first: int = FIRST, floor: list | None = None
) -> DataFrame:
    """query (its number in the block), bound, doc and tag of documents with a bound above 0.

    Without ``floor``, of each query and task the ``first`` best. With it, a score and document id for each query, all that may come
    before these: with a larger bound, or the same and a smaller id.
    """
    shared = sketches.sparkSession.sparkContext.broadcast((block, floor))  # at most a block of queries

    def rows_of(found):
        parts = [[np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)]] if found else []
        query, bound, doc, tag = parts[0] if parts else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(bound.astype(np.int64)), pa.array(doc), pa.array(tag)],
            ["query", "bound", "doc", "tag"],
        )

    def run(batches):
        block, floor = shared.value
        step = max(64, (1 << 22) // max(1, block.width))  # documents at once: a table of 32 MB
        best: dict[int, list[np.ndarray]] = {}
        for whole in batches:
            for begin in range(0, len(whole), step):
                batch = whole.slice(begin, step)
                spot, ptr = _binary(batch.column("places"), "<u2")
                tf, _ = _binary(batch.column("tfs"), "<u4")
                row = np.repeat(np.arange(len(batch)), np.diff(ptr))
                m = length_factor(batch.column("n").to_numpy(), documents, terms)
                doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
                found = []
                for k, bound in block.bounds(row, spot, impact(tf, m[row]), len(batch)):
                    if floor is not None:
                        least, last = floor[k]
                        hit = np.flatnonzero((bound > least) | (bound == least) & (doc < last) & (bound > 0))
                        found.append((np.full(len(hit), k), bound[hit], doc[hit], tag[hit]))
                        continue
                    held = best.get(k)
                    least = held[0][-1] if held is not None and len(held[0]) == first else 1
                    hit = np.flatnonzero(bound >= least)
                    if len(hit):
                        own = [bound[hit], doc[hit], tag[hit]]
                        joined = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
                        order = np.lexsort((joined[2], joined[1], -joined[0]))[:first]
                        best[k] = [x[order] for x in joined]
                if found:
                    yield rows_of(found)
        if floor is None:
            yield rows_of([(np.full(len(x[0]), k), *x) for k, x in best.items()])

    return sketches.select("n", "doc", "tag", "places", "tfs").filter("n > 0").mapInArrow(run, PAIR)


def rescored(texts: DataFrame, pairs: DataFrame, block: Block, documents: int, terms: int) -> DataFrame:
    """query, doc, tag and score, from the whole texts, of the pairs (query, doc, tag) with a score above 0."""
    shared = texts.sparkSession.sparkContext.broadcast(block)  # at most a block of queries
    wanted = stage(pairs.groupBy("doc", "tag").agg(F.collect_set("query").alias("queries")), "wanted")

    def run(batches):
        block = shared.value
        for batch in batches:
            row, term, tf, total = _counted(batch.column("text"))
            ptr = np.searchsorted(row, np.arange(len(batch) + 1))
            m = length_factor(total, documents, terms)
            doc, tag = batch.column("doc").to_pylist(), batch.column("tag").to_pylist()
            rows = []
            for k, queries in enumerate(batch.column("queries").to_pylist()):
                own = term[ptr[k] : ptr[k + 1]]
                worth = impact(tf[ptr[k] : ptr[k + 1]].astype(np.int64), m[k])
                for query in queries:
                    part = slice(block.ptr[query], block.ptr[query + 1])
                    at = np.searchsorted(own, block.term[part])
                    has = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == block.term[part])
                    score = int((block.weight[part][has] * worth[at[has]]).sum())
                    if score > 0:
                        rows.append((query, doc[k], tag[k], score))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(4)]
            kinds = [pa.int32(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query", "doc", "tag", "score"]
            )

    joined = texts.filter(id_filter(wanted, "doc")(F.col("doc"))).join(wanted, ["doc", "tag"])
    return stage(joined.mapInArrow(run, "query int, doc long, tag long, score long"), "rescored")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _block_results(
    texts: DataFrame, sketches: DataFrame, block: Block, documents: int, terms: int, top: int, first: int
) -> DataFrame:
    """item, rank, doc and score of the queries of one block."""
    spark = texts.sparkSession
    best = Window.partitionBy("query").orderBy(F.desc("bound"), F.asc("doc"), F.asc("tag"))
    found = looked_up(sketches, block, documents, terms, first).distinct()
    found = stage(found.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= first), "first")
    scored = rescored(texts, found.select("query", "doc", "tag"), block, documents, terms)
    floor = [(0, 0)] * len(block.items)
    for row in _ranked(scored, top).filter(F.col("rank") == top).select("query", "score", "doc").collect():
        floor[row["query"]] = (row["score"], row["doc"])  # one row for each query of the block
    # Of equal texts (one tag, hence one bound) only the smallest ids can be in the result.
    alike = Window.partitionBy("query", "tag", "bound").orderBy("doc")
    rest = looked_up(sketches, block, documents, terms, first, floor).distinct()
    rest = rest.withColumn("_place", F.row_number().over(alike)).filter(F.col("_place") <= top)
    rest = rest.join(found.select("query", "doc", "tag"), ["query", "doc", "tag"], "left_anti")
    scored = scored.union(rescored(texts, rest.select("query", "doc", "tag"), block, documents, terms))
    names = spark.createDataFrame(
        [(k, int(item)) for k, item in enumerate(block.items)], "query int, item long"
    )  # the items of the block
    return _ranked(scored, top).join(names, "query").select("item", "rank", "doc", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_terms: int = BLOCK_TERMS,
    width: int = WIDTH,
    first: int = FIRST,
) -> DataFrame:
    """item, rank, doc and score: the ``top`` documents of each item by score, equal scores by id."""
    spark = bounded_batches(docs.sparkSession)
    texts = _texts(docs, id_column, text_column)
    asked = stage(query_terms(items, item_column, item_text), "query-terms")
    sketches = stage(sketch(texts, term_table(asked), width), "sketches")
    totals = sketches.filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = totals["documents"], totals["terms"] or 0
    found_in = sketches.filter("n = 0").select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
    found_in = found_in.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    ratio = F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1)
    weighted = asked.join(found_in, "term").withColumn("weight", F.floor(1000 * F.log(ratio)).cast("long"))
    weighted = stage(weighted.filter("weight > 0"), "query-weights")
    blocks = max(1, math.ceil(weighted.count() / block_terms))
    dealt = weighted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    out = None
    for k in range(blocks):  # blocks of the stated query set; each meets all documents in one pass
        rows = dealt.filter(F.col("block") == k).select("item", "term", "weight").toArrow()
        columns = [rows[c].to_numpy() for c in ("item", "term", "weight")]
        if not len(rows):
            continue
        block = Block(columns[0], columns[1].astype(np.int64).view(_U), columns[2], width)
        part = stage(_block_results(texts, sketches, block, documents, terms, top, first), "ranked")
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], "item long, rank int, doc long, score long") if out is None else out


def plain_id(name: str) -> Column:
    return F.when(F.col(name) != LEAST, F.col(name))
