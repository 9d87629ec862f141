"""Near duplicates by MinHash bands with sequential Bayesian verification.

A document's set are its distinct word shingles; two documents are linked when the Jaccard similarity of
their sets reaches the threshold. Signatures of ``BANDS * ROWS`` minima are cut into bands; documents
that agree in a band are candidates. A candidate's signatures are compared in batches: after each
batch the pair is dropped if, given the agreements so far and a uniform prior, the posterior
probability that its similarity reaches the threshold is below ``MISS``. Survivors are verified on
their full sets. A pair at similarity 0.8 shares no band with probability 3e-6.

No group is expanded into all pairs. Members of a bucket are compared with its smallest member first
and the links contracted to components. Only buckets
that then still hold several components are looked at again: each member outside the bucket's largest
component is compared, signature by signature in blocks, with all members of other components. There
a second test without error drops more: shingles fall into ``CELLS`` cells, and two sets share at most
the sum of the smaller counts of each cell. The
likeliest pair of a member and a component is verified first, and all others of components that are
still apart at last, so no link between components is lost.

Defined cases: a null text, or one without words, has an empty set, links with nothing and is kept.
With fewer words than a shingle has, the whole sequence is one shingle. Repeated rows of one id are
one node, linked by what any of them links; equal texts with different ids are linked. A null id is
one node below all others. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.components import components
from inkspan.llm.frames import LEAST, bounded_batches, id_filter, key_or_least, pack, stage
from inkspan.llm.wordhash import BLANKS, grams, mix, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
CELLS = 1024  # one byte each
BATCH = 32  # minima compared before each look at the posterior
MISS = 1e-4
BLOCK = 512  # members compared at once
SLOT = 512  # members verified against one document in one task
CHUNK = 1 << 16

_U = np.uint64
_FACTORS = np.random.default_rng(94_021).integers(0, 1 << 63, MINIMA, dtype=_U) * _U(2) + _U(1)


def least_matches(threshold: float, miss: float = MISS, minima: int = MINIMA, batch: int = BATCH) -> dict[int, int]:
    """For each number of minima compared, the agreements a pair needs to be looked at further.

    One byte of each minimum is compared, so unlike minima agree once in 256.
    """
    similarity = np.linspace(0, 1, 4001)
    agree = similarity + (1 - similarity) / 256
    over = similarity >= threshold - 1e-12
    needed = {}
    for n in [*range(batch, minima, batch), minima]:
        for m in range(n + 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                weight = m * np.log(agree) + np.where(agree < 1, (n - m) * np.log1p(-agree), 0 if m == n else -np.inf)
            weight = np.exp(weight - weight.max())
            if weight[over].sum() >= miss * weight.sum():
                needed[n] = m
                break
    return needed


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted set of hashed shingles of each text."""
    words = words_of(texts, BLANKS)
    runs = grams(words.hash, shingle)
    out = []
    for a, b in zip(words.row_ptr, words.row_ptr[1:], strict=False):
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        else:
            own = grams(words.hash[a:b], b - a) if b > a else np.zeros(0, _U)
            out.append(mix(own + _U(b - a)))  # apart from full shingles
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima (documents x MINIMA) of sets that aren't empty."""
    out = np.empty((len(sets), len(_FACTORS)), _U)
    at = 0
    while at < len(sets):
        stop, total = at, 0
        while stop < len(sets) and (stop == at or total + len(sets[stop]) <= CHUNK):
            total += len(sets[stop])
            stop += 1
        joined = np.concatenate(sets[at:stop])
        ptr = np.cumsum([0, *[len(s) for s in sets[at : stop - 1]]])
        for k, factor in enumerate(_FACTORS):
            out[at:stop, k] = np.minimum.reduceat(joined * factor, ptr)
        at = stop
    return out


def _band_keys(minima: np.ndarray) -> np.ndarray:
    parts = mix(minima).reshape(len(minima), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=_U), parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc, n (set size), bands (keys), signature (a byte of each minimum) and cells. Needs columns doc and text."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), shingle)
            full = [s for s in sets if len(s)]
            minima = signatures(full) if full else np.zeros((0, len(_FACTORS)), _U)
            small = (mix(minima + _U(1)) & _U(255)).astype(np.uint8)
            keys = _band_keys(minima).view(np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            ends = np.cumsum(size > 0)
            bands = pa.ListArray.from_arrays(
                pa.array(np.append(0, ends * BANDS).astype(np.int32)), pa.array(keys.ravel())
            )
            rows = [small[e - 1].tobytes() if n else b"" for n, e in zip(size, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(size), bands, pack(rows), pack(cells_of(s) for s in sets)],
                ["doc", "n", "bands", "signature", "cells"],
            )

    return docs.mapInArrow(run, "doc long, n long, bands array<long>, signature binary, cells binary")


def cells_of(members: np.ndarray) -> bytes:
    """How many shingles fall into each cell. A set that overfills one counts as filling all."""
    count = np.bincount((members & _U(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return (count if count.max() <= 255 else np.full(CELLS, 255)).astype(np.uint8).tobytes()


def most_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Upper bounds of the shingles shared by aligned rows of cells (of sets of up to 255 * CELLS)."""
    return np.minimum(left, right).sum(axis=1, dtype=np.int64)


def _matrix(column) -> np.ndarray:
    """Signatures of one length as rows."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(len(column), -1)


def may_reach(left: np.ndarray, right: np.ndarray, needed: dict[int, int]) -> np.ndarray:
    """Which of the aligned signature rows survive all batches."""
    alive, agreed = np.arange(len(left)), np.zeros(len(left), np.int32)
    begin = 0
    for n, least in needed.items():
        agreed[alive] += (left[alive, begin:n] == right[alive, begin:n]).sum(axis=1, dtype=np.int32)
        alive = alive[agreed[alive] >= least]
        begin = n
    return alive


def prune(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the threshold."""
    needed = least_matches(threshold)
    slim = sketch.select("doc", "n", "signature")
    left = slim.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    right = slim.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").filter(_sizes_allow("na", "nb", threshold))

    def run(batches):
        for batch in batches:
            if len(batch):
                alive = may_reach(_matrix(batch.column("sa")), _matrix(batch.column("sb")), needed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(alive)) for c in ("a", "b")], ["a", "b"]
                )

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sizes_allow(a: str, b: str, threshold: float):
    percent = round(threshold * 100)
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b; a staged table) whose full sets reach the threshold.

    The texts of all ``b`` meet the text of their ``a`` in a group; the groups of an ``a`` with many
    partners are split into slots, and the text of ``a`` goes to each of them.
    """
    percent = round(threshold * 100)
    slots = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLOT).alias("slots"))
    placed = pairs.join(slots, "a").withColumn("slot", F.pmod(F.xxhash64("b"), F.col("slots")))
    wanted = placed.select(F.col("b").alias("doc"), "a", "slot", F.lit(1).alias("role")).union(
        slots.select(F.col("a").alias("doc"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)), F.lit(0))
    )
    # Staged, so that the join with the texts is planned with the real size of this side; texts that
    # aren't wanted are mostly kept out of the join.
    wanted = stage(wanted, "wanted")
    gathered = (
        texts.filter(id_filter(wanted, "doc")(F.col("doc"))).join(wanted, "doc")
        .repartition("a", "slot")
        .sortWithinPartitions("a", "slot", "role")
        .select("a", "slot", "role", "doc", "text")
    )

    def run(batches):
        group, heads = None, []
        for batch in batches:
            sets = shingle_sets(batch.column("text"), shingle)
            found = []
            keys = zip(*[batch.column(c).to_pylist() for c in ("a", "slot", "role", "doc")], strict=True)
            for own, (a, slot, role, doc) in zip(sets, keys, strict=True):
                if (a, slot) != group:
                    group, heads = (a, slot), []
                if role == 0:
                    heads.append(own)  # several only if rows of one id differ
                elif any(_reaches(own, head, percent) for head in heads):
                    found.append((a, doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"]
            )

    return gathered.mapInArrow(run, "a long, b long")


def _reaches(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    union = len(left) + len(right) - both
    return union > 0 and 100 * both >= percent * union


def _labelled(rows: DataFrame, column: str, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of ``column``; a node without links is its own."""
    return (
        rows.join(found.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left")
        .withColumn(name, F.coalesce(name, column))
    )


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs between different components, with them: a, b, ca, cb."""
    return _labelled(_labelled(pairs, "a", found, "ca"), "b", found, "cb").filter("ca <> cb")


def residual_pairs(members: DataFrame, found: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """Pairs that may reach the threshold in buckets holding several components: home, other, part, share.

    ``part`` is the component of ``other``, ``share`` bounds the similarity.

    ``members``: key, doc. Each member outside the largest component of its bucket is dealt to a block
    of its bucket; every member passes by every block of its bucket and is compared with the block's
    members of other components.
    """
    placed = _labelled(members, "doc", found, "component")
    counted = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    largest = counted.groupBy("key").agg(
        F.max_by("component", F.struct("size", -F.col("component"))).alias("largest"),
        F.count("*").alias("kinds"),
        F.sum("size").alias("total"),
        F.max("size").alias("most"),
    )
    open_keys = stage(
        largest.filter("kinds > 1").select("key", "largest", F.ceil((F.col("total") - F.col("most")) / BLOCK).alias("blocks")),
        "open",
    )
    if open_keys.isEmpty():
        return members.sparkSession.createDataFrame([], RESIDUAL)
    rows = placed.join(open_keys, "key").join(sketch.select("doc", "n", "signature", "cells"), "doc")
    home = rows.filter("component <> largest").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    passing = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["key", "block", "role", "doc", "component", "n", "signature", "cells"]
    dealt = (
        home.withColumn("role", F.lit(0)).select(columns)
        .union(passing.withColumn("role", F.lit(1)).select(columns))
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", "role")
    )
    needed, percent = least_matches(threshold), round(threshold * 100)

    def run(batches):
        group, block, ready = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), strict=True))
            role = batch.column("role").to_numpy()
            docs, parts, sizes = (batch.column(c).to_numpy() for c in ("doc", "component", "n"))
            shapes, filled = _matrix(batch.column("signature")), _matrix(batch.column("cells"))
            at, found = 0, []
            while at < len(keys):
                if keys[at] != group:
                    group, block, ready = keys[at], [], None
                end = at + 1
                while end < len(keys) and keys[end] == group and role[end] == role[at]:
                    end += 1
                piece = (docs[at:end], parts[at:end], sizes[at:end], shapes[at:end], filled[at:end])
                if role[at] == 0:
                    block.append(piece)
                else:
                    if ready is None:
                        ready = [np.concatenate(x) for x in zip(*block, strict=True)]
                    for d, c, n, s, f in zip(*ready, strict=True):
                        fit = (piece[1] != c) & (
                            100 * np.minimum(piece[2], n) >= percent * np.maximum(piece[2], n)
                        )
                        near = np.flatnonzero(fit)
                        if len(near):
                            alive = may_reach(piece[3][near], np.broadcast_to(s, (len(near), len(s))), needed)
                            kept = near[alive]
                            both = most_shared(piece[4][kept], f[None])
                            total = piece[2][kept] + n
                            large = np.minimum(piece[2][kept], n) > 255 * CELLS
                            fit = large | (100 * both >= percent * (total - both))
                            kept, share = kept[fit], (both / (total - both))[fit]
                            found.append((np.full(len(kept), d), piece[0][kept], piece[1][kept], share))
                at = end
            columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(k)) for c, k in zip(columns, (np.int64, np.int64, np.int64, np.float64), strict=True)],
                ["home", "other", "part", "share"],
            )

    return dealt.mapInArrow(run, RESIDUAL)


RESIDUAL = "home long, other long, part long, share double"


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: the id, n_shingles, component_id (smallest id reachable by links), kept."""
    spark = bounded_batches(docs.sparkSession)
    texts = docs.select(key_or_least(id_column).alias("doc"), F.col(text_column).cast("string").alias("text"))
    sketch = stage(sketches(texts, shingle), "sketch")
    banded = sketch.filter("n > 0").select("doc", F.explode("bands").alias("key"))
    buckets = stage(
        banded.groupBy("key").agg(F.min("doc").alias("head"), F.count("*").alias("size")).filter("size > 1"), "buckets"
    )
    shared = banded.join(buckets, "key")
    stars = shared.filter("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
    candidates = stage(prune(stars, sketch, threshold), "candidates")

    members = shared.filter("size > 2").select("key", "doc")
    links: list[DataFrame] = []
    found = spark.createDataFrame([], "node long, component long")

    def settle(pairs: DataFrame) -> None:
        nonlocal found
        if links:
            pairs = stage(_across(pairs, found).select("a", "b"), "open")
        if not pairs.isEmpty():
            links.append(stage(verify(pairs, texts, shingle, threshold), "links"))
            found = stage(components(reduce(DataFrame.union, links)), "components")

    settle(candidates)
    # Buckets that still hold several components.
    rest = stage(residual_pairs(members, found, sketch, threshold), "rest")
    if not rest.isEmpty():
        pair = F.struct(F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"))
        likeliest = rest.groupBy("home", "part").agg(F.max_by("other", F.struct("share", -F.col("other"))).alias("other"))
        settle(likeliest.select(pair.alias("p")).select("p.*").distinct())
        settle(rest.select(pair.alias("p")).select("p.*").distinct())

    labelled = _labelled(sketch.select("doc", "n"), "doc", found, "component")
    plain = lambda c: F.when(F.col(c) != LEAST, F.col(c))
    return labelled.select(
        plain("doc").alias(id_column),
        F.col("n").alias("n_shingles"),
        plain("component").alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"),
    )
