"""Exact near duplicates of vectors: a metric range join over cells of pivots.

Vectors of one label are linked when their cosine reaches the threshold; on unit vectors that is a
Euclidean distance of at most ``radius``. A bounded sample gives the pivots. A vector is at home in the cell of its nearest
pivot, and by the triangle inequality a partner of a vector of that cell is at most ``2 * radius``
farther from the pivot than from its own; for Euclidean distances the way to the plane between both pivots is
a tighter bound, so a vector visits exactly the cells it may have partners in. Cells join on their own. Home vectors of a large cell are dealt to blocks, visitors pass by every block of their cell;
inside, distances to the pivot differ by at most ``radius`` between partners, and cosines are
computed in double precision from the vectors themselves.

Equal vectors of a label are one row with a count, so copies are not paired. Of the links a task
finds only a spanning forest leaves it, besides the counts: that keeps both the number of links and
reachability exact.

Defined cases: a null label, a null or zero vector, and one with null, NaN or infinite components
link with nothing and are kept. Vectors of different length do not link. Rows that repeat an id are
one node; its number of links is the largest of its rows'. A null id is one node below all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.components import components
from inkspan.llm.frames import LEAST, bounded_batches, key_or_least, stage

THRESHOLD = 0.98
PIVOTS = 64
BLOCK = 1024
SLACK = 1e-7


def usable(vector: str):
    """Neither null nor zero, all components finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _vectors(column: pa.Array, size: int | None = None) -> list[np.ndarray] | np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ptr = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(int)
    if size is None:
        return [flat[a:b] for a, b in zip(ptr, ptr[1:], strict=False)]
    # Cut or padded to the pivots' length: that never lengthens a distance, so the bounds hold.
    out = np.zeros((len(column), size))
    lengths = np.diff(ptr)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        norm = np.sqrt((flat[ptr[rows][:, None] + np.arange(n)] ** 2).sum(axis=1))
        out[rows, : min(n, size)] = flat[ptr[rows][:, None] + np.arange(min(n, size))] / norm[:, None]
    return out


def pivots(distinct: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """At most ``count`` unit vectors: those with the smallest hash. Any choice gives the same links."""
    rows = distinct.select("vector").orderBy(F.xxhash64("vector"), "first").limit(count).toArrow()
    column = rows["vector"].combine_chunks()
    size = int(max(column.value_lengths().to_pylist(), default=1))
    return np.unique(_vectors(column, size), axis=0)


def _cells(distinct: DataFrame, centres: np.ndarray, radius: float) -> DataFrame:
    """first, label, copies, vector, cell, home (whether the cell is its own), away (distance to the pivot)."""
    shared = distinct.sparkSession.sparkContext.broadcast(centres)  # at most PIVOTS vectors

    def run(batches):
        points = shared.value
        gaps = np.sqrt(np.maximum(((points[:, None] - points[None]) ** 2).sum(-1), 1e-300))
        for batch in batches:
            if not len(batch):
                continue
            own = _vectors(batch.column("vector"), points.shape[1])
            square = np.maximum((own**2).sum(1)[:, None] + (points**2).sum(1)[None] - 2 * own @ points.T, 0)
            away = np.sqrt(square)
            home = square.argmin(axis=1)
            least = square[np.arange(len(own)), home]
            to_plane = (square - least[:, None]) / (2 * gaps[home])
            near = (to_plane <= radius + SLACK) & (away <= np.sqrt(least)[:, None] + 2 * radius + SLACK)
            near[np.arange(len(own)), home] = True
            row, cell = np.nonzero(near)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(cell, pa.int32()), pa.array(cell == home[row]), pa.array(away[row, cell])],
                [*batch.schema.names, "cell", "home", "away"],
            )

    ddl = "first long, label string, copies long, vector array<double>, size int"
    return distinct.mapInArrow(run, ddl + ", cell int, home boolean, away double")


class _Block:
    """Home vectors of one block, in order of their distance to the pivot."""

    def __init__(self, parts: list[tuple]) -> None:
        self.first, self.copies, self.away, self.vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(self.away, kind="stable")
        self.first, self.copies, self.away, self.vectors = (
            x[order] for x in (self.first, self.copies, self.away, self.vectors)
        )
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.links = np.zeros(len(order), np.int64)
        self.edges: list[tuple[int, int]] = []

    def meet(self, first: np.ndarray, copies: np.ndarray, away: np.ndarray, vectors: np.ndarray, radius: float, threshold: float) -> None:
        low = np.searchsorted(self.away, away.min() - radius - SLACK)
        high = np.searchsorted(self.away, away.max() + radius + SLACK, "right")
        if low >= high:
            return
        norms = np.sqrt((vectors**2).sum(axis=1))
        cosine = (self.vectors[low:high] @ vectors.T) / (self.norms[low:high, None] * norms[None])
        linked = (cosine >= threshold) & (self.first[low:high, None] != first[None])
        self.links[low:high] += linked @ copies
        parts = np.arange(len(first))  # groups of visitors that are joined already
        for k in np.flatnonzero(linked.any(axis=1)):
            groups = np.unique(parts[linked[k]])
            self.edges += [(int(self.first[low + k]), int(first[g])) for g in groups]
            parts[np.isin(parts, groups)] = groups[0]


def _join(cells: DataFrame, radius: float, threshold: float) -> DataFrame:
    """first, links (copies of other vectors linked) and edges; several rows per vector."""
    sizes = cells.filter("home").groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = cells.join(sizes, ["label", "size", "cell"])
    columns = ["label", "size", "cell", "block", "role", "away", "first", "copies", "vector"]
    home = placed.filter("home").withColumn("block", F.pmod(F.xxhash64("first"), F.col("blocks"))).withColumn("role", F.lit(0))
    passing = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("role", F.lit(1))
    dealt = (
        home.select(columns).union(passing.select(columns))
        .repartition("label", "size", "cell", "block")
        .sortWithinPartitions("label", "size", "cell", "block", "role", "away")
    )

    def run(batches):
        group, parts, block = None, [], None

        def done():
            own = block or (_Block(parts) if parts else None)
            if own is None:
                return
            a = [e[0] for e in own.edges]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*own.first.tolist(), *a], pa.int64()),
                    pa.array([*own.links.tolist(), *[0] * len(a)], pa.int64()),
                    pa.array([*[None] * len(own.first), *[e[1] for e in own.edges]], pa.int64()),
                ],
                ["first", "links", "other"],
            )

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("label", "size", "cell", "block")], strict=True))
            role = batch.column("role").to_numpy()
            numbers = [batch.column(c).to_numpy() for c in ("first", "copies", "away")]
            vectors = _vectors(batch.column("vector"))
            at = 0
            while at < len(keys):
                if keys[at] != group:
                    yield from done()
                    group, parts, block = keys[at], [], None
                end = at + 1
                while end < len(keys) and end - at < BLOCK and keys[end] == group and role[end] == role[at]:
                    end += 1
                piece = (*[x[at:end] for x in numbers], np.stack(vectors[at:end]))
                if role[at] == 0:
                    parts.append(piece)
                elif parts:  # a block may have got no home vector
                    block = block or _Block(parts)
                    block.meet(*piece, radius, threshold)
                at = end
        yield from done()

    return dealt.mapInArrow(run, "first long, links long, other long")


def near_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per vector: the id, n_links, component_id (smallest id reachable), kept."""
    bounded_batches(vectors.sparkSession)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = vectors.select(
        key_or_least(id_column).alias("id"),
        F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )
    fit = rows.filter(F.col("label").isNotNull() & usable("vector"))
    # -0.0 and 0.0 are equal numbers but different bytes.
    fit = fit.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    distinct = stage(
        fit.groupBy("label", "vector")
        .agg(F.min("id").alias("first"), F.count_distinct("id").alias("copies"))
        .select("first", "label", "copies", "vector", F.size("vector").alias("size")),
        "vectors",
    )
    centres = pivots(distinct)
    empty = distinct.select(F.col("first"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("other"))
    if len(centres):
        joined = _join(_cells(distinct, centres, radius), radius, threshold)
    else:
        joined = empty
    found = stage(joined, "found")
    linked = found.groupBy("first").agg(F.sum("links").alias("links"))
    edges = found.filter("other is not null").select(F.col("first").alias("a"), F.col("other").alias("b"))
    # The members of a vector's class link with its first member.
    members = fit.join(distinct.select("label", "vector", "first", "copies"), ["label", "vector"])
    members = stage(members.select("id", "first", "copies"), "members")
    within = members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    groups = stage(components(edges.union(within)), "components")
    counted = (
        members.join(linked, "first", "left")
        .groupBy("id")
        .agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    plain = lambda c: F.when(F.col(c) != LEAST, F.col(c))
    return (
        rows.select("id")
        .join(counted, "id", "left")
        .join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .select(
            plain("id").alias(id_column),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            plain("component").alias("component_id"),
            (F.col("id") == F.col("component")).alias("kept"),
        )
    )
