"""Shared ways to run vectorised helpers over DataFrames: Arrow batches, sorted groups, staged tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.sources.staging import stage
from inkspan.sources.tables import table

__all__ = ["ARROW_BYTES", "append_columns", "bounded_batches", "fresh_name", "id_filter", "key_or_least", "pack", "stage",
           "table", "text_tag"]

# Bytes of one Arrow batch handed to Python. Bounds a task's Python memory whatever a text's length:
# a batch ends with the row that crosses it.
ARROW_BYTES = 2 << 20

LEAST = -(1 << 63)
ROOT = str(Path(__file__).resolve().parents[2])


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Cut Arrow batches by bytes, not by 10,000 rows; let workers of this machine find the package.

    On a cluster the package is shipped as usual (``--py-files``); the path then does no harm.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def append_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    ddl: str,
) -> DataFrame:
    """``df`` with computed columns (``ddl``) at the end; no shuffle.

    ``make`` runs once per task and returns the function applied to each batch. An input column with
    the name of a computed one is replaced.
    """
    bounded_batches(df.sparkSession)
    fields = T.StructType.fromDDL(ddl).fields
    kept = df.drop(*[f.name for f in fields])
    names = [*kept.columns, *[f.name for f in fields]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch)], names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The last column of that name, so that helper columns win over a caller's own."""
    return batch.column(max(i for i, n in enumerate(batch.schema.names) if n == name))


def parts(batches: Iterable[pa.RecordBatch], name: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``size`` bytes of the text column; a longer text is a run of its own."""
    for batch in batches:
        lengths = pc.coalesce(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(lengths, dtype=np.int64), 0
        while first < len(batch):
            room = size + (ends[first - 1] if first else 0)
            stop = max(first + 1, int(np.searchsorted(ends, room, "right")))
            yield batch.slice(first, stop - first)
            first = stop


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, to carry a helper value beside a caller's own columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_tag(name: str) -> Column:
    """Tells rows of one id apart that differ in text."""
    return F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")))


def pack(values: Iterable[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def key_or_least(name: str) -> Column:
    """An id for joins and orders; null ids are one id below all others. Ids are integers, whatever their type's width."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LEAST))


def id_filter(ids: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test that lets all of ``ids`` through and few others, to thin a table before a join that decides.

    A bit table of 2**16 to 2**23 bits (1 MB at most, about 16 bits an id below that), made by an
    aggregate and read in the JVM as a scalar subquery. With many more ids it lets everything through.
    """
    wanted = min(1 << 23, max(1 << 16, 1 << (16 * max(1, ids.count()) - 1).bit_length()))
    slots = wanted // 64

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(wanted))

    spot = place(F.col(name))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))
    rows = ids.select((F.floor(spot / 64)).cast("int").alias("slot"), bit.alias("bit"))
    empty = ids.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("bit"))
    table = rows.union(empty).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    packed = table.agg(F.array_sort(F.collect_list(F.struct("slot", "bits"))).alias("t")).select("t.bits")
    bits = packed.scalar()

    def test(column: Column) -> Column:
        at = place(column)
        word = F.element_at(bits, (F.floor(at / 64) + 1).cast("int"))
        return F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(1) == 1

    return test
