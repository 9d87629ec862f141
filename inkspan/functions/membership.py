"""A test that thins a table before a join decides: everything listed passes, and little else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 23  # bits: 1 MB


def listed_filter(listed: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test for values of ``listed``. About 16 bits a value, ``LARGEST`` at most; a longer list lets more of others through.

    The bits are one array, made by an aggregate and read as a scalar subquery, so the test is part of the scan's stage.
    """
    bits = max(1 << 12, min(LARGEST, 1 << (16 * max(1, listed.count()) - 1).bit_length()))

    def place(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(bits))

    spot = place(F.col(column))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))
    marked = listed.select((F.floor(spot / 64)).cast("int").alias("slot"), one.alias("bit"))
    empty = listed.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("bit"))
    words = marked.unionByName(empty).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    table = words.agg(F.array_sort(F.collect_list(F.struct("slot", "bits"))).alias("t")).select(F.col("t.bits").alias("bits")).scalar()

    def test(value: Column) -> Column:
        at = place(value)
        word = F.element_at(table, (F.floor(at / 64) + 1).cast("int"))
        return F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(1) == 1

    return test
