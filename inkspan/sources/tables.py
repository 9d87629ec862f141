"""The given parquet tables."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART_BYTES = 4 << 20  # of files for a task that counts the words of texts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table of fewer files than cores over all cores before text work; others are left as they are.

    A scan cannot split a row group, so a single small file would keep one core busy. Rows do not
    change; a table of many files is never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def text_parts(df: DataFrame) -> int:
    """How many parts of about ``PART_BYTES`` the files have that ``df`` comes from, at least one for each core."""
    spark, files = df.sparkSession, [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(f)) for f in df.inputFiles()]
    # only the lengths are asked for, so no file is opened
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    return max(spark.sparkContext.defaultParallelism, -(-(size or 0) // PART_BYTES))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by a key into ``text_parts``.

    What is counted by the key and more columns stays where it is: instead of a row for each word the texts are shuffled, and
    a task holds the words of a part, however large the files or the scan's splits are.
    """
    return df.repartition(text_parts(df), key)
