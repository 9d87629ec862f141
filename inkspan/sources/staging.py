"""Written intermediate tables in the cluster's shared folder.

A staged table is read by several consumers without recomputing its input and survives the loss
of executors, because it lives in the file system and not in executor memory.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master a new folder if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    app = context.applicationId
    if app not in _local_fallback:
        _local_fallback[app] = tempfile.mkdtemp(prefix="run-inkspan-", dir="/tmp")
    return _local_fallback[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody else writes to."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/inkspan/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
