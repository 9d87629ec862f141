"""File listings and file containers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.operators.ingest import normalize_extension

LISTING_COLUMNS = ["path", "iuuid", "name", "ext", "size_bytes", "created"]


def scan_files(
    spark: SparkSession, folders: str | Sequence[str], pattern: str = "*", max_bytes: int | None = None
) -> DataFrame:
    """List files below one or several folders without reading their content.

    The size limit is pushed into the file source; ``content`` is not selected, so it is pruned.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folders if isinstance(folders, str) else list(folders))
    )
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    return files.select(
        "path",
        F.col("path").alias("iuuid"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        normalize_extension(F.col("path")).alias("ext"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("created"),
    )


def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Opener for zip containers: one output row per contained file, yielded file by file."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as box:
                for info in box.infolist():
                    if not info.is_dir():
                        yield pd.DataFrame(
                            {"path": [path], "member": [info.filename], "content": [box.read(info)]}
                        )


UNZIP_SCHEMA = "path string, member string, content binary"
