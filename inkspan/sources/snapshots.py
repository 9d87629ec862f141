"""Tables that change by one commit: a folder of parts and numbered manifests that say which parts count.

A write puts new parts beside the old ones and then a manifest beside the old manifests. Readers take the manifest with the largest
number, so a change is visible whole or not at all, and a job that dies leaves parts nobody reads. Parts hold the rows
of one value of the key, so replacing or deleting rows of some keys writes only these again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Somebody else has committed since the table was read."""


class SnapshotTable:
    """A table at ``path`` with parts by ``key`` (few values with many rows each, as companies are)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        full = self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}"
        self.files, self.base = fs.FileSystem.from_uri(full)

    def version(self) -> int:
        """Number of the newest manifest; 0 if there is none."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/manifests", allow_not_found=True))
        return max((int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json")), default=0)

    def parts(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders of each key's rows."""
        version = self.version() if version is None else version
        if not version:
            return {}
        with self.files.open_input_stream(f"{self.base}/manifests/{version:012d}.json") as file:
            return json.loads(file.read())

    def read(self, version: int | None = None, keys: Sequence | None = None) -> DataFrame:
        """The rows of a version (the newest by default), of all keys or some."""
        found = self.parts(version)
        wanted = found if keys is None else {k: found.get(k, []) for k in map(_name, keys)}
        folders = [f"{self.path}/{x}" for listed in wanted.values() for x in listed]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def commit(self, rows: DataFrame, keys: Sequence, seen: int) -> int:
        """Replace the rows of ``keys`` by ``rows`` (of these keys only); returns the new version.

        ``seen`` is the version the change was made from; if it is not the newest any more, nothing changes.
        """
        label = f"data/{uuid.uuid4().hex}"
        marked = rows.select(*self.schema.names).withColumn("_key", F.coalesce(F.col(self.key).cast("string"), F.lit("")))
        marked.hint("rebalance", "_key").write.partitionBy("_key").parquet(f"{self.path}/{label}")
        written = self.files.get_file_info(fs.FileSelector(f"{self.base}/{label}"))
        fresh = {_name_of(x.base_name): [f"{label}/{x.base_name}"] for x in written if x.base_name.startswith("_key=")}
        kept = {k: v for k, v in self.parts(seen).items() if k not in set(map(_name, keys))}
        if clash := set(fresh) & set(kept):
            raise ValueError(f"rows of other keys than given: {sorted(clash)}")
        return self._publish({**kept, **fresh}, seen)

    def _publish(self, parts: dict[str, list[str]], seen: int) -> int:
        """The manifest appears under its number at once, by a rename.

        A number that is taken already is a conflict. A rename does not exclude another one of the same moment in every file
        system, so of writers that race within it one may win unnoticed; those take turns by a lock of their own.
        """
        folder, number = f"{self.base}/manifests", seen + 1
        self.files.create_dir(folder)
        hidden, target = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{number:012d}.json"
        with self.files.open_output_stream(hidden, compression=None) as file:
            file.write(json.dumps(parts).encode())
        if self.version() != seen or self.files.get_file_info(target).type != fs.FileType.NotFound:
            self.files.delete_file(hidden)
            raise Conflict(f"version {seen} is not the newest")
        self.files.move(hidden, target)
        return number

    def replace(self, rows: DataFrame, keys: Sequence) -> int:
        """Rows of ``keys`` become ``rows``; a key without rows is emptied."""
        return self.commit(rows, keys, self.version())

    def delete(self, doomed: DataFrame, ids: Sequence[str]) -> int:
        """Rows that match ``doomed`` in the key and ``ids`` go. Only the parts of its keys are written again."""
        seen = self.version()
        keys = [r[0] for r in doomed.select(self.key).distinct().collect()]  # keys, not rows
        stay = self.read(seen, keys).join(doomed.select(self.key, *ids).distinct(), [self.key, *ids], "left_anti")
        return self.commit(stay, keys, seen) if keys else seen


def _name(value) -> str:
    return "" if value is None else str(value)


def _name_of(folder: str) -> str:
    value = unquote(folder.split("=", 1)[1])
    return "" if value == "__HIVE_DEFAULT_PARTITION__" else value
