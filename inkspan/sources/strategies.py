"""File strategies: named sources of files that Spark reads as tables and as streams.

A strategy says how to list a place and how to open what it lists; a listed item may hold many files. Reading plans one task for
each folder directly below the place (and one for the files beside these), which lists its own subtree; the driver
never holds all paths. An item that cannot be listed or opened is a row with an error, and the others go on.

    register(spark)
    spark.read.format("folder_files").load(path)            # path, member, name, ext, size_bytes, created, content, error
    spark.readStream.format("folder_files").load(path)      # files as they arrive

Options: ``content`` (default true; false lists only), ``settle_seconds`` (a stream leaves files changed within so many seconds
to the next batch, so that none arrives behind its mark; default 2).
"""

from __future__ import annotations

import io
import json
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = (
    "path string, member string, name string, ext string, size_bytes bigint, created timestamp, content binary, error string"
)


@dataclass
class Folder(InputPartition):
    """A part of a place: a folder with all below it, or only the files directly in it; changed from ``since`` to ``until``."""

    path: str
    deep: bool
    since: int = -1
    until: int = 1 << 62


@dataclass(frozen=True)
class Item:
    path: str
    size: int
    changed: int  # nanoseconds


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _changed(info: fs.FileInfo) -> int:
    return info.mtime_ns or 0


def list_folder(path: str, deep: bool) -> Iterator[Item]:
    """Files in a folder; hidden ones and those below hidden folders are left out."""
    system, base = _system(path)
    for info in system.get_file_info(fs.FileSelector(base, recursive=deep)):
        own = info.path[len(base) :]
        if info.type == fs.FileType.File and "/." not in own and "/_" not in own:
            yield Item(info.path, info.size, _changed(info))


def read_whole(path: str) -> bytes:
    system, name = _system(path)
    with system.open_input_file(name) as file:
        return file.read()


def open_plain(path: str) -> Iterator[tuple[str, bytes]]:
    yield "", read_whole(path)


def open_zip(path: str) -> Iterator[tuple[str, bytes]]:
    """The files of an archive, one after the other; any other file is itself."""
    data = read_whole(path)
    if not path.lower().endswith(".zip"):
        yield "", data
        return
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        for info in box.infolist():
            if not info.is_dir():
                yield info.filename, box.read(info)


def _ext(name: str) -> str | None:
    rest = name.rstrip(".")
    return rest.rsplit(".", 1)[1].lower() or None if "." in rest else None


class _Reads:
    """What batch and stream readers share."""

    def __init__(self, options: dict, opener: Callable[[str], Iterator[tuple[str, bytes]]]) -> None:
        self.path, self.opener = options["path"].rstrip("/"), opener
        self.content = str(options.get("content", "true")).lower() == "true"
        self.settle = float(options.get("settle_seconds", 2))

    def folders(self, since: int = -1, until: int = 1 << 62) -> list[Folder]:
        system, base = _system(self.path)
        below = [
            Folder(x.path, True, since, until) for x in system.get_file_info(fs.FileSelector(base))
            if x.type == fs.FileType.Directory and not x.base_name.startswith((".", "_"))
        ]
        return [Folder(self.path, False, since, until), *below]

    def rows(self, part: Folder) -> Iterator[tuple]:
        import datetime

        try:
            items = sorted(list_folder(part.path, part.deep), key=lambda i: i.path)
        except OSError as error:
            yield part.path, None, None, None, None, None, None, type(error).__name__
            return
        for item in items:
            if not part.since < item.changed <= part.until:
                continue
            stamp = datetime.datetime.fromtimestamp(item.changed / 1e9, datetime.timezone.utc)
            name = item.path.rsplit("/", 1)[-1]
            if not self.content:
                yield item.path, "", name, _ext(name), item.size, stamp, None, None
                continue
            try:
                for member, data in self.opener(item.path):
                    own = member.rsplit("/", 1)[-1] or name
                    yield item.path, member, own, _ext(own), len(data), stamp, data, None
            except (OSError, ValueError, RuntimeError, zipfile.BadZipFile) as error:
                yield item.path, None, name, _ext(name), item.size, stamp, None, type(error).__name__


class _Batch(_Reads, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return self.folders()

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from self.rows(partition)


class _Stream(_Reads, DataSourceStreamReader):
    """Offsets are times of change in nanoseconds; a batch takes the files changed after its start and up to its end."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"changed": int((time.time() - self.settle) * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.folders(start["changed"], end["changed"])

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def strategy(strategy_name: str, opener: Callable[[str], Iterator[tuple[str, bytes]]]) -> type[DataSource]:
    """A data source of that name whose listed items are opened by ``opener``: path to (member, content) pairs."""

    class FileStrategy(DataSource):
        @classmethod
        def name(cls) -> str:
            return strategy_name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Batch(dict(self.options), opener)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return _Stream(dict(self.options), opener)

    return FileStrategy


STRATEGIES = {"folder_files": open_plain, "zip_files": open_zip}


def register(spark: SparkSession, more: dict[str, Callable[[str], Iterator[tuple[str, bytes]]]] | None = None) -> list[str]:
    """Make the strategies, and any further ones, known to the session; returns their names."""
    known = {**STRATEGIES, **(more or {})}
    for strategy_name, opener in known.items():
        spark.dataSource.register(strategy(strategy_name, opener))
    return list(known)


def load(spark: SparkSession, strategy_name: str, path: str, stream: bool = False, **options):
    """Files of a place by a strategy's name; an unknown name is an error before anything is read."""
    if strategy_name not in register(spark):
        raise ValueError(f"unknown strategy: {strategy_name}")
    reader = (spark.readStream if stream else spark.read).format(strategy_name)
    return reader.options(**{k: json.dumps(v) if isinstance(v, bool) else v for k, v in options.items()}).load(path)
