"""Opening only the files that are wanted, by their paths."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_BYTES = 64 << 20  # of content for a task, about
BATCH_BYTES = 8 << 20  # of content held at once, but for a larger file
PART_BYTES = 4 << 20  # of a file that is read in parts


def open_file(path: str) -> bytes:
    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    with system.open_input_file(name) as file:
        return file.read()


def _parts_of(path: str | None, size: int) -> Iterator[tuple]:
    """(content, fetch_error, part, end, md5, is_last) of each part of a file; md5 is that of all bytes up to the part's end."""
    digest, part, end = hashlib.md5(), 0, 0
    try:
        if path is None:
            raise ValueError("no path")
        system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        with system.open_input_file(name) as file:
            content, after = file.read(size), b"more"
            while after:
                after = file.read(size)
                digest.update(content)
                end += len(content)
                yield content, None, part, end, digest.hexdigest(), not after
                part, content = part + 1, after
    except (OSError, ValueError) as error:
        yield None, type(error).__name__, part, None, None, True


def fetch(
    wanted: DataFrame, opener: Callable[[str], bytes] = open_file, task_bytes: int = TASK_BYTES, part_bytes: int | None = None
) -> DataFrame:
    """The columns of ``wanted`` (with path and size_bytes) with content and fetch_error.

    No other file is listed or opened. Files are dealt over tasks by their number and bytes; one that cannot be read has an
    error and no content, and the others go on.

    With ``part_bytes`` no file is held whole: it is read from its start (without ``opener``), each part of so many bytes a row
    with part (from 0), end (bytes up to its end), md5 (of these) and is_last, in order. The row of an error is the last one.
    """
    bytes_ = wanted.agg(F.sum(F.coalesce("size_bytes", F.lit(0))).alias("n")).first()["n"] or 0
    tasks = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-bytes_ // task_bytes))
    names = [*wanted.columns, "content", "fetch_error"]

    def run(batches):
        for batch in batches:
            first, contents, errors, room = 0, [], [], 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                try:
                    if path is None:
                        raise ValueError("no path")
                    contents.append(opener(path))
                    errors.append(None)
                except (OSError, ValueError) as error:
                    contents.append(None)
                    errors.append(type(error).__name__)
                room += len(contents[-1] or b"")
                if room > BATCH_BYTES:
                    yield part(batch, first, contents, errors)
                    first, contents, errors, room = k + 1, [], [], 0
            yield part(batch, first, contents, errors)

    def part(batch, first, contents, errors):
        found = batch.slice(first, len(contents))
        return pa.RecordBatch.from_arrays([*found.columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=names)

    more = ["part", "end", "md5", "is_last"]
    kinds = [pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]

    def run_parts(batches):
        for batch in batches:
            at, rows, room = [], [], 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                for row in _parts_of(path, part_bytes):
                    at.append(k)
                    rows.append(row)
                    room += len(row[0] or b"")
                    if room >= min(part_bytes, BATCH_BYTES):
                        yield several(batch, at, rows)
                        at, rows, room = [], [], 0
            yield several(batch, at, rows)

    def several(batch, at, rows):
        made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
        found = batch.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*found.columns, *made], names=[*names, *more])

    schema = wanted.schema.add("content", "binary").add("fetch_error", "string")
    dealt = wanted.repartition(int(tasks), F.xxhash64("path"))
    if part_bytes is None:
        return dealt.mapInArrow(run, schema)
    for name, kind in zip(more, ["integer", "long", "string", "boolean"], strict=True):
        schema = schema.add(name, kind)
    return dealt.mapInArrow(run_parts, schema)
