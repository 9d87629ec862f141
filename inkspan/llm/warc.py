"""Web archives: WARC files with revisit records, and a two-level capture index over them.

Captures are dealt to archives by a hash of their id, in numbers that follow the payload bytes. Each task
writes archives of its own to the shared folder, one gzip member per record, so a record can be
read alone from its offset. A file is named after the attempt that wrote it and counts only if it is in
the table of captures, so a lost executor leaves at most a file that nobody reads.

The index lists captures by reversed-host key (``org,example,www)/path``). Lines are range-partitioned
and sorted, packed into compressed blocks of ``LINES`` lines, and a sparse directory keeps the first
key of each block. A lookup finds a key's range of the directory by binary search, its blocks there, lines by binary search in
the block, and reads only the records' ranges.

Defined cases: a null payload is an empty one; payloads under ``LEAST_BYTES`` are never revisits. Of
equal payloads the one with the smallest id is the response; rows that repeat it (same id and payload)
are responses too. A null id comes before all others. A null url has an empty key. Extra columns are not
read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.frames import LEAST, bounded_batches, key_or_least, stage
from inkspan.sources.staging import new_path

LEAST_BYTES = 100
ARCHIVE_BYTES = 64 << 20
LINES = 3_000
PARTS = 4  # a block's keys are looked up in so many parts
RANGES = 1 << 12  # of keys, in which a lookup merges keys and directory
FETCH_BYTES = 32 << 20  # of archives a task of a lookup reads, about
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # for names that are URLs
RECORD = "capture long, url string, kind string, digest string, payload_bytes long, payload binary, refers_to long"
DATE = "2024-01-01T00:00:00Z"  # the tables carry no capture time


def reversed_host_key(url: str | None) -> str:
    """``http://www.Example.org:8080/a?b`` as ``org,example,www:8080)/a?b``; scheme, user and fragment go."""
    rest = "%20".join((url or "").split("#", 1)[0].split())  # index lines end a key at a space
    rest = rest.split("://", 1)[-1]
    if not rest:
        return ""
    cut = min((k for k in (rest.find(c) for c in "/?") if k >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    host, colon, port = host.partition(":")
    return ",".join(reversed(host.split("."))) + colon + port + ")" + (path if path[0] == "/" else "/" + path)


def record_id(capture: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'capture:{capture}')}>"


def record(capture: int, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record: a response, or a revisit without body that refers to capture ``first``."""
    kind = "response" if first is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if first is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(capture)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Capture: {capture}",
    ]
    if first is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Capture: {first}",
        ]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers of a record, its HTTP headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(named["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    sizes = [line[16:] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: ")]
    return {"headers": named, "payload": payload, "payload_bytes": int(sizes[0]) if sizes else len(payload)}


def members(stream, size: int = 1 << 20):
    """The gzip members of a file one after the other, unpacked."""
    reader, parts, rest = zlib.decompressobj(31), [], b""
    while chunk := rest or stream.read(size):
        parts.append(reader.decompress(chunk))
        rest = b""
        if reader.eof:
            yield b"".join(parts)
            rest = reader.unused_data
            reader, parts = zlib.decompressobj(31), []


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, name


def plan(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    """capture, url, payload, digest and first: the capture a revisit refers to."""
    base = pages.select(
        key_or_least(id_column).alias("capture"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Only digests that several captures share; the aggregate combines before the shuffle.
    shared = (
        base.filter(F.length("payload") >= LEAST_BYTES).groupBy("digest")
        .agg(F.min("capture").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    )
    joined = base.join(stage(shared, "shared"), "digest", "left")
    return joined.withColumn("first", F.when(F.col("first") != F.col("capture"), F.col("first")))


def write(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html"
) -> DataFrame:
    """Write the archives below ``folder``; returns the staged table of captures.

    Columns: capture, url, key, path, offset, length, digest, kind.
    """
    bounded_batches(pages.sparkSession)
    total = pages.agg(F.sum(F.length(payload_column)).alias("n")).first()["n"] or 0
    archives = max(pages.sparkSession.sparkContext.defaultParallelism, -(-total // ARCHIVE_BYTES))
    dealt = plan(pages, id_column, url_column, payload_column).repartition(archives, F.xxhash64("capture"))

    def run(batches):
        path = f"{folder}/capture-{uuid.uuid4().hex}.warc.gz"
        stream, offset = None, 0
        try:
            for batch in batches:
                rows = []
                for capture, url, payload, digest, first in zip(
                    *[batch.column(c).to_pylist() for c in ("capture", "url", "payload", "digest", "first")], strict=True
                ):
                    if stream is None:
                        system, name = _open(path)
                        system.create_dir(name.rsplit("/", 1)[0])
                        stream = system.open_output_stream(name, compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record(capture, url, payload, digest, first)) + packer.flush()
                    stream.write(data)
                    rows.append((capture, url, reversed_host_key(url), path, offset, len(data), digest, "response" if first is None else "revisit"))
                    offset += len(data)
                names = ["capture", "url", "key", "path", "offset", "length", "digest", "kind"]
                kinds = [pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 2, *[pa.string()] * 2]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        finally:
            if stream is not None:
                stream.close()

    ddl = "capture long, url string, key string, path string, offset long, length long, digest string, kind string"
    return stage(dealt.select("capture", "url", "payload", "digest", "first").mapInArrow(run, ddl), "captures")


def read(captures: DataFrame) -> DataFrame:
    """All records of the archives in ``captures``, one archive per task.

    Columns: capture, url, kind, digest, payload_bytes, payload, refers_to.
    """
    paths = captures.select("path").distinct()
    count = max(1, paths.count())

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _open(path)
                with system.open_input_stream(name, compression=None) as stream:
                    rows, room = [], 0
                    for data in members(stream):
                        found = parse(data)
                        named = found["headers"]
                        refers = named.get("X-Refers-To-Capture")
                        rows.append(
                            (
                                int(named["X-Capture"]), named["WARC-Target-URI"], named["WARC-Type"],
                                named["WARC-Payload-Digest"].removeprefix("sha256:"), found["payload_bytes"],
                                found["payload"], int(refers) if refers else None,
                            )
                        )
                        room += len(data)
                        if room > 4 << 20:
                            yield _batch(rows)
                            rows, room = [], 0
                    yield _batch(rows)

    return paths.repartition(count, "path").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["capture", "url", "kind", "digest", "payload_bytes", "payload", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def build_index(captures: DataFrame, lines: int = LINES) -> tuple[DataFrame, DataFrame]:
    """The staged index: blocks (block, first_key, last_key, n, bytes, data) and directory (block, first_key, last_key).

    A block never mixes range partitions, and its lines are sorted by key, capture and offset.
    """
    ordered = captures.select("key", "capture", "url", "path", "offset", "length", "digest", "kind")
    # Ranges over key and capture, so a key with very many captures is split as well.
    ordered = ordered.repartitionByRange("key", "capture", "offset").sortWithinPartitions("key", "capture", "offset")

    def pack(rows: list[dict]) -> tuple:
        text = "\n".join(f"{r['key']} {json.dumps(r)}" for r in rows)
        block = hashlib.sha256(f"{rows[0]['key']} {rows[0]['capture']} {rows[0]['path']} {rows[0]['offset']}".encode()).hexdigest()[:24]
        return block, rows[0]["key"], rows[-1]["key"], len(rows), sum(r["length"] for r in rows), zlib.compress(text.encode())

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            done = [pack(held[k : k + lines]) for k in range(0, len(held) - lines + 1, lines)]
            held = held[len(done) * lines :]
            yield blocks_of(done)
        yield blocks_of([pack(held)] if held else [])

    def blocks_of(rows):
        names = ["block", "first_key", "last_key", "n", "bytes", "data"]
        kinds = [pa.string()] * 3 + [pa.int32(), pa.int64(), pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    blocks = stage(ordered.mapInArrow(run, "block string, first_key string, last_key string, n int, bytes long, data binary"), "blocks")
    return blocks, stage(blocks.select("block", "first_key", "last_key"), "directory")


def reversed_keys(urls: DataFrame, url_column: str) -> DataFrame:
    """key: the reversed-host key of each url, in Arrow batches."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(map(reversed_host_key, batch.column(0).to_pylist()), pa.string())], ["key"])

    return urls.select(F.col(url_column).cast("string").alias("url")).mapInArrow(run, "key string")


def _blocks_of(keys: DataFrame, directory: DataFrame, borders: list[str]) -> DataFrame:
    """key and block: the blocks whose range of keys holds a key.

    A block goes to every range it reaches into. In a range rows come sorted by key, a block by its first one, so a pass
    that keeps the blocks not yet ended meets every key.
    """
    shared = keys.sparkSession.sparkContext.broadcast(borders)  # RANGES at most

    def rows(found):
        columns = list(zip(*found, strict=True)) if found else [[] for _ in range(5)]
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
        names = ["range", "key", "kind", "last_key", "block"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def deal_keys(batches):
        for batch in batches:
            yield rows([(bisect.bisect_right(shared.value, k), k, 1, None, None) for k in batch.column("key").to_pylist()])

    def deal_blocks(batches):
        for batch in batches:
            listed = [batch.column(c).to_pylist() for c in ("first_key", "last_key", "block")]
            yield rows([
                (k, first, 0, last, block)
                for first, last, block in zip(*listed, strict=True)
                for k in range(bisect.bisect_right(shared.value, first), bisect.bisect_right(shared.value, last) + 1)
            ])

    def merge(batches):
        at, open_ = None, []
        for batch in batches:
            pairs = []
            for range_, key, kind, last, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if range_ != at:
                    at, open_ = range_, []
                if kind == 0:
                    open_.append((last, block))
                else:
                    open_ = [b for b in open_ if b[0] >= key]
                    pairs += [(key, b) for _, b in open_]
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.string()) for c in (0, 1)], ["key", "block"])

    ddl = "range int, key string, kind int, last_key string, block string"
    dealt = keys.mapInArrow(deal_keys, ddl).union(directory.select("first_key", "last_key", "block").mapInArrow(deal_blocks, ddl))
    return dealt.repartition("range").sortWithinPartitions("range", "key", "kind").mapInArrow(merge, "key string, block string")


def lookup(urls: DataFrame, index: tuple[DataFrame, DataFrame], url_column: str = "url") -> DataFrame:
    """Captures of the given urls, read by range; columns as of ``read``.

    Keys and directory are dealt into ranges of the key, at borders drawn from the directory (``RANGES`` of them at most),
    and merged in each. Records are fetched in tasks of about ``FETCH_BYTES`` of the archives.
    """
    blocks, directory = index
    spark: SparkSession = bounded_batches(urls.sparkSession)
    keys = reversed_keys(urls, url_column).distinct()
    drawn = directory.select("first_key").distinct().orderBy(F.xxhash64("first_key"), "first_key").limit(RANGES - 1).toArrow()
    wanted = _blocks_of(keys, directory, sorted(drawn["first_key"].to_pylist()))
    # A block goes to its keys once per part, not once per key.
    asked = wanted.groupBy("block", F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part")).agg(
        F.sort_array(F.collect_set("key")).alias("keys")
    )
    bytes_ = blocks.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-bytes_ // FETCH_BYTES))
    placed = asked.join(blocks.select("block", "data"), "block").repartition(int(tasks), "block", "part").select("keys", "data")

    def fetch(batches):
        files = _Files()
        for batch in batches:
            for keys, data in zip(batch.column("keys").to_pylist(), batch.column("data").to_pylist(), strict=True):
                lines = zlib.decompress(data).decode().split("\n")
                rows, room = [], 0
                for line in _lines_of(lines, keys):
                    found = parse(zlib.decompress(files.read(line["path"], line["offset"], line["length"]), 31))
                    refers = found["headers"].get("X-Refers-To-Capture")
                    rows.append(
                        (
                            line["capture"], line["url"], found["headers"]["WARC-Type"],
                            found["headers"]["WARC-Payload-Digest"].removeprefix("sha256:"), found["payload_bytes"],
                            found["payload"], int(refers) if refers else None,
                        )
                    )
                    room += line["length"]
                    if room > 1 << 20:
                        yield _batch(rows)
                        rows, room = [], 0
                yield _batch(rows)
        files.close()

    return placed.mapInArrow(fetch, RECORD)


def _lines_of(lines: list[str], keys: list[str]):
    """The index lines of the keys, in the order of their records in the archives."""
    hits = []
    for key in keys:
        at = bisect.bisect_left(lines, key, key=_line_key)
        while at < len(lines) and _line_key(lines[at]) == key:
            hits.append(json.loads("{" + lines[at].split(" {", 1)[1]))
            at += 1
    return sorted(hits, key=lambda x: (x["path"], x["offset"]))


def _line_key(line: str) -> str:
    return line.split(" {", 1)[0]


class _Files:
    """Archives a task has open, a few at a time, for range reads."""

    def __init__(self, most: int = 32) -> None:
        self.most, self.open = most, {}

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            system, name = _open(path)
            self.open[path] = system.open_input_file(name)
        self.open[path].seek(offset)
        return self.open[path].read(length)

    def close(self) -> None:
        for file in self.open.values():
            file.close()


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "archives")


def plain_id(column: str):
    return F.when(F.col(column) != LEAST, F.col(column))
