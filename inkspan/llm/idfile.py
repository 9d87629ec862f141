"""Token ids in files of word-aligned packed integers (Simple-8b), written and read back.

Texts are encoded by the tokenizers library; each document's ids end with ``END_ID``. Documents stand in ascending order
of id over all files. A file is a stream of ids in blocks of ``BLOCK`` ids (the last may be shorter), each packed on its
own into 64-bit words. A word's lowest 4 bits are its selector, which says how many ids of how many bits fill the
other 60 bits, the first id lowest. Selectors (fixed): see ``COUNTS`` and ``WIDTHS``; an id too wide for any packing stands
alone in a word of selector ``ESCAPE``. In the last word of a block, places beyond its ids are zero.

    header   8 bytes  b"IDS8B\\0\\0\\1"
    blocks   words, little-endian unsigned 64 bits
    offsets  blocks + 1 words: where each block begins, in words
    keys     documents x signed 64 bits: ids of the documents
    sizes    documents x unsigned 64 bits: how many ids each has, the end id included
    footer   6 words: blocks, documents, ids, ids per block, crc32 of offsets, keys and sizes, b"IDS8B\\0\\0\\1"

A block is found by its offset alone, and all blocks of a read are unpacked at once, one selector after the other.

Each task writes files of at most about ``FILE_IDS`` ids into the shared folder; a file is named after the attempt that
wrote it and counts only if the staged manifest names it, so a lost executor leaves at most a file that nobody reads.

Defined cases: a null or empty text has only the end id. A null document id comes before all others. Rows that repeat
an id are documents of their own, in the order of their texts' hash. Special tokens written out in a text are
ordinary text. Extra columns are not read. No documents give no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.llm.frames import LEAST, bounded_batches, key_or_least, parts, stage
from inkspan.llm.splitter import encoder
from inkspan.llm.warc import _open
from inkspan.sources.staging import new_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2

BLOCK = 1024
FILE_IDS = 1 << 24
PART_BYTES = 1 << 19  # of texts encoded at once, but for longer ones
WINDOW_BLOCKS = 64  # blocks unpacked at once when reading
MAGIC = b"IDS8B\0\0\1"

# Fixed values of the format, by selector: ids in a word, and bits of each.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15  # the next word holds one id of 64 bits

_U = np.uint64


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits each id needs, at least 1."""
    if ids.max() < 1 << 53:  # exact as a float: its exponent tells
        return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.int8)
    out = np.ones(len(ids), np.int8)
    for width in range(1, 64):
        out += ids >= _U(1) << _U(width)
    return out


def _steps(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the selector of a word that begins there and the ids it takes: the most that fit, block borders kept.

    A selector also fits where fewer ids than it holds are left in the block.
    """
    total = len(ids)
    need = _bits(ids)
    least, most = need.min(), need.max()
    selector = np.full(total, ESCAPE, np.int8)
    left = np.minimum(block - np.arange(total) % block, total - np.arange(total))
    ends = np.flatnonzero(left < COUNTS[0])  # places near the end of a block, looked at one by one below
    for k in range(len(COUNTS) - 1, -1, -1):
        count, width = COUNTS[k], WIDTHS[k]
        if width < least:
            break  # no id is so small
        if width >= most:  # all ids are
            selector[:] = k
            continue
        wide = np.zeros(total + 1, np.int32)
        np.cumsum(need > width, out=wide[1:])
        if total > count:
            fits = wide[count:] == wide[:-count]
            np.putmask(selector[: len(fits)], fits, k)
        reach = ends + np.minimum(left[ends], count)
        selector[ends[wide[reach] == wide[ends]]] = k
    return selector, np.minimum(np.array([*COUNTS, 0, 1], np.int32)[selector], left)


def pack_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks and the word offset of each block (and the end). All blocks are packed side by side."""
    ids = np.asarray(ids, _U)
    if not len(ids):
        return np.zeros(0, "<u8"), np.zeros(1, np.int64)
    selector, taken = _steps(ids, block)
    at = np.arange(0, len(ids), block)
    stop = np.minimum(at + block, len(ids))
    blocks, begins = len(at), np.zeros(len(ids), bool)
    while len(at):
        begins[at] = True
        at = at + taken[at]
        going = at < stop
        at, stop = at[going], stop[going]
    begin = np.flatnonzero(begins)
    kind = selector[begin]
    width = 1 + (kind == ESCAPE)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), _U)
    words[place] = kind.astype(_U)
    for k, (count, bits) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(kind == k)
        first, held = begin[mine], taken[begin[mine]]
        for j in range(count if len(mine) else 0):
            has = held > j
            words[place[mine[has]]] |= ids[first[has] + j] << _U(4 + j * bits)
    alone = kind == ESCAPE
    words[place[alone] + 1] = ids[begin[alone]]
    per_block = np.bincount(begin // block, width, blocks).astype(np.int64)
    return words.astype("<u8"), np.concatenate([[0], np.cumsum(per_block)])


def unpack_blocks(words: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids of consecutive blocks: their words, offsets (relative to the first word) and numbers of ids."""
    words = np.asarray(words, _U)
    kind = (words & _U(15)).astype(np.int8)
    # A word after an escape holds a value, whatever its lowest bits are. Escapes follow each other in runs at most
    # where values are wide, so they are walked one by one only there.
    value = np.zeros(len(words) + 1, bool)
    for k in np.flatnonzero(kind == ESCAPE):
        if not value[k]:
            value[k + 1] = True
    head = np.flatnonzero(~value[: len(words)])
    kind = kind[head]
    counts = np.array([*COUNTS, 0, 1])[kind]
    # The last word of a block may hold fewer ids than its selector says.
    block = np.searchsorted(offsets, head, "right") - 1
    total = np.bincount(block, counts, len(sizes)).astype(np.int64)
    last = np.searchsorted(head, offsets[1:]) - 1
    counts[last] -= (total - sizes)[block[last]]
    start = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), _U)
    for k, (count, bits) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(kind == k)
        if not len(mine):
            continue
        found = (words[head[mine]][:, None] >> (_U(4) + _U(bits) * np.arange(count, dtype=_U))) & _U((1 << bits) - 1)
        inside = np.arange(count) < counts[mine][:, None]
        out[(start[mine][:, None] + np.arange(count))[inside]] = found[inside]
    alone = np.flatnonzero(kind == ESCAPE)
    out[start[alone]] = words[head[alone] + 1]
    return out


class Writer:
    """One file: ids come in runs of documents and leave in whole blocks, so memory holds a few blocks and the index."""

    def __init__(self, stream, block: int = BLOCK) -> None:
        self.stream, self.block = stream, block
        self.rest = np.zeros(0, _U)
        self.offsets, self.keys, self.sizes, self.ids = [np.zeros(1, np.int64)], [], [], 0
        stream.write(MAGIC)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys.astype("<i8"))
        self.sizes.append(sizes.astype("<u8"))
        self.ids += len(ids)
        held = np.concatenate([self.rest, ids.astype(_U)])
        whole = len(held) // self.block * self.block
        self._blocks(held[:whole])
        self.rest = held[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        if len(ids):
            words, offsets = pack_blocks(ids, self.block)
            self.stream.write(words.tobytes())
            self.offsets.append(offsets[1:] + self.offsets[-1][-1])

    def close(self) -> None:
        self._blocks(self.rest)
        offsets = np.concatenate(self.offsets).astype("<u8")
        parts = [offsets.tobytes(), *[np.concatenate(x).tobytes() if x else b"" for x in (self.keys, self.sizes)]]
        crc = zlib.crc32(b"".join(parts))
        documents = sum(map(len, self.keys))
        self.stream.write(b"".join(parts))
        self.stream.write(struct.pack("<5Q", len(offsets) - 1, documents, self.ids, self.block, crc) + MAGIC)


class Reader:
    """One file opened for range reads: the index at its end, then any run of blocks."""

    def __init__(self, file) -> None:
        self.file = file
        end = file.size()
        file.seek(end - 48)
        *numbers, magic = struct.unpack("<5Q8s", file.read(48))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        blocks, documents, self.ids, self.block, crc = numbers
        size = 8 * (blocks + 1 + 2 * documents)
        file.seek(end - 48 - size)
        index = file.read(size)
        if zlib.crc32(index) != crc:
            raise ValueError("the index of a file of packed ids is damaged")
        self.offsets = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        self.keys = np.frombuffer(index, "<i8", documents, 8 * (blocks + 1))
        self.sizes = np.frombuffer(index, "<u8", documents, 8 * (blocks + 1 + documents)).astype(np.int64)

    def blocks(self, first: int, stop: int) -> np.ndarray:
        """Ids of the blocks from ``first`` to before ``stop``."""
        a, b = self.offsets[first], self.offsets[stop]
        self.file.seek(8 + 8 * int(a))
        words = np.frombuffer(self.file.read(8 * int(b - a)), "<u8")
        at = np.arange(first, stop) * self.block
        return unpack_blocks(words, self.offsets[first : stop + 1] - a, np.minimum(self.block, self.ids - at))

    def documents(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Number of each document and its ids, in runs as they were read."""
        stops = np.cumsum(self.sizes)
        doc, at, held = 0, 0, []
        for first in range(0, len(self.offsets) - 1, WINDOW_BLOCKS):
            ids = self.blocks(first, min(first + WINDOW_BLOCKS, len(self.offsets) - 1))
            begin = 0
            for stop in stops[doc : np.searchsorted(stops, at + len(ids), "right")].tolist():
                held.append(ids[begin : stop - at])
                yield doc, held
                doc, begin, held = doc + 1, stop - at, []
            if begin < len(ids):
                held.append(ids[begin:])
            at += len(ids)


def write(
    docs: DataFrame,
    folder: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    path: str = TOKENIZER,
    end_id: int = END_ID,
    partitions: int | None = None,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode all texts and write the files below ``folder``; returns the staged manifest.

    Columns: part and file (their order is that of the documents), path, documents, ids, bytes. Documents are
    range-partitioned by id, and by text hash where ids repeat, so no id makes a partition too large.
    """
    spark = bounded_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # the tokenizer's size, whatever the input
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.select(key_or_least(id_column).alias("key"), F.xxhash64(text).alias("tie"), text.alias("body"))
    order = ["key", "tie"]
    dealt = keyed.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        tokens, part = encoder(vocabulary.value), TaskContext.get().partitionId()
        writer, stream, count, rows = None, None, 0, []

        def close():
            writer.close()
            rows.append((part, count, name_of, sum(map(len, writer.keys)), writer.ids, stream.tell()))
            stream.close()

        for batch in parts(batches, "body", PART_BYTES):
            ids, sizes = tokens.encode(batch.column("body").to_pylist(), end_id)
            keys, stops, first = batch.column("key").to_numpy(), np.cumsum(sizes), 0
            while first < len(keys):
                if writer is None:
                    name_of = f"{folder}/ids-{uuid.uuid4().hex}.ids8b"
                    system, name = _open(name_of)
                    system.create_dir(name.rsplit("/", 1)[0])
                    stream = system.open_output_stream(name, compression=None)
                    writer = Writer(stream)
                # Up to the document that fills the file.
                begin = stops[first - 1] if first else 0
                stop = min(int(np.searchsorted(stops, file_ids - writer.ids + begin)) + 1, len(keys))
                writer.add(keys[first:stop], sizes[first:stop], ids[begin : stops[stop - 1]])
                first = stop
                if writer.ids >= file_ids:
                    close()
                    writer, count = None, count + 1
        if writer is not None:
            close()
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3]
        names = ["part", "file", "path", "documents", "ids", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return stage(dealt.mapInArrow(run, "part int, file int, path string, documents long, ids long, bytes long"), "idfiles")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids of all files before it. Sums per partition first, so that one task adds up only as
    many numbers as there are partitions."""
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(over), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("ids").over(inside), F.lit(0))
    return manifest.withColumn("own", own).join(parts, "part").select(
        *manifest.columns, (F.col("before") + F.col("own")).alias("start")
    )


def read(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the files, one file per task at a time: key, start, n_tokens, ids_crc32 and, if wanted, ids (packed).

    ``start`` counts the ids of all documents before it. Ids are unsigned 32-bit integers, little-endian, when packed.
    """
    spark: SparkSession = bounded_batches(manifest.sparkSession)
    files = with_starts(manifest)
    count = max(1, manifest.count())

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as file:
                    reader = Reader(file)
                    keys, starts = reader.keys, start + np.cumsum(reader.sizes) - reader.sizes
                    first, crcs, bodies, room = 0, [], [], 0
                    for doc, runs in reader.documents():
                        data = [x.astype("<u4").tobytes() for x in runs]
                        crc = 0
                        for piece in data:
                            crc = zlib.crc32(piece, crc)
                        crcs.append(crc)
                        if with_ids:
                            bodies.append(b"".join(data))
                            room += len(bodies[-1])
                        if room > 4 << 20 or len(crcs) == 10_000:
                            yield rows(keys, starts, reader.sizes, first, crcs, bodies)
                            first, crcs, bodies, room = doc + 1, [], [], 0
                    yield rows(keys, starts, reader.sizes, first, crcs, bodies)

    def rows(keys, starts, sizes, first, crcs, bodies):
        part = slice(first, first + len(crcs))
        columns = [pa.array(x[part].astype(np.int64)) for x in (keys, starts, sizes)] + [pa.array(crcs, pa.int64())]
        names = ["key", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            columns, names = [*columns, pa.array(bodies, pa.binary())], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    ddl = "key long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    dealt = files.select("path", "start").repartition(min(count, 4 * spark.sparkContext.defaultParallelism + count // 8), "path")
    return dealt.mapInArrow(run, ddl)


def plain_key(name: str = "key") -> Column:
    """The id itself; null for documents without one."""
    return F.when(F.col(name) != LEAST, F.col(name))


def archive_folder(spark: SparkSession) -> str:
    return new_path(spark, "idfiles-data")
