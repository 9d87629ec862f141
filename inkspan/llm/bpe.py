"""Byte-level BPE encoding and decoding with the tokenizers library.

The vocabulary comes from a file of ranks. A text is split by the public pattern (see ``splitter``); each match is
merged on its own, so equal matches have equal ids and are merged once while a worker remembers them.
Ids are kept packed as little-endian unsigned 32-bit integers.

Byte-level BPE works on a printable stand-in character for each byte. A token may end inside a
character: offsets name the characters a token touches, and decoding joins the bytes of all tokens
before it makes characters of them.

Defined cases: a null or empty text has no ids. Decoding null gives no bytes; bytes that are not
UTF-8 become replacement characters in the decoded text, and stay as they are in the decoded bytes.
An id outside the vocabulary fails the task. Computed columns replace columns of their name.
"""

from __future__ import annotations

import base64
import json
from functools import cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from inkspan.llm.frames import append_columns, column, pack, parts
from inkspan.llm.splitter import encoder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

PART_BYTES = 1 << 19  # of texts encoded at once, but for longer ones


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def stand_ins() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def printable(ranks: dict[bytes, int]) -> dict[str, int]:
    """The ranks by the stand-ins of each token's bytes."""
    char = stand_ins()
    return {"".join(char[b] for b in token): rank for token, rank in ranks.items()}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes ``token``: merge by rank until two are left."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        joined = [ranks.get(a + b, len(ranks)) for a, b in pairwise(parts)]
        k = joined.index(min(joined))
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


def model_json(ranks: dict[bytes, int]) -> str:
    """The ranks as a tokenizer of the tokenizers library (without its own splitting)."""
    vocab = printable(ranks)
    name = dict(zip(ranks, vocab, strict=True))
    merges = [
        [name[part] for part in _last_merge(token, ranks)]
        for token in sorted(ranks, key=ranks.__getitem__)
        if len(token) > 1
    ]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps(
        {
            "version": "1.0",
            "pre_tokenizer": level,
            "decoder": level,
            "model": {"type": "BPE", "vocab": vocab, "merges": merges},
        }
    )


@cache
def vocabulary(path: str) -> str:
    return model_json(read_ranks(path))


class _Bytes:
    """Bytes of each id, to join by index arithmetic."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray) -> bytes:
        length = self.length[ids]
        end = np.cumsum(length)
        at = np.repeat(self.start[ids] - (end - length), length)
        return self.data[at + np.arange(len(at))].tobytes()


def _ids(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", "<u4")


def _table(path: str) -> _Bytes:
    """The byte table, reversed: each token's characters back to the bytes they stand for."""
    back = {char: byte for byte, char in enumerate(stand_ins())}
    return _Bytes({bytes(map(back.__getitem__, token)): k for token, k in printable(read_ranks(path)).items()})


def _encoded(tokens, batch: pa.RecordBatch, text_column: str) -> tuple[np.ndarray, bytes]:
    """How many ids each row has, and all ids packed."""
    sizes, ids = [np.zeros(0, np.int64)], []
    for part in parts([batch], text_column, PART_BYTES):
        found, size = tokens.encode([t or "" for t in column(part, text_column).to_pylist()])
        sizes.append(size)
        ids.append(found.astype("<u4").tobytes())
    return np.concatenate(sizes), b"".join(ids)


def _binary(ends: np.ndarray, data: bytes) -> pa.Array:
    """A binary column from its rows one after the other; ``ends`` begins with 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def encode(docs: DataFrame, text_column: str = "text", path: str = RANKS) -> DataFrame:
    """``docs`` with n_tokens and ids (packed)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # the vocabulary's size

    def make():
        tokens = encoder(shared.value)

        def compute(batch):
            sizes, ids = _encoded(tokens, batch, text_column)
            return [pa.array(sizes, pa.int64()), _binary(4 * np.concatenate([[0], np.cumsum(sizes)]), ids)]

        return compute

    return append_columns(docs, make, "n_tokens long, ids binary")


def round_trip(docs: DataFrame, text_column: str = "text", path: str = RANKS) -> DataFrame:
    """``docs`` with n_tokens, ids (packed) and decoded (the bytes these ids decode to), in one pass of one worker a task."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((vocabulary(path), _table(path)))  # the vocabulary's size

    def make():
        text, table = shared.value
        tokens = encoder(text)

        def compute(batch):
            sizes, ids = _encoded(tokens, batch, text_column)
            ends = 4 * np.concatenate([[0], np.cumsum(sizes)])
            decoded = [table.join(_ids(ids[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            return [pa.array(sizes, pa.int64()), _binary(ends, ids), pack(decoded)]

        return compute

    return append_columns(docs, make, "n_tokens long, ids binary, decoded binary")


def decode(docs: DataFrame, ids_column: str = "ids", path: str = RANKS) -> DataFrame:
    """``docs`` with decoded (bytes) and decoded_text."""
    shared = docs.sparkSession.sparkContext.broadcast(_table(path))  # the vocabulary's size

    def make():
        table = shared.value

        def compute(batch):
            found = [table.join(_ids(x)) for x in column(batch, ids_column).to_pylist()]
            return [pack(found), pa.array([x.decode("utf-8", "replace") for x in found], pa.string())]

        return compute

    return append_columns(docs, make, "decoded binary, decoded_text string")


def offsets(docs: DataFrame, ids_column: str = "ids", path: str = RANKS) -> DataFrame:
    """``docs`` with starts and ends: the code points each token touches, in the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(_table(path))  # the vocabulary's size

    def make():
        table = shared.value

        def compute(batch):
            starts, ends = [], []
            for packed in column(batch, ids_column).to_pylist():
                ids = _ids(packed)
                stop = np.cumsum(table.length[ids])
                begin = stop - table.length[ids]
                data = np.frombuffer(table.join(ids), np.uint8)
                char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
                starts.append(char[begin].tolist() if len(ids) else [])
                ends.append((char[stop - 1] + 1).tolist() if len(ids) else [])
            kind = pa.list_(pa.int32())
            return [pa.array(starts, kind), pa.array(ends, kind)]

        return compute

    return append_columns(docs, make, "starts array<int>, ends array<int>")
