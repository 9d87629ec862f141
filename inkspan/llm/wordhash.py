"""64-bit hashes of all words of an Arrow text column, computed over its bytes without a loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes worked on at once: about 50 times as much memory is used meanwhile.
SEGMENT = 1 << 18

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

# Everything in ASCII but digits and letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
for _a, _z in ("09", "AZ", "az"):
    NOT_ALNUM[ord(_a) : ord(_z) + 1] = False

_U = np.uint64
_VALUES = np.random.default_rng(20_240_607).integers(0, 1 << 64, 256, dtype=_U) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@dataclass
class Words:
    """Words of a batch in order. ``row_ptr[i]:row_ptr[i + 1]`` are the words of row ``i``."""

    hash: np.ndarray
    start: np.ndarray
    row_ptr: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    prefixes: list[np.ndarray]

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_ptr) - 1), np.diff(self.row_ptr))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without a copy, and the offset of each row; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) else b"")
    _, at, values = texts.buffers()
    offsets = np.frombuffer(at, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray) -> list[int]:
    """Ends of segments of about SEGMENT bytes; none is inside a word."""
    cuts, at, total = [], 0, len(data)
    while at < total:
        end = at + SEGMENT
        while end < total:
            row = offsets[np.searchsorted(offsets, end, "right") - 1]
            gaps = np.flatnonzero(blank[data[max(at, row) : end]])
            cut = max(row, max(at, row) + gaps[-1] + 1 if len(gaps) else 0)
            if cut > at:
                end = int(cut)
                break
            end += SEGMENT
        at = min(end, total)
        cuts.append(at)
    return cuts


def words_of(
    texts: pa.Array, blank: np.ndarray = BLANKS, lower: bool = True, prefixes: tuple[int, ...] = ()
) -> Words:
    """Words (maximal runs of bytes that are not ``blank``) with hashes; A-Z count as a-z if ``lower``.

    ``prefixes`` also hashes the first so many bytes of each word.
    """
    data, offsets = text_bytes(texts)
    values = _VALUES.copy()
    if lower:
        values[65:91] = values[97:123]
    values[blank] = 0
    hashes, begins, heads = [], [], [[] for _ in prefixes]
    at = 0
    for end in _cuts(data, offsets, blank):
        part = data[at:end]
        gap = blank[part]
        first = ~gap
        first[1:] &= gap[:-1]
        rows = offsets[(offsets > at) & (offsets < end)] - at
        first[rows] = ~gap[rows]
        starts = np.flatnonzero(first)
        if len(starts):
            inside = np.arange(len(part)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
            np.maximum(inside, 0, out=inside)
            powers = np.ones(int(inside.max()) + 1, _U)
            powers[1:] = _BASE
            powers = np.cumprod(powers)
            worth = values[part] * powers[inside]
            hashes.append(np.add.reduceat(worth, starts))
            begins.append(starts + at)
            for k, n in enumerate(prefixes):
                heads[k].append(np.add.reduceat(np.where(inside < n, worth, _U(0)), starts))
        at = end
    empty = np.zeros(0, _U)
    start = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return Words(
        mix(np.concatenate(hashes) if hashes else empty),
        start,
        np.searchsorted(start, offsets),
        data,
        offsets,
        [mix(np.concatenate(h) if h else empty) for h in heads],
    )


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, rows not minded: run ``i`` starts at word ``i``."""
    out = np.zeros(max(0, len(words) - n + 1), _U)
    for k in range(n if len(out) else 0):
        out = out * _BASE + words[k : k + len(out)]
    return mix(out)


def char_index(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte (and the end) how many code points start before it, over the whole batch."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
