"""The public pattern's matches in a batch of texts by array operations, and token ids of equal matches looked up together.

The pattern cuts a text into contractions, runs of letters, of digits and of other signs, each with one space before it, and
runs of white space, of which a last character that is followed by something stays apart. These cuts follow from
the classes of neighbouring characters, so they are found for all characters of a batch at once. Matches are told
apart by a 64-bit hash from prefix sums; each kind of match is merged once by the tokenizers library while a worker
remembers it.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import regex

from inkspan.llm.wordhash import mix

OTHER, LETTER, DIGIT, SPACE = range(4)
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}  # fixed: contractions of the pattern
CHUNK = 1 << 18  # characters hashed at once
REMEMBERED = 1 << 19  # matches a worker remembers; beyond that it starts anew, which changes no result

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.zeros(0x110000, np.int8)
    for low in range(0, len(out), 1 << 12):  # a few at a time; surrogates are in no text
        text = "".join("\0" if 0xD800 <= k < 0xE000 else chr(k) for k in range(low, low + (1 << 12)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                out[low + m.start() : low + m.end()] = kind
    return out


@cache
def _values() -> np.ndarray:
    return np.random.default_rng(20_250_312).integers(1, 1 << 64, 0x110000, dtype=_U)


def match_starts(points: np.ndarray, row_ptr: np.ndarray) -> np.ndarray:
    """Where the matches begin in the code points of all rows (``row_ptr``: where each row begins, and the end)."""
    total = len(points)
    if not total:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.ones(total + 1, bool)
    first[1:-1] = kind[1:] != kind[:-1]
    rows = row_ptr[(row_ptr < total) & (np.append(np.diff(row_ptr), 0) > 0)]
    first[rows] = True
    border = np.zeros(total + 1, bool)  # a row begins here, or all end
    border[rows] = border[total] = True
    begin = np.flatnonzero(first)
    run, end = begin[:-1], begin[1:]
    # White space followed by something: its last character stands apart; a space goes with what follows.
    blank = end[(kind[run] == SPACE) & ~border[end]]
    first[blank - 1] = True
    attached = blank[points[blank - 1] == 32]
    first[attached] = False
    # A lone apostrophe without such a space, before letters.
    nxt = np.minimum(end, total - 1)
    lone = (points[run] == 39) & (end - run == 1) & first[run] & ~border[end] & (kind[nxt] == LETTER)
    at = run[lone]
    if len(at):
        stop = end[np.flatnonzero(lone) + 1]  # of the letters
        one, two = points[at + 1], np.where(at + 2 < stop, points[np.minimum(at + 2, total - 1)], 0)
        size = np.isin(one, [ord(c) for c in SHORT]).astype(np.int64)
        for a, b in LONG.items():
            size[(one == ord(a)) & (two == ord(b))] = 2
        found = size > 0
        first[at[found] + 1] = False
        cut = at[found] + 1 + size[found]
        first[cut[cut < stop[found]]] = True
    return np.flatnonzero(first[:-1])


def match_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), _U)
    k = 0
    while k < len(start):
        low = start[k]
        stop = max(k + 1, int(np.searchsorted(end, low + CHUNK, "right")))
        size = int(end[stop - 1] - low)
        power, inverse = _powers(max(size, CHUNK))
        sums = np.zeros(size + 1, _U)
        np.cumsum(_values()[points[low : low + size]] * power[:size], out=sums[1:])
        out[k:stop] = (sums[end[k:stop] - low] - sums[start[k:stop] - low]) * inverse[start[k:stop] - low]
        k = stop
    return mix(out)


@cache
def _base_powers() -> tuple[np.ndarray, np.ndarray]:
    return _cumulated(CHUNK)


def _cumulated(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(size, base, _U)
        powers[0] = 1
        both.append(np.cumprod(powers))
    return both[0], both[1]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _base_powers() if size == CHUNK else _cumulated(size)


class Encoder:
    """Ids of whole batches; what is remembered serves later batches."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.library = Tokenizer.from_str(vocabulary)
        self.library.encode_special_tokens = True  # written out in a text they are ordinary text
        # The matches come cut; only their bytes are mapped to characters.
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocab = self.library.get_vocab()
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id: one character a byte
        for token, k in vocab.items():
            self.length[k] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known, self.place, self.size = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _merge(self, matches: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches one after the other and how many each has; ``sizes`` are their bytes."""
        encoding = self.library.encode_batch_fast([matches], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(encoding.ids, np.uint32)
        stops = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(stops, prepend=0)

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with ``end_id`` at its end if there is one, and how many each has."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        row_ptr = np.cumsum([0, *map(len, texts)])
        start = match_starts(points, row_ptr)
        end = np.append(start[1:], len(points))
        kinds, first, which = np.unique(match_hashes(points, start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(kinds) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, kinds)
        new = np.ones(len(kinds), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != kinds[inside]
        if new.any():
            width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            upto = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
            low, high = start[first[new]], end[first[new]]
            matches = [whole[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            ids, size = self._merge(matches, upto[high] - upto[low])
            self.known = np.insert(self.known, at[new], kinds[new])
            self.place = np.insert(self.place, at[new], len(self.pool) + np.cumsum(size) - size)
            self.size = np.insert(self.size, at[new], size)
            self.pool = np.concatenate([self.pool, ids])
            at = at + np.cumsum(new) - new
        match = at[which]
        size = self.size[match].astype(np.int64)
        ends = np.searchsorted(start, row_ptr)
        upto = np.concatenate([[0], np.cumsum(size)])
        sizes = upto[ends[1:]] - upto[ends[:-1]]
        source = np.repeat(self.place[match] - upto[:-1], size) + np.arange(upto[-1])
        if end_id is None:
            return self.pool[source], sizes
        out = np.full(upto[-1] + len(texts), end_id, np.uint32)
        last = np.cumsum(sizes + 1) - 1
        body = np.ones(len(out), bool)
        body[last] = False
        out[body] = self.pool[source]
        return out, sizes + 1


@cache
def encoder(vocabulary: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(vocabulary)
