"""License notices in texts, exact and with a few wrong characters.

A text is read as words (runs of digits, letters and non-ASCII characters, A-Z lower-cased) joined by
single spaces. Base phrases count where their words stand exactly. Short notices may also be
misspelt: a notice of ``n`` characters may have ``k = n // EVERY`` edits. It is cut into ``k + 1``
pieces, at least one of which is then intact, so an Aho-Corasick search for the pieces finds every candidate
place; there the regex library's bounded-error matching decides and gives the span and the edits.

Defined cases: null and empty texts have no words, no notices and score 0. Repeated rows are read one
by one. Computed columns replace columns of their name.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkspan.llm.frames import append_columns, column
from inkspan.llm.wordhash import NOT_ALNUM

# Fixed base phrases and labels.
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Notices that are also looked for with errors.
NOTICES = (
    *BASE[1:],
    ("apache license version", "apache"),
    ("licensed under the apache license", "apache"),
    ("permission is hereby granted free of charge", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("lesser general public license", "lgpl"),
    ("eclipse public license", "epl"),
    ("public domain dedication", "public-domain"),
    ("spdx license identifier", "spdx"),
)

EVERY = 10  # characters of a notice for each edit allowed

_FOLD = bytearray(range(256))
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
for _c in np.flatnonzero(NOT_ALNUM):
    _FOLD[_c] = 0x20
FOLD = bytes(_FOLD)

WINDOW = 8  # longest reaches of a notice that are searched at once


def budget(notice: str) -> int:
    return len(notice) // EVERY


class Notices:
    """The search over folded texts, taken as one character per byte."""

    def __init__(self, notices: tuple[tuple[str, str], ...]) -> None:
        self.notices, self.patterns = notices, []
        self.machine = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, _) in enumerate(notices):
            parts = budget(notice) + 1
            cuts = [len(notice) * p // parts for p in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(notice[a:b], []).append((k, a))
            fuzzy = rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={budget(notice)}}}(?![^ ])"
            self.patterns.append(regex.compile(fuzzy))
        for piece, uses in pieces.items():
            self.machine.add_word(piece, (len(piece), uses))
        self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """start, end, notice and edits of places that do not overlap within a notice."""
        windows: dict[int, list[list[int]]] = {}
        for last, (length, uses) in self.machine.iter(text):
            for k, offset in uses:
                notice, _ = self.notices[k]
                edits = budget(notice)
                start = last + 1 - length - offset
                low = max(0, start - 2 * edits - 1)
                high = min(len(text), start + len(notice) + 2 * edits + 1)
                own = windows.setdefault(k, [])
                if own and low <= own[-1][1]:
                    own[-1] = [min(low, own[-1][0]), max(high, own[-1][1])]
                else:
                    own.append([low, high])
        found = []
        for k, own in windows.items():
            for low, high in own:
                found += self._stretch(k, text, low, high)
        return found

    def _stretch(self, k: int, text: str, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """Places in a stretch of any length, window by window.

        A place that begins so near a window's end that it may go on behind it is left to the next window.
        """
        reach = len(self.notices[k][0]) + 2 * budget(self.notices[k][0]) + 2
        found, at = [], low
        while at < high:
            stop = min(high, at + WINDOW * reach)
            places = self._window(k, text, at, stop)
            safe = stop - reach if stop < high else high
            places = [p for p in places if p[0] < safe]
            found += places
            at = max([safe, *(p[1] for p in places)])
        return found

    def _window(self, k: int, text: str, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """The best place comes first; what is before and after it is searched as well."""
        open_parts, places = [(low, high)], []
        while open_parts:
            a, b = open_parts.pop()
            hit = self.patterns[k].search(text, a, b)
            if not hit or hit.end() == hit.start():
                continue
            open_parts += [(a, hit.start()), (hit.end(), b)]
            start = hit.start() + len(hit[0]) - len(hit[0].lstrip(" "))
            end = hit.start() + len(hit[0].rstrip(" "))
            if start < end:
                places.append((start, end, k, sum(hit.fuzzy_counts)))
        return sorted(places)


SPANS = "array<struct<label:string,first_word:long,last_word:long,start:int,end:int,edits:int>>"
_KIND = pa.struct(
    [("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]
)


def base_places(folded: bytes) -> list[tuple[int, str]]:
    """Byte place and label of each base phrase in a folded text with a space at both ends."""
    out = []
    for phrase, label in BASE:
        wanted = b" " + phrase.encode() + b" "
        at = folded.find(wanted)
        while at >= 0:
            out.append((at, label))
            at = folded.find(wanted, at + 1)
    return out


def _char_spans(data: bytes, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the first and the end of the last of each pair of words."""
    filled = np.frombuffer(data, np.uint8)
    inside = ~NOT_ALNUM[filled]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(~inside & before)
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    chars = np.concatenate([[0], np.cumsum((filled & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[ends[b]])) for a, b in words]


def detect(docs: DataFrame, text_column: str = "text", notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """``docs`` with n_words, base (word places and labels), notices (spans with edits) and score.

    ``score`` is the best share of a notice's characters that is right: 1 with a base phrase.
    """

    def make():
        search = Notices(notices)

        def compute(batch):
            words, bases, spans, scores = [], [], [], []
            for data in column(batch, text_column).cast(pa.binary()).to_pylist():
                split = (data or b"").translate(FOLD).split()
                folded = b" " + b" ".join(split) + b" "
                words.append(len(split))
                base = [{"word": folded.count(b" ", 0, at), "label": label} for at, label in base_places(folded)]
                found, best = [], 1.0 if base else 0.0
                hits = search.find(folded.decode("latin-1"))
                if hits:
                    places = [(folded.count(b" ", 0, a) - 1, folded.count(b" ", 0, b) - 1) for a, b, _, _ in hits]
                    points = _char_spans(data, places)
                    for (_, _, k, edits), (first, last), (a, b) in zip(hits, places, points, strict=True):
                        notice, label = notices[k]
                        found.append({"label": label, "first_word": first, "last_word": last, "start": a, "end": b, "edits": edits})
                        best = max(best, 1 - edits / len(notice))
                bases.append(base)
                spans.append(found)
                scores.append(best)
            place = pa.struct([("word", pa.int64()), ("label", pa.string())])
            return [
                pa.array(words, pa.int64()), pa.array(bases, pa.list_(place)),
                pa.array(spans, pa.list_(_KIND)), pa.array(scores, pa.float64()),
            ]

        return compute

    return append_columns(
        docs, make, f"n_words long, base array<struct<word:long,label:string>>, notices {SPANS}, score double"
    )
