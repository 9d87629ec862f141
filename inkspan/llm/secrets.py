"""Secrets in texts, also under nested encodings.

A worklist starts with the text. Each layer is scanned by the base rules; every run that looks encoded
(URL escapes; backslash, percent-u and HTML character references; hexadecimal bytes; base64; gzip, zlib, raw deflate
or bzip2 inside these) is decoded, and what is text in it joins the worklist, whatever bytes stand beside. It ends when no layer yields a new one:
layers already seen are not taken up again, so encodings that decode to each other end too. A hit in a decoded
layer is mapped back, through the runs it came from, to the outermost run of the original text.

Decoded layers are taken up one after the other, so memory holds one chain of them at a time. Compressed
content is read in pieces of ``PIECE`` bytes that overlap by ``OVERLAP``, whatever it grows to.

Defined cases: null and empty texts have no spans; repeated rows are scanned one by one; computed
columns replace columns of their name. Spans count code points, end exclusive.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.llm.frames import append_columns, column, fresh_name

# Fixed patterns of the base rules.
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")

# Runs that may be encoded.
URL_RUN = re.compile(rb"[A-Za-z0-9_.~+/=:&?%-]+")
URL_CODE = re.compile(rb"%[0-9A-Fa-f]{2}")
ESCAPED_RUN = re.compile(rb"[!-~]+")
# Base64, also wrapped: single line breaks (real ones or written \n) and indents are left out. It may follow '=',
# which only ends such a run. Other data may stand before it in one run, so all four offsets are read.
BREAK = re.compile(rb"\r?\n[\x20\t]*|(?:\\r)?\\n")
BASE64 = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+(?:(?:%s)[A-Za-z0-9+/_-]+)*={0,2}" % BREAK.pattern)
LEAST_RUN = 16
SEPARATOR = re.compile(rb"[/_+-]+")
# Character references; the last group is decimal.
ESCAPE = re.compile(
    rb"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}|%u([0-9A-Fa-f]{4})"
    rb"|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
HEX_RUN = re.compile(rb"(?:[0-9A-Fa-f]{2}){16,}")
BZIP = b"BZh"
NOT_TEXT = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]")
# ASCII text, and such text in UTF-16; no secret has fewer than 14 characters. All rules are on ASCII, so any other byte
# only separates.
TEXT = re.compile(rb"[\t-\r -~]{14,}")
WIDE = re.compile(rb"(?:\x00[\t-\r -~]){14,}|(?:[\t-\r -~]\x00){14,}")
PACKED = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY")

PIECE, OVERLAP = 16 << 20, 64 << 10
CHUNK = 256 << 10  # compressed bytes read at once


def scan(data: bytes) -> list[tuple[str, int, int]]:
    """Base spans of one layer, in bytes: leftmost, not overlapping within a kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(data) if len(m[2]) >= 8]
    if b"AKIA" in data:
        found += [("access", *m.span()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(data)]
    return found


def _printable(data: bytes) -> bool:
    if NOT_TEXT.search(data):
        return False
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _readable(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """What can hold a secret: the data if it has text, and its stretches of UTF-16 text."""
    if TEXT.search(data):
        yield 0, len(data), data
    for m in WIDE.finditer(data):
        yield *m.span(), m[0].replace(b"\0", b"")


class _Bzip:
    """A bzip2 reader with the ways of a zlib one: what was read but not used yet is handed back with the next call."""

    def __init__(self) -> None:
        self.reader, self.unconsumed_tail = bz2.BZ2Decompressor(), b""

    eof = property(lambda self: self.reader.eof)
    unused_data = property(lambda self: self.reader.unused_data)

    def decompress(self, chunk: bytes, room: int) -> bytes:
        try:
            part = self.reader.decompress(b"" if chunk == b"more" else bytes(chunk), max(1, room))
        except (OSError, EOFError) as error:
            raise zlib.error(str(error)) from error
        self.unconsumed_tail = b"" if self.reader.eof or self.reader.needs_input else b"more"
        return part

    def flush(self) -> bytes:
        return b""


def _reader(data: memoryview, begin: int, raw: bool):
    if raw:
        return zlib.decompressobj(-15)
    return _Bzip() if bytes(data[begin : begin + 3]) == BZIP else zlib.decompressobj(47)


def _inflated(data: bytes, begin: int, raw: bool = False) -> Iterator[tuple[int, bytes]]:
    """Content in pieces of the compressed data from ``begin`` on, and how far it was read.

    Members that follow at once are read as one content. ``raw`` data (deflate without a header) count only as a whole, as
    any bytes may begin like them.
    """
    view, at, rest, kept, fresh = memoryview(data), begin, b"", b"", []
    reader = _reader(view, begin, raw)
    more, room = True, PIECE
    while more:
        chunk = rest or view[at : at + CHUNK]
        if not rest:
            at += len(chunk)
        try:
            part = reader.decompress(chunk, room) if len(chunk) else reader.flush()
        except zlib.error:
            at, part, more = begin + 1, b"", False
            if raw:
                return
        else:
            rest, more = reader.unconsumed_tail, bool(len(chunk))
            if reader.eof:
                at -= len(reader.unused_data)
                rest, more = b"", not raw and PACKED.match(view, at) is not None
                if more:
                    begin, reader = at, _reader(view, at, raw)
            elif raw and not more:
                return
        if part:
            fresh.append(part)
            room -= len(part)
        if fresh and (room <= 0 or not more):
            whole = b"".join([kept, *fresh])
            fresh, room, kept = [], PIECE, whole[-OVERLAP:]
            yield at, whole


def _contents(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Place and content, in pieces, of everything compressed in the data."""
    read, found = 0, False
    for m in PACKED.finditer(data):
        if m.start() < read:
            continue
        for read, piece in _inflated(data, m.start()):
            found = True
            yield m.start(), max(read, m.end()), piece
    if not found:
        for read, piece in _inflated(data, 0, raw=True):
            yield 0, read, piece


def _unescape(match: re.Match) -> bytes:
    number = int(match[match.lastindex], 10 if match.lastindex == ESCAPE.groups else 16)
    return chr(number if 0 < number < 0x110000 else 0xFFFD).encode("utf-8", "surrogatepass")


def _from_base64(body: bytes) -> bytes:
    body = body[: len(body) - 1] if len(body) % 4 == 1 else body
    return binascii.a2b_base64(body + b"=" * (-len(body) % 4))


def _base64_layers(start: int, run: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Text and compressed content in a run of base64 that stands at ``start``, read at all four offsets.

    If the run is text as a whole, or compressed from its first byte on, it is the place. Otherwise the place goes from
    the last separator before what was found to the next line end after it.
    """
    breaks = [m.span() for m in BREAK.finditer(run)]
    body = (BREAK.sub(b"", run) if breaks else run).rstrip(b"=")
    if len(body) < LEAST_RUN:
        return
    # Place in the run of each line, and of its first character among all of the body.
    begins = [0, *[b for _, b in breaks]]
    ends = [*[a for a, _ in breaks], len(run)]
    firsts = [0]
    for a, b in zip(begins, ends, strict=True):
        firsts.append(firsts[-1] + b - a)

    def place(low: int, high: int) -> tuple[int, int]:
        """From the last separator up to ``low`` to the first line end from ``high`` on, characters of the body."""
        line = bisect_right(firsts, low, 0, len(begins)) - 1
        first = begins[line]
        for m in SEPARATOR.finditer(run, first, first + low - firsts[line] + 1):
            first = min(m.end(), begins[line] + low - firsts[line])
        last = ends[min(bisect_left(firsts, high, 1), len(ends)) - 1]
        return start + first, start + last

    plainer = body.translate(bytes.maketrans(b"-_", b"+/"))
    for offset in range(4):
        plain = _from_base64(plainer[offset:] if offset else plainer)
        if not offset and _printable(plain):
            yield start, start + len(run), plain
            continue

        def spot(a: int, b: int) -> tuple[int, int]:
            return place(offset + a * 4 // 3, offset + -(-b * 4 // 3))  # noqa: B023

        for m in TEXT.finditer(plain):
            yield *spot(*m.span()), m[0]
        for m in WIDE.finditer(plain):
            yield *spot(*m.span()), m[0].replace(b"\0", b"")
        for low, high, piece in _contents(plain):
            whole = (start, start + len(run)) if not offset and not low else spot(low, high)
            for _, _, text in _readable(piece):
                yield *whole, text


def layers(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Decoded runs of one layer that have text: start, end and the decoded text."""
    if b"%" in data:
        for m in URL_RUN.finditer(data):
            if URL_CODE.search(m[0]):
                for _, _, plain in _readable(unquote_to_bytes(m[0])):
                    yield *m.span(), plain
    if b"\\" in data or b"%u" in data or b"&#" in data:
        for m in ESCAPED_RUN.finditer(data):
            if ESCAPE.search(m[0]):
                plain = ESCAPE.sub(_unescape, m[0]).decode("utf-8", "surrogatepass")
                plain = plain.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # joins pairs
                for _, _, found in _readable(plain.encode()):
                    yield *m.span(), found
    for m in HEX_RUN.finditer(data):
        plain = bytes.fromhex(m[0].decode())
        for _, _, found in _readable(plain):
            yield *m.span(), found
        for _, _, piece in _contents(plain):
            for _, _, found in _readable(piece):
                yield *m.span(), found
    for m in BASE64.finditer(data):
        if m.end() - m.start() >= LEAST_RUN:
            yield from _base64_layers(m.start(), m[0])


def find(data: bytes) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, int]]]:
    """Base spans of the text and spans of hits inside decoded layers with their depth, in bytes."""
    hidden, seen = [], set()
    work = [layers(data)]  # open layers, each waiting for its next decoded run
    outer = (0, 0)
    while work:
        following = next(work[-1], None)
        if following is None:
            work.pop()
            continue
        start, end, plain = following
        if len(work) == 1:
            outer = (start, end)
        key = (*outer, hashlib.sha256(plain).digest())
        if key not in seen:
            seen.add(key)
            hidden += [(kind, *outer, len(work)) for kind, _, _ in scan(plain)]
            work.append(layers(plain))
    return scan(data), hidden


def _points(data: bytes, spans: list[tuple]) -> list[tuple]:
    """Byte offsets as code points."""
    if data.isascii():
        return spans
    at = sorted({x for s in spans for x in s[1:3]})
    char, last, total = {}, 0, 0
    for x in at:
        total += len(data[last:x].decode("utf-8", "replace"))
        char[x] = total
        last = x
    return [(s[0], char[s[1]], char[s[2]], *s[3:]) for s in spans]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())])


def _spans(data: bytes) -> list[tuple[str, int, int, int]]:
    """All spans of a text with their depth, in bytes, without repeats."""
    base, hidden = find(data)
    spans = {(kind, a, b): 0 for kind, a, b in base}
    for kind, a, b, depth in sorted(hidden, key=lambda s: s[3]):
        spans.setdefault((kind, a, b), depth)
    return [(*key, depth) for key, depth in spans.items()]


def _listed(data: bytes, spans: list[tuple]) -> list[dict]:
    placed = sorted(_points(data, spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [{"kind": k, "start": a, "end": b, "depth": d} for k, a, b, d in placed]


def _masked(data: bytes, spans: list[tuple], mask: bytes) -> bytes:
    out, at = [], 0
    for _, start, end, _ in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [data[at:start], mask]
        at = max(at, end)
    return b"".join([*out, data[at:]])


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


SECRETS = "secrets array<struct<kind:string,start:int,end:int,depth:int>>"


def detect(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with secrets: spans with kind, start, end and depth (0: in the text itself), in span order."""

    def make():
        def compute(batch):
            return [pa.array([_listed(x, _spans(x)) for x in _texts(batch, text_column)], pa.list_(SPAN))]

        return compute

    return append_columns(docs, make, SECRETS)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the spans."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(docs: DataFrame, text_column: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones joined) replaced by ``mask``, and the secrets found.

    Texts without a secret, null ones too, stay as they are.
    """

    def make():
        def compute(batch):
            texts = _texts(batch, text_column)
            spans = [_spans(x) for x in texts]
            clean = [_masked(x, s, mask.encode()).decode("utf-8", "replace") if s else None for x, s in zip(texts, spans, strict=True)]
            listed = [_listed(x, s) for x, s in zip(texts, spans, strict=True)]
            return [pa.array(listed, pa.list_(SPAN)), pa.array(clean, pa.string())]

        return compute

    clean = fresh_name(docs, "_clean")
    found = append_columns(docs, make, f"{SECRETS}, {clean} string")
    text = F.coalesce(clean, F.col(text_column)).alias(text_column)
    return found.select(*[text if c == text_column else c for c in found.columns if c != clean])
