"""Character references, hexadecimal bytes and compressed layers without a usual header."""

import base64
import bz2
import random
import time
import zlib

import pytest

from inkspan.llm import secrets

HIDDEN = "password=hunter2hunter2"


def deflate(data):
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush()


CODES = {
    "decimal": "".join(f"&#{ord(c)};" for c in HIDDEN),
    "hexadecimal": "".join(f"&#x{ord(c):x};" for c in HIDDEN),
    "percent-u": "".join(f"%u{ord(c):04x}" for c in HIDDEN),
    "long": "".join(f"\\U{ord(c):08x}" for c in HIDDEN),
    "braces": "".join(f"\\u{{{ord(c):x}}}" for c in HIDDEN),
    "mixed": "".join(f"&#{ord(c)};" if k % 2 else f"\\x{ord(c):02X}" for k, c in enumerate(HIDDEN)),
    "hex": HIDDEN.encode().hex(),
    "upper hex": HIDDEN.encode().hex().upper(),
    "raw deflate": base64.b64encode(deflate(f"some text and {HIDDEN} here".encode())).decode(),
    "bzip2": base64.b64encode(bz2.compress(f"some text and {HIDDEN} here".encode())).decode(),
    "bzip2 in hex": bz2.compress(HIDDEN.encode()).hex(),
}
CODES["twice"] = base64.b64encode(CODES["decimal"].encode()).decode()
CODES["members"] = base64.b64encode(bz2.compress(b"nothing here at all") + bz2.compress(HIDDEN.encode())).decode()


@pytest.mark.parametrize("name", list(CODES))
def test_hidden_secrets_are_found(name):
    text = f"see {CODES[name]} end".encode()
    _, hidden = secrets.find(text)
    assert ("assign", 4, 4 + len(CODES[name])) in {h[:3] for h in hidden}


def test_numbers_that_are_no_characters():
    for text in ("&#99999999; &#0; &#xFFFFFF; \\UFFFFFFFF \\u{110000} %uD800 abc=def", "&#1114112;" * 30):
        assert secrets.find(text.encode())[1] == []


def test_large_contents_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 5_000)
    monkeypatch.setattr(secrets, "OVERLAP", 100)
    monkeypatch.setattr(secrets, "CHUNK", 700)
    rng = random.Random(1)
    filler = "".join(rng.choices("abcdef \n", k=40_000))
    for pack in (bz2.compress, zlib.compress, deflate):
        data = pack(f"{filler} {HIDDEN} {filler}".encode())
        text = b"x " + base64.b64encode(data) + b" y"
        assert {h[0] for h in secrets.find(text)[1]} >= {"assign"}


def test_long_runs_of_nothing_take_linear_time():
    def seconds(n):
        text = ("&#65;" * n + " " + "ab" * n + " " + "\\u0041" * n).encode()
        begin = time.perf_counter()
        secrets.find(text)
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.01)
