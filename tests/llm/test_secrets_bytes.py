"""Secrets beside bytes that are not text."""

import base64
import gzip
import zlib

import pytest

from inkspan.llm.secrets import PIECE, _spans

SECRET = b"token=abcdefgh12345"


def depths(text: bytes) -> list[int]:
    return [depth for _, _, _, depth in _spans(text) if depth]


@pytest.mark.parametrize("text", [b"q=caf%E9&token%3Dabcdefgh12345", b"a%00b&token%3Dabcdefgh12345", b"\\u0000\\u0074oken=abcdefgh12345"])
def test_one_odd_byte_does_not_hide_a_layer(text):
    assert depths(text) == [1]


@pytest.mark.parametrize("plain", [b"\0" + SECRET, SECRET + b"\xff", b"\x01\xfe\x80" + SECRET + b"\0\0"])
def test_binary_base64_is_scanned(plain):
    assert depths(base64.b64encode(plain))


@pytest.mark.parametrize("code", ["utf-16", "utf-16-le", "utf-16-be"])
def test_utf16_is_read(code):
    plain = ("é " + SECRET.decode() + " æ").encode(code)
    assert depths(base64.b64encode(plain))
    assert depths(base64.b64encode(gzip.compress(plain)))


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress])
def test_all_members_are_read(pack):
    assert depths(base64.b64encode(pack(b"first one\n") + pack(SECRET)))
    assert depths(base64.b64encode(pack(b"one " + SECRET[:9]) + pack(SECRET[9:])))
    assert depths(base64.b64encode(b"head" + pack(SECRET)))


def test_a_long_content_with_a_zero_byte():
    plain = b"some words " * 1000 + b"\0" + SECRET + b" more" * (PIECE // 5) + b"\0 api_key=" + b"z" * 20
    assert len(depths(base64.b64encode(gzip.compress(plain)))) == 1
    tail = b"more words\0" * (PIECE // 11 + 1000) + SECRET
    assert depths(base64.b64encode(gzip.compress(tail)))
