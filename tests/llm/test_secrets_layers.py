"""Secrets in encoded runs: where a run begins and ends, and what stands beside the text in it."""

import base64
import gzip
import textwrap
import zlib

import pytest

from inkspan.llm.secrets import _masked, _spans, find

SECRET = b"password=hunter2hunter2"
RUN = base64.b64encode(SECRET)
LONG = b"".join(b"line %d of the file\n" % (k * 7919) for k in range(60))


def hidden(text: bytes) -> list[bytes]:
    return [text[a:b] for _, a, b, depth in _spans(text) if depth]


@pytest.mark.parametrize(
    "before",
    [b"config=", b"?state=", b"https://h.org/", b"https://h.org/a/", b"a-", b"ab_", b"abc+", b"x/y-z/", b"see "],
)
def test_a_run_is_read_whatever_stands_before_it(before):
    found = hidden(before + RUN + b" end")
    assert found and all(x.endswith(RUN) for x in found)
    assert SECRET not in _masked(before + RUN, _spans(before + RUN), b"[secret]")


def test_a_run_in_a_url_layer_is_read():
    assert hidden(b"q%3D1&state%3D" + RUN)


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("wrap", ["\n", "\r\n", "\n  ", "\\n"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress])
def test_wrapped_base64_is_one_run(width, wrap, pack):
    for shift in range(0, 76, 5):
        plain = LONG[:200] + b"x" * shift + b" " + SECRET + b" and " + LONG
        lines = textwrap.wrap(base64.b64encode(pack(plain)).decode(), width)
        text = f"begin:\n{wrap.join(lines)}\nthe end".encode()
        spans = [(a, b) for _, a, b, depth in _spans(text) if depth]
        assert spans
        # Nothing that is left shows the secret.
        assert not find(_masked(text, _spans(text), b" "))[1]


def test_a_run_that_follows_a_word_on_the_line_before():
    assert hidden(b"certificate\n" + RUN)
    assert hidden(RUN.rstrip(b"=") + b"\nwords that follow")
