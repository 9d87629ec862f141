"""Cuts by character classes against the public pattern, and ids against the tokenizers library."""

import numpy as np
import public_tokenizers
import regex
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkspan.llm import idfile, splitter

PATTERN = regex.compile(public_tokenizers.PATTERN)
PIECES = st.sampled_from(["'", "'s", "'re", "'l", "'ll", "'S", "a", "st", "é", "9", "½", " ", "  ", "\n", "\t", " ", "　", "!", "’", "😀", "é"])
TEXT = st.one_of(st.text(max_size=40), st.lists(PIECES, max_size=25).map("".join))


@settings(max_examples=600, deadline=None)
@given(st.lists(TEXT, max_size=6))
@example(["it's", "'s'tis 'll'l 'x", "", "a  ", " b", "''s"])
def test_cuts_are_those_of_the_pattern(texts):
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    start = splitter.match_starts(points, np.cumsum([0, *map(len, texts)])).tolist()
    assert [whole[a:b] for a, b in zip(start, [*start[1:], len(whole)], strict=False)] == [m for t in texts for m in PATTERN.findall(t)]


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    text = "one two one two " * 9
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    start = splitter.match_starts(points, np.array([0, len(points)]))
    end = np.append(start[1:], len(points))
    want = splitter.match_hashes(points, start, end)
    kinds = [text[a:b] for a, b in zip(start, end, strict=True)]
    assert len({*want.tolist()}) == len({*kinds}) and len({*zip(want.tolist(), kinds, strict=True)}) == len({*kinds})
    monkeypatch.setattr(splitter, "CHUNK", 7)
    splitter._base_powers.cache_clear()
    assert np.array_equal(splitter.match_hashes(points, start, end), want)
    splitter._base_powers.cache_clear()


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_ids_are_those_of_the_library(texts):
    with open(idfile.TOKENIZER, encoding="utf-8") as file:
        vocabulary = file.read()
    library = test_ids_are_those_of_the_library.__dict__.setdefault("library", Tokenizer.from_str(vocabulary))
    library.encode_special_tokens = True
    ids, sizes = splitter.encoder(vocabulary).encode(texts, 2)
    want = [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_forgetting_changes_nothing(monkeypatch):
    with open(idfile.TOKENIZER, encoding="utf-8") as file:
        encoder = splitter.Encoder(file.read())
    texts = [f"word{k} other {k * k} née {'x' * (k % 7)}" for k in range(200)]
    want = [encoder.encode([t], 2)[0].tolist() for t in texts]
    monkeypatch.setattr(splitter, "REMEMBERED", 20)
    assert [encoder.encode([t], 2)[0].tolist() for t in texts] == want
