"""Several notices of one kind side by side."""

import itertools
import time

import pytest

from inkspan.llm.licenses import NOTICES, Notices

SEARCH = Notices(NOTICES)
GPL = [k for k, (_, label) in enumerate(NOTICES) if label == "gpl"][0]
WAYS = ["general public license", "generel public license", "generel publik license"]


def places(text):
    return [(a, b, edits) for a, b, k, edits in SEARCH.find(text) if k == GPL]


@pytest.mark.parametrize("order", list(itertools.product(range(3), repeat=2)) + list(itertools.permutations(range(3))))
@pytest.mark.parametrize("between", [" ", " and "])
def test_each_notice_of_a_list_is_found(order, between):
    text, wanted = " ", []
    for k in order:
        wanted.append((len(text), len(text) + len(WAYS[k]), k))
        text += WAYS[k] + between
    assert places(text.rstrip() + " ") == wanted


def test_many_notices_in_one_stretch():
    text = " " + " ".join(WAYS[k * 7 % 3] for k in range(60)) + " "
    assert len(places(text)) == 60


def test_notices_across_windows_are_found_once():
    notice = NOTICES[GPL][0]
    for gap in range(1, 40):
        text = " " + " ".join([WAYS[1], "x" * gap] * 40) + " "
        assert [(b - a, e) for a, b, e in places(text)] == [(len(WAYS[1]), 1)] * 40, gap
    assert len(WAYS[0]) == len(notice)


def test_very_many_notices_take_linear_time():
    def seconds(n):
        text = " " + " ".join(WAYS[k % 3] for k in range(n)) + " "
        begin = time.perf_counter()
        assert len(places(text)) == n
        return time.perf_counter() - begin

    seconds(50)
    assert seconds(1600) < 16 * max(seconds(200), 0.01)
