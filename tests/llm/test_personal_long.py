"""Numbers with very many zeros, and texts with very many candidates."""

import time

from inkspan.llm import personal


def test_long_runs_of_zeros():
    zeros = "0" * 6000
    for text, found in [(f"{zeros}7.1.2.{zeros}", 1), (f"1.{zeros}255.2.3", 1), (f"1.{zeros}256.2.3", 0), (f"1.2.3.1{zeros}", 0)]:
        assert sum(k == 1 for k, _, _ in personal.base_spans(text)) == found
    assert personal.learnable(f"host {zeros}7.1.2.3 and +1 {zeros}")[1] is not None


def test_many_candidates_take_linear_time():
    def seconds(n):
        text = " ".join(f"10.0.{k % 256}.{k // 256} 10,0,{k % 999},1" for k in range(n))
        begin = time.perf_counter()
        personal.learnable(text)
        return time.perf_counter() - begin

    seconds(500)
    assert seconds(8000) < 12 * max(seconds(1000), 0.01)


def test_overlaps_by_bisection():
    taken = personal._Taken([(3, 5), (4, 9), (20, 22), (9, 10)])
    spans = [(3, 9), (9, 10), (20, 22)]
    for a in range(25):
        for b in range(a + 1, 26):
            assert taken.overlaps(a, b) == any(a < y and x < b for x, y in spans)
    taken.add(12, 14)
    assert taken.overlaps(13, 20) and not taken.overlaps(14, 20) and not taken.overlaps(10, 12)
