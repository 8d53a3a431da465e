"""The best grounded chunk of each claim, found by rare words and by kinds, against all pairs."""

from __future__ import annotations

import random

import pytest

from pagewright.operators import citations


@pytest.mark.parametrize("rare", [0, 2, 200])
def test_best_overlaps_equal_all_pairs(spark, monkeypatch, rare):
    monkeypatch.setattr(citations, "RARE", rare)
    rng = random.Random(rare)
    some = lambda: sorted(set(rng.choices("abcdefghijkl", k=rng.randint(0, 5))))
    held = [(g, i, some()) for g in (1, 2) for i in range(30)]
    wanted = sorted({(g, tuple(some())) for g in (1, 2, 3) for _ in range(25)})
    got = citations.best_overlaps(
        spark.createDataFrame(wanted, "g int, claim_words array<string>"), spark.createDataFrame([(g, (i,), w) for g, i, w in held], "g int, chunk struct<chunk_seq:int>, chunk_words array<string>"), ["g"]
    )

    def raw(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0

    expected = {}
    for g, words in wanted:
        near = [(-raw(words, w), i) for h, i, w in held if h == g]
        if near:
            expected[g, words] = (-min(near)[0], min(near)[1])
    assert {(r["g"], tuple(r["claim_words"])): (r["raw"], r["chunk"]["chunk_seq"]) for r in got.collect()} == expected
