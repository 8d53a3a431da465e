"""Long texts in windows: sound stitching for any pattern, and work dealt out."""

from __future__ import annotations

import random

import pytest
import regex

from pagewright.llm import bpe, queries

THREES = r"""\p{N}{1,3}| ?\p{L}+| ?[^\s\p{L}\p{N}]+|\s*[\r\n]+|\s+(?!\S)|\s+"""


def odd_texts(n, size):
    rng = random.Random(n)
    parts = ["1", "12", "123", "4567890" * 3, "a", "word ", " ", "  ", "\n", "\r\n ", ".", "é", "x" * 50, "9" * 70, "it's ", "😀"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, size)))) for i in range(n)]


@pytest.mark.parametrize("pattern", [queries.PATTERN, THREES])
@pytest.mark.parametrize(("chunk", "overlap"), [(30, 9), (15, 4), (200, 40)])
def test_ids_equal_for_any_pattern(spark, pattern, chunk, overlap):
    rows = [*odd_texts(150, 60), (900, "7" * 1_000 + " end of it 12 " + "8" * 500), (901, "z" * 3_000), (902, " " * 500), (903, "ab " * 700), (904, "ab " * 700)]
    encoder = bpe.encoder(queries.RANKS, pattern)
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), queries.RANKS, pattern, chunk=chunk, overlap=overlap)
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {i: encoder.encode_ordinary(t) for i, t in rows}


@pytest.mark.parametrize("pattern", [queries.PATTERN, THREES])
def test_reading_on_in_order(pattern):
    """``resume`` cuts only where the whole text's pieces end, and gives the text back."""
    compiled, chunk, overlap = regex.compile(pattern), 20, 6
    for _, text in odd_texts(300, 50):
        windows = [text[i : i + chunk + overlap] for i in range(0, len(text), chunk)]
        ends = {m.end() for m in compiled.finditer(text)}
        rows = [("k", c, c + 1 == len(windows), w, 0 if c == 0 else None) for c, w in enumerate(windows)]
        spans = list(bpe.resume(rows, compiled, chunk))
        assert "".join(s for _, _, s in spans) == text and [c for _, c, _ in spans] == sorted({c for _, c, _ in spans})
        at = 0
        for _, _, span in spans:
            at += len(span)
            assert at in ends


def test_windows_of_one_text_are_dealt_out(spark):
    text = " ".join(f"word{i % 91} {i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = bpe.encode_documents(docs, queries.RANKS, queries.PATTERN, chunk=2_000, overlap=200)
    assert list(got.first().ids) == bpe.encoder(queries.RANKS, queries.PATTERN).encode_ordinary(text)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("MapInArrow scan")
    assert "hashpartitioning(key" in plan[scan : plan.index("MapInArrow cut", scan)]
