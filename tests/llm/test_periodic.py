"""Periodic runs against a plain search, word by word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pagewright.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, exponent=4, least=6):
    """All runs by their definition: grow from every place, smallest period by trial."""
    out = set()
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, q, length))
            i = j + 1
    return sorted(out)


def plain_collapse(words, runs):
    gone = {i for start, q, length in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def text_of(rng, size):
    words = []
    names = [f"w{i}" for i in range(rng.choice([1, 2, 3, 40]))]
    while len(words) < size:
        if rng.random() < 0.4:
            words += [rng.choice(names) for _ in range(rng.randint(1, 6))] * rng.randint(2, 9)
        words.append(rng.choice(names))
    return "".join(w + rng.choice([" ", "\n", " \t", "  "]) for w in words[:size])


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string, n_words string, key string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], r["collapsed"], [(x["start"], x["period"], x["length"]) for x in r["runs"]]) for r in periodic.periodic_runs(docs, **options).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        runs = plain_runs(words, options.get("min_exponent", 4), options.get("min_length", 6))
        want.append((doc_id, len(words), plain_collapse(words, runs), runs))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("options", [{}, {"long_words": 30, "range_lags": 4}, {"min_exponent": 2, "min_length": 2}, {"min_exponent": 3, "min_length": 9, "long_words": 10, "range_lags": 1}])
def test_equal_to_a_plain_search(spark, options):
    rng = random.Random(str(options))
    rows = [(i, text_of(rng, rng.randint(0, 120)), "r", "c", "n", "k") for i in range(150)]
    rows += [(None, "a " * 50, "r", "c", "n", "k"), (1, None, "r", "c", "n", "k"), (2, "", "r", "c", "n", "k"), (2, "", "r", "c", "n", "k"), (3, " \n", "r", "c", "n", "k"), (3, "a b " * 40, "r", "c", "n", "k"), (3, "a b " * 40, "r", "c", "n", "k")]
    rows += [(4, "é ü ж " * 20, "r", "c", "n", "k")]
    check(spark, rows, **options)


def test_long_text_is_dealt_out_and_agrees(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(9000)]
    words[4000:7000] = (words[:700] * 5)[:3000]
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole, dealt = (periodic.periodic_runs(docs, long_words=n, range_lags=100).collect()[0] for n in (65_536, 100))
    assert whole == dealt and [tuple(r) for r in whole["runs"] if r["length"] >= 3000] == [(4000, 3000, 700)]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(empty).columns == ["doc_id", "n_words", "runs", "collapsed"] and periodic.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, min_exponent=1)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_the_query_equals_its_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 4000)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [r for r in queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect() if r["doc_id"] in texts]
    assert len(rows) == len(texts) and any(r["n_runs"] for r in rows)
    for r in rows:
        words = planted(r["doc_id"], WORD.findall(texts[r["doc_id"]] or ""))
        runs = plain_runs(words)
        best = min(((-n, s, q) for s, q, n in runs), default=None)
        expected = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else [None] * 4))
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == expected
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
