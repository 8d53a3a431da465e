"""The training-data operators against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import bpe, components, letter_words, licenses, line_dedup, mixing, multi_index, qalsh, queries, rans, simhash, simhash_similarity, token_stream, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "one", "Ab  cd\n\nef", "x" * 5_000, "a b c d e f g", "a b c d e f g", "é à\nnaïve 東京 🙂", "word " * 3_000, " \n\t "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, "lone text", "en", "s1", 9)], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("chunk", [64, 32_768])
def test_bpe_equals_the_library(docs, odd, chunk):
    encoder = bpe.encoder(queries.RANKS, queries.PATTERN)
    for df in (docs.limit(60), odd):
        got = sorted((str(r.doc_id), list(r.ids)) for r in bpe.encode_documents(df, queries.RANKS, queries.PATTERN, chunk=chunk, overlap=chunk // 4).collect())
        want = [(i, encoder.encode_ordinary(t or "")) for i, t in texts_of(df)]
        assert got == sorted((str(i), ids) for i, ids in want)


def test_bpe_round_trip_and_digest(odd, none):
    encoded = bpe.encode_documents(odd, queries.RANKS, queries.PATTERN)
    back = sorted((str(r.doc_id), bytes(r.data)) for r in bpe.decode_documents(encoded, queries.RANKS, queries.PATTERN).collect())
    assert back == sorted((str(i), (t or "").encode()) for i, t in texts_of(odd))
    shas = {r.decoded_sha256 for r in bpe.encode_documents(odd, queries.RANKS, queries.PATTERN, digest=True).collect()}
    assert shas == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts_of(odd)}
    assert bpe.encode_documents(none, queries.RANKS, queries.PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, rans.LANES - 1, rans.LANES, rans.LANES + 1, 50_000])
def test_rans_round_trip(n):
    symbols = np.random.default_rng(n).zipf(1.5, n).clip(0, 40_000)
    table = rans.Table(np.bincount(symbols, minlength=40_001))
    block = rans.encode(symbols, table, every=8)
    assert (rans.decode(block, table) == symbols).all()
    assert (rans.decode(block, table, n // 3, n // 2) == symbols[n // 3 : n // 2]).all()
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(block[:-5] + bytes([block[-5] ^ 1]) + block[-4:], table)


def test_token_stream_equals_the_library(spark, docs, odd, none, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, df in enumerate((docs, odd, none)):
        token_stream.write_stream(df, queries.WORD_BPE, str(tmp_path / str(k)), block_tokens=5_000)
        got = sorted((r.start, str(r.doc_id), r.n_tokens, list(r.ids)) for r in token_stream.read_stream(spark, str(tmp_path / str(k))).collect())
        assert sorted((i, ids) for _, i, _, ids in got) == sorted((str(i), [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts_of(df))
        at = 0
        for start, _, n, ids in got:
            assert (start, n) == (at, len(ids))
            at += n
        order = [-1 if i == "None" else int(i) for _, i, _, _ in got]
        assert order == sorted(order)
        sums = {(r.start, r.ids_crc32) for r in token_stream.read_checksums(spark, str(tmp_path / str(k))).collect()}
        assert sums == {(s, zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for s, _, _, ids in got}


def coded(coder, texts):
    ids, bounds = coder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def test_words_that_look_special_keep_their_case():
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["A <|endoftext|> b", "A <|ENDOFTEXT|> b.", "It's, fine!, ok.", "x,\ny. Z", "Straße, É.", "a1b23.c'd,'s e.'s (f)g"]
    assert coded(token_stream.WordCoder(queries.WORD_BPE, 2), texts) == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("letters", [None, False])
def test_odd_strings_equal_the_library(letters, monkeypatch):
    monkeypatch.setattr(token_stream, "CACHE_WORDS", 500)  # forgotten words are found anew
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    pieces = [*"abZ.,'!<|> \n\t\r\x0b\x0c\x1c\x85\xa0éÉßİ東😀\u0301\u0338=\x00019-_", "<|endoftext|>", "it's", " the ", "e.", "a,", "'ll", "\u212a", "ǅ", "ﬁ", *"HJTWY\u0331\u030c\u0308\u030a"]
    texts = [None, "", *("".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(4_000))]
    coder = token_stream.WordCoder(queries.WORD_BPE, 2, letters)
    for low in range(0, len(texts), 333):
        part = texts[low : low + 333]
        assert coded(coder, part) == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in part]


def test_capitals_before_marks_equal_the_library():
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = [f"{a}{m}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks] + [f"x{a}{m}{n}y {a}{n}" for a in "HJTWYIK" for m in marks for n in marks[::9]]
    coder = token_stream.WordCoder(queries.WORD_BPE, 2)
    assert coded(coder, texts) == [[*e.ids, 2] for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_letter_words_equal_the_library():
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(2)
    words = ["".join(rng.choices(letter_words.LETTERS[: 26 if k % 2 else None], k=rng.randint(1, 14))) for k in range(20_000)] + ["a" * k for k in range(1, 300)]
    ids, ends = letter_words.LetterWords.of(plain).encode(words)
    want = [e.ids for e in plain.encode_batch(words, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == want


def test_licenses_are_confirmed_by_wording(spark):
    near = "This work is licensed under the GNU General Public License, version 2."
    rows = [(1, f"a\n{near}"), (2, "He has a driving license for the big red car."), (3, None), (4, "before it. Released under the MIT License. after"), (5, "")]
    got = {(r.doc_id, r.license, r.differences) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "GPL-3.0", 1), (4, "MIT", 0)}


def test_license_query_finds_exactly_the_notices(spark):
    found = {r.doc_id for r in queries.op3_license_scan(spark, SF).where("n_lines > 0").collect()}
    wanted = {i for i, t in texts_of(spark.read.parquet(f"{SF}/documents.parquet")) if any(n in (t or "").split("\n") for n in licenses.TEMPLATES.values())}
    assert found == wanted


@pytest.mark.parametrize("n", [0, 500, 2_000, 20_000])
def test_licenses_in_long_lines(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, name, " ".join([*(prose := [f"w{x}" for x in rng.integers(50_000, size=n)])[: n // 3], text, *prose[n // 3 :]])) for i, (name, text) in enumerate(licenses.TEMPLATES.items())]
    got = {(r.doc_id, r.license, r.differences) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect()}
    assert got == {(i, name, 0) for i, name, _ in rows}


@pytest.mark.parametrize("lead", ["", "# ", " * ", "//"])
def test_licenses_wrapped_over_lines(spark, lead):
    wrap = lambda text, n: "\n".join(lead + " ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    rows = [(i * 10 + n, name, f"code\n\n{wrap(text, n)}\nmore") for i, (name, text) in enumerate(licenses.TEMPLATES.items()) for n in (1, 3, 8)]
    got = {(r.doc_id, r.line, r.license, r.differences) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect()}
    assert got == {(i, 2, name, 0) for i, name, _ in rows}


def test_all_licenses_of_a_line(spark):
    both = [f"{licenses.TEMPLATES[a]} or {licenses.TEMPLATES[b]}" for a in licenses.TEMPLATES for b in licenses.TEMPLATES]
    docs = spark.createDataFrame([(i, f"{text}\n{text}") for i, text in enumerate([*both, " and ".join(licenses.TEMPLATES.values())])], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.licenses, r.least_differences) for r in licenses.document_licenses(docs).collect()}
    pairs = [";".join(sorted({a, b})) for a in licenses.TEMPLATES for b in licenses.TEMPLATES]
    assert got == {i: (2, names, 0) for i, names in enumerate([*pairs, ";".join(sorted(licenses.TEMPLATES))])}


def test_mixing_targets_and_copies(odd, docs, none):
    for df in (odd, docs):
        rows = mixing.mix(df).collect()
        sizes, targets = defaultdict(int), {}
        for r in rows:
            assert r["__pw_size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            assert 0 <= r["__pw_copies"] <= 3
            sizes[r.source] += r["__pw_size"]
            targets[r.source] = r["__pw_target"]
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        share, free, left = {}, set(names), sum(sizes.values())
        while free:
            level = left / sum(weight[s] for s in free)
            over = {s for s in free if level * weight[s] > 3 * sizes[s]}
            share |= {s: 3 * sizes[s] for s in over} or {s: level * weight[s] for s in free}
            left -= sum(3 * sizes[s] for s in over)
            free = free - over if over else set()
        assert targets == pytest.approx(share)
        assert mixing.mixed_documents(df).count() == sum(r["__pw_copies"] for r in rows)
    assert mixing.mix(none).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op5_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hits >= 0.85 * sum(r.toxic for r in rows) and hits >= 0.9 * sum(r.predicted for r in rows)


def test_toxicity_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.judge(odd, labels).collect()} == {(0.0, 0)}
    assert toxicity.judge(none, labels).count() == 0


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def brute_lines(rows):
    first, kept = {}, {}
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            first.setdefault(line, (i, k))
    near = {max(a, b, key=first.get) for a in first for b in first if a < b and abs(len(a) - len(b)) <= 1 and one_edit(a, b)}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept[i] = "\n".join(x for k, x in enumerate(lines) if not re.search(r"[^\x20\x09-\x0D]", x) or (first[x] == (i, k) and x not in near))
    return kept


def test_line_dedup_equals_brute_force(spark, none):
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("abé "), rng.integers(1, 7))) for _ in range(60)] + ["the same long line of words", "the same long line of word", "the same long lime of words", ""]
    rows = [(i, "\n".join(rng.choice(lines, 5)) if i % 9 else None) for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_lines(rows)
    for r in got.collect():
        assert (r.text or "") == want[r.doc_id]
        assert (r.text is None) == (dict(rows)[r.doc_id] is None)
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_keeps_odd_rows(odd):
    got = line_dedup.dedup_lines(odd.withColumn("gone", F.lit(1)).withColumnRenamed("lang", "th").drop("gone"))
    assert got.count() == odd.count()


def test_aliases_take_over_blocks_but_not_over_allows(spark):
    page = lambda to: f'<link href="{to}" rel="canonical">' if to else None
    rows = [(1, "http://a.org/x", page("http://b.net/y")), (2, "https://c.org/x#f", page("//a.org/x")), (3, "http://d.org/fr/x", page("/q")), (4, "http://d.org/q", page("http://b.net/y")), (5, None, None), (6, "no url", None), (7, "HTTP://X.Example.NET/en/", None), (8, "http://e.org/", "<meta http-equiv=refresh content='0; url=http://z.example.com/de/'>"), (9, "http://f.org/", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: ("org/fr/", "allow"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"), 7: ("example.net/en/", "allow"), 8: (None, "block"), 9: (None, "allow")}


def test_relative_targets(spark):
    base = "http://A.org/b/c/d?p=q"
    wanted = {"index.html": "/b/c/index.html", "?id=3": "/b/c/d?id=3", "../a": "/b/a", "./": "/b/c/", "..": "/b/", "../../../x#f": "/x#f", "/q": "/q", "e/../f?u=../v": "/b/c/f?u=../v", "#s": "/b/c/d?p=q#s", "go?u=http://z.net/": "/b/c/go?u=http://z.net/"}
    rows = [(base, f'<link rel="canonical" href="{to}">') for to in [*wanted, "mailto:x"]] + [("http://e.org", '<link rel="canonical" href="i">')]
    got = [r.dst for r in url_filter.page_links(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert sorted(got) == sorted([*(f"http://a.org{path}" for path in wanted.values()), "http://e.org/i"])
    page = '<meta http-equiv="refresh" content="0; url=../a">'
    judged = url_filter.filter_urls(spark.createDataFrame([(1, "http://a.org/b/c", page), (2, "http://a.org/a", '<link rel="canonical" href="http://b.net/">')], "page_id long, url string, html string"))
    assert {r.page_id: r.verdict for r in judged.collect()} == {1: "block", 2: "block"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 5), (7, 7), (None, 3), (200, 103)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 100 for i in [*range(100, 141), 200]} | {3: 3, 5: 3}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


BAD = [(900, None, 1), (901, [0.0] * 4, 1), (902, [1.0, None, 0.0, 0.0], 1), (903, [float("nan"), 1.0, 0.0, 0.0], 1), (904, [float("inf"), 1.0, 0.0, 0.0], 1)]


def test_nearest_recall_and_odd_rows(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    x, ids = np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in qalsh.nearest(df, df.where("vec_id % 20 = 0"), shard=200, block=7).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -9
        hits += len({v for v, _ in got[ids[i]]} & set(ids[np.lexsort((ids, -scores))[:20]]))
    assert hits >= 0.9 * 20 * len(got)
    small = vectors(spark, [(0, [1.0, 0.0, 0.0, 0.0], 1), (5, [2.0, 0.0, 0.0, 0.0], 1), (3, [2.0, 0.0, 0.0, 0.0], 1), *BAD])
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in qalsh.nearest(small, small).where("query_id = 0").orderBy("rank").collect()] == [(0, 1, 3, 2.0), (0, 2, 5, 2.0)]
    assert qalsh.nearest(small.limit(0), small.limit(0)).count() == 0


def test_nearest_with_repeated_ids_and_odd_lengths(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 3.0], 0), (2, [4.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [9.0, 0.0, 0.0, 0.0], 0), (5, [], 0), (None, [5.0, 5.0], 0)]
    got = qalsh.nearest(vectors(spark, rows), vectors(spark, rows), k=4).orderBy("query_id", "rank").collect()
    # two rows of one id are two candidates, but one query: that of the smallest vector
    assert [(r.vec_id, r.score) for r in got if r.query_id == 1] == [(2, 4.0), (3, 2.0), (2, 0.0)]
    assert [(r.vec_id, r.score) for r in got if r.query_id == 2] == [(1, 0.0), (1, 0.0), (3, 0.0)]
    assert [r.rank for r in got if r.query_id == 3] == [1, 2, 3, 4]
    assert {r.query_id for r in got} == {1, 2, 3}


def test_collisions_choose_few_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = qalsh.Shard(np.arange(len(x)), x, 1.0)
    found = [set(at.tolist()) for at, _ in shard.search(np.arange(30), x[:30], 20)]
    hits = 0
    for i, at in enumerate(found):
        scores = x @ x[i]
        scores[i] = -9
        hits += len(at & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.93 * 30 * 20
    assert shard.verified <= 0.1 * 30 * len(x)


def test_sequence_equals_a_full_sort():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = multi_index.MultiIndex(x, 12, 0.9)
    one, two = index._distances(x)
    sums = (one[:, :, None] + two[:, None, :]).reshape(len(x), -1)
    for visits in (1, 2, 7, 60, 144):
        index.visits = visits
        assert (index.sequence(x) == np.argsort(sums, axis=1, kind="stable")[:, :visits]).all()


def brute_links(rows, threshold=0.93):
    """For each row its number of links and the smallest id that it reaches."""
    n, out = len(rows), []
    fit = [v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) and k is not None and i is not None for i, v, k in rows]
    x = [np.array(v, dtype=np.float32).astype(np.float64) if f else None for f, (_, v, _) in zip(fit, rows, strict=True)]
    near = [[j for j in range(n) if j != i and fit[i] and fit[j] and rows[i][2] == rows[j][2] and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= threshold] for i in range(n)]
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen), default=None) if rows[i][0] is not None else None
        out.append((rows[i][0], len(near[i]), least, least == rows[i][0]))
    return out


def test_links_of_repeated_rows(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 6))
    some = [(int(i), base[i].tolist(), int(i % 2)) for i in range(40)]
    rows = [*some, *some[:10], *((i, (base[i + 1] + 0.02).tolist(), k) for i, _, k in some[:8]), (None, base[0].tolist(), 0), (None, None, 0), (7, None, 1), (7, base[7].tolist(), None), *[(50 + i, base[3].tolist(), 1) for i in range(30)]]
    rows = [(i, v and [float(np.float32(c)) for c in v], k) for i, v, k in rows]
    got = [tuple(r) for r in multi_index.link_vectors(vectors(spark, rows)).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(brute_links(rows), key=key)
    # vectors of another length than most have link with nothing
    odd = multi_index.link_vectors(vectors(spark, [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0, 0.0, 0.0], 0), (4, [1.0], 0), (5, [], 0)])).collect()
    assert sorted(tuple(r) for r in odd) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    assert multi_index.link_vectors(vectors(spark, [])).count() == 0


def test_links_equal_brute_force_with_a_hot_group(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((300, 16))
    hot = base[:1] + 0.05 * rng.standard_normal((150, 16))
    x = np.vstack([base, hot, base[:20] + 0.08 * rng.standard_normal((20, 16)), base[:5]]).astype(np.float32)
    labels = [None if i % 50 == 49 else i % 2 if i < 300 else 0 for i in range(len(x))]
    df = vectors(spark, [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels, strict=True))])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.link_vectors(df, chunk=64).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.93
    for i in range(len(x)):
        for j in range(len(x)):
            link[i, j] &= i != j and labels[i] is not None and labels[i] == labels[j]
    seen = {}
    for i in range(len(x)):
        if i not in seen:
            todo = [i]
            while todo:
                at = todo.pop()
                if at not in seen:
                    seen[at] = i
                    todo += np.flatnonzero(link[at]).tolist()
    assert sum(got[i][0] for i in got) >= 0.98 * link.sum()
    assert all(got[i][0] <= link[i].sum() for i in got)
    assert sum(got[i][1] != seen[i] for i in got) <= 2
    odd = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.link_vectors(vectors(spark, [(1, [1.0] * 4, 1), *BAD])).collect()}
    assert odd == {i: (0, i, True) for i in (1, 900, 901, 902, 903, 904)}


def plain_print(text, shingle):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_equals_brute_force(docs, odd, none):
    for df in (docs.limit(80), odd):
        rows = df.collect()
        prints = [plain_print(r.text, 3) for r in rows]
        got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()]
        assert sorted((str(i), f) for i, f, _ in got) == sorted((str(r.doc_id), f"{p:016x}") for r, p in zip(rows, prints, strict=True))
    assert simhash.simhash_components(none).count() == 0


def test_close_links_connect_a_hot_bucket(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    values = {centre} | {centre ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(120)} | {int(v) for v in rng.integers(1 << 62, size=200)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    links = simhash.close_links(df, chunk=16).distinct().collect()
    assert all(((r.src ^ r.dst) & ((1 << 64) - 1)).bit_count() <= 3 for r in links)
    parent = {v: v for (v,) in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in links:
        parent[root(r.src)] = root(r.dst)
    near = [(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    assert near and all(root(a) == root(b) for a, b in near)


def test_similar_texts_equal_brute_force(spark, none):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(5_000, size=150)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: 150 - i])), (len(rows) + 2, " ".join(words).upper())]
    rows += [(500, ""), (501, None), (502, "short text"), (503, "Short  text")]
    sets = {i: set(simhash_similarity.shingle_hashes(t).tolist()) for i, t in rows}
    got = {r.doc_id: r.component_id for r in simhash_similarity.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in sets:
        alike = [j for j in sets if (sets[i] or sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] or [500, 501]
        assert got[i] == min(alike)
    assert simhash_similarity.similar_components(none).count() == 0


def test_a_twin_among_texts_below_the_similarity(spark):
    rng = np.random.default_rng(1)
    word = lambda k: [f"w{x}" for x in rng.integers(10**9, size=k)]
    common = word(500)
    rows = [(i, " ".join(common + word(70))) for i in range(300)]
    rows.append((300, " ".join(rows[150][1].split()[:-45] + word(45))))
    got = {r.doc_id: r.component_id for r in simhash_similarity.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 150 if i == 300 else i for i, _ in rows}


def test_pipeline_stages(spark, docs, none):
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, SF).cache()
        assert out.columns == docs.columns, name
        assert out.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
        assert stage(spark, none, SF).count() == 0
    rows = corpus_pipeline.STAGES[-1][1](spark, out, SF)
    assert rows.count() == out.count() == corpus_pipeline.run(spark, SF).count()


def test_entry_registers_all(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 13)} == {re.match(r"op\d+_", n)[0] for n in names if n.startswith("op")}
    assert "pipeline" in names
