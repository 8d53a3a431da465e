"""Search in blocks, ranks by counting, the stored index, postings of keywords: all against plain code."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.operators import blocks, retrieval
from pagewright.operators import vectors as S
from pagewright.operators.ivf import IvfStore

NAN = float("nan")
#: Odd vectors beside plain ones, and a third of all rows alike.
ODD = [(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, NAN, 0.0]), (4, [1.0, None, 0.0]), (5, [1.0, 2.0]), (6, []), (7, [float("inf"), 1.0, 0.0]), (8, [0.3, 0.1]), (9, [3.0, 4.0, 0.0])]


def odd_rows():
    rng = random.Random(4)
    return ODD + [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(10, 120)] + [(i, [0.5, 0.5, -1.0]) for i in range(200, 260)]


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def plain_score(metric, v, q):
    inner = sum(a * b for a, b in zip(v, q, strict=True))
    if metric == "l2":
        return 1 / (1 + sum((a - b) ** 2 for a, b in zip(v, q, strict=True)))
    lengths = math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(b * b for b in q))
    return inner if metric == "ip" else inner / lengths if lengths else 0.0


@pytest.mark.parametrize("metric", S.METRICS)
@pytest.mark.parametrize("small", [True, False])
def test_search_of_odd_vectors(spark, monkeypatch, metric, small):
    if not small:
        monkeypatch.setattr(S, "BROADCAST_QUESTIONS", 0)
        monkeypatch.setattr(S, "PART_ROWS", 7)
        monkeypatch.setattr(S, "BLOCK_QUESTIONS", 3)
    rows = odd_rows()
    index = spark.createDataFrame([(i, v, i % 3) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    asked = [(i, v) for i, v in rows if i < 15 or i in (200, 201)]
    questions = spark.createDataFrame(asked, "query_id long, query_vec array<double>").repartition(2).withColumn("want_x", F.col("query_id") * 2)
    got: dict = {}
    for r in S.knn(index, questions, 4, metric, keep=("label",)).orderBy("query_id", "rank").collect():
        assert r["want_x"] == 2 * r["query_id"] and r["label"] == r["vec_id"] % 3
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    want = {}
    for i, q in asked:
        if usable(q):
            scored = sorted((-round(plain_score(metric, v, q), 12), j) for j, v in rows if usable(v) and len(v) == len(q))[:4]
            want[i] = [(k + 1, j, round(-s, 9) + 0.0) for k, (s, j) in enumerate(scored)]
    assert got == want


def test_blocks_do_not_change_a_score():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 64))
    whole = blocks.exact("ip", v, v)
    assert all(blocks.exact("ip", v[i : i + 1], v[i : i + 1])[0] == whole[i] for i in range(50))


@pytest.mark.parametrize("small", [True, False])
def test_rank_by_counting(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(S, "BROADCAST_QUESTIONS", 0)
        monkeypatch.setattr(S, "PART_ROWS", 9)
    rows = odd_rows()
    index = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [(i, v, i + 1) for i, v in rows[:40]] + [(500, [1.0, 1.0, 1.0], 205), (501, [1.0, 1.0, 1.0], 9999)]
    questions = spark.createDataFrame(asked, "query_id long, query_vec array<double>, want_id long")
    by_id, want = dict(rows), {}
    for i, q, target in asked:
        v = by_id.get(target)
        fit = usable(q) and usable(v) and len(v) == len(q)
        own = plain_score("cosine", v, q) if fit else None
        want[i] = (target, 1 + (sum(plain_score("cosine", x, q) > own + 1e-12 for x in by_id.values() if usable(x) and len(x) == len(q)) if fit else 0))
    got = S.rank_of(index, questions)
    assert {r["query_id"]: (r["target"], r["rank"]) for r in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().toString()


def test_a_stored_index_reads_the_cells_it_visits(spark, tmp_path):
    path = str(tmp_path / "index")
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    built = S.build_index(vectors, "ivf", path=path, cells=40)
    assert built.settings["rows"] == vectors.count() and built.settings["cells"] == 40 and 1 <= built.settings["probes"] <= 40
    index = IvfStore.open(spark, path, dim=64)
    assert index.settings == built.settings
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = {(r.query_id, r.vec_id) for r in S.knn(vectors, asked, 5).collect()}
    found = {(r.query_id, r.vec_id) for r in index.search(asked, 5).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    one = index.search(asked.limit(1), 5, probes=2)
    plan = one._jdf.queryExecution().toString()
    line = next(x for x in plan.split("\n") if "PartitionFilters" in x and "cell" in x)
    assert "cell" in line.split("PartitionFilters: [")[1].split("]")[0]
    read = {f.split("cell=")[1].split("/")[0] for f in index.lists().where(F.col("cell").isin([0, 1])).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert read == {"0", "1"}
    assert {(r.query_id, r.vec_id) for r in index.search(asked, 5, probes=40).collect()} == exact
    with pytest.raises(ValueError, match="length 64, not 32"):
        IvfStore.open(spark, path, dim=32)


def test_index_of_odd_vectors_and_of_none(spark, tmp_path):
    index = spark.createDataFrame(odd_rows(), "vec_id long, embedding array<double>")
    built = S.build_index(index, "ivf", path=str(tmp_path / "odd"))
    assert built.settings["dim"] == 3 and built.settings["rows"] == 171
    questions = spark.createDataFrame(ODD, "query_id long, query_vec array<double>")
    got = built.search(questions, 2, probes=built.settings["cells"]).collect()
    assert {r.query_id for r in got} == {2, 9} and [r.vec_id for r in got if r.query_id == 9 and r["rank"] == 1] == [9]
    empty = S.build_index(index.limit(0), "ivf", path=str(tmp_path / "none"))
    assert empty.settings["rows"] == 0 and empty.search(questions, 2).count() == 0


def test_postings_give_the_factor_of_every_named_chunk(spark):
    rng = random.Random(6)
    words = ["TRL", "the", "XTRLS", "CDR", "Section", "ABCDEF", "A", "sCDRt", "TR", "RL", "2", "1.10"]
    chunks = [(d, f"c{i}", i, rng.choice(["1", "1.1", "1.10", "11.2", "2.3.1", "", None]), " ".join(rng.choice(words) for _ in range(6))) for d in (1, 2) for i in range(30)]
    chunks += [(3, "c0", 0, "1.1", None)]
    asked = [(1, "Section 1.1 and TRL or TRL in 1"), (2, "RL CDE"), (3, "nothing here"), (4, None), (5, "2 2.3 2.3.1 9"), (6, "ABCDEF CDR")]
    frame = spark.createDataFrame(chunks, "doc_id long, chunk_id string, chunk_seq long, section_number string, content string")
    questions = spark.createDataFrame(asked, "query_id long, query string")
    got = {(r["query_id"], r["doc_id"], r["chunk_id"]): round(r["factor"], 6) for r in retrieval.boosted_pairs(questions, frame).collect()}
    factor = retrieval.boost_factor(F.coalesce("query", F.lit("")), F.coalesce("section_number", F.lit("")), F.coalesce("content", F.lit("")))
    pairs = questions.crossJoin(frame).select("query_id", "doc_id", "chunk_id", factor.alias("factor"))
    assert got == {(r["query_id"], r["doc_id"], r["chunk_id"]): round(r["factor"], 6) for r in pairs.collect() if r["factor"] > 1}
    assert len(got) > 100 and "NestedLoop" not in retrieval.boosted_pairs(questions, frame)._jdf.queryExecution().toString()
    assert retrieval.boosted_pairs(questions.where("query_id = 4"), frame).count() == 0
