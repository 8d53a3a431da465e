"""Exact search over a grid of many cells, with keys that are structs and many equal vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import blocks, ivf
from pagewright.operators import vectors as S


def test_a_grid_of_cells_finds_what_one_cell_finds(spark, monkeypatch):
    rows = spark.range(600).select(F.struct((F.col("id") % 2).alias("doc_id"), F.col("id").alias("seq")).alias("key"), F.array(*[((F.col("id") * p) % 7).cast("double") for p in (1, 2, 3)]).alias("v"))
    asked = spark.range(40).select(F.col("id").alias("query_id"), F.array(*[((F.col("id") + p) % 5).cast("double") for p in (1, 2, 3)]).alias("query_vec"))
    find = lambda: {(r["query_id"], r["rank"]): (tuple(r["key"]), r["score"]) for r in S.knn(rows, asked, 5, key="key", vector="v").collect()}
    whole = find()
    monkeypatch.setattr(blocks, "CELL_PAIRS", 1_000)
    monkeypatch.setattr(blocks, "SLICE_ROWS", 16)
    monkeypatch.setattr(blocks, "SLICE_QUESTIONS", 3)
    monkeypatch.setattr(S, "PART_ROWS", 100)
    assert find() == whole and len(whole) == 39 * 5 + 5
    plan = S.knn(rows, asked, 5, key="key", vector="v")._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan


def test_many_visits_of_cells_find_what_few_do(spark, tmp_path, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    index = S.build_index(vectors, "ivf", path=str(tmp_path / "index"), cells=12)
    asked = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    find = lambda: {tuple(r) for r in index.search(asked, 5, probes=4).select("query_id", "rank", "vec_id", "score").collect()}
    few = find()
    monkeypatch.setattr(S, "BROADCAST_QUESTIONS", 0)
    monkeypatch.setattr(ivf, "VISITS", 7)
    assert find() == few and len(few) == 500
    plan = index.search(asked, 5, probes=12)._jdf.queryExecution().toString()
    assert "cell" not in plan.split("FlatMapCoGroupsInArrow")[0] and "FlatMapCoGroupsInArrow" in plan


def test_every_pair_has_its_boosted_score(spark):
    from pagewright.operators import retrieval

    chunks = spark.createDataFrame([(1, "a", 0, "1.1", "TRL"), (1, "b", 1, "2", "none")], "doc_id long, chunk_id string, chunk_seq long, section_number string, content string")
    asked = spark.createDataFrame([(1, "Section 1 and TRL"), (2, "nothing")], "query_id long, query string")
    got = {(r["query_id"], r["chunk_id"]): round(r["factor"], 6) for r in retrieval.boosted_all(asked, chunks).collect()}
    assert got == {(1, "a"): 1.5, (1, "b"): 1.0, (2, "a"): 1.0, (2, "b"): 1.0}


def test_all_pairs_meet_in_cells_and_those_without_terms_are_not_looked_at(spark, monkeypatch):
    from pagewright.operators import retrieval

    monkeypatch.setattr(retrieval, "PART_ROWS", 3, raising=False)
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 20, raising=False)
    contents = ["TRL and SEMP", "aTRLb", "XTRLY CD", "TR L", "", None, "ÄTRL C DR", "none"]
    numbers = ["1", "1.1", "10.2", "2.3.1", "", None, "3"]
    chunks = spark.createDataFrame([(d, f"c{n}", n, numbers[n % 7], contents[(n + d) % 8]) for d in (1, 2) for n in range(11)], "doc_id long, chunk_id string, chunk_seq long, section_number string, content string")
    queries = ["Section 1 and TRL", "nothing", None, "TRL TRL 1 1.1", "CDR in 2.3", "", "RL CD", "what is this", "TR 3", "plain again"]
    asked = spark.createDataFrame([(n, queries[n % 10]) for n in range(14)] + [(3, "another 1"), (1, "nothing")], "query_id long, query string")
    found = retrieval.boosted_all(asked, chunks)
    pairs = asked.crossJoin(chunks).select("query_id", "doc_id", "chunk_id", "chunk_seq", retrieval.boost_factor(F.col("query"), F.col("section_number"), F.col("content")).alias("factor"))
    want, got = (sorted(map(str, df.collect())) for df in (pairs, found))
    assert got == want and len(got) == 16 * 22
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "1.0 AS factor" in found._jdf.queryExecution().optimizedPlan().toString()


def test_no_questions_or_no_chunks_have_no_pairs(spark):
    from pagewright.operators import retrieval

    chunks = spark.createDataFrame([(1, "a", 0, "1.1", "TRL")], "doc_id long, chunk_id string, chunk_seq long, section_number string, content string")
    asked = spark.createDataFrame([(1, "Section 1 and TRL"), (2, "nothing")], "query_id long, query string")
    assert retrieval.boosted_all(asked.where("query_id > 2"), chunks).count() == 0 == retrieval.boosted_all(asked, chunks.where("chunk_seq > 0")).count()
    assert {tuple(r) for r in retrieval.boosted_all(asked.where("query_id = 2"), chunks).collect()} == {(2, 1, "a", 0, 1.0)}


def test_both_kinds_of_index_are_built_and_counted(spark):
    from pagewright.plans import catalogue

    got = catalogue.queries()["idx_unknown"](spark, "/root/testdata/sf0.001").groupBy("kind").agg(F.sum("n_rows").alias("n"), F.max("refused").alias("r")).collect()
    assert {tuple(r) for r in got} == {("flat", 500, None), ("ivf", 500, None), ("tree", None, "unknown index type 'tree'")}
