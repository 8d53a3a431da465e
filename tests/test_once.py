"""What belongs to a question or a chunk is worked out once, and only what later stages read is kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.functions import vectors as V
from pagewright.operators import blocks, retrieval


def _inputs(spark):
    said = [(1, "What are the Systems and the TRL of Section 1.1?"), (2, "Show how it should look like"), (3, "MÉTÉO ärger")]
    held = [(1, i, f"chunk_{i}", f"1.{i}", "Title " + "abc"[i], kind, text) for i, (kind, text) in enumerate([("table", "**Table 1: systems and teams**"), ("diagram_ref", "Show how it should look like"), ("text", "the météo ärger of TRL")])]
    questions = spark.createDataFrame(said, "query_id long, query string").withColumn("query_vec", V.hashed_words(F.col("query")))
    chunks = spark.createDataFrame(held, "doc_id long, chunk_seq long, chunk_id string, section_number string, section_title string, chunk_type string, content string")
    return questions, chunks.withColumn("content_vec", V.hashed_words(F.col("content"))).withColumn("context_vec", F.col("content_vec"))


def test_retrieval_keeps_no_texts_of_its_hits(spark, monkeypatch):
    kept, settled = [], retrieval.settled
    monkeypatch.setattr(retrieval, "settled", lambda df: kept.append(df.columns) or settled(df))
    questions, chunks = _inputs(spark)
    edges = spark.createDataFrame([], "doc_id long, source string, target string")
    assert retrieval.retrieve(questions, chunks, edges).where("stage = 'final'").count() == 9
    assert kept and not any({"query", "content", "query_vec"} & set(columns) for columns in kept)


def test_signals_of_texts_are_found_before_hits_meet_them(spark):
    questions, chunks = _inputs(spark)
    hits = questions.select("query_id").crossJoin(chunks.select("doc_id", "chunk_id", "chunk_seq")).withColumn("score", F.lit(0.5)).withColumn("pos", F.col("chunk_seq"))
    got = retrieval.rerank(hits, questions, chunks)
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "score" in above and "lower(" not in above
    met = hits.join(questions, "query_id").join(chunks, ["doc_id", "chunk_id"])
    factor = retrieval.rerank_factor(F.col("query"), F.col("content"), F.col("section_title"), F.col("chunk_type"))
    plain = met.select("query_id", "chunk_id", ((0.7 * V.cosine(F.col("query_vec"), F.col("content_vec")) + 0.3 * F.col("score")) * factor).alias("score"))
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], r["score"]) for r in df.collect())
    assert rows(got) == rows(plain) and len({r[2] for r in rows(plain)}) > 3


def test_names_in_questions_are_found_before_hits_meet_them(spark):
    questions, chunks = _inputs(spark)
    above = retrieval.primary_hits(questions, chunks)._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "score" in above and "regexp" not in above


def test_pairs_are_found_by_slices_as_by_brute_force():
    rng = np.random.default_rng(1)
    v, q = rng.integers(0, 3, (9_000, 8)).astype(float), rng.integers(0, 3, (1_500, 8)).astype(float)
    lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())
    rows = pa.StructArray.from_arrays([pa.array(np.arange(len(v))), lists(v)], names=["key", "v"])
    asked = pa.StructArray.from_arrays([pa.array(np.arange(len(q))), lists(q)], names=["query_id", "q"])
    which, whose, score = blocks.best_pairs("cosine", rows, asked, 5)
    for i in (0, 1_023, 1_024, 1_499):
        exact = blocks.exact("cosine", v, np.broadcast_to(q[i], v.shape))
        want = np.lexsort((np.arange(len(v)), -exact))[:5]
        mine = np.flatnonzero(whose == i)
        mine = mine[np.lexsort((which[mine], -score[mine]))]
        assert which[mine].tolist() == want.tolist() and score[mine].tolist() == exact[want].tolist()
