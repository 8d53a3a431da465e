"""What the operators refuse, before any job runs."""

from __future__ import annotations

import pytest

from pagewright.llm import line_dedup, mixing, multi_index, qalsh, queries, simhash, token_stream


@pytest.mark.parametrize("work", [mixing.mix, mixing.mixed_documents, line_dedup.dedup_lines])
@pytest.mark.parametrize("name", ["__pw_size", "__PW_lines"])
def test_the_operators_own_names_are_refused(spark, work, name):
    docs = spark.createDataFrame([(1, "a", "s", 7)], f"doc_id long, text string, source string, {name} int")
    with pytest.raises(ValueError, match="__pw_"):
        work(docs)


def test_ids_that_are_no_integers_are_refused(spark):
    vectors = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>")
    with pytest.raises(ValueError, match="vec_id holds string"):
        qalsh.nearest(vectors, vectors)
    with pytest.raises(ValueError, match="vec_id holds string"):
        multi_index.link_vectors(vectors, label_col=None)
    named = spark.createDataFrame([(1, [1.0], "a")], "vec_id long, embedding array<float>, label string")
    with pytest.raises(ValueError, match="label holds string"):
        multi_index.link_vectors(named)
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(ValueError, match="doc_id holds string"):
        simhash.simhash_components(docs)
    with pytest.raises(ValueError, match="doc_id holds string"):
        token_stream.write_stream(docs, queries.WORD_BPE, "nowhere")


def test_rows_are_dealt_by_what_they_hold(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    plan = qalsh.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=3, shard=50)._jdf.queryExecution().toString()
    assert "monotonically_increasing_id" not in plan and "xxhash64" in plan
