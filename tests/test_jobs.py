"""The jobs over growing input, after failures, and run again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jobs import common, glossary, ingest_chunks

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def stored(spark, out):
    return rows_of(ingest_chunks.current_chunks(spark, out), "doc_id", "lang", "source", "chunk_index", "tokens", "acronyms", "content")


@pytest.fixture
def folders(tmp_path):
    return f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"


def test_growing_input_gives_what_one_run_gives(spark, folders, tmp_path):
    documents, out, checkpoint = folders
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, second = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    first.repartition(2).write.parquet(documents)
    one = ingest_chunks.run(spark, documents, out, checkpoint, separator="\n")
    assert [x["read"] for x in one] == [first.count()] and one[0]["read"] == one[0]["new"] and one[0]["chunks"] > 0
    assert ingest_chunks.run(spark, documents, out, checkpoint, separator="\n") == []
    kept = stored(spark, out)
    # new files hold the rest and some that are known
    second.unionByName(first.limit(20)).repartition(3).write.mode("append").parquet(documents)
    two = ingest_chunks.run(spark, documents, out, checkpoint, files_per_batch=1, separator="\n")
    assert sum(x["read"] for x in two) == second.count() + 20 and sum(x["new"] for x in two) == second.count() and len(two) > 1
    whole = f"{tmp_path}/whole"
    docs.write.parquet(f"{whole}/in")
    ingest_chunks.run(spark, f"{whole}/in", f"{whole}/out", f"{whole}/checkpoint", separator="\n")
    assert stored(spark, out) == stored(spark, f"{whole}/out") and set(kept) < set(stored(spark, out))


def test_a_changed_text_replaces_the_old_chunks(spark, folders):
    documents, out, checkpoint = folders
    spark.createDataFrame([(1, "old " * 300, "en", "s", 0), (2, "same " * 300, None, None, 0), (None, "none " * 300, "en", "s", 0)], DOCS).write.parquet(documents)
    ingest_chunks.run(spark, documents, out, checkpoint)
    spark.createDataFrame([(1, "new " * 300, "en", "s", 0), (2, "same " * 300, None, None, 0)], DOCS).write.mode("append").parquet(documents)
    assert [x["new"] for x in ingest_chunks.run(spark, documents, out, checkpoint)] == [1]
    held = {(r["doc_id"], r["lang"], r["content"][:3]) for r in ingest_chunks.current_chunks(spark, out).collect()}
    assert held == {(1, "en", "new"), (2, None, "sam"), (None, "en", "non")}
    spark.createDataFrame([(1, "short", "en", "s", 0)], DOCS).write.mode("append").parquet(documents)
    ingest_chunks.run(spark, documents, out, checkpoint)
    assert {r["doc_id"] for r in ingest_chunks.current_chunks(spark, out).collect()} == {2, None}


def test_repeated_rows_are_taken_once(spark, folders):
    documents, out, checkpoint = folders
    rows = [(1, "x " * 500, "fr", "b", 0), (1, "x " * 500, "en", "z", 0), (1, "x " * 500, "en", "a", 0), (None, None, "de", "s", 0), (None, None, "de", "s", 0), (2, "x " * 500, "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(documents)
    assert ingest_chunks.run(spark, documents, out, checkpoint)[0] == {"batch_id": 0, "read": 6, "new": 3, "chunks": 2}
    assert {(r["doc_id"], r["lang"], r["source"]) for r in ingest_chunks.current_chunks(spark, out).collect()} == {(1, "en", "a"), (2, "en", "s")}


def test_a_failed_batch_is_run_again(spark, folders, monkeypatch):
    documents, out, checkpoint = folders
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("doc_id % 2 = 0").write.parquet(documents)
    ingest_chunks.run(spark, documents, out, checkpoint, separator="\n")
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(documents)
    read = ingest_chunks.read_if_there

    def fails_late(session, path, schema):
        if "/chunks/batch_id=1" in path:  # both folders of the batch are written by then
            raise RuntimeError("lost")
        return read(session, path, schema)

    with monkeypatch.context() as m:
        m.setattr(ingest_chunks, "read_if_there", fails_late)
        with pytest.raises(Exception, match="lost"):
            ingest_chunks.run(spark, documents, out, checkpoint, separator="\n")
    again = ingest_chunks.run(spark, documents, out, checkpoint, separator="\n")
    assert [(x["batch_id"], x["new"]) for x in again] == [(1, docs.where("doc_id % 2 = 1").count())]
    plain = ingest_chunks.chunk_rows(docs, ingest_chunks.ChunkSizes(), "\n")
    assert stored(spark, out) == rows_of(plain, "doc_id", "lang", "source", "chunk_index", "tokens", "acronyms", "content")


def test_a_new_checkpoint_with_old_output_is_refused(spark, folders, tmp_path):
    documents, out, checkpoint = folders
    for text in ("a " * 900, "b " * 900):
        spark.createDataFrame([(1, text, "en", "s", 0)], DOCS).write.mode("append").parquet(documents)
        ingest_chunks.run(spark, documents, out, checkpoint)
    with pytest.raises(Exception, match="another checkpoint"):
        ingest_chunks.run(spark, documents, out, f"{tmp_path}/other")


@pytest.mark.parametrize("kind", ["json", "orc"])
def test_other_formats_and_no_documents(spark, folders, kind):
    documents, out, checkpoint = folders
    spark.createDataFrame([(1, "one two " * 200, "en", "s", 0), (2, None, "en", "s", 0), (3, "", None, "s", 0)], DOCS).write.format(kind).save(documents)
    assert ingest_chunks.run(spark, documents, out, checkpoint, format=kind)[0]["new"] == 3
    assert {r["doc_id"] for r in ingest_chunks.current_chunks(spark, out).collect()} == {1}
    assert ingest_chunks.current_chunks(spark, f"{out}-none").count() == 0


def test_glossary_of_a_few_texts(spark, folders):
    documents, out, _ = folders
    rows = [(1, "we use (TRL) Technology Level and TRL.", "en"), (2, "Technology Readiness Level (TRL) rules; the AND of XQZ", "en"), (3, "XQZ", None), (4, None, "en"), (5, "", "de"), (6, "CDR ABC", "fr")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(documents)
    assert glossary.run(spark, documents, out) == {"read": 6, "written": 5}
    held = {(r["lang"], r["acronym"]): (r["definition"], r["origin"], r["frequency"], r["n_docs"], round(r["doc_share"], 3), r["first_doc"]) for r in glossary.read_glossary(spark, out).collect()}
    assert held[("en", "TRL")] == ("Technology Level", "text", 3, 2, 0.667, 1)
    assert held[("en", "XQZ")] == (None, None, 1, 1, 0.333, 2) and held[(None, "XQZ")] == (None, None, 1, 1, 1.0, 3)
    assert held[("fr", "CDR")] == ("Critical Design Review", "dictionary", 1, 1, 1.0, 6) and ("fr", "ABC") in held
    spark.createDataFrame([(7, "QRS QRS", "fr"), (8, "QRS", "de")], "doc_id bigint, text string, lang string").write.mode("append").parquet(documents)
    glossary.run(spark, documents, out, langs=["fr"])
    after = {(r["lang"], r["acronym"]): r["frequency"] for r in glossary.read_glossary(spark, out).collect()}
    assert after[("fr", "QRS")] == 2 and ("de", "QRS") not in after and after[("en", "TRL")] == 3


def test_command_line(spark, folders, tmp_path, monkeypatch):
    documents, out, _ = folders
    spark.createDataFrame([(1, "TRL", "en")], "doc_id bigint, text string, lang string").write.parquet(documents)
    config = tmp_path / "glossary.json"
    config.write_text('{"format": "parquet", "documents": "none"}')
    monkeypatch.setattr("sys.argv", ["glossary", "--config", str(config), "--documents", documents, "--out", out])
    monkeypatch.setattr(common, "build_session", lambda name: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    common.main("glossary", "doc", ("documents", "out"), glossary.run)
    assert glossary.read_glossary(spark, out).where(F.col("acronym") == "TRL").count() == 1
