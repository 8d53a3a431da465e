"""Stores that are merged into, page files as a data source, models that refuse, long ways up a hierarchy."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import metadata
from pagewright.plans import catalogue_ingest
from pagewright.sources import page_files, parsers
from pagewright.sources import tables as sources


def models():
    """A model that takes three requests, then refuses, and fails at images named bad; and one that always answers."""

    class Refuses:
        def __init__(self):
            self.calls = 0

        def describe(self, image, caption):
            self.calls += 1
            if image == b"bad":
                raise ValueError("no image")
            if self.calls > 3:
                raise parsers.RateLimited("slow down")
            return f"VISUALIZATION_TYPE: {caption}"

    class Describes:
        def describe(self, image, caption):
            return f"VISUALIZATION_TYPE: {caption}"

    return Refuses, Describes


def files_of(path):
    return {f for d, _, names in os.walk(path) for f in (os.path.join(d, n) for n in names) if f.endswith(".parquet")}


def test_a_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(d, f"c{i}", f"text {i}", [float(i)]) for d in (1, 2) for i in range(60)]
    sources.save_store(spark.createDataFrame(rows, "doc_id long, chunk_id string, content string, embedding array<double>"), path, {"dimension": 1}, key=("doc_id", "chunk_id"), buckets=16)
    before = files_of(f"{path}/chunks")
    new = spark.createDataFrame([(1, "c5", "new text", [9.0]), (2, "c99", "added", [8.0])], "doc_id long, chunk_id string, content string, embedding array<double>")
    touched = sources.merge_store(spark, path, new, ("content", "embedding"))
    after = files_of(f"{path}/chunks")
    kept = {f for f in before if int(f.split("__bucket=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 2 and kept and kept <= after and not (before - kept) & after
    want = {(d, c): (t, e) for d, c, t, e in rows} | {(1, "c5"): ("new text", [9.0]), (2, "c99"): ("added", [8.0])}
    held = lambda: {(r.doc_id, r.chunk_id): (r.content, list(r.embedding)) for r in sources.load_store(spark, path, {"dimension": 1}).collect()}
    assert held() == want
    assert sources.merge_store(spark, path, new, ("content", "embedding")) == touched and held() == want
    assert sources.merge_store(spark, path, new.limit(0), ("content",)) == [] and held() == want
    # a run that fails leaves what was there
    broken = new.withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sources.merge_store(spark, path, broken, ("content",))
    assert held() == want


def test_page_files_as_a_source_and_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"d{i}.txt").write_text("\f".join(f"page {i}.{k}" for k in range(i + 1)))
    (folder / "broken.txt").write_bytes(b"\xff")
    (folder / "other.bin").write_text("no")
    page_files.register(spark)
    options = {"parser": "pagewright.plans.catalogue_ingest:FormFeeds", "pathGlobFilter": "*.txt", "filesPerPartition": "2"}
    read = spark.read.format("page_files").options(**options).load(str(folder))
    assert read.rdd.getNumPartitions() == 3
    plain = parsers.parse_pages(parsers.binary_files(spark, str(folder), "d*.txt"), catalogue_ingest.FormFeeds).select("doc_id", "page_no", "text", "error")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(read.where("path not like '%broken%'").select("doc_id", "page_no", "text", "error")) == rows(plain)
    broken = read.where("path like '%broken%'").collect()
    assert [(r.page_no, r.text, "decode" in r.error) for r in broken] == [(1, None, True)]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.format("page_files").options(**options).load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return rows(spark.read.parquet(out).select("doc_id", "page_no", "text", "error"))

    first = run()
    assert first == rows(read.select("doc_id", "page_no", "text", "error")) and run() == first
    (folder / "d9.txt").write_text("late page")
    os.utime(folder / "d9.txt", (4_000_000_000, 4_000_000_000))
    assert [x for x in run() if x not in first] == [(page_files.document_id(f"file:{folder}/d9.txt"), 1, "late page", None)]
    assert spark.read.format("page_files").options(**options).load(str(tmp_path / "none")).count() == 0


def test_a_model_that_refuses_is_left_alone(spark):
    images = spark.createDataFrame([(i, bytearray(b"bad" if i == 1 else b"x"), f"c{i}") for i in range(12)], "i int, image binary, caption string").coalesce(1).sortWithinPartitions("i")

    Refuses, Describes = models()
    rows = {r.i: (r.reply is not None, r.describe_error) for r in parsers.describe_images(images, Refuses, limit=2).collect()}
    assert [i for i, (yes, _) in rows.items() if yes] == [0, 2] and rows[1] == (False, "no image")
    assert rows[3][1] == rows[4][1] == "slow down" and {rows[i][1] for i in range(5, 12)} == {parsers.NOT_TRIED}
    stored = parsers.describe_images(images, Refuses, limit=2)
    rest = parsers.describe_missing(images, stored, Describes, ("i",))
    assert sorted(r.i for r in rest.collect()) == [1, *range(3, 12)] and rest.where("reply is null").count() == 0
    assert rest.columns == stored.columns


def test_fallback_for_what_fails_late(spark, tmp_path):
    def first(session, path):
        rows = [(1, 1, "one", None), (2, 1, "two", None), (2, 2, None, "broken")]
        return session.createDataFrame(rows, "doc_id long, page_no int, text string, error string")

    def second(session, path):
        return session.createDataFrame([(1, 1, "other one"), (2, 1, "other two"), (2, 2, "more")], "doc_id long, page_no int, text string")

    def fails(session, path):
        return session.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("late"))).cast("string").alias("text"))

    got = sources.parse_with_fallback(first, second)(spark, "x")
    assert sorted((r.doc_id, r.page_no, r.text) for r in got.collect()) == [(1, 1, "one"), (2, 1, "other two"), (2, 2, "more")]
    assert sources.parse_with_fallback(fails, second)(spark, "x").count() == 3
    with pytest.raises(Exception, match="late"):
        sources.parse_with_fallback(fails, None)(spark, "x")


def test_paths_of_any_depth(spark):
    rows = [(1, str(i), str(i - 1) if i else "root") for i in range(60)] + [(2, "a", None), (2, "b", "a")]
    got = {(r.doc_id, r.section_number): list(r.path) for r in metadata.section_paths(spark.createDataFrame(rows, "doc_id long, section_number string, parent string")).collect()}
    assert got == {(1, str(i)): ["root", *map(str, range(i + 1))] for i in range(60)} | {(2, "a"): ["a"], (2, "b"): ["a", "b"]}
    circle = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "doc_id long, section_number string, parent string")
    with pytest.raises(ValueError, match="own ancestors"):
        metadata.section_paths(circle)


def test_expanding_follows_what_definitions_bring_in(spark):
    pairs = [("AB", "All of CD"), ("CD", "Common Data"), ("EF", "Every Form of AB"), ("x1", "ex one"), ("GH", "Great Hall")]
    array = F.array(*[F.struct(F.lit(a).alias("acronym"), F.lit(d).alias("definition")) for a, d in pairs])

    def plain(text):
        import re

        for a, d in pairs:
            text = re.sub(rf"\b{a}\b", lambda m, a=a, d=d: f"{d} ({a})", text, count=1)
        return text

    texts = ["AB here", "EF and AB", "no", "x1 CD CD", "", "GHI GH"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", metadata.expand_acronyms(F.col("t"), array).alias("e")).collect()
    assert {r.t: r.e for r in got} == {t: plain(t) for t in texts}
