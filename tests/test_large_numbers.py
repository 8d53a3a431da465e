"""What larger tables bring: section numbers of three digits, elements that round to zero."""

from __future__ import annotations

import math
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from pagewright.operators import metadata, structure
from pagewright.plans import catalogue

#: Two sections, the second with a number of three digits.
_TEXT = "1.1 First\nbody a\n1.2.121.30 Second\nbody b"


def test_type_tells_headings_with_long_numbers(spark):
    rows = [(1, i, 1, text, [(size, 0)]) for i, (text, size) in enumerate([("1.1 First", 14.0), ("body a", 10.0), ("body c", 10.0), ("1.2.121.30 Second", 14.0), ("body b", 10.0)])]
    blocks = spark.createDataFrame(rows, "doc_id long, block_seq long, page_no int, text string, spans array<struct<size:double,flags:int>>")
    got = structure.sections_from_blocks(blocks).orderBy("section_seq").select("section_number", "content").collect()
    assert [tuple(r) for r in got] == [("1.1", "body a\nbody c"), ("1.2.121.30", "body b")]


def test_pages_have_headings_with_long_numbers(spark):
    pages = spark.createDataFrame([(1, 1, _TEXT)], "doc_id long, page_no int, text string")
    got = structure.sections_from_pages(pages).orderBy("section_seq").select("section_number", "content").collect()
    assert [tuple(r) for r in got] == [("1.1", _TEXT), ("1.2.121.30", "1.2.121.30 Second\nbody b")]


def test_text_has_headings_with_long_numbers(spark):
    pages = spark.createDataFrame([(1, 1, _TEXT)], "doc_id long, page_no int, text string")
    got = structure.sections_from_text(pages).orderBy("section_seq").select("section_number", "content").collect()
    assert [tuple(r) for r in got] == [("1.1", "body a"), ("1.2.121.30", "body b")]


def test_small_negative_elements_keep_their_sign(spark, tmp_path):
    rows = [(1, [-1e-9, 1.0], 0), (2, [0.0, 0.0], 0), (3, [-3.0, 4.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["unit"] for r in catalogue.queries()["l2_normalize"](spark, str(tmp_path)).collect()}
    assert math.copysign(1, got[1][0]) == -1 and got[1] == [0.0, 1.0]
    assert all(math.isnan(x) for x in got[2]) and got[3] == [-0.6, 0.8]


def test_a_large_section_is_dealt_to_several_tasks(spark, monkeypatch):
    from pagewright.operators import chunking

    monkeypatch.setattr(chunking, "SECTION_ROWS", 3)
    rows = spark.createDataFrame([(1, i, "1" if i < 10 else "unknown" if i < 14 else "2") for i in range(15)], "doc_id long, table_seq long, section_number string")
    info = spark.createDataFrame([(1, "1", "one"), (1, "2", "two"), (1, "3", "three")], "doc_id long, section_number string, name string")
    got = chunking._with_section(rows, info, "table_seq")
    assert got.columns == ["doc_id", "section_number", "table_seq", "name"]
    assert {(r["table_seq"], r["name"]) for r in got.collect()} == {(i, "one" if i < 10 else None if i < 14 else "two") for i in range(15)} and got.count() == 15


def test_counts_of_words_by_bucket_for_any_number_of_buckets(spark):
    import hashlib

    from pagewright.functions import vectors as V

    words = "the cat and the dog and the bird".split()
    frame = spark.createDataFrame([("The cat and the dog, and THE bird",), ("",), (None,)], "t string")
    for dim in (64, 10, 7):
        bucket = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim  # noqa: B023, E731
        got = [r["v"] for r in frame.select(V.hashed_words(F.col("t"), dim).alias("v")).collect()]
        assert got == [[float(sum(bucket(w) == b for w in words)) for b in range(dim)], [0.0] * dim, None]


_SECTION = "doc_id long, section_seq long, section_number string, content string, title string"


def _around(body: str, pattern: str) -> list[tuple]:
    return [(m[1], body[max(0, m.start() - 50) : m.end() + 50].strip()) for m in re.finditer(pattern, body, re.IGNORECASE | re.ASCII)]


def test_work_on_references_grows_with_the_section(spark):
    lines = [f"1.{i} Supplier-{i:09d}\nAs described in Section {i % 5 + 1}. See Chapter 3 and refer to Section {i}. See Section 1.{i} for it" for i in range(3000)]
    body = "\n".join(lines)
    metadata.cross_references(spark.createDataFrame([(1, 1, "1", lines[0], "T")], _SECTION)).count()  # workers and compiled code
    began = time.perf_counter()
    rows = metadata.cross_references(spark.createDataFrame([(1, 1, "1", body, "T")], _SECTION)).orderBy("pattern", "pos").collect()
    assert time.perf_counter() - began < 40
    want = [(i, *hit) for i, (pattern, _) in enumerate(metadata.XREF_PATTERNS) for hit in _around(f"{body} T", pattern)]
    assert len(rows) == 21_000 and [(r["pattern"], r["target"], r["context"]) for r in rows] == want


def test_references_side_by_side_lie_in_the_context_of_each_other(spark):
    texts = ["Section 1" * 20, "Chapter 1" * 13 + "see", "see Section 2see\n\nsection 2.1" * 7, "\u00e9\U0001d4b3" * 30 + "Section 3" + "\U0001d4b3" * 60, "Section 4", "", "none"]
    rows = metadata.cross_references(spark.createDataFrame([(1, i, "1", text, "Section 9") for i, text in enumerate(texts)], _SECTION)).orderBy("section_seq", "pattern", "pos").collect()
    want = [(n, i, *hit) for n, text in enumerate(texts) for i, (pattern, _) in enumerate(metadata.XREF_PATTERNS) for hit in _around(f"{text} Section 9", pattern)]
    assert [(r["section_seq"], r["pattern"], r["target"], r["context"]) for r in rows] == want


@pytest.mark.parametrize("name", ["sections_pages", "sections_regex", "chunk_doc"])
def test_queries_equal_their_sql_at_keys_of_larger_tables(spark, tmp_path, name):
    con = duckdb.connect()
    for table in ("region", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    keys = [0, 49, 4_949, 4_950, 5_999, 59_999, 359_999, 50_000_000]
    con.execute(f"CREATE TABLE supplier AS SELECT k AS s_suppkey, printf('Supplier#%09d', k) AS s_name, (k % 2)::INT AS s_nationkey, 1.0::DOUBLE AS s_acctbal FROM (SELECT unnest({keys})::BIGINT AS k)")
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
    rows = catalogue.queries()[name](spark, str(tmp_path))
    cursor = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    assert sorted(columns) == sorted(rows.columns) and len(want) == 38
    assert sorted(str(tuple(r)) for r in rows.select(*columns).collect()) == want
