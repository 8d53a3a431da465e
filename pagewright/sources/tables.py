"""Sources and sinks: pages, JSON documents and chunks, stores, reports."""

from __future__ import annotations

import json
import urllib.request
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..operators.vectors import upsert
from ..session import settled

PAGES = "doc_id bigint, page_no int, text string"
SECTION = "struct<section_number:string,title:string,content:string,page_start:int,page_end:int,level:int,parent_section:string,subsections:array<string>>"
TABLE = "struct<table_id:string,caption:string,page_range:array<int>,headers:array<string>,rows:array<array<string>>,table_number:string,section_number:string,section_title:string>"
DIAGRAM = "struct<diagram_id:string,caption:string,page:int,figure_number:string,image_path:string,section_number:string,section_title:string,extracted_text:string,diagram_description:string,image_size_bytes:int>"
DOCUMENT = f"title string, sections array<{SECTION}>, tables array<{TABLE}>, diagrams array<{DIAGRAM}>, metadata map<string,string>, raw_text string"
CHUNK = "chunk_id string, content string, chunk_type string, section_number string, section_title string, section_level int, parent_section string, section_path array<string>, page_start int, page_end int, token_count int, metadata string"
GOLD = "id int, query string, category string, expected_sections array<string>, expected_terms array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def download(url: str, path: str, timeout: float = 300.0, block: int = 8_192) -> str:
    """Fetch a file block by block into a local path, folders included.  A driver-side helper."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with urllib.request.urlopen(url, timeout=timeout) as response, open(path, "wb") as out:  # noqa: S310
        while data := response.read(block):
            out.write(data)
    return path


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one a document, pages parted by form feeds, as ``(doc_id, page_no, text)``."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    pages = files.select(F.xxhash64("file").alias("doc_id"), F.posexplode(F.split("value", "\f")).alias("p", "text"))
    return pages.select("doc_id", (F.col("p") + 1).alias("page_no"), "text")


def page_tables(html_pages: DataFrame) -> DataFrame:
    """HTML pages ``(page_id, url, html)`` as page texts: markup taken off, one page a document."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<(br|/p|/h\d|/li|/tr|/div)[^>]*>", "\n"), r"<[^>]+>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?m)^ +| +$", "")
    return html_pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_no"), text.alias("text"))


def parse_with_fallback(first, second):
    """A page source that turns to the second one where the first can't be read.

    Sources are callables ``(spark, path) -> DataFrame``.  Spark is lazy, so the first one's rows are
    worked out and kept in the shared folder: a file that fails late is noticed too.  Rows with an
    ``error``, as ``parsers.parse_pages`` gives them, count as failed documents: these come from the second source.
    """

    def read(spark: SparkSession, path: str) -> DataFrame:
        try:
            df = settled(first(spark, path))
        except Exception:
            if second is None:
                raise
            return second(spark, path)
        if second is None or "error" not in df.columns:
            return df
        failed = df.where("error is not null").select("doc_id").distinct()
        if not failed.limit(1).count():
            return df
        other = second(spark, path).join(failed, "doc_id", "left_semi")
        return df.join(failed, "doc_id", "left_anti").unionByName(other, allowMissingColumns=True)

    return read


def read_documents(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Parsed documents in JSON as four relations: documents, sections, tables, diagrams."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("doc_id", F.xxhash64(F.input_file_name()))

    def part(name: str, seq: str) -> DataFrame:
        return raw.select("doc_id", F.posexplode(name).alias(seq, "x")).select("doc_id", F.col(seq).cast("long").alias(seq), "x.*")

    return {"documents": raw.select("doc_id", "title", "metadata", "raw_text"), "sections": part("sections", "section_seq"), "tables": part("tables", "table_seq"), "diagrams": part("diagrams", "diagram_seq")}


def write_documents(parts: dict[str, DataFrame], path: str) -> None:
    """The four relations as Parquet, one folder each."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON array; metadata stays JSON text, numbered in file order within a file."""
    return spark.read.schema(CHUNK).option("multiLine", True).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def write_metadata(parts: dict[str, DataFrame], path: str) -> None:
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions ``(query_id, query, category, expected_sections, expected_terms)``."""
    return spark.read.schema(GOLD).option("multiLine", True).json(path).withColumnRenamed("id", "query_id")


#: Folders that a store's chunks are dealt into.
BUCKETS = 64
_BUCKET = "__bucket"


def _bucket(key: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def save_store(chunks: DataFrame, path: str, config: dict, key: tuple[str, ...] = ("chunk_id",), buckets: int = BUCKETS) -> None:
    """Chunks with their vectors as Parquet, a folder for each bucket of their keys, and the settings beside them."""
    chunks.withColumn(_BUCKET, _bucket(key, buckets)).hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/chunks")
    spark, settings = chunks.sparkSession, config | {"key": list(key), "buckets": buckets, "schema": chunks.schema.json()}
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def _store(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    held = json.loads(spark.read.text(f"{path}/config").first()[0])
    schema = StructType.fromJson(json.loads(held["schema"])).add(_BUCKET, IntegerType())
    return held, spark.read.schema(schema).parquet(f"{path}/chunks")


def load_store(spark: SparkSession, path: str, expected: dict | None = None) -> DataFrame:
    """The stored chunks; settings that differ from the expected ones are an error."""
    held, rows = _store(spark, path)
    wrong = {k: (held.get(k), v) for k, v in (expected or {}).items() if held.get(k) != v}
    if wrong:
        raise ValueError(f"the store was built with other settings: {wrong}")
    return rows.drop(_BUCKET)


def merge_store(spark: SparkSession, path: str, new: DataFrame, columns: tuple[str, ...]) -> list[int]:
    """Put ``new`` rows into a store: ``columns`` of rows whose key it has, whole rows otherwise.  The buckets written anew.

    Only the folders of buckets that hold a key of ``new`` are read and overwritten, by Spark's dynamic
    partition overwrite, which moves finished files in at the end: the others keep their
    files, and a run that fails before leaves the store as it was.
    """
    held, rows = _store(spark, path)
    key = tuple(held["key"])
    fresh = new.withColumn(_BUCKET, _bucket(key, held["buckets"]))
    touched = sorted(r[0] for r in fresh.select(_BUCKET).distinct().collect())  # buckets at most
    if touched:
        old = rows.where(F.col(_BUCKET).isin(touched))
        merged = settled(upsert(old, fresh, key, columns).select(*rows.columns))  # read before its folders are overwritten
        merged.hint("rebalance", _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(f"{path}/chunks")
    return touched


def write_report(results: DataFrame, summary: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(f"{path}/results")
    summary.write.mode("overwrite").json(f"{path}/summary")
