"""The jobs as queries over the given tables, run twice into one new folder, and the SQL of what they leave."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import glossary, ingest_chunks
from pagewright.functions.acronym_dictionary import COMMON_WORDS, KNOWN
from pagewright.plans import catalogue
from pagewright.session import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "ingest")
    for _ in range(2):
        ingest_chunks.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/out", f"{folder}/checkpoint", separator="\n")
    chunks = ingest_chunks.current_chunks(spark, f"{folder}/out")
    return chunks.select("doc_id", "lang", "source", "chunk_index", "tokens", F.array_join("acronyms", ",").alias("acronyms"), "content")


def job2_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "glossary")
    for _ in range(2):
        glossary.run(spark, f"{sf_dir}/documents.parquet", folder)
    rows = glossary.read_glossary(spark, folder)
    return rows.withColumn("doc_share", F.round("doc_share", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_ingest_chunks, job2_glossary)}


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_WORDS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+')"
_CAPITALS = f"list_filter({_WORDS}, lambda w: regexp_full_match(w, '[A-Z]{{{{2,}}}}') AND w NOT IN {_list(COMMON_WORDS)})"
_KNOWN = ", ".join("('{}', '{}')".format(a, d.replace("'", "''")) for a, d in KNOWN.items())
_NAME = "([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)"


def _defined(turn: int, pattern: str, acronym: int, definition: int) -> str:
    return f"""SELECT lang, doc_id, {turn} AS turn, unnest(regexp_extract_all(text, '{pattern}', {acronym})) AS acronym,
  unnest(regexp_extract_all(text, '{pattern}', {definition})) AS definition, generate_subscripts(regexp_extract_all(text, '{pattern}', 1), 1) AS pos FROM documents"""


def oracle_sql() -> dict[str, str]:
    chunks = f"""SELECT c.doc_id, lang, source, chunk_index, tokens, array_to_string(list_sort(list_distinct({_CAPITALS.format("content")})), ',') AS acronyms, content
FROM ({catalogue.oracle_sql()["chunk_split"]}) c JOIN documents d ON d.doc_id = c.doc_id"""
    terms = f"""WITH w AS (SELECT doc_id, lang, unnest({_CAPITALS.format("text")}) AS acronym FROM documents),
c AS (SELECT lang, acronym, count(*) AS frequency, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM w GROUP BY 1, 2),
n AS (SELECT lang, count(*) AS n_lang FROM documents GROUP BY 1), known(acronym, known) AS (VALUES {_KNOWN}),
f AS ({_defined(0, _NAME + "\\s*\\(([A-Z]{2,})\\)", 2, 1)} UNION ALL {_defined(1, "\\(([A-Z]{2,})\\)\\s+" + _NAME, 1, 2)}),
r AS (SELECT lang, acronym, definition, row_number() OVER (PARTITION BY lang, acronym ORDER BY doc_id, turn, pos) AS k FROM f)
SELECT c.lang, c.acronym, coalesce(r.definition, known) AS definition,
 CASE WHEN r.definition IS NOT NULL THEN 'text' WHEN known IS NOT NULL THEN 'dictionary' END AS origin,
 frequency::BIGINT AS frequency, n_docs, round(n_docs / n_lang, 6) AS doc_share, first_doc
FROM c JOIN n ON n.lang IS NOT DISTINCT FROM c.lang LEFT JOIN r ON r.lang IS NOT DISTINCT FROM c.lang AND r.acronym = c.acronym AND k = 1 LEFT JOIN known ON known.acronym = c.acronym"""
    return {"job1_ingest_chunks": chunks, "job2_glossary": terms}
