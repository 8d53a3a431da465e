"""A corpus with sections, references and definitions, derived from the dimension tables.

The same SQL runs in Spark and in DuckDB, so queries and their oracles see one corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, metadata
from ..session import settled
from ..sources.tables import table

#: Sections; level 3 is left out on purpose, so that some parents do not exist.
SECTIONS = """
WITH raw AS (
 SELECT concat('', r_regionkey + 1) AS section_number, r_name AS title, r_regionkey AS a, 0 AS b, 0 AS k, 1 AS kind FROM region
 UNION ALL
 SELECT concat(n_regionkey + 1, '.', n_nationkey + 1), replace(n_name, '_', '-'), n_regionkey, n_nationkey, 0, 2 FROM nation
 UNION ALL
 SELECT concat(n_regionkey + 1, '.', n_nationkey + 1, '.', CAST(FLOOR(s_suppkey / 50) AS INT) + 1, '.', s_suppkey % 50 + 1),
        replace(s_name, '#', '-'), n_regionkey, n_nationkey, s_suppkey, 3
 FROM supplier JOIN nation ON s_nationkey = n_nationkey
), numbered AS (
 SELECT *, row_number() OVER (ORDER BY a, b, kind, k) AS section_seq FROM raw
)
SELECT CAST(1 AS BIGINT) AS doc_id, CAST(section_seq AS BIGINT) AS section_seq, section_number, title,
       CAST(length(section_number) - length(replace(section_number, '.', '')) + 1 AS INT) AS level,
       CASE WHEN kind = 1 THEN NULL ELSE regexp_replace(section_number, '[.][^.]+$', '') END AS parent_section,
       CAST(FLOOR(section_seq / 3) AS INT) + 1 AS page_start, CAST(FLOOR(section_seq / 3) AS INT) + 1 + CAST(section_seq % 2 AS INT) AS page_end,
       concat('As described in Section ', (a + 1) % 5 + 1, '. ',
              CASE k % 4 WHEN 0 THEN 'The Technology Readiness Level (TRL) applies. ' WHEN 1 THEN '(CDR) Critical Design Review follows. '
                         WHEN 2 THEN 'Use SEMP and TPM data. ' ELSE 'See Chapter 3 and refer to Section 2. ' END,
              'See Section ', a + 1, '.', b + 1, ' for ', title) AS content
FROM numbered
"""
#: Two chunks of every tenth section, one of the others.
CHUNKS = f"""
SELECT doc_id, section_seq * 2 + part AS chunk_seq, concat('chunk_', section_seq * 2 + part) AS chunk_id, section_number, title AS section_title,
       level AS section_level, parent_section, page_start, page_end,
       CASE WHEN part = 1 THEN 'table' WHEN section_seq % 7 = 3 THEN 'diagram_ref' ELSE 'text' END AS chunk_type,
       CASE WHEN part = 1 THEN concat('**Table ', section_number, ': nations and suppliers of ', title, '** (Rows 1-5)') ELSE concat('# ', title, chr(10), chr(10), content) END AS content
FROM ({SECTIONS}) s CROSS JOIN (SELECT 0 AS part UNION ALL SELECT 1) p
WHERE part = 0 OR section_seq % 10 = 0
"""
#: Questions: user turns of all conversations and some that name sections and acronyms, whose ids the turns leave free.
QUESTIONS = """
SELECT CAST(conv_id * 100 + turn + CASE WHEN conv_id >= 9000 THEN 1000000 ELSE 0 END AS BIGINT) AS query_id, text AS query FROM conversations WHERE role = 'user'
UNION ALL SELECT CAST(900001 AS BIGINT), 'What are the nations and suppliers of Section 1.1 and the TRL?'
UNION ALL SELECT CAST(900002 AS BIGINT), 'Show how Section 2 and CDR or SEMP data follow'
UNION ALL SELECT CAST(900003 AS BIGINT), 'ASIA'
UNION ALL SELECT CAST(900004 AS BIGINT), 'What does Critical Design Review look like in 3.4?'
"""
#: Answers with citations of various forms.
ANSWERS = f"""
SELECT section_seq AS query_id,
       concat(content, ' (Section ', section_number, ', page ', page_start, '). ', CASE section_seq % 5 WHEN 0 THEN 'It is unclear. ' WHEN 1 THEN 'Compare section 2.3 and Section 77.1 p. 9! ' ELSE '' END,
              CASE WHEN section_seq % 3 = 0 THEN concat('Further see Section ', section_number, ' page ', page_start + 40, '.') ELSE 'No more.' END) AS answer
FROM ({SECTIONS}) s
"""
#: Ranked hits per question: every section asks, and finds its neighbours.
HITS = f"""
SELECT q.section_seq AS query_id, c.doc_id, c.chunk_id, c.chunk_seq, c.section_number, CAST((c.section_seq - q.section_seq + 5) AS BIGINT) AS pos, CAST(1.0 AS DOUBLE) / greatest(1, c.section_seq - q.section_seq + 6) AS score
FROM ({SECTIONS}) q JOIN (SELECT *, CAST(FLOOR(chunk_seq / 2) AS BIGINT) AS section_seq FROM ({CHUNKS}) cc WHERE chunk_seq % 2 = 0) c
  ON c.section_seq BETWEEN q.section_seq - 5 AND q.section_seq + 5
"""
_TABLES = ("region", "nation", "supplier", "conversations", "customer", "part", "lineitem")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the driver's tables; names are bound to this directory's files, not to shared views."""
    for name in _TABLES:
        text = _bound(text, name, f"parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(text)


def _bound(text: str, name: str, source: str) -> str:
    for word in ("FROM ", "JOIN "):
        for end in (" ", "\n", ")"):
            text = text.replace(f"{word}{name}{end}", f"{word}{source}{end}")
        if text.endswith(f"{word}{name}"):
            text = text[: -len(name)] + source
    return text


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SECTIONS)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.hierarchy(sections(spark, sf_dir))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(metadata.dedup_references(metadata.cross_references(sections(spark, sf_dir))))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CHUNKS)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, HITS)


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with both vectors: of the context string and of the raw content."""
    # numbering the sections leaves them in one task; the words of chunks are counted by several
    rows = chunks(spark, sf_dir).repartition("chunk_seq").withColumn("section_path", F.array(F.substring_index("section_number", ".", 1)))
    return settled(rows.withColumn("context_vec", V.hashed_words(chunking.context_string(rows))).withColumn("content_vec", V.hashed_words(F.col("content"))))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(sql(spark, sf_dir, QUESTIONS).withColumn("query_vec", V.hashed_words(F.col("query"))))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, ANSWERS)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as page texts: a contents page, then two sections a page, a part of the second on the next page."""
    rows = sections(spark, sf_dir).select("doc_id", "section_seq", (F.floor((F.col("section_seq") - 1) / 2) + 2).cast("int").alias("page_no"), F.concat(F.col("section_number"), F.lit(" "), F.col("title"), F.lit("\n"), F.col("content")).alias("body"), F.concat(F.col("section_number"), F.lit(" "), F.col("title"), F.lit(" ..... "), F.col("page_start")).alias("entry"))
    body = rows.groupBy("doc_id", "page_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("section_seq", "body"))).getField("body"), "\n").alias("text"))
    contents = rows.groupBy("doc_id").agg(F.lit(1).alias("page_no"), F.array_join(F.array_sort(F.collect_list(F.struct("section_seq", "entry"))).getField("entry"), "\n").alias("text"))
    return contents.unionByName(body)


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table fragments of order lines: a fragment for each page of three lines, some with the header repeated."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    row = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"))
    groups = lines.groupBy(F.col("l_orderkey").alias("doc_id"), F.floor((F.col("l_linenumber") - 1) / 3).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("r")))).getField("r").alias("rows"))
    header = F.array(F.lit("part"), F.lit("supplier"), F.lit("line"))
    rows = F.when(F.col("page") % 2 == 1, F.concat(F.array(header), F.col("rows"))).otherwise(F.col("rows"))
    caption = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Lines part "), F.col("page"))).when(F.col("page") > 0, "").otherwise(F.concat(F.lit("Table "), F.col("doc_id")))
    return groups.select("doc_id", F.col("page").cast("long").alias("table_seq"), F.concat(F.lit("table_"), F.col("page")).alias("table_id"), caption.alias("caption"), F.array(F.col("page") + 1).alias("page_range"), header.alias("headers"), rows.alias("rows"), T.table_number(caption).alias("table_number"))
