"""The thin queries ``op1_*`` to ``op12_*``, each its operator over a whole table.

``queries()`` and ``oracle_sql()`` have the form of ``__spark_entry__``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, line_dedup, mixing, multi_index, packing, periodic, qalsh, simhash, token_stream, toxicity, url_filter
from .common import read_table, scratch_path

#: Files of public tokenizers; the operators take them as parameters.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), RANKS, PATTERN, digest=True)


def op2_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "stream")
    token_stream.write_stream(read_table(spark, sf_dir, "documents"), WORD_BPE, out)
    return token_stream.read_checksums(spark, out)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licenses(read_table(spark, sf_dir, "documents"), templates=licenses.TEMPLATES | licenses.PASSAGES)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("__pw_copies") * F.col("__pw_size")).alias("taken")
    return mixed.select("doc_id", F.col("__pw_size").alias("size"), F.col("__pw_source_size").alias("source_size"), F.col("__pw_target").alias("target"), taken)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__pw_lines").alias("n_lines"), F.col("__pw_gone").alias("n_removed"), F.md5(F.col("text")).alias("kept_md5"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return qalsh.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.link_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, seed=42, max_bits=3)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``; the words of a tenth of the documents, by the checksum h of their ids, repeat from word a on with period p."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeated(w: Column) -> Column:
        n, g = F.size(w), F.floor(hashed / 10)
        start = g % n
        period = 1 + F.floor((n - start) / (3 + g % 8))
        return F.array_join(_bound(F.struct(start.alias("a"), period.alias("p")), lambda s: F.transform(w, lambda x, i: F.when(i >= s["a"], F.get(w, (s["a"] + (i - s["a"]) % s["p"]).cast("int"))).otherwise(x))), " ")

    text = F.when(hashed % 10 == 0, _bound(words, lambda w: F.when(F.size(w) > 0, repeated(w)))).otherwise(F.col("text"))
    return docs.select("doc_id", F.coalesce(text, F.col("text")).alias("text"))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once, not at each place where ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")), min_exponent=4, min_length=6)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), BYTE_BPE, scratch_path(spark, "packed"), end_id=0, length=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_bpe, op2_token_stream, op3_license_scan, op4_mix, op5_toxicity, op6_line_dedup, op7_url_filter, op8_nearest, op9_embedding_links, op10_simhash, op11_periodic_runs, op12_pack)
    return {f.__name__: f for f in named}


_MIX = """
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3 * source_size AS most,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM totals
), filled AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT
         - coalesce(sum(w) OVER o, 0)::BIGINT AS rest, coalesce(sum(most) OVER o, 0)::BIGINT AS capped
  FROM weighed
  WINDOW o AS (ORDER BY most::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stepped AS (
  SELECT *, (total - capped)::DOUBLE / rest::DOUBLE AS level FROM filled
), settled AS (
  SELECT source, source_size, most, w, max(CASE WHEN level * w <= most THEN level END) OVER () AS lvl FROM stepped
), targets AS (
  SELECT source, source_size, coalesce(least(most::DOUBLE, lvl * w), most::DOUBLE) AS target FROM settled
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, 'null:' || md5(coalesce(s.text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

_URLS = """
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), best AS (
  SELECT page_id, url, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, url
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND p.url IS NOT DISTINCT FROM b.url
"""

_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN least ON least.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the operator: no page of the tables has a link or redirect, so ``_URLS`` needs no aliases."""
    return {"op4_mix": _MIX, "op7_url_filter": _URLS, "op9_embedding_links": _LINKS}
