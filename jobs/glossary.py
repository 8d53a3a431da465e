"""A glossary of the acronyms in a corpus, one part for each language.

    spark-submit --py-files ... jobs/glossary.py --config jobs/glossary.json \\
        --documents s3a://in/documents --out s3a://store/glossary

One scan and one shuffle of ``(language, acronym)``, summed up in the tasks first.  Written
as ``lang=L``; a run for some languages replaces their parts alone, a run for all replaces all.
The same documents give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from pagewright.functions import text as T
from pagewright.operators.metadata import acronym_dictionary, definition_pairs, drop_common_words

GLOSSARY = "acronym string, definition string, origin string, frequency bigint, n_docs bigint, doc_share double, first_doc bigint, lang string"


def glossary(documents: DataFrame) -> DataFrame:
    """``(lang, acronym, definition, origin, frequency, n_docs, doc_share, first_doc)`` of ``documents (doc_id, lang, text)``.

    The definition is the first that a text of the language gives, by document, forms before the acronym
    going before those after it; else that of the dictionary; else null.  ``origin`` says which: text,
    dictionary or null.  ``doc_share`` is the share of the language's documents that name the acronym.
    """
    found = documents.select("doc_id", "lang", T.acronyms(F.col("text")).alias("all"), definition_pairs(F.col("text")).alias("pairs"))
    one = lambda a: F.struct(
        a.alias("acronym"), F.size(F.filter("all", lambda x: x == a)).alias("n"),
        F.get(F.filter("pairs", lambda p: p["acronym"] == a), F.lit(0))["definition"].alias("definition"),
    )
    rows = found.select("doc_id", "lang", F.explode(F.transform(F.array_distinct("all"), one)).alias("x")).select("doc_id", "lang", "x.*")
    counted = drop_common_words(rows).groupBy("lang", "acronym").agg(
        F.sum("n").alias("frequency"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"),
        F.min_by("definition", F.when(F.col("definition").isNotNull(), F.struct("doc_id", "definition"))).alias("found"),
    )
    known = acronym_dictionary(documents.sparkSession).withColumnRenamed("definition", "known")
    sizes = documents.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n_lang"))
    met = counted.join(known, "acronym", "left").join(sizes, F.col("lang").eqNullSafe(F.col("l")))
    origin = F.when(F.col("found").isNotNull(), "text").when(F.col("known").isNotNull(), "dictionary")
    return met.select(
        "lang", "acronym", F.coalesce("found", "known").alias("definition"), origin.alias("origin"),
        "frequency", "n_docs", (F.col("n_docs") / F.col("n_lang")).alias("doc_share"), "first_doc",
    )


def run(spark: SparkSession, documents: str, out: str, format: str = "parquet", langs: list[str] | None = None) -> dict[str, int]:
    """Write the glossary of ``documents``, or of those in ``langs``; how many documents and rows that were."""
    docs = spark.read.schema("doc_id bigint, text string, lang string").format(format).load(documents)
    if langs:
        docs = docs.where(F.col("lang").isin(*langs))
    writer = glossary(docs).hint("rebalance", "lang").write.mode("overwrite").partitionBy("lang")
    writer.option("partitionOverwriteMode", "dynamic" if langs else "static").parquet(out)
    held = read_glossary(spark, out)
    done = {"read": docs.count(), "written": (held.where(F.col("lang").isin(*langs)) if langs else held).count()}
    log.info("read %(read)d documents, wrote %(written)d acronyms", done)
    return done


def read_glossary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(GLOSSARY).parquet(out)


if __name__ == "__main__":
    main("glossary", __doc__.split("\n")[0], ("documents", "out"), run)
