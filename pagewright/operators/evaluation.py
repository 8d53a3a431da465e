"""Scores of answers against loosely stated expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the parts of a score.
WEIGHTS = {"answer_provided": 0.2, "has_citations": 0.2, "section_recall": 0.3, "term_coverage": 0.2, "confidence": 0.1}


def evaluate(gold: DataFrame, answers: DataFrame, citations: DataFrame) -> DataFrame:
    """One row a gold question ``(query_id, category, expected_sections, expected_terms)``.

    An expected section counts if any citation begins with it, a term if the
    answer holds it, case ignored; nothing expected counts as 1.
    """
    cited = citations.groupBy("query_id").agg(F.collect_set("section_number").alias("cited"))
    met = gold.join(answers.select("query_id", "answer", "confidence"), "query_id").join(cited, "query_id", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<string>")))
    expected = F.array_distinct("expected_sections")
    hit = F.size(F.filter(expected, lambda e: F.exists("cited", lambda c: F.startswith(c, e))))
    found = F.size(F.filter("expected_terms", lambda t: F.contains(F.lower("answer"), F.lower(t))))
    scored = met.select(
        "query_id", "category", (F.length("answer") > 0).alias("answer_provided"), (F.size("cited") > 0).alias("has_citations"),
        F.when(F.size("expected_sections") > 0, hit / F.size("expected_sections")).otherwise(1.0).alias("section_recall"),
        F.when(F.size("expected_terms") > 0, found / F.size("expected_terms")).otherwise(1.0).alias("term_coverage"), "confidence",
    )
    total = sum((F.col(name).cast("double") * weight for name, weight in WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("overall_score", total)


def summarize(results: DataFrame) -> DataFrame:
    """A row for each category and one, category null, for all; recall is reported as citation accuracy too."""
    return results.groupingSets([[F.col("category")], []], "category").agg(
        F.count("*").alias("total_queries"), F.count_if("answer_provided").alias("successful_answers"), F.avg("section_recall").alias("citation_accuracy"),
        F.avg("confidence").alias("avg_confidence"), F.avg("section_recall").alias("retrieval_recall"), F.avg("overall_score").alias("performance"),
    )


def report_lines(results: DataFrame) -> DataFrame:
    """``(query_id, line)`` with a mark by score: over 0.7, over 0.5, below."""
    mark = F.when(F.col("overall_score") > 0.7, "✓").when(F.col("overall_score") > 0.5, "⚠").otherwise("✗")
    line = F.concat(mark, F.format_string(" Query %2d (%-20s): Score=%.2f, Section Recall=%.2f, Term Coverage=%.2f", "query_id", "category", "overall_score", "section_recall", "term_coverage"))
    return results.select("query_id", mark.alias("mark"), line.alias("line"))
