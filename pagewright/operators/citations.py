"""Answers, their citations, and how far the chunks bear them out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import settled
from .retrieval import CHUNK, of_document

#: A citation in an answer; section number and page.
CITATION = r"[Ss]ection\s+(\d{1,2}(?:\.\d{1,2}){0,3})(?:[,\s]+(?:p(?:age|\.)?\.?\s*)(\d+))?"
#: A word is rare in a section if at most this many of the section's chunks have it.  The result is the same.
RARE = 200
#: Fixed value: what is answered when nothing is found.
NOT_FOUND = "I cannot find this information in the provided sections of the handbook."


class AnswerGenerator(Protocol):
    """Answers a question from a context; an exception becomes the answer, with confidence 0."""

    def answer(self, query: str, context: str) -> str: ...


def generate(asked: DataFrame, make: Callable[[], AnswerGenerator]) -> DataFrame:
    """``asked (query_id, query, context)`` with ``answer`` and ``confidence``; the generator is made once a task."""
    columns = asked.columns
    schema = asked.withColumn("answer", F.lit("")).withColumn("failed", F.lit(False)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generator = make()
        for rows in batches:
            answers, failed = [], []
            for query, context in zip(rows.column(columns.index("query")).to_pylist(), rows.column(columns.index("context")).to_pylist(), strict=True):
                try:
                    answers.append(generator.answer(query, context or ""))
                    failed.append(False)
                except Exception as problem:  # noqa: BLE001  the reference behaviour: the error text is the answer
                    answers.append(f"Error generating answer: {problem}")
                    failed.append(True)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(answers, pa.string()), pa.array(failed)], names=[*columns, "answer", "failed"])

    return with_confidence(asked.mapInArrow(work, schema))


def extractive_answers(final: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, query, answer, failed, confidence)`` without a model: an extract, as a stand-in.

    The last line that isn't blank of the two best chunks, its first 300 characters, each with its citation.
    """
    met = of_document(final).where("pos < 2").join(of_document(chunks).select(*CHUNK, "content", "section_number", "page_start"), CHUNK)
    line = F.substring(F.element_at(F.filter(F.split("content", "\n"), lambda x: T.strip(x) != ""), -1), 1, 300)
    part = F.concat(line, F.lit(" (Section "), "section_number", F.lit(", page "), "page_start", F.lit(")."))
    joined = met.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))).getField("p"), " ").alias("answer"))
    out = questions.select("query_id", "query").join(joined, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(NOT_FOUND))).withColumn("failed", F.lit(False))
    return with_confidence(out)


def with_confidence(answers: DataFrame) -> DataFrame:
    return answers.withColumn("confidence", F.when(F.col("failed"), 0.0).otherwise(T.confidence(F.col("answer"))))


def extract_citations(final: DataFrame, chunks: DataFrame, least: float = 0.3) -> DataFrame:
    """``(query_id, rank, doc_id, section_number, section_title, page_start, page_end, chunk_type, confidence)``.

    The first hit of each section that scores at least ``least``, best first.
    """
    met = of_document(final).join(of_document(chunks).select(*CHUNK, "section_number", "section_title", "page_start", "page_end", "chunk_type"), CHUNK).where(F.col("score") >= least)
    first = met.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "doc_id", "section_number").orderBy("pos"))).where("rn = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    return first.select("query_id", rank.alias("rank"), "doc_id", "section_number", "section_title", "page_start", "page_end", "chunk_type", F.col("score").alias("confidence"))


def parse_citations(answers: DataFrame) -> DataFrame:
    """``(query_id, pos, section_number, page_cited)`` of every citation in ``answers (query_id, answer)``."""
    hits = F.arrays_zip(F.regexp_extract_all("answer", F.lit(CITATION), 1).alias("s"), F.regexp_extract_all("answer", F.lit(CITATION), 2).alias("p"))
    rows = answers.select("query_id", F.posexplode(hits).alias("pos", "h"))
    return rows.select("query_id", "pos", F.col("h.s").alias("section_number"), T.blank_to_null(F.col("h.p")).cast("int").alias("page_cited"))


def claims(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """``cited`` with ``claim``: the first sentence that names the section, else the whole answer."""
    met = cited.join(answers.select("query_id", "answer"), "query_id")
    sentences = F.split("answer", r"(?<=[.!?])\s+")
    label = F.concat(F.lit("Section "), F.col("section_number"))
    naming = F.filter(sentences, lambda s: F.contains(s, label))
    return met.withColumn("claim", F.coalesce(F.get(naming, F.lit(0)), F.col("answer"))).drop("answer")


def verify_citations(answers: DataFrame, chunks: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """``(query_id, section_number, page_cited, status, grounding_score, chunk_found, page_in_range, matched_chunk_id)``.

    An answer cites a section by its number alone.  ``scope (query_id, doc_id)`` names the
    documents that an answer drew from, and only their chunks can bear it out;
    without it any document's can.
    Candidates are the chunks of the section and all below it: each chunk is
    exploded to its number's prefixes, so the join is an equi-join.  The best
    is that with the largest word overlap, 0.1 more if the page fits; ties in
    order of section, then chunk.  Of a section's citations the best grounded
    stays, the first of equals.
    """
    cited = claims(answers, parse_citations(answers))
    cited = settled(cited.select("query_id", "pos", "section_number", "page_cited", F.array_sort(T.words(F.col("claim"))).alias("claim_words")))
    first = F.min("chunk_seq").over(Window.partitionBy("doc_id", "section_number"))
    parts = F.split("section_number", r"\.")
    rows = of_document(chunks).select("doc_id", "chunk_id", "chunk_seq", "section_number", "content", "page_start", F.coalesce("page_end", "page_start").alias("page_end")).withColumn("sec_first", first)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    words = F.coalesce(T.words(F.col("content")), F.array().cast("array<string>"))
    one = F.struct("doc_id", "sec_first", "chunk_seq", "chunk_id")
    below = rows.select(F.explode(prefixes).alias("section_number"), "doc_id", one.alias("chunk"), words.alias("chunk_words"), "page_start", "page_end")
    place = ["section_number"] if scope is None else ["doc_id", "section_number"]
    asked = cited if scope is None else cited.join(scope.select("query_id", "doc_id").distinct(), "query_id")
    # a citation looks among all chunks of its section, and with 0.1 more among those on its page
    within = [*place, "page_ok", "page"]
    any_page = [F.lit(False).alias("page_ok"), F.lit(0).alias("page")]
    asked = asked.select("query_id", "pos", "claim_words", *place, *any_page).unionByName(asked.where("page_cited is not null").select("query_id", "pos", "claim_words", *place, F.lit(True).alias("page_ok"), F.col("page_cited").alias("page")))
    wanted = asked.select(*within, "claim_words").distinct()
    on_page = below.where("page_start <= page_end").select(*place, "chunk", "chunk_words", F.lit(True).alias("page_ok"), F.explode(F.sequence(F.col("page_start").cast("int"), F.col("page_end").cast("int"))).alias("page"))
    held = below.select(*place, "chunk", "chunk_words", *any_page).unionByName(on_page).join(wanted.select(*within).distinct(), within, "left_semi")
    best = asked.join(best_overlaps(wanted, held, within), [*within, "claim_words"])
    order = F.struct(-(F.col("raw") + F.when(F.col("page_ok"), 0.1).otherwise(0.0)), "chunk")
    best = best.groupBy("query_id", "pos").agg(F.min_by(F.struct("raw", "page_ok", "chunk"), order).alias("b"))
    judged = cited.join(best, ["query_id", "pos"], "left").select("query_id", "pos", "section_number", "page_cited", F.col("b.chunk.chunk_id").alias("chunk_id"), F.coalesce("b.raw", F.lit(0.0)).alias("raw"), F.coalesce("b.page_ok", F.lit(False)).alias("page_ok"))
    status = F.when(F.col("chunk_id").isNull(), "not_found").when((F.col("raw") >= 0.15) & (F.col("page_cited").isNull() | F.col("page_ok")), "verified").otherwise("partial")
    judged = judged.withColumn("status", status).withColumn("grounding_score", F.round("raw", 4))
    keep = F.row_number().over(Window.partitionBy("query_id", "section_number").orderBy(F.desc("grounding_score"), "pos"))
    return judged.withColumn("k", keep).where("k = 1").select("query_id", "section_number", "page_cited", "status", "grounding_score", F.col("chunk_id").isNotNull().alias("chunk_found"), F.col("page_ok").alias("page_in_range"), F.col("chunk_id").alias("matched_chunk_id"))


def best_overlaps(wanted: DataFrame, held: DataFrame, within: list[str]) -> DataFrame:
    """``(*within, claim_words, raw, chunk)``: for each of ``wanted (*within, claim_words)`` the chunk of its group with the largest word overlap.

    ``held (*within, chunk, chunk_words)``; ties go to the smaller ``chunk``.  Words are rare or common
    within a group.  Chunks that share a rare word with a claim meet it by that word.  All others share
    common words alone, so their overlap depends on these and on the number of words: chunks that are alike in
    both stand together, the first for all, and so do claims.  Chunks with a rare word are underrated
    there, but met by that word they have their full overlap.
    """
    claims_of = wanted.select(*within, "claim_words", F.explode("claim_words").alias("word"))
    counted = held.select(*within, "chunk", F.size("chunk_words").alias("n"), F.explode("chunk_words").alias("word"))
    postings = settled(counted.join(claims_of.select(*within, "word").distinct(), [*within, "word"], "left_semi"))
    common = postings.groupBy(*within, "word").agg(F.count("*").alias("times")).where(F.col("times") > RARE).select(*within, "word")
    none = F.array().cast("array<string>")
    shared = postings.join(common, [*within, "word"], "left_semi").groupBy(*within, "chunk").agg(F.array_sort(F.collect_list("word")).alias("held_common"))
    chunk_side = settled(held.select(*within, "chunk", F.size("chunk_words").alias("n")).join(shared, [*within, "chunk"], "left").withColumn("held_common", F.coalesce("held_common", none)))
    told = claims_of.join(common, [*within, "word"], "left_semi").groupBy(*within, "claim_words").agg(F.array_sort(F.collect_list("word")).alias("told_common"))
    claim_side = settled(wanted.join(told, [*within, "claim_words"], "left").withColumn("told_common", F.coalesce("told_common", none)).withColumn("m", F.size("claim_words")))

    def overlap(more: Column) -> Column:
        both = more + F.size(F.array_intersect("told_common", "held_common"))
        return F.when((F.col("m") == 0) | (F.col("n") == 0), 0.0).otherwise(both / (F.col("m") + F.col("n") - both))

    def first(found: DataFrame, *key: str) -> DataFrame:
        return found.groupBy(*within, *key).agg(F.min_by(F.struct("raw", "chunk"), F.struct(-F.col("raw"), "chunk")).alias("b"))

    kinds = chunk_side.groupBy(*within, "held_common", "n").agg(F.min("chunk").alias("chunk"))
    alike = claim_side.select(*within, "told_common", "m").distinct().join(kinds, within).withColumn("raw", overlap(F.lit(0)))
    by_kind = claim_side.join(first(alike, "told_common", "m"), [*within, "told_common", "m"]).select(*within, "claim_words", "b")
    rare = postings.join(common, [*within, "word"], "left_anti").select(*within, "word", "chunk")
    met = claims_of.join(rare, [*within, "word"]).groupBy(*within, "claim_words", "chunk").agg(F.count("*").cast("int").alias("more"))
    met = met.join(claim_side, [*within, "claim_words"]).join(chunk_side, [*within, "chunk"]).withColumn("raw", overlap(F.col("more")))
    both = by_kind.unionByName(first(met, "claim_words"))
    return both.groupBy(*within, "claim_words").agg(F.min_by("b", F.struct(-F.col("b.raw"), F.col("b.chunk"))).alias("b")).select(*within, "claim_words", "b.raw", "b.chunk")


def citation_badges(citations: DataFrame, verified: DataFrame, n: int = 5) -> DataFrame:
    """The first n citations of each question with their verification, null where there is none."""
    marks = verified.select("query_id", "section_number", "status", "grounding_score")
    return citations.where(F.col("rank") <= n).join(marks, ["query_id", "section_number"], "left")


def answer_report(answers: DataFrame, citations: DataFrame, used: DataFrame, style: str = "section_page") -> DataFrame:
    """``(query_id, report)``: question, answer, numbered sources, and the number of chunks used."""
    line = F.concat(
        F.lit("  "), F.col("rank"), F.lit(". "), T.citation_text(F.col("section_number"), F.col("page_start"), F.col("page_end"), style), F.lit("\n     ("), F.col("section_title"), F.lit(")\n     Confidence: "), F.format_string("%.2f", "confidence")
    )
    sources = citations.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).getField("l"), "\n").alias("sources"))
    met = answers.join(sources, "query_id", "left").join(used, "query_id", "left")
    hops = F.when(F.coalesce(F.col("n_xref"), F.lit(0)) > 0, F.lit("✓ Multi-hop cross-references resolved"))
    report = F.concat_ws("\n", F.concat(F.lit("Q: "), "query", F.lit("\n")), F.concat(F.lit("A: "), "answer", F.lit("\n")), F.concat(F.lit("Sources:\n"), "sources"), F.concat(F.lit("\nContext used: "), F.coalesce("n_context", F.lit(0)), F.lit(" chunks")), hops)
    return met.select("query_id", report.alias("report"))
