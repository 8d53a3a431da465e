"""The two programs: documents to chunks with vectors, and questions to verified answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import chunking, citations, evaluation, metadata, retrieval, structure
from ..operators.chunking import ChunkSizes
from ..operators.retrieval import Retrieval
from ..session import settled


@dataclass(frozen=True)
class Corpus:
    """What ingestion leaves: relations that can be written one by one and read again."""

    sections: DataFrame
    acronyms: DataFrame
    hierarchy: DataFrame
    references: DataFrame
    chunks: DataFrame


def ingest(pages: DataFrame, tables: DataFrame | None = None, diagrams: DataFrame | None = None, sizes: ChunkSizes = ChunkSizes(), separator: str = "\n\n") -> Corpus:
    """Pages (and tables, diagrams of a parser) to sections, metadata and chunks with vectors."""
    sections = settled(structure.sections_from_text(pages))
    nodes = settled(metadata.hierarchy(sections))
    paths = metadata.section_paths_by_number(nodes)
    refs = settled(metadata.dedup_references(metadata.cross_references(sections)))
    acronyms = metadata.drop_common_words(metadata.define_acronyms(sections))
    texts = chunking.chunk_sections(sections, nodes, paths, metadata.references_by_section(refs), sizes, separator)
    table_chunks = None if tables is None else chunking.chunk_tables(structure.sections_of_tables(structure.merge_tables(tables), sections).withColumn("confidence", F.lit(None).cast("array<struct<row:int,col:int,score:double>>")), nodes, paths, sizes)
    diagram_chunks = None if diagrams is None else chunking.chunk_diagrams(structure.sections_of_diagrams(diagrams, sections), nodes, paths)
    chunks = chunking.chunk_document(texts, table_chunks, diagram_chunks, acronyms)
    chunks = chunks.withColumn("context_vec", V.hashed_words(chunking.context_string(chunks))).withColumn("content_vec", V.hashed_words(F.col("content")))
    return Corpus(sections, acronyms, nodes, refs, chunks)


def ask(questions: DataFrame, chunks: DataFrame, edges: DataFrame, options: Retrieval = Retrieval(), generator: Callable[[], citations.AnswerGenerator] | None = None, least: float = 0.3) -> dict[str, DataFrame]:
    """Answers, citations, verification and context of all questions; without a generator answers are extracts."""
    hits = settled(retrieval.retrieve(questions, chunks, edges, options))  # a few rows a question, used four times
    final = hits.where("stage = 'final'")
    if generator is None:
        answers = citations.extractive_answers(final, questions, chunks)
    else:
        asked = questions.select("query_id", "query").join(retrieval.context_text(final, chunks), "query_id", "left")
        answers = citations.generate(asked.select("query_id", "query", F.coalesce("context", F.lit("")).alias("context")), generator)
    answers = settled(answers)
    cited = citations.extract_citations(final, chunks, least)
    used = hits.groupBy("query_id").agg(F.count_if(F.col("stage") == "final").alias("n_context"), F.count_if(F.col("stage") == "xref").alias("n_xref"), F.count_if(F.col("stage") == "parent").alias("n_parent"))
    return {"hits": hits, "answers": answers, "citations": cited, "verification": citations.verify_citations(answers, chunks, scope=final), "used": used}


def assess(gold: DataFrame, asked: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Results of gold questions and their summary."""
    results = evaluation.evaluate(gold, asked["answers"], asked["citations"])
    return results, evaluation.summarize(results)
