"""Embedding, index and search.

Every search is one plan for all
questions: parts of the index meet parts of the questions (``blocks``), and what is left is
ranked by ``row_number() <= k``, which Spark cuts per partition before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from . import blocks

#: Visits of an index's cells up to this many are broadcast; more meet it in a join.  The result is the same.
BROADCAST_QUESTIONS = 100_000
#: Most rows in one part of an index and of questions; most questions in one block of a cell.
PART_ROWS, BLOCK_QUESTIONS = 1 << 16, 1_024

METRICS = ("cosine", "ip", "l2")


class Embedder(Protocol):
    """Turns a batch of texts into vectors of one length; None for a text that failed."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


def embed_texts(df: DataFrame, make: Callable[[], Embedder], text_col: str = "content", out: str = "embedding", batch: int = 100) -> DataFrame:
    """``df`` with the embedder's vectors; the embedder is made once a task, failures are null with ``embed_error``."""
    columns = df.columns
    schema = df.withColumn(out, F.lit(None).cast("array<float>")).withColumn("embed_error", F.lit(None).cast("string")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for rows in batches:
            texts, vectors, errors = rows.column(columns.index(text_col)).to_pylist(), [], []
            for at in range(0, len(texts), batch):
                part = [t or "" for t in texts[at : at + batch]]
                try:
                    vectors += embedder.embed(part)
                    errors += [None] * len(part)
                except Exception as problem:  # noqa: BLE001  a failed batch is data, not the end of the job
                    vectors += [None] * len(part)
                    errors += [str(problem)[:500]] * len(part)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*columns, out, "embed_error"])

    return df.mapInArrow(work, schema)


def hashed_embedding(df: DataFrame, text_col: str, out: str = "embedding", dim: int = V.DIM) -> DataFrame:
    """The deterministic stand-in embedding, in the JVM."""
    return df.withColumn(out, V.hashed_words(F.col(text_col), dim))


def normalized(df: DataFrame, vector_col: str = "embedding", out: str = "unit") -> DataFrame:
    return df.withColumn(out, V.unit(F.col(vector_col)))


def top_k(scored: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """The k best of each question, ties by key, with ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def checked(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return metric


def _rows(index: DataFrame, key: str, vector: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """An index as ``(key, *keep, v)``."""
    return index.select(F.col(key).alias("key"), *keep, F.col(vector).alias("v"))


def _asked(questions: DataFrame, *more: str) -> DataFrame:
    """Questions as ``(query_id, *more, q)``."""
    return questions.select("query_id", *more, F.col("query_vec").alias("q"))


def knn(index: DataFrame, questions: DataFrame, k: int = 5, metric: str = "cosine", where: Column | None = None, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """Exact search: ``(query_id, want_*, key, *keep, score, rank)``; ``where`` filters the index before it is ranked.

    cosine: inner product of unit vectors; ip: inner product; l2: 1 / (1 + squared distance).
    Parts of the index meet parts of the questions; only a pair's k best leave a task.
    ``blocks`` says which vectors take part.
    """
    rows = index if where is None else index.where(where)
    wanted = [c for c in questions.columns if c.startswith("want_")]
    found = blocks.searched_all(_rows(rows, key, vector, keep), _asked(questions, *wanted), PART_ROWS, k, checked(metric), key, keep, wanted)
    return top_k(found, k, key)


def knn_overfetch(index: DataFrame, questions: DataFrame, where: Column, k: int = 5, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """Ranks first: of the 3 k best those that pass ``where`` (over ``key`` and ``keep``), k at most; may return fewer though more would pass."""
    first = knn(index, questions, 3 * k, metric, None, key, vector, keep).where(where)
    return top_k(first.drop("rank"), k, key)


def chunk_filter(chunk_type: str | None = None, section_number: str | None = None, min_page: int | None = None, max_page: int | None = None, metadata: dict[str, str] | None = None, map_col: str = "metadata") -> Column:
    """Predicate on chunks; a metadata key that a chunk lacks does not exclude it."""
    out = F.lit(True)
    if chunk_type is not None:
        out = out & (F.col("chunk_type") == chunk_type)
    if section_number is not None:
        out = out & (F.col("section_number") == section_number)
    if min_page is not None:
        out = out & (F.col("page_start") >= min_page)
    if max_page is not None:
        out = out & (F.col("page_end") <= max_page)
    for name, value in (metadata or {}).items():
        held = F.try_element_at(F.col(map_col), F.lit(name))
        out = out & F.coalesce(held == value, F.lit(True))
    return out


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id)


def chunks_of_section(chunks: DataFrame, section_number: str) -> DataFrame:
    return chunks.where(F.col("section_number") == section_number)


def rank_of(index: DataFrame, questions: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, target, rank)``: 1 + how many rows score higher than the question's own target ``want_id``.

    First each question's own score, one row a question; then every part of the index
    counts what is above it.  A question whose target or vector takes no part has rank 1.
    """
    own = index.join(questions, F.col(key) == F.col("want_id")).select("query_id", F.array(F.struct(F.lit(0).alias("key"), V.doubles(F.col(vector)).alias("v"))).alias("rows"), F.array(F.struct("query_id", V.doubles(F.col("query_vec")).alias("q"))).alias("asked"))
    id_type = questions.schema["query_id"].dataType.simpleString()
    mine = blocks.searched(own, 1, "cosine", "key", (), []).groupBy("query_id").agg(F.max("score").alias("own"))
    known = questions.select("query_id", "query_vec").join(mine, "query_id")

    def count(rows: pa.StructArray, asked: pa.StructArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([asked.field("query_id"), pa.array(blocks.count_higher("cosine", rows, asked))], names=["query_id", "n"])

    higher = blocks.met(_rows(index, key, vector), _asked(known, "own"), PART_ROWS, f"query_id {id_type}, n bigint", count).groupBy("query_id").agg(F.sum("n").alias("n"))
    return questions.select("query_id", F.col("want_id").alias("target")).join(higher, "query_id", "left").select("query_id", "target", (F.coalesce("n", F.lit(0)) + 1).alias("rank"))


def build_index(index: DataFrame, kind: str = "flat", **options) -> DataFrame | ivf.IvfStore:
    """flat: the rows themselves; ivf: a stored index of cells; any other kind is an error."""
    if kind == "flat":
        return index
    if kind == "ivf":
        return ivf.IvfStore.build(index, **options)
    raise ValueError(f"unknown index type {kind!r}")


def upsert(old: DataFrame, new: DataFrame, key: str | tuple[str, ...] = "chunk_id", columns: tuple[str, ...] = ("content", "embedding")) -> DataFrame:
    """``old`` with the columns of ``new`` where it has the key, and the rows of ``new`` that are new."""
    keys = [key] if isinstance(key, str) else list(key)
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = old.join(fresh, keys, "left")
    changed = joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
    added = new.join(old.select(*keys), keys, "left_anti")
    return changed.unionByName(added, allowMissingColumns=True)


def unanalysed_diagrams(chunks: DataFrame) -> DataFrame:
    """Diagram chunks that have no relationship analysis yet."""
    return chunks.where((F.col("chunk_type") == "diagram_ref") & ~F.coalesce(F.col("diagram_meta.has_relationship_analysis"), F.lit(False)))


from . import ivf  # noqa: E402  it searches by this module
