"""New documents become chunks: an incremental ingest over a folder that grows.

    spark-submit --py-files ... jobs/ingest_chunks.py --config jobs/ingest_chunks.json \\
        --documents s3a://in/documents --out s3a://store/handbook --checkpoint s3a://store/handbook-checkpoint

A file stream takes the files that the checkpoint does not know and ends when there are no
more.  Of their documents those with a known id and text are left out; the others are split
and written as ``chunks/batch_id=N/lang=L``, and noted in ``documents/batch_id=N``.  A batch
that failed is run again under its number and writes its folders anew; it looks only at what
batches before it noted, so the result is that of one run.  Documents whose text changed are
taken again: ``current_chunks`` reads those of a document's latest batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, read_if_there
from pagewright.functions import text as T
from pagewright.functions.acronym_dictionary import COMMON_WORDS
from pagewright.operators.chunking import ChunkSizes, split_text

DOCUMENTS = "doc_id bigint, text string, lang string, source string"
NOTED = "doc_id bigint, document_key string, batch_id bigint"
CHUNKS = "doc_id bigint, source string, chunk_index int, tokens int, acronyms array<string>, content string, batch_id bigint, lang string"


def chunk_rows(documents: DataFrame, sizes: ChunkSizes, separator: str) -> DataFrame:
    """``(doc_id, lang, source, chunk_index, tokens, acronyms, content)``; acronyms are distinct, sorted, without common words."""
    pieces = documents.select("doc_id", "lang", "source", F.posexplode(split_text(F.col("text"), sizes, separator)).alias("chunk_index", "p"))
    found = F.array_except(F.array_distinct(T.acronyms(F.col("p.content"))), F.array(*[F.lit(w) for w in COMMON_WORDS]))
    return pieces.select("doc_id", "lang", "source", "chunk_index", "p.tokens", F.array_sort(found).alias("acronyms"), "p.content")


def run(
    spark: SparkSession, documents: str, out: str, checkpoint: str, format: str = "parquet", files_per_batch: int | None = None,
    files: int = 16, size: int = 800, overlap: int = 150, least: int = 200, separator: str = "\n\n",
) -> list[dict[str, int]]:
    """Ingest what is new below ``documents``, a folder or a pattern of paths; a summary for each batch, none if nothing was new.

    A batch writes about ``files`` files for each language, of equal size also where one language has most documents
    (streams run without adaptive execution).  A checkpoint and an output folder belong together:
    with a new checkpoint the output must be new.
    """
    sizes, done = ChunkSizes(size, overlap, least), []

    def take(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        noted = read_if_there(session, f"{out}/documents", NOTED)
        if noted.where(F.col("batch_id") > batch_id).limit(1).count():
            raise ValueError(f"{out} holds later batches than {batch_id}: it was written with another checkpoint")
        key = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("\x01"))), 256)
        # rows of one key are equal in id and text; of several languages or sources the least pair counts
        place = F.min(F.struct("lang", "source")).alias("place")
        keyed = batch.withColumn("document_key", key).groupBy("document_key").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"), place)
        keyed = keyed.select("document_key", "doc_id", "text", "place.lang", "place.source")
        before = noted.where(F.col("batch_id") < batch_id).select("document_key")
        fresh = keyed.join(before, "document_key", "left_anti").persist()
        try:
            dealt = chunk_rows(fresh, sizes, separator).repartition("lang", F.pmod(F.xxhash64("doc_id", "content"), F.lit(files)))
            dealt.write.mode("overwrite").partitionBy("lang").parquet(f"{out}/chunks/batch_id={batch_id}")
            fresh.select("doc_id", "document_key").coalesce(files).write.mode("overwrite").parquet(f"{out}/documents/batch_id={batch_id}")
        finally:
            fresh.unpersist()
        new = session.read.schema("doc_id bigint").parquet(f"{out}/documents/batch_id={batch_id}").count()
        written = read_if_there(session, f"{out}/chunks/batch_id={batch_id}", "doc_id bigint").count()
        done.append({"batch_id": batch_id, "read": batch.count(), "new": new, "chunks": written})
        log.info("batch %(batch_id)d: read %(read)d documents, %(new)d of them new, wrote %(chunks)d chunks", done[-1])

    reader = spark.readStream.format(format).schema(DOCUMENTS)
    if format == "csv":
        reader = reader.option("header", True).option("multiLine", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = reader.load(documents).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        log.info("nothing new in %s", documents)
    return done


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each document's latest batch, without ``batch_id``; documents without an id stand for one."""
    chunks, noted = read_if_there(spark, f"{out}/chunks", CHUNKS), read_if_there(spark, f"{out}/documents", NOTED)
    latest = noted.groupBy(F.col("doc_id").alias("id")).agg(F.max("batch_id").alias("latest"))
    met = chunks.join(latest, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("batch_id") == F.col("latest")), "left_semi")
    return met.drop("batch_id")


if __name__ == "__main__":
    main("ingest-chunks", __doc__.split("\n")[0], ("documents", "out", "checkpoint"), run)
