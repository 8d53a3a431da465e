"""Incremental ingestion of pages: documents may come in parts, late and out of order.

Each micro-batch notes its pages, gathers all pages of the documents it touches and puts these through
the batch plan.  Nothing open is carried along: a section that goes on over a batch's end is built again
with the pages that follow, so the stored chunks are those of one run over all pages.
A batch writes ``pages/batch_id=N/bucket=B`` and ``chunks/batch_id=N``; run again after a failure it writes
the same folders, and looks at no later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..plans.pipeline import ingest

#: Folders that a batch's pages are dealt into, so that a later batch reads only those of its documents.
BUCKETS = 64
_STORED = "doc_id bigint, page_no int, text string, batch_id bigint, bucket int"


def _known_pages(spark: SparkSession, out: str, batch_id: int, buckets: list[int]) -> DataFrame:
    """The noted pages of some buckets up to a batch: of a page that came again the latest batch's."""
    rows = spark.read.schema(_STORED).parquet(f"{out}/pages").where((F.col("batch_id") <= batch_id) & F.col("bucket").isin(buckets))
    latest = Window.partitionBy("doc_id", "page_no").orderBy(F.desc("batch_id"), F.desc("text"))
    return rows.withColumn("rn", F.row_number().over(latest)).where("rn = 1").select("doc_id", "page_no", "text")


def ingest_stream(pages: DataFrame, out: str, checkpoint: str, separator: str = "\n\n", available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the chunks below ``out`` those of all ``pages (doc_id, page_no, text)`` that have come; read them by ``stored_chunks``.

    Rows without a document or a page number are left out.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.where("doc_id is not null and page_no is not null").select("doc_id", "page_no", "text")
        new.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/pages/batch_id={batch_id}")
        noted = spark.read.schema("doc_id bigint, bucket int").parquet(f"{out}/pages/batch_id={batch_id}")
        touched = noted.select("doc_id").distinct()
        held = sorted(r[0] for r in noted.select("bucket").distinct().collect())  # buckets at most
        if held:
            whole = _known_pages(spark, out, batch_id, held).join(touched, "doc_id", "left_semi")
            ingest(whole, separator=separator).chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch_id={batch_id}")

    writer = pages.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stored_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each document's latest batch."""
    chunks = spark.read.parquet(f"{out}/chunks")
    latest = spark.read.schema(_STORED).parquet(f"{out}/pages").groupBy("doc_id").agg(F.max("batch_id").cast("int").alias("batch_id"))
    return chunks.join(latest, ["doc_id", "batch_id"], "left_semi").drop("batch_id")
