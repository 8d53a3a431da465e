"""Parsers of binary documents, plugged in: a page parser, a layout parser, a vision model.

Each is an object made once a task by a callable that can be pickled; files are read by
Spark (``binaryFile``), so any store will do, and a file that can't be parsed becomes a row
with ``error`` and no pages, not the end of the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

ITEM = "seq bigint, label string, level int, text string, page int, pages array<int>, grid array<array<string>>"


class PageParser(Protocol):
    """The texts of a file's pages, in order."""

    def pages(self, content: bytes) -> Iterable[str]: ...


class LayoutParser(Protocol):
    """The items of a file in reading order: mappings with any of the columns of ``ITEM`` but ``seq``."""

    def items(self, content: bytes) -> Iterable[dict[str, Any]]: ...


class ImageDescriber(Protocol):
    """A vision model's reply to an image and its caption."""

    def describe(self, image: bytes, caption: str) -> str: ...


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(doc_id, path, content)`` of files in a folder or given one by one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def _parsed(files: DataFrame, each: Callable[[], Callable[[bytes], Iterable[tuple]]], fields: str) -> DataFrame:
    """A row for each that ``each()`` gives for a file's content, numbered from 0, or one with the error."""
    kind = files.sparkSession.createDataFrame([], f"doc_id bigint, place bigint, {fields}, error string").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse, names = each(), [f.name for f in kind.fields]
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(doc_id, i, *row, None) for i, row in enumerate(parse(content or b""))]
                except Exception as problem:  # noqa: BLE001  a file that can't be parsed is data
                    rows = [(doc_id, 0, *[None] * (len(names) - 3), str(problem)[:500])]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)
    return files.select("doc_id", "content").mapInArrow(work, kind)


def parse_pages(files: DataFrame, make: Callable[[], PageParser]) -> DataFrame:
    """``(doc_id, page_no, text, error)`` of ``files (doc_id, content)``, pages numbered from 1."""

    def each() -> Callable[[bytes], Iterable[tuple]]:
        parser = make()
        return lambda content: ((page,) for page in parser.pages(content))

    rows = _parsed(files, each, "text string")
    return rows.select("doc_id", (F.col("place") + 1).cast("int").alias("page_no"), "text", "error")


def parse_layout(files: DataFrame, make: Callable[[], LayoutParser]) -> DataFrame:
    """``(doc_id, seq, label, level, text, page, pages, grid, error)`` of ``files (doc_id, content)``.

    The relations that ``operators.structure`` takes are rows of it by label:
    ``sections_from_items``, ``tables_from_items``, ``diagrams_from_items``, ``document_titles``.
    """
    names = ("label", "level", "text", "page", "pages", "grid")

    def each() -> Callable[[bytes], Iterable[tuple]]:
        parser = make()
        return lambda content: (tuple(item.get(name) for name in names) for item in parser.items(content))

    rows = _parsed(files, each, ITEM.removeprefix("seq bigint, "))
    return rows.withColumnRenamed("place", "seq")


#: What the rows say that a model was not asked for any more.
NOT_TRIED = "not tried: the model refuses requests"


class RateLimited(Exception):
    """A model's way to say that it takes no more requests for now."""


def describe_images(images: DataFrame, make: Callable[[], ImageDescriber], image_col: str = "image", caption_col: str = "caption", limit: int = 3) -> DataFrame:
    """``images`` with the model's reply, told apart in parts as ``analysis``, and ``describe_error``.

    A failure is a row's error.  After ``limit`` refusals (``RateLimited``) in a row a task asks no
    more: its remaining rows say ``NOT_TRIED``, for ``describe_missing`` to ask later.
    """
    kept = images.columns
    schema = images.withColumn("reply", F.lit(None).cast("string")).withColumn("describe_error", F.lit(None).cast("string")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, refused = make(), 0
        for batch in batches:
            replies, errors = [], []
            for image, caption in zip(batch.column(kept.index(image_col)), batch.column(kept.index(caption_col)), strict=True):
                reply, error = None, NOT_TRIED
                if refused < limit:
                    try:
                        reply, error, refused = model.describe(image.as_py() or b"", caption.as_py() or ""), None, 0
                    except RateLimited as problem:
                        error, refused = str(problem)[:500], refused + 1
                    except Exception as problem:  # noqa: BLE001  a failed image is data
                        error, refused = str(problem)[:500], 0
                replies.append(reply)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*kept, "reply", "describe_error"])

    return images.mapInArrow(work, schema).withColumn("analysis", F.when(F.col("reply").isNotNull(), T.split_reply(F.col("reply"))))


def describe_missing(images: DataFrame, stored: DataFrame, make: Callable[[], ImageDescriber], key: tuple[str, ...], **options) -> DataFrame:
    """Rows of ``describe_images`` for images without a reply among ``stored`` ones of an earlier run, told by ``key``."""
    done = stored.where("reply is not null").select(*key).distinct()
    return describe_images(images.join(done, list(key), "left_anti").select(*images.columns), make, **options)
