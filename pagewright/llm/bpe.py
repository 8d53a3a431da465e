"""Byte-level BPE by a rank file: overlapping chunks, stitched, then encoded.

Short texts are encoded where they are read.  A longer text is cut into
windows of ``chunk`` characters plus an ``overlap`` into the next; the windows are
dealt out and pre-tokenised in parallel.  Where the piece boundaries of a window and of
its successor meet inside the overlap, the scan has resynchronised: from a
boundary on, both scans see the same text and agree for good.  The text is cut
at the first such place (after a character that isn't white space, so that a
run of white space is never split), and the pieces between two cuts are
encoded, in parallel again.  Only the boundaries of a text's windows come together in one task.

A window counts as synchronised only if the one before it is.  From the first that does not
meet its predecessor, a text is read on in order (``resume``): scanned window by window until the scan
meets a window's own boundaries, cut where windows meet after that.  Decoding concatenates
the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters in a window, and how far it reaches into the next.
CHUNK, OVERLAP = 32_768, 1_024


@lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; once a worker."""
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def decode(ids: list[int], ranks_path: str, pattern: str) -> bytes:
    """The bytes of the ids, concatenated."""
    return encoder(ranks_path, pattern).decode_bytes(ids)


def boundaries(window: str, pattern: regex.Pattern, first: int, last: int) -> list[int]:
    """Ends of pieces in [first, last) after a character that isn't white space.

    The last piece isn't counted: beyond the window it might go on.
    """
    ends = [m.end() for m in pattern.finditer(window)][:-1]
    return [p for p in ends if first <= p < last and not window[p - 1].isspace()]


def resume(rows: Iterable[tuple[str, int, bool, str, int | None]], pattern: regex.Pattern, chunk: int) -> Iterator[tuple[str, int, str]]:
    """``(key, c, span)`` of texts' windows ``(key, c, last, w, from)`` in order, the first of each text synchronised.

    While a window is synchronised, the next one's ``from`` is a place to cut.  Else the text
    since the last cut is scanned with the window, cut at its last boundary, and the window is
    synchronised if its own scan has one of the boundaries.  While none is found, as much
    text again is gathered before the next scan.
    """
    text, held, size, enough, synced = None, [], 0, 0, True
    for key, c, last, w, start in rows:
        body = w if last else w[:chunk]
        if key != text:
            text, held, enough, synced = key, [body[start:]], 0, True
        elif synced and start is not None:
            yield key, c - 1, "".join(held) + w[:start]
            held = [body[start:]]
        else:
            synced = False
            if last or size + len(w) >= enough:
                pending = "".join(held)
                whole, most = pending + w, len(pending) + len(body)
                ends = [p for p in boundaries(whole, pattern, 1, len(whole)) if p <= most]
                if ends:
                    own = set(boundaries(w, pattern, 1, len(w)))
                    synced, enough = any(p - len(pending) in own for p in ends), 0
                    yield key, c - 1, whole[: ends[-1]]
                    held = [whole[ends[-1] : most]]
                else:
                    held, enough = [pending, body], 2 * len(whole)
            else:
                held.append(body)
        size = sum(map(len, held))
        if last and size:
            yield key, c, "".join(held)


def _digest(ids: list[int], ranks_path: str, pattern: str) -> tuple[int, str, str]:
    text = decode(ids, ranks_path, pattern)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def _finish(names: list[str], rows: list, ids: list[list[int]], digest: bool, ranks_path: str, pattern: str) -> pa.RecordBatch:
    if digest:
        done = [_digest(x, ranks_path, pattern) for x in ids]
        columns = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())]
    else:
        columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([np.asarray(x, dtype=np.int32) for x in ids], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([*rows, *columns], names=names)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``(doc_id, n_tokens, ids)``, or with ``digest`` ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    One row for each row of ``docs``, repeated and null ids included.  Null
    and empty texts have no ids.  ``decoded_sha256`` is that of the bytes that
    decoding the ids gives; an empty table gives an empty one.  Other columns of ``docs`` are not read.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be positive and smaller than a chunk")
    out = ["n_tokens long", *(["ids_sha256 string", "decoded_sha256 string"] if digest else ["ids array<int>"])]
    names = [x.split()[0] for x in out]
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    id_type = base.schema["doc_id"].dataType.simpleString()

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _finish(["doc_id", *names], [part.column(0)], [bpe.encode_ordinary(x) for x in part.column(1).to_pylist()], digest, ranks_path, pattern)

    short = base.where(F.length("x") <= chunk).mapInArrow(encode_short, ", ".join([f"doc_id {id_type}", *out]))

    long = base.where(F.length("x") > chunk).withColumn("key", F.sha2("x", 256))
    texts = long.select("key", "x").dropDuplicates(["key"])
    start = F.col("c") * chunk
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x in zip(batch.column("key").to_pylist(), batch.column("x"), strict=True):
                text = x.as_py()
                starts = range(0, len(text), chunk)
                for low in range(0, len(starts), 32):
                    some = starts[low : low + 32]
                    columns = [pa.array([key] * len(some)), pa.array([s // chunk for s in some], pa.int32()), pa.array([s + chunk >= len(text) for s in some])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([text[s : s + chunk + overlap] for s in some])], names=["key", "c", "last", "w"])

    windows = texts.mapInArrow(cut, "key string, c int, last boolean, w string").repartition(tasks, "key", "c")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(pattern)
        for batch in batches:
            head, tail = [], []
            for w in batch.column("w"):
                ends = boundaries(w.as_py(), pieces, 1, chunk + overlap)
                head.append([p for p in ends if p < overlap])
                tail.append([p - chunk for p in ends if p >= chunk])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("c"), pa.array(head, kind), pa.array(tail, kind)], names=["key", "c", "head", "tail"])

    scanned = windows.mapInArrow(scan, "key string, c int, head array<int>, tail array<int>")
    text = Window.partitionBy("key")
    order = text.orderBy("c")
    met = F.array_min(F.array_intersect(F.col("head"), F.lag("tail").over(order)))
    placed = scanned.select("key", "c", F.when(F.col("c") == 0, 0).otherwise(met).alias("from")).withColumn("until", F.lead("from").over(order))
    lost = F.min(F.when(F.col("from").isNull(), F.col("c"))).over(text)  # the first window that does not meet the one before
    placed = placed.withColumn("in_order", F.coalesce(F.col("c") >= lost - 1, F.lit(False)))
    found = windows.join(placed, ["key", "c"])
    upto = F.when(F.col("last"), F.length("w")).otherwise(F.col("until") + chunk)
    spans = found.where("not in_order").select("key", "c", F.substring("w", F.col("from") + 1, upto - F.col("from")).alias("span"))
    resumed = found.where("in_order").select("key", "c", "last", "w", "from").repartition(tasks, "key").sortWithinPartitions("key", "c")

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(pattern)
        rows = (tuple(x.as_py() for x in row) for batch in batches for row in zip(*batch.columns, strict=True))
        for key, c, span in resume(rows, pieces, chunk):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([c], pa.int32()), pa.array([span])], names=["key", "c", "span"])

    spans = spans.unionByName(resumed.mapInArrow(go_on, "key string, c int, span string").repartition(tasks, "key", "c"))

    def encode_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            ids = [np.asarray(bpe.encode_ordinary(s.as_py()), dtype=np.int32) for s in batch.column("span")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("c"), pa.array(ids, pa.list_(pa.int32()))], names=["key", "c", "ids"])

    pieces = spans.mapInArrow(encode_spans, "key string, c int, ids array<int>")
    joined = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).getField("ids").alias("parts")).select("key", F.flatten("parts").alias("ids"))

    def finish_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                yield _finish(["key", *names], [row.column("key")], [row.column("ids")[0].as_py()], digest, ranks_path, pattern)

    finished = joined.mapInArrow(finish_long, ", ".join(["key string", *out]))
    return short.unionByName(long.select("doc_id", "key").join(finished, "key").select("doc_id", *names))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, data)``: the bytes of each row's ids; null ids give null."""
    base = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [None if x is None else decode(x, ranks_path, pattern) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return base.mapInArrow(work, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, data binary")
