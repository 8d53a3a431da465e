"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints.

A fingerprint is cut into ``blocks`` blocks.  Two fingerprints that differ in
at most ``max_bits`` bits agree on at least ``blocks - max_bits`` of them, so
joining on every choice of that many blocks finds every close pair; the
Hamming distance is then verified.  With five blocks and three bits a key has
about 26 bits, so buckets stay small when the corpus grows (six blocks: 32
bits).  Equal fingerprints are collapsed before the join.

A bucket never becomes a list of pairs: each group of at most two chunks of
``chunk`` fingerprints is searched inside one task, which emits a spanning
forest of the links it verified (fewer links than fingerprints).  Larger
buckets are dealt out by pairs of chunks, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_integer_ids
from .components import connected_components
from .runs import blocks_of_runs

#: Groups up to this size are compared shift by shift, all groups of a batch at once.
_SMALL_GROUP = 12


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeats included.

    A-Z are lower-cased and words are runs without ASCII white space.  A text
    with fewer words than a shingle hashes its whole word sequence; one without
    words (or null) has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The word whose bit is 1 where over half of the hashes have it."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``, fp being the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, fp long")


def block_keys(blocks: int, max_bits: int) -> list[tuple[int, int]]:
    """``(table, mask)`` for each choice of blocks on which a close pair may agree."""
    bounds = np.linspace(0, 64, blocks + 1).astype(int)
    masks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [(i, sum(x)) for i, x in enumerate(combinations(masks, blocks - max_bits))]


def _forest(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the close pairs, breadth first."""
    out: list[tuple[int, int]] = []
    left = values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            found = left[near]
            out += [(int(at), int(x)) for x in found]
            queue += list(found)
            left = left[~near]
    return out


def _search(max_bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in blocks_of_runs(batches, ["t", "k", "a", "b"]):
            fps = table.column("fp").to_numpy().view(np.uint64)
            sizes = np.diff(bounds)
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = (sizes <= _SMALL_GROUP)[group]
            f, g = fps[small], group[small]
            left, right = [], []
            for shift in range(1, _SMALL_GROUP):
                near = (g[shift:] == g[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= max_bits)
                left.append(f[:-shift][near])
                right.append(f[shift:][near])
            for i in np.flatnonzero(sizes > _SMALL_GROUP):
                links = _forest(np.unique(fps[bounds[i] : bounds[i + 1]]), max_bits)
                left.append(np.array([x for x, _ in links], dtype=np.uint64))
                right.append(np.array([x for _, x in links], dtype=np.uint64))
            src, dst = np.concatenate(left), np.concatenate(right)
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], names=["src", "dst"])

    return work


def close_links(values: DataFrame, blocks: int = 5, max_bits: int = 3, chunk: int = 4096) -> DataFrame:
    """Verified links ``(src, dst)`` that connect all of ``values.fp`` (distinct) within ``max_bits``."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("k")) for t, mask in block_keys(blocks, max_bits)])
    rows = values.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")
    shared = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (
        rows.join(shared, ["t", "k"])
        .withColumn("g", F.ceil(F.col("n") / chunk).cast("int"))
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("t", "k", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "fp")
    )
    return dealt.repartition("t", "k", "a", "b").sortWithinPartitions("t", "k", "a", "b").mapInArrow(_search(max_bits), "src long, dst long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, blocks: int = 5, max_bits: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest doc_id
    reachable over links of at most ``max_bits`` differing bits, itself
    included.  Null and empty texts have fingerprint zero and link like any
    other.  Rows with equal doc_id are each judged by their own text.  A null
    doc_id never is a component's id unless all its members are null.  An empty table
    stays empty; ids that are no integers are an error.
    """
    prints = cut(fingerprints(with_integer_ids(docs, id_col), id_col, text_col, shingle, seed))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = connected_components(close_links(classes.select("fp"), blocks, max_bits))
    named = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = named.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the smallest id.

    Rows that repeat an id that stays are reduced to one of them.  Rows without
    an id can't stand for a group and are always kept.
    """
    judged = simhash_components(docs, id_col, text_col, **options)
    keep = judged.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__pw_id")).distinct()
    named = docs.join(keep, F.col(id_col).cast("long") == F.col("__pw_id"), "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
