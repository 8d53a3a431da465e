"""SimHash near-duplicates by similarity: one document of each group of texts alike.

A similarity of 0.8 between sets of word shingles leaves about 15 % of a
SimHash's bits different, far more than pigeonhole blocks of a 64-bit
fingerprint can bear.  Here a fingerprint has 1,024 bits in 64 blocks of 16: a
pair at exactly 0.8 shares a block with probability 0.99, closer pairs more
surely.  Documents are joined on blocks, compared by the Hamming distance of a
quarter of the bits, and what passes is confirmed by the exact Jaccard
similarity of the texts' shingles.

As in ``simhash.py``, buckets are dealt out by pairs of chunks and give links
that connect what is near, not all pairs: small groups all their near pairs;
larger ones a spanning forest of the nearest, and the nearest pair between any
two of its trees.  Confirmation breaks some of these links.  So the texts that
such links connect, which hold every near pair they stand for, are compared
again where confirmation left them in several parts: dealt over tiles with their
shingles, each near pair of different parts is put to the exact test within its
tile, and only the links that join two parts leave it.  A near pair is either
within one component already or put to the exact test itself, whatever the size
of its group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .components import connected_components
from .runs import blocks_of_runs

WORDS, BLOCK_BITS, COMPARED = 16, 16, 4
#: Differing bits of the compared 256: joined first; possibly 0.8 (three deviations above the mean of such pairs).
SURE, POSSIBLE = 40, 57
#: Differing bits of all 1,024: again three deviations above the mean at 0.8.
MOST = 190
#: Groups up to this size give all their near pairs.
_SMALL_GROUP = 12
#: Ids or blocks up to this many are broadcast to what they are joined with; more are shuffled.
BROADCAST_IDS = 200_000
#: Pairs of a tile on average.
TILE_PAIRS = 1_000
#: Shingles of a chunk on average (32 MB as hashes).
TILE_SHINGLES = 4_000_000
_MIX = np.random.default_rng(11).integers(1 << 62, dtype=np.uint64, size=WORDS) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles (A-Z lower-cased); of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))], dtype=np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words of majority bits, each from another mixing of the shingle hashes."""
    if not len(hashes):
        return np.zeros(WORDS, dtype=np.uint64)
    counts = np.zeros(WORDS * 64, dtype=np.int64)
    for low in range(0, len(hashes), 255):
        mixed = hashes[low : low + 255, None] * _MIX
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).view(np.uint64)


def _prints(rows: DataFrame, shingle: int) -> DataFrame:
    """``(id, keys, f0..)``: the wide fingerprint of each row's text, as its blocks and as the words compared first; texts without words have none."""
    names = ["id", "keys", *[f"f{i}" for i in range(COMPARED)]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([wide_fingerprint(shingle_hashes(x.as_py(), shingle)) for x in batch.column(1)], dtype=np.uint64).reshape(-1, WORDS)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(prints.view(np.int16).ravel()), WORDS * 4).cast(pa.list_(pa.int16()))
            some = np.ascontiguousarray(prints[:, :: WORDS // COMPARED].view(np.int64).T)
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, *map(pa.array, some)], names=names)

    return rows.where("x <> ''").select("id", "x").mapInArrow(work, "id long, keys array<smallint>, " + ", ".join(f"{x} long" for x in names[2:])).dropDuplicates(["id"])


def _blocks(prints: DataFrame) -> DataFrame:
    """``(t, k, id, f0.., *more)``: a row for each block of each fingerprint, with what else ``prints`` has."""
    return prints.select(F.posexplode("keys").alias("t", "k"), *[c for c in prints.columns if c != "keys"])


def _distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=-1, dtype=np.int32)


def _connect(prints: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """Positions of links for a larger group, and whether they stand for more near pairs than they are."""
    n, tree, out = len(prints), np.full(len(prints), -1), []
    left = np.arange(n)
    trees = 0
    while len(left):
        queue, left = [left[0]], left[1:]
        tree[queue[0]] = trees
        while queue and len(left):
            at = queue.pop()
            near = _distances(prints[at], prints[left]) <= SURE
            found = left[near]
            tree[found] = trees
            out += [(int(at), int(x)) for x in found]
            queue += list(found)
            left = left[~near]
        trees += 1
    more = np.bincount(tree).max() > 2
    if trees > 1:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for at in range(n - 1):
            gaps = _distances(prints[at], prints[at + 1 :])
            others = np.flatnonzero((gaps <= POSSIBLE) & (tree[at + 1 :] != tree[at])) + at + 1
            for x in others:
                key = (min(tree[at], tree[x]), max(tree[at], tree[x]))
                more |= key in best
                best[key] = min(best.get(key, (999, 0, 0)), (int(gaps[x - at - 1]), at, int(x)))
        out += [(a, b) for _, a, b in best.values()]
    return out, bool(more)


def _dealt(blocks: DataFrame, chunk: int) -> DataFrame:
    """Blocks by pairs ``(a, b)`` of chunks; ``n`` is the size of the block's bucket, null for small ones."""
    keys = ["t", "k", "a", "b"]
    return (
        blocks.withColumn("g", F.coalesce(F.ceil(F.col("n") / chunk).cast("int"), F.lit(1)))
        .withColumn("c", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("t", "k", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), *[x for x in blocks.columns if x not in ("t", "k", "n")])
        .repartition(*keys)
        .sortWithinPartitions(*keys)
    )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(a, b, more)`` of each bucket; ``more`` if the bucket's links stand for more near pairs."""
    for table, bounds in blocks_of_runs(batches, ["t", "k", "a", "b"]):
        ids = table.column("id").to_numpy()
        prints = np.stack([table.column(f"f{i}").to_numpy() for i in range(COMPARED)], axis=1).view(np.uint64)
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.flatnonzero((sizes <= _SMALL_GROUP)[group])
        left, right, more = [], [], []
        for shift in range(1, _SMALL_GROUP):
            a, b = small[:-shift], small[shift:]
            same = group[a] == group[b]
            a, b = a[same], b[same]
            near = _distances(prints[a], prints[b]) <= POSSIBLE
            left.append(ids[a[near]])
            right.append(ids[b[near]])
            more.append(np.zeros(near.sum(), dtype=np.int64))
        for i in np.flatnonzero(sizes > _SMALL_GROUP):
            # in the order of ids, so that the tables' forests begin at the same texts and share their links
            order = np.argsort(ids[bounds[i] : bounds[i + 1]]) + bounds[i]
            links, crowded = _connect(prints[order])
            links = order[np.array(links, dtype=np.int64).reshape(-1, 2)]
            left.append(ids[links[:, 0]])
            right.append(ids[links[:, 1]])
            more.append(np.full(len(links), int(crowded), dtype=np.int64))
        one, two = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two), np.concatenate(more)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.array(pairs[:, 2] > 0)], names=["a", "b", "more"])


def _close(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs whose whole fingerprints differ in ``MOST`` bits at most: far fewer texts to fetch."""
    one, two = (prints.select(F.col("id").alias(name), F.col("keys").alias(f"k{name}")) for name in ("a", "b"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "ka", "kb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.ascontiguousarray(batch.column(i).flatten().to_numpy()).view(np.uint64).reshape(-1, WORDS) for i in (2, 3))
            d = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int32)
            yield batch.select(["a", "b"]).filter(pa.array(d <= MOST))

    return met.mapInArrow(work, "a long, b long")


def _confirmed(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs whose shingle sets really are that similar.

    Pairs are dealt over tiles by both ends, and a text goes to each of its tiles
    once; a tile that many pairs of one text crowd is split by the hash of the pair.
    """
    side = math.ceil(math.sqrt((pairs.count() + 1) / TILE_PAIRS))
    tiled = pairs.select("a", "b", F.pmod("a", F.lit(side)).alias("i"), F.pmod("b", F.lit(side)).alias("j"))
    crowded = tiled.groupBy("i", "j").agg(F.count("*").alias("n")).where(F.col("n") > 4 * TILE_PAIRS)
    parts = F.coalesce(F.ceil(F.col("n") / TILE_PAIRS), F.lit(1))
    tiled = tiled.join(crowded, ["i", "j"], "left").select("a", "b", "i", "j", F.pmod(F.xxhash64("a", "b"), parts).alias("k"))
    ends = lambda name: tiled.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("k").alias("tk"), F.col(name).alias("id")).distinct()
    needed = ends("a").unionByName(ends("b")).distinct()
    ids = needed.select("id").distinct()
    texts = rows.select("id", "x").join(_beside(ids), "id").dropDuplicates(["id"])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {i: shingle_hashes(x.as_py(), shingle) for i, x in zip(right.column("id").to_pylist(), right.column("x"), strict=True)}
        keep = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            keep.append(common >= similarity * (len(sets[a]) + len(sets[b]) - common))
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return tiled.groupBy("i", "j", "k").cogroup(needed.join(texts, "id").groupBy("ti", "tj", "tk")).applyInArrow(work, "a long, b long")


def _joining(similarity: float):
    """Compares the texts of a tile: ``(a, b)`` links of that similarity that join texts of different ``part``.

    In a tile of two chunks only pairs between them are compared; pairs whose
    parts an earlier link has joined need no test.
    """

    def work(table: pa.Table) -> pa.Table:
        ids, chunks = table.column("id").to_numpy(), table.column("c").to_numpy()
        parts = np.unique(table.column("part").to_numpy(), return_inverse=True)[1]
        prints = np.ascontiguousarray(table.column("keys").combine_chunks().flatten().to_numpy()).view(np.uint64).reshape(-1, WORDS)
        sets = [x.values.to_numpy() for x in table.column("hashes")]
        sizes = np.array([len(x) for x in sets])
        one_chunk = len(ids) > 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left, right = [], []
        for at in range(len(ids) - 1):
            others = np.flatnonzero((parts[at + 1 :] != parts[at]) & (one_chunk | (chunks[at + 1 :] != chunks[at]))) + at + 1
            others = others[_distances(prints[at], prints[others]) <= MOST]
            others = others[np.minimum(sizes[others], sizes[at]) >= similarity * np.maximum(sizes[others], sizes[at])]
            for x in others:
                if parts[x] == parts[at]:
                    continue
                common = len(np.intersect1d(sets[at], sets[x], assume_unique=True))
                if common >= similarity * (sizes[at] + sizes[x] - common):
                    left.append(min(ids[at], ids[x]))
                    right.append(max(ids[at], ids[x]))
                    parts[parts == parts[x]] = parts[at]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return work


def _joined_late(found: DataFrame, groups: DataFrame, prints: DataFrame, rows: DataFrame, shingle: int, similarity: float, chunk: int) -> DataFrame:
    """Links ``(a, b)`` between texts of different ``groups`` that the links ``found`` of crowded buckets stood for.

    All near pairs of a bucket lie within one component of its links, so these
    components are compared where they hold several groups.  One of more than
    ``chunk`` texts or ``TILE_SHINGLES`` shingles is dealt out by pairs of chunks.
    """
    near = connected_components(found.where("more"), "a", "b").select(F.col("node").alias("id"), F.col("component").alias("s"))
    parted = cut(near.join(groups, "id", "left").select("id", "s", F.coalesce("component", "id").alias("part")))
    mixed = parted.groupBy("s").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("s")
    members = cut(parted.join(_beside(cut(mixed)), "s"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sets = pa.array([shingle_hashes(batch.column(1)[row].as_py(), shingle).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), sets], names=["id", "hashes"])

    texts = rows.select("id", "x").join(_beside(members.select("id")), "id").dropDuplicates(["id"])
    held = cut(members.join(texts.mapInArrow(hashed, "id long, hashes array<long>"), "id").join(prints.select("id", "keys"), "id"))
    wanted = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum(F.size("hashes")) / TILE_SHINGLES))
    dealt = held.join(_beside(cut(held.groupBy("s").agg(wanted.cast("int").alias("g")))), "s").withColumn("c", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    tiled = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    tiles = tiled.select("s", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "id", "part", "keys", "hashes")
    return tiles.groupBy("s", "i", "j").applyInArrow(_joining(similarity), "a long, b long")


def _beside(few: DataFrame) -> DataFrame:
    """A table of ids or blocks to join with: broadcast after a count."""
    return F.broadcast(few) if few.count() <= BROADCAST_IDS else few


def _worded(text: Column) -> Column:
    """The text, or the empty one in place of null and of texts without words: all of these are alike."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise("")


def _judged(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8, chunk: int = 1_024) -> DataFrame:
    """``(doc_id, id, component, component_id)``, one row for each row of ``docs``: ``id`` names its text, ``component`` the group of texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _worded(F.col(text_col)).alias("x")).withColumn("id", F.xxhash64("x"))
    named = cut(rows.groupBy("id").agg(F.min("doc_id").alias("first_id")))
    prints = cut(_prints(rows, shingle))
    blocks = _blocks(prints)
    sizes = cut(blocks.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > chunk))
    found = cut(_dealt(blocks.join(_beside(sizes), ["t", "k"], "left"), chunk).mapInArrow(_search, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more")))
    linked = cut(_confirmed(cut(_close(found, prints)), rows, shingle, similarity))
    groups = cut(connected_components(linked, "a", "b").withColumnRenamed("node", "id"))
    late = cut(_joined_late(found, groups, prints, rows, shingle, similarity, chunk))
    if not late.isEmpty():
        groups = connected_components(linked.unionByName(late), "a", "b").withColumnRenamed("node", "id")
    joined = named.join(groups, "id", "left").select("id", "first_id", F.coalesce("component", "id").alias("component"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "id").join(joined.join(least, "component").select("id", "component", "component_id"), "id")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, component_id)``, one row for each row of ``docs``; component_id is the smallest doc_id of its group.

    Equal texts are one group; null texts and those without words count as empty
    ones, which form a group of their own.  Rows that repeat an id are each judged by their own text.
    """
    return _judged(docs, id_col, text_col, **options).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one document of each group: that of the smallest id.

    Where rows repeat that id, it is the one with the least text hash within the
    group, and of rows equal in id and text that with the least hash of all columns.
    Rows without an id can't stand for a group and are always kept.
    """
    judged = _judged(docs, id_col, text_col, **options).where(F.col("doc_id") == F.col("component_id"))
    keep = cut(judged.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("k"), F.count("*").alias("n")).select(F.col("k.doc_id").alias("__pw_id"), F.col("k.id").alias("__pw_text"), (F.col("n") > 1).alias("__pw_more")))
    own_text = F.xxhash64(_worded(F.col(text_col)))
    kept = docs.join(_beside(keep), (F.col(id_col).cast("long") == F.col("__pw_id")) & (own_text == F.col("__pw_text")))
    nth = F.row_number().over(Window.partitionBy("__pw_id", "__pw_text").orderBy(F.xxhash64(*docs.columns)))
    repeated = kept.where("__pw_more").withColumn("__pw_nth", nth).where("__pw_nth = 1")
    return kept.where("not __pw_more").select(*docs.columns).unionByName(repeated.select(*docs.columns)).unionByName(docs.where(F.col(id_col).isNull()))
