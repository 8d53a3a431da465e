"""Embedding near-duplicates over an inverted multi-index.

Each half of a vector has a codebook of its own; the pairs of centroids form a
grid of cells, and a vector is stored in the cell of its nearest centroids.  A
vector looks for near-duplicates in the cells that the multi-sequence order
visits first (growing sum of the two squared distances).  How many cells
are visited is measured on a bounded sample: vectors are moved to the link threshold in
a random direction, and the visits go on until the target share of the moved
vectors' cells is reached.  All candidates met are verified in double precision.

A task holds a chunk of one cell's members and streams visitors past it.  It
emits a count for each vector and a spanning forest of the links it verified,
never all pairs.  Cells with many members or visitors are dealt out by chunk;
equal vectors are collapsed first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_integer_ids
from .components import connected_components
from .qalsh import usable_vector, usual_length
from .runs import blocks_of_runs

#: Vectors that the codebooks and the number of visits are fitted on, at most.
SAMPLE = 8_192
TARGET_RECALL = 0.999
#: Members and visitors of a cell in one task, about.
CHUNK = 2_048


def codebook(points: np.ndarray, size: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means from sampled points."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(size, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(axis=1) - 2 * points @ centres.T, axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


class MultiIndex:
    """Two codebooks over unit vectors and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, size: int, threshold: float, recall: float = TARGET_RECALL, seed: int = 5):
        half = sample.shape[1] // 2
        self.books = (codebook(sample[:, :half], size, seed=seed), codebook(sample[:, half:], size, seed=seed + 1))
        rng = np.random.default_rng(seed)
        aside = rng.standard_normal(sample.shape)
        aside -= (aside * sample).sum(axis=1, keepdims=True) * sample
        norm = np.linalg.norm(aside, axis=1, keepdims=True)
        moved = threshold * sample + np.sqrt(1 - threshold**2) * aside / np.where(norm > 0, norm, 1)
        # a pair is met if either finds the other's cell
        needed = np.minimum(self._position(sample, moved), self._position(moved, sample))
        self.visits = min(int(np.quantile(needed, recall, method="higher")), len(self.books[0]) * len(self.books[1]))

    def _distances(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """To the centroids of either half, squared and less a constant of the point."""
        half = points.shape[1] // 2
        one, two = (((b * b).sum(axis=1) - 2 * x @ b.T) for x, b in zip((points[:, :half], points[:, half:]), self.books, strict=True))
        return one, two

    def _position(self, points: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Cells that each point visits until it comes to the other's own cell, that one included."""
        out = np.zeros(len(points), dtype=np.int64)
        for low in range(0, len(points), 512):
            (a, b), (x, y) = self._distances(points[low : low + 512]), self._distances(others[low : low + 512])
            there = np.take_along_axis(a, x.argmin(axis=1)[:, None], 1)[:, 0] + np.take_along_axis(b, y.argmin(axis=1)[:, None], 1)[:, 0]
            for i, (one, two, total) in enumerate(zip(a, np.sort(b, axis=1), there, strict=True)):
                out[low + i] = two.searchsorted(total - one + 1e-12, "right").sum()
        return out

    def sequence(self, points: np.ndarray) -> np.ndarray:
        """For each point the first ``visits`` cells in multi-sequence order; the first is its own.

        The cell of a half's i-th and the other's j-th nearest centroid (from 1) has i * j cells
        no farther than itself, so only cells with i * j <= visits come into question.
        """
        one, two = self._distances(points)
        first, second = (np.argsort(x, axis=1, kind="stable")[:, : self.visits] for x in (one, two))
        i, j = np.nonzero(np.outer(np.arange(1, first.shape[1] + 1), np.arange(1, second.shape[1] + 1)) <= self.visits)
        sums = np.take_along_axis(one, first, 1)[:, i] + np.take_along_axis(two, second, 1)[:, j]
        order = np.argsort(sums, axis=1, kind="stable")[:, : self.visits]
        return np.take_along_axis(first[:, i] * len(self.books[1]) + second[:, j], order, 1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows; floats as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return flat.astype(np.float64) if flat.dtype.kind == "f" else flat


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _placed(classes: DataFrame, index: MultiIndex) -> DataFrame:
    """Each class with its visits, the first of them its own cell."""
    element = classes.schema["v"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1_024):
                part = batch.slice(low, 1_024)
                cells = index.sequence(_unit(_matrix(part.column(3)))) if part.num_rows else np.zeros((0, index.visits), dtype=np.int64)
                visits = pa.FixedSizeListArray.from_arrays(pa.array(cells.astype(np.int32).ravel()), cells.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, visits], names=["id", "label", "w", "v", "visits"])

    return classes.select("id", "label", "w", "v").mapInArrow(work, f"id long, label long, w long, v array<{element}>, visits array<int>")


def _forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the matrix connects: labels of both sides spread until they settle."""
    if not linked.any():
        return rows[:0], rows[:0]
    at, to = np.nonzero(linked)
    first_row = np.full(linked.shape[1], len(rows))
    np.minimum.at(first_row, to, at)
    first_column = np.full(linked.shape[0], len(columns))
    np.minimum.at(first_column, at, to)
    # star of each row on its first column, star of each column on its first row ...
    src, dst = [rows[first_column < len(columns)]], [columns[first_column[first_column < len(columns)]]]
    hit = first_row < len(rows)
    src.append(columns[hit])
    dst.append(rows[first_row[hit]])
    # ... and whatever those two leave apart
    group = np.arange(len(rows) + len(columns))
    pairs = np.concatenate([np.stack([np.flatnonzero(first_column < len(columns)), len(rows) + first_column[first_column < len(columns)]], 1), np.stack([len(rows) + np.flatnonzero(hit), first_row[hit]], 1)])
    group = _spread(group, pairs[:, 0], pairs[:, 1])
    while True:
        apart = np.flatnonzero(group[at] != group[len(rows) + to])
        if not len(apart):
            break
        keys = group[at[apart]] * len(group) + group[len(rows) + to[apart]]
        pick = apart[np.unique(keys, return_index=True)[1]]
        src.append(rows[at[pick]])
        dst.append(columns[to[pick]])
        group = _spread(group, at[pick], len(rows) + to[pick])
    return np.concatenate(src), np.concatenate(dst)


def _spread(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; labels are positions and only fall."""
    while True:
        low = np.minimum(group[a], group[b])
        new = group.copy()
        np.minimum.at(new, group[a], low)
        np.minimum.at(new, group[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == group).all():
            return group
        group = new


def _verify(threshold: float):
    """Within each (label, cell, chunks): visitors against members."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in blocks_of_runs(batches, ["label", "cell", "mc", "vc"]):
            ids, member = table.column("id").to_numpy(), table.column("member").to_numpy(zero_copy_only=False)
            weight = table.column("w").to_numpy()
            vectors = _matrix(table.column("v"))
            visits, visitor_home = table.column("visits").combine_chunks(), table.column("home").to_numpy()
            norms = np.linalg.norm(vectors, axis=1)
            counts: list[tuple[np.ndarray, np.ndarray]] = []
            links: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                here = np.arange(a, b)
                inside, outside = here[member[a:b]], here[~member[a:b]]
                if not len(inside):
                    continue
                # members visit their own cell too; a pair of members is seen from both sides
                their_visits = _matrix(visits.take(pa.array(inside)))
                for low in range(0, len(outside), CHUNK):
                    visitors = outside[low : low + CHUNK]
                    cosine = vectors[visitors] @ vectors[inside].T / (norms[visitors][:, None] * norms[inside])
                    linked = (cosine >= threshold) & (ids[visitors][:, None] != ids[inside])
                    if not linked.any():
                        continue
                    links.append(_forest(linked, ids[visitors], ids[inside]))
                    counts.append((ids[visitors], linked @ weight[inside]))
                    # the other side counts here only if it does not visit the visitor's cell itself
                    x, y = np.nonzero(linked)
                    alone = np.zeros(len(x), dtype=bool)
                    for part in range(0, len(x), 1 << 18):
                        home = visitor_home[visitors[x[part : part + (1 << 18)]]]
                        alone[part : part + (1 << 18)] = ~(their_visits[y[part : part + (1 << 18)]] == home[:, None]).any(axis=1)
                    if alone.any():
                        counts.append((ids[inside], np.bincount(y[alone], weights=weight[visitors[x[alone]]], minlength=len(inside)).astype(np.int64)))
            rows = [(i, n, None) for i, n in counts] + [(s, None, d) for s, d in links]
            for who, n, other in rows:
                size = len(who)
                if n is not None:
                    keep = n > 0
                    who, n, size = who[keep], n[keep], int(keep.sum())
                if size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(who), pa.array(n, pa.int64()) if n is not None else pa.nulls(size, pa.int64()), pa.array(other, pa.int64()) if other is not None else pa.nulls(size, pa.int64())], names=["id", "n", "other"]
                    )

    return work


def link_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", recall: float = TARGET_RECALL, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Two vectors link if their labels are equal and not null (without a label
    column: any) and their cosine is at least the threshold.  Vectors that are
    null, zero or hold null or non-finite components link with nothing, nor do
    vectors of another length than most have, nor rows without an id.  Equal vectors
    of a label link with each other.  Rows that repeat an id are vectors each,
    judged by their own label and vector; an empty table stays empty.  Ids and labels
    that are no integers are an error.
    """
    for name in (id_col, label_col) if label_col else (id_col,):
        with_integer_ids(vectors, name)
    label = F.col(label_col).cast("long") if label_col else F.lit(0).cast("long")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).alias("v"))
    fit = usable_vector("v") & F.col("label").isNotNull() & F.col("id").isNotNull()
    dim, n, _ = usual_length(base.where(fit), "v")
    fit = fit & (F.size("v") == dim)
    alone = base.where(~fit).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.lit(True))
    rows = base.where(fit).withColumn("key", F.xxhash64("v"))
    equal = rows.groupBy("label", "key", "v").agg(F.min("id").alias("least"), F.count("*").alias("w"))
    # ids may repeat, so a class has a number of its own
    classes = cut(equal.withColumn("id", F.monotonically_increasing_id()))
    n = classes.count()
    drawn = classes.orderBy(F.xxhash64("least", "key", F.lit(3)), "least", "key").select("v").limit(sample).toArrow()
    # cells hold about 200 classes, and no more however many vectors there are
    index = MultiIndex(_unit(_matrix(drawn.column("v"))), max(2, round((n / 200) ** 0.5)), threshold, recall)
    placed = cut(_placed(classes, index)).withColumn("home", F.col("visits")[0])
    members = placed.withColumn("cell", F.col("home")).withColumn("member", F.lit(True))
    # visitors need no list of their visits
    visitors = placed.withColumn("cell", F.explode("visits")).withColumn("member", F.lit(False)).withColumn("visits", F.lit(None).cast("array<int>"))
    sizes = placed.select("label", F.posexplode("visits").alias("p", "cell")).groupBy("label", "cell").agg(F.count_if(F.col("p") == 0).alias("nm"), F.count("*").alias("nv")).where("nm > 0")
    sizes = sizes.select("label", "cell", F.ceil(F.col("nm") / chunk).cast("int").alias("gm"), F.ceil(F.col("nv") / (8 * chunk)).cast("int").alias("gv"))

    def dealt(side: DataFrame, mine: str, other: str, my_name: str, other_name: str) -> DataFrame:
        met = side.join(sizes, ["label", "cell"])
        return met.withColumn(my_name, F.pmod(F.xxhash64("id"), F.col(mine)).cast("int")).withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    columns = ["label", "cell", "mc", "vc", "id", "w", "member", "home", "v", "visits"]
    groups = dealt(members, "gm", "gv", "mc", "vc").select(columns).unionByName(dealt(visitors, "gv", "gm", "vc", "mc").select(columns))
    keys = ["label", "cell", "mc", "vc"]
    found = cut(groups.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(threshold), "id long, n long, other long"))
    counts = found.where("n is not null").groupBy("id").agg(F.sum("n").alias("near"))
    components = connected_components(found.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    judged = classes.join(counts, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = judged.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = judged.join(least, "component").select("label", "key", "v", (F.coalesce("near", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    linked = rows.select(F.col("id").alias("vec_id"), "label", "key", "v").join(of_class, ["label", "key", "v"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
