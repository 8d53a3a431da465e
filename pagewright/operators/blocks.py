"""Vectors compared by blocks: some rows and some questions meet as two matrices inside a task.

A search of all rows deals rows and questions to the cells of a grid (``met``), so a task holds a
bounded part of each, whatever their number; a stored index is packed by cell where it lies.  A product of
matrices says which pairs can matter; those are worked out again one by one, in an order that
does not depend on the block, so equal vectors have equal scores wherever they stand.

Null vectors and such with null or non-finite elements take no part; vectors of different
lengths do not meet; a zero vector has cosine 0 with all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Elements of the vectors in a block, about; rows of a block that meet the questions at once; pairs worked out at once.
BLOCK_ELEMENTS, SLICE_ROWS, PAIRS = 1 << 21, 4_096, 1 << 16
#: Questions that meet a slice of rows at once; elements of a part of rows or questions; pairs that are worth a task, and tasks that are enough.
SLICE_QUESTIONS, CELL_ELEMENTS, CELL_PAIRS, CELLS = 1_024, 1 << 22, 1 << 24, 64


def packed(rows: DataFrame, most: int, name: str, by: str | None = None) -> DataFrame:
    """Rows ``(v, …)`` by at most ``most`` in one array ``name`` each, each task for itself; with ``by`` a block has one value of it."""
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != by)
    schema = f"{name} array<struct<{kinds}>>" + (f", {by} {rows.schema[by].dataType.simpleString()}" if by else "")
    elements = BLOCK_ELEMENTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("v")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            block = (np.cumsum(size) - size) // elements + np.arange(batch.num_rows) // most
            changed = block[1:] != block[:-1]
            if by:
                held = batch.column(by).to_numpy(zero_copy_only=False)
                changed |= held[1:] != held[:-1]
            bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            names = [n for n in batch.schema.names if n != by]
            whole = pa.StructArray.from_arrays([batch.column(n) for n in names], names=names)
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                if high > low:
                    lists = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), whole.slice(low, high - low))
                    yield pa.RecordBatch.from_arrays([lists, batch.column(by).slice(low, 1)] if by else [lists], names=[name, by] if by else [name])

    return rows.mapInArrow(work, schema)


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places and matrix of the vectors that take part."""
    sizes, out = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        good = np.isfinite(values).all(axis=1)
        if good.any():
            out[n] = at[good], np.ascontiguousarray(values[good])
    return out


def exact(metric: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of rows of two matrices, pair by pair."""
    if metric == "l2":
        return 1 / (1 + np.einsum("ij,ij->i", v - q, v - q))
    inner = np.einsum("ij,ij->i", v, q)
    if metric == "ip":
        return inner
    lengths = np.sqrt(np.einsum("ij,ij->i", v, v)) * np.sqrt(np.einsum("ij,ij->i", q, q))
    return np.divide(inner, lengths, out=np.zeros_like(inner), where=lengths > 0)


class _Near:
    """Scores of questions and rows of a matrix by a product of matrices, and by how much they may be wrong."""

    def __init__(self, metric: str, v: np.ndarray):
        self.metric, self.wide = metric, 1e-12 * v.shape[1]
        self.vv = np.einsum("ij,ij->i", v, v)
        self.v = _units(v, self.vv) if metric == "cosine" else v

    def of(self, q: np.ndarray) -> Callable[[int, int], tuple[np.ndarray, float]]:
        """For questions: scores of the rows from one to another, a row a question."""
        qq = np.einsum("ij,ij->i", q, q)
        if self.metric == "cosine":  # unit vectors in single precision: wrong by no more than so many roundings
            units, wrong = _units(q, qq), 1e-7 * (q.shape[1] + 8)
            return lambda low, high: (units @ self.v[low:high].T, wrong)

        def scores(low: int, high: int) -> tuple[np.ndarray, float]:
            inner, vv = q @ self.v[low:high].T, self.vv[low:high]
            if self.metric == "ip":
                return inner, self.wide * float(np.sqrt(vv.max() * qq.max())) + 1e-300
            return 1 / (1 + np.maximum(qq[:, None] + vv - 2 * inner, 0)), self.wide * (1 + float(vv.max() + qq.max()))

        return scores


def _units(v: np.ndarray, vv: np.ndarray) -> np.ndarray:
    lengths = np.sqrt(vv)[:, None]
    return np.divide(v, lengths, out=np.zeros_like(v), where=lengths > 0).astype(np.float32)


def _exact_pairs(metric: str, v: np.ndarray, q: np.ndarray, which: np.ndarray, whose: np.ndarray) -> np.ndarray:
    parts = [exact(metric, v[which[i : i + PAIRS]], q[whose[i : i + PAIRS]]) for i in range(0, len(which), PAIRS)]
    return np.concatenate(parts) if parts else np.empty(0)


def _places(keys: pa.Array) -> np.ndarray:
    """The rank of each key in ascending order, field by field."""
    columns = keys.flatten() if pa.types.is_struct(keys.type) else [keys]
    table = pa.table({str(i): c for i, c in enumerate(columns)})
    order = pc.sort_indices(table, sort_keys=[(n, "ascending") for n in table.column_names]).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _firsts(whose: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Of each question the ``k`` best pairs, ties by rank."""
    order = np.lexsort((rank, -score, whose))
    sorted_whose = whose[order]
    begin = np.searchsorted(sorted_whose, sorted_whose, side="left")
    return order[np.arange(len(order)) - begin < k]


def _alike(v: np.ndarray, k: int) -> np.ndarray:
    """Places of rows, in order, without those that ``k`` earlier ones equal."""
    kind = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(kind, kind="stable")
    begin = np.searchsorted(kind[order], kind[order], side="left")
    return np.sort(order[np.arange(len(order)) - begin < k])


def best_pairs(metric: str, rows: pa.StructArray, asked: pa.StructArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(which row, whose question, score)`` of each question's ``k`` best rows ``(key, v)``, ties by key.

    Rows come in the order of their keys, some at a time; what the first ones leave as the k-th best
    score is what later ones must reach.  Of equal vectors only the first k can matter.
    """
    held, wanted, rank, out = _matrices(rows.field("v")), _matrices(asked.field("q")), _places(rows.field("key")), []
    for n in held.keys() & wanted.keys():
        (at, v), (ask, q) = held[n], wanted[n]
        order = np.argsort(rank[at], kind="stable")
        order = order[_alike(v[order], k)]
        at, v = at[order], v[order]
        near_of = _Near(metric, v)
        for begin in range(0, len(q), SLICE_QUESTIONS):
            some, which, whose, score = q[begin : begin + SLICE_QUESTIONS], np.empty(0, int), np.empty(0, int), np.empty(0)
            scores = near_of.of(some)
            for low in range(0, len(v), SLICE_ROWS):
                near, wrong = scores(low, min(low + SLICE_ROWS, len(v)))
                if len(which) == k * len(some):  # in order of question, then score
                    least = score.reshape(len(some), k)[:, -1]
                else:
                    least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else near.min(axis=1)
                    if len(which):
                        least = np.minimum(least, score.reshape(len(some), -1)[:, -1])
                mine, found = np.divmod(np.flatnonzero(near >= (least - 3 * wrong).astype(near.dtype)[:, None]), near.shape[1])
                which, whose = np.concatenate([which, low + found]), np.concatenate([whose, mine])
                score = np.concatenate([score, _exact_pairs(metric, v, some, low + found, mine)])
                kept = _firsts(whose, score, which, k)
                which, whose, score = which[kept], whose[kept], score[kept]
            out.append((at[which], ask[begin + whose], score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def count_higher(metric: str, rows: pa.StructArray, asked: pa.StructArray) -> np.ndarray:
    """For each question ``(q, own)`` how many rows score higher than ``own``."""
    held, wanted, out = _matrices(rows.field("v")), _matrices(asked.field("q")), np.zeros(len(asked), dtype=np.int64)
    own_of = asked.field("own").to_numpy(zero_copy_only=False)
    for n in held.keys() & wanted.keys():
        (_, v), (ask, q) = held[n], wanted[n]
        near_of = _Near(metric, v)
        for begin in range(0, len(q), SLICE_QUESTIONS):
            some, mine = q[begin : begin + SLICE_QUESTIONS], ask[begin : begin + SLICE_QUESTIONS]
            own, scores = own_of[mine], near_of.of(some)
            for low in range(0, len(v), SLICE_ROWS):
                near, wrong = scores(low, min(low + SLICE_ROWS, len(v)))
                gap = near - own[:, None]
                out[mine] += (gap > wrong).sum(axis=1)
                whose, which = np.nonzero(np.abs(gap) <= wrong)
                higher = _exact_pairs(metric, v, some, low + which, whose) > own[whose]
                out[mine] += np.bincount(whose[higher], minlength=len(mine))
    return out


def searched(pairs: DataFrame, k: int, metric: str, key: str, keep: tuple[str, ...], wanted: list[str]) -> DataFrame:
    """``(*wanted, query_id, key, *keep, score)`` of pairs of blocks ``rows`` and ``asked``: the k best of each pair."""
    row, ask = (pairs.schema[c].dataType.elementType for c in ("rows", "asked"))
    best = _best_of(k, metric, key, keep, wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some_rows, some_asked in zip(batch.column("rows"), batch.column("asked"), strict=True):
                yield best(some_rows.values, some_asked.values)

    return pairs.select("rows", "asked").mapInArrow(work, _found(row, ask, key, keep, wanted))


def searched_all(rows: DataFrame, asked: DataFrame, most: int, k: int, metric: str, key: str, keep: tuple[str, ...], wanted: list[str]) -> DataFrame:
    """The same of all rows and questions: the k best of each part of the rows."""
    return met(rows, asked, most, _found(rows.schema, asked.schema, key, keep, wanted), _best_of(k, metric, key, keep, wanted))


def _found(row: StructType, ask: StructType, key: str, keep: tuple[str, ...], wanted: list[str]) -> str:
    kinds = {c: ask[c].dataType for c in (*wanted, "query_id")} | {key: row["key"].dataType} | {c: row[c].dataType for c in keep}
    return ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds.items()) + ", score double"


def _best_of(k: int, metric: str, key: str, keep: tuple[str, ...], wanted: list[str]) -> Callable[[pa.StructArray, pa.StructArray], pa.RecordBatch]:
    def best(r: pa.StructArray, a: pa.StructArray) -> pa.RecordBatch:
        which, whose, score = best_pairs(metric, r, a, k)
        at, of = pa.array(which, pa.int64()), pa.array(whose, pa.int64())
        columns = [_plain(a.field(c).take(of)) for c in (*wanted, "query_id")] + [_plain(r.field(c).take(at)) for c in ("key", *keep)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*wanted, "query_id", key, *keep, "score"])

    return best


def _plain(column: pa.Array) -> pa.Array:
    """A struct with fields that may be null, as a result's type says."""
    return pa.StructArray.from_arrays(column.flatten(), names=[f.name for f in column.type]) if pa.types.is_struct(column.type) else column


def met(rows: DataFrame, asked: DataFrame, most: int, out: str, work: Callable[[pa.StructArray, pa.StructArray], pa.RecordBatch]) -> DataFrame:
    """What ``work`` gives for parts of ``rows (key, v, …)`` and ``asked (query_id, q, …)``: every row meets every question once.

    Both are dealt by hashes to parts, of ``most`` rows and of ``CELL_ELEMENTS`` at most, about; a task holds a part of each.
    """
    (n, wide), (m, wider) = (df.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0))).first() for df, c in ((rows, "v"), (asked, "q")))
    largest = max(1, min(most, CELL_ELEMENTS * max(n, m, 1) // max(wide, wider, 1)))
    cells = min(CELLS, n * m // CELL_PAIRS + 1)
    side = min(largest, math.isqrt(n * m // cells) + 1)
    asked_parts = max(1, -(-m // side))
    row_parts = max(1, -(-n // side), min(n, -(-cells // asked_parts)))
    part = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    cell, tasks = ["__row_part", "__asked_part"], 2 * row_parts * asked_parts
    left = rows.withColumn("__row_part", part("key", row_parts)).withColumn("__asked_part", every(asked_parts)).repartition(tasks, *cell)
    right = asked.withColumn("__asked_part", part("query_id", asked_parts)).withColumn("__row_part", every(row_parts)).repartition(tasks, *cell)
    return _together(left, right, cell, rows.columns, asked.columns, out, work)


def searched_by(rows: DataFrame, asked: DataFrame, by: list[str], tasks: int, k: int, metric: str, key: str) -> DataFrame:
    """``(query_id, key, score)``: of each group ``by`` its questions' k best of its rows."""
    names = ["key", "v"], ["query_id", "q"]
    out, best = _found(rows.schema, asked.schema, key, (), []), _best_of(k, metric, key, (), [])
    return _together(rows.repartition(tasks, *by), asked.repartition(tasks, *by), by, *names, out, best)


def _together(rows: DataFrame, asked: DataFrame, by: list[str], row_names: list[str], asked_names: list[str], out: str, work: Callable[[pa.StructArray, pa.StructArray], pa.RecordBatch]) -> DataFrame:
    def run(some_rows: pa.Table, some_asked: pa.Table) -> pa.Table:
        one = [pa.StructArray.from_arrays([_whole(t.column(c)) for c in cs], names=cs) for t, cs in ((some_rows, row_names), (some_asked, asked_names))]
        return pa.Table.from_batches([work(*one)])

    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, out)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
