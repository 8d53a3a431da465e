"""Stretches of words that repeat with a short period, and texts without the repeats.

A run of period q is a longest stretch of words in which words q apart are equal.
For every lag q up to n / ``min_exponent`` a text's word ids are compared with the
same ids shifted by q; a stretch of at least (``min_exponent`` - 1) q equal places
is a run.  Such a stretch covers a multiple of its least length, so a lag is first
compared at these places alone (and next to them, as it goes on to one side by half
its length at least), and the whole text only where they agree.  Nothing is left out: a place that does not agree can't lie
in a long enough stretch.

Texts are scanned many at once as one array, longest first: word ids differ
between texts, so no stretch crosses from one to the next, and the texts long enough for
a lag are a prefix.  A text of over ``long_words`` words is numbered once and its
lags are dealt out in ranges of ``range_lags``, one row a range, so that machines
share it; runs found in several ranges are joined by their place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_stream import text_groups

#: Texts of more words are dealt out; lags of one range.
LONG_WORDS, RANGE_LAGS = 65_536, 16_384
#: Bytes of texts that are scanned together, about.
GROUP_BYTES = 4 << 20
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_RUNS_SQL = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int32)


def _true_stretches(ids: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the longest stretches with ``ids[i] == ids[i + q]``, of those with ``least`` places."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], ids[q:] == ids[:-q], [False])).astype(np.int8)))
    begins, sizes = edges[::2], edges[1::2] - edges[::2]
    enough = sizes >= least
    return begins[enough], sizes[enough]


def _goes_on(ids: np.ndarray, places: np.ndarray, q: int, step: int, many: int) -> np.ndarray:
    """Whether the next places to one side (four of them, or ``many`` if that is less) are equal too."""
    yes = np.ones(len(places), dtype=bool)
    for d in range(1, min(many, 4) + 1):
        at = places + step * d
        inside = (at >= 0) & (at < len(ids) - q)
        at = np.where(inside, at, 0)
        yes &= inside & (ids[at] == ids[at + q])
    return yes


class _Found:
    """Runs of one text so far: by place the least period."""

    def __init__(self):
        self.least: dict[tuple[int, int], int] = {}
        self.table = np.empty((0, 3), dtype=np.int64)

    def add(self, begins: np.ndarray, sizes: np.ndarray, q: int) -> None:
        new = [(b, s + q) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True) if (b, s + q) not in self.least]
        self.least.update(dict.fromkeys(new, q))
        if new:
            self.table = np.concatenate((self.table, [(b, b + n, q) for b, n in new]))

    def explain(self, places: np.ndarray, q: int) -> bool:
        """Whether each place lies in a run whose period divides q and which is longer than q by more: lag q gives that run again."""
        begins, ends, _ = self.table[q % self.table[:, 2] == 0].T
        return bool(len(begins)) and bool(((begins <= places[:, None]) & (places[:, None] < ends - q)).any(axis=1).all())


def runs_of(ids: np.ndarray, sizes: np.ndarray, min_exponent: int, min_length: int, lags: Iterable[int] | None = None) -> list[dict[tuple[int, int], int]]:
    """For each text ``{(start, length): period}``.

    ``ids`` are the texts' word ids one after another, by falling ``sizes``; no id is in two
    texts.  ``lags`` (default all) are those to compare.
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    found: dict[int, _Found] = {}
    longest = int(sizes[0]) if len(sizes) else 0
    for q in range(1, longest // min_exponent + 1) if lags is None else lags:
        texts = int(np.searchsorted(-sizes, -max(min_exponent * q, min_length), side="right"))
        if texts == 0:
            break
        least = max((min_exponent - 1) * q, min_length - q, 1)
        size = int(ends[texts - 1])
        some = ids[:size]
        places = np.flatnonzero(some[: size - q : least] == some[q::least]) * least
        if len(places):
            places = places[_goes_on(some, places, q, 1, (least - 1) // 2) | _goes_on(some, places, q, -1, (least - 1) // 2)]
        if not len(places):
            continue
        of = np.searchsorted(ends, places, side="right")
        for text in np.unique(of).tolist():
            low, mine = int(begins[text]), found.setdefault(text, _Found())
            if not (len(mine.table) and mine.explain(places[of == text] - low, q)):
                mine.add(*_true_stretches(ids[low : int(ends[text])], q, least), q)
    return [found[i].least if i in found else {} for i in range(len(sizes))]


def _rows(runs: dict[tuple[int, int], int]) -> list[dict[str, int]]:
    """Runs by start, then period."""
    ordered = sorted((start, period, length) for (start, length), period in runs.items())
    return [{"start": s, "length": n, "period": p} for s, p, n in ordered]


def collapsed(words: list[bytes], runs: list[dict[str, int]]) -> bytes:
    """The words that no run holds after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    for run in runs:
        marks[run["start"] + run["period"]] += 1
        marks[run["start"] + run["length"]] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()])


def _result(columns: dict[str, pa.Array], runs: list[list[dict]], texts: list[bytes]) -> pa.RecordBatch:
    columns = columns | {"runs": pa.array(runs, _RUNS), "collapsed": pa.array(texts, pa.binary()).cast(pa.string())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = 4, min_length: int = 6, long_words: int = LONG_WORDS, range_lags: int = RANGE_LAGS
) -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start,length,period>>, collapsed)``, one row for each row of ``docs``.

    Words are what ASCII white space parts, numbered from 0.  A run has its smallest period,
    at least ``min_length`` words and ``min_exponent`` periods, and no neighbouring word goes
    on with it; runs come by start, then period.  ``collapsed`` are the words that no run holds
    after its first period, joined by single spaces.  Null and empty texts have no words, no
    runs and an empty ``collapsed``; rows repeat as they do in ``docs``, null ids stay; an
    empty table gives an empty one.  Other columns of ``docs`` are not read.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    # a text of n words has n - 1 bytes of white space and n of words at least
    may_be_long = F.octet_length("x") >= 2 * long_words
    columns = f"n_words bigint, runs {_RUNS_SQL}, collapsed string"

    def scan_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_groups(batch, GROUP_BYTES):
                words = [x.split() for x in _texts(rows.column("x"))]
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                order = np.argsort(-sizes, kind="stable")
                flat = [w for i in order.tolist() for w in words[i]]
                ids, by_size = numbered(flat).astype(np.int64), sizes[order]
                ids += np.repeat(np.arange(len(order)), by_size) * (int(ids.max(initial=0)) + 1)
                runs: list[list[dict]] = [[]] * len(words)
                for i, found in zip(order.tolist(), runs_of(ids, by_size, min_exponent, min_length), strict=True):
                    runs[i] = _rows(found)
                texts = [collapsed(w, r) for w, r in zip(words, runs, strict=True)]
                yield _result({"doc_id": rows.column("doc_id"), "n_words": pa.array(sizes)}, runs, texts)

    short = base.where(~may_be_long).mapInArrow(scan_short, f"doc_id {id_type}, {columns}")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), _texts(batch.column("x")), strict=True):
                ids = numbered(text.split())
                ranges = max(1, -(-(len(ids) // min_exponent) // range_lags))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([ids.tobytes()]), pa.array([ranges], pa.int64())], names=["key", "ids", "ranges"])

    def scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data, part in zip(*(batch.column(c) for c in ("key", "ids", "part")), strict=True):
                ids = np.frombuffer(data.as_py(), dtype=np.int32)
                lags = range(part.as_py() * range_lags + 1, min((part.as_py() + 1) * range_lags, len(ids) // min_exponent) + 1)
                rows = _rows(runs_of(ids, np.array([len(ids)]), min_exponent, min_length, lags)[0])
                if rows:
                    at = [pa.array([r[c] for r in rows], pa.int64()) for c in ("start", "length", "period")]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows)), *at], names=["key", "start", "length", "period"])

    long = base.where(may_be_long).withColumn("key", F.sha2("x", 256))
    texts = long.select("key", "x").dropDuplicates(["key"])
    ranges = texts.mapInArrow(number, "key string, ids binary, ranges bigint").select("key", "ids", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("part"))
    found = ranges.repartition("key", "part").mapInArrow(scan_ranges, "key string, start bigint, length bigint, period bigint")
    found = found.groupBy("key", "start", "length").agg(F.min("period").alias("period"))  # a multiple of the smallest period gives the same place
    listed = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                words = _texts(one.column("x"))[0].split()
                runs = [{c: r[c] for c in ("start", "length", "period")} for r in one.column("runs")[0].as_py() or []]
                yield _result({"key": one.column("key"), "n_words": pa.array([len(words)], pa.int64())}, [runs], [collapsed(words, runs)])

    finished = texts.join(listed, "key", "left").select("key", "x", "runs").mapInArrow(finish, f"key string, {columns}")
    return short.unionByName(long.select("doc_id", "key").join(finished, "key").drop("key"))
