"""Token ids of a corpus as entropy-coded files, in ascending document order.

``write_stream`` tokenises every document, counts all ids, derives one shared
frequency table and codes the ids block by block (``rans.py``).  A block holds
whole documents and can be decoded alone; its checkpoints let a part of it be
decoded alone, and its checksum tells damage.  The files are Parquet tables
(``blocks``, ``counts``), so any store that Spark writes to can hold them.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rans
from .common import delete_path, scratch_path, with_integer_ids
from .letter_words import LetterWords

#: A block ends with the document that brings it to this many ids.
BLOCK_TOKENS = 1 << 19
#: Words whose ids a worker remembers; the ids of further words are found anew each time.
CACHE_WORDS = 800_000
#: Bytes of texts that are coded together, about; a longer text is coded alone.
GROUP_BYTES = 8 << 20
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + 32, _BYTES).astype(np.uint8)
#: Kinds of bytes: 1 letters, 2 digits, 3 punctuation but the apostrophe, 4 white space, 0 all others.
_KIND = np.zeros(256, dtype=np.uint8)
for _kind, _of in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"0123456789"), (3, b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'), (4, b" \t\n\v\f\r")):
    _KIND[np.frombuffer(_of, dtype=np.uint8)] = _kind
#: Whether a word begins between two kinds (five times the first, plus the second).
_CUT = np.array([b != 4 and (a == 4 or (a > 0 and b > 0 and (a != b or a == 2))) for a in range(5) for b in range(5)])


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file; once a worker, on one thread (tasks are the parallelism)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordCoder:
    """Ids of texts, word by word.

    For tokenizers that lower-case, whose normaliser and pre-tokeniser never
    join what ASCII white space separates, drop the white space itself, and
    part letters from punctuation: then a text's ids are those of its words,
    and a word is encoded once.  ASCII capitals are lowered and runs of ASCII letters,
    digits and punctuation parted beforehand, which leaves fewer different words.  Words with
    other bytes keep their capitals: a normaliser may join a capital and a mark before it lowers.
    Words are told apart and numbered for many texts at once; only the different
    ones are looked up, and ids are gathered by number.
    ``letters``: whether ``LetterWords`` is known to hold for the tokenizer; None: not known.
    """

    def __init__(self, path: str, end_id: int, letters: bool | None = None):
        self.tokenizer = tokenizer(path)
        self.letters = None if letters is False else LetterWords.of(self.tokenizer, checked=bool(letters))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        #: Word 0 is a text's end; the ids of word i are ids[begin[i]:begin[i + 1]].
        self.known: dict[bytes, int] = {}
        self.ids = array(self.dtype.char, [end_id])
        self.begin = array("i", [0, 1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id behind it, and where each text begins (length = texts + 1)."""
        words, ends = self._words(texts)
        numbered = words.dictionary_encode()
        different = numbered.dictionary.to_numpy(zero_copy_only=False)
        size, held = len(self.ids), len(self.known)
        number = np.fromiter(map(self.known.get, different, repeat(-1)), dtype=np.int32, count=len(different))
        missing = np.flatnonzero(number < 0)
        new = different[missing].tolist()
        self._learn(new)
        number[missing] = np.fromiter(map(self.known.__getitem__, new), dtype=np.int32, count=len(new))
        row = np.insert(number[numbered.indices.to_numpy()], ends, 0)
        begin = np.frombuffer(self.begin, dtype=np.int32)
        sizes = begin[row + 1] - begin[row]
        after = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat((begin[row] - after + sizes).astype(np.int32), sizes) + np.arange(after[-1], dtype=np.int32)
        ids = np.frombuffer(self.ids, dtype=self.dtype)[at]
        bounds = np.concatenate(([0], after[ends + np.arange(len(ends))]))
        del begin
        if len(self.known) > CACHE_WORDS:
            for word in new:
                del self.known[word]
            del self.ids[size:], self.begin[held + 2 :]
        return ids, bounds

    def _learn(self, new: list[bytes]) -> None:
        """Encode new words: those of Latin letters alone by ``LetterWords``, others by the tokenizer."""
        lowered = b"\n".join(new).decode("utf-8", "replace").lower().split("\n") if new else []
        plain = [self.letters is not None and LetterWords.takes(t) for t in lowered]
        known, some = [w for w, yes in zip(new, plain, strict=True) if yes], [t for t, yes in zip(lowered, plain, strict=True) if yes]
        if some:
            ids, ends = self.letters.encode(some)
            self._add(known, ids.astype(self.dtype).tobytes(), ends)
        other = [w for w, yes in zip(new, plain, strict=True) if not yes]
        for low in range(0, len(other), 20_000):
            part = other[low : low + 20_000]
            self._add_encoded(part, [w.decode("utf-8", "replace") for w in part])

    def _add_encoded(self, words: list[bytes], texts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self._add(words, array(self.dtype.char, chain.from_iterable(found)).tobytes(), np.cumsum([len(x) for x in found]))

    def _add(self, words: list[bytes], ids: bytes, ends: np.ndarray) -> None:
        first, size = len(self.begin) - 1, len(self.ids)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.ids.frombytes(ids)
        self.begin.frombytes((ends + size).astype(np.int32).tobytes())

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All words of the texts as one array, and the number of words up to each text's end."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = (int(bounds[0]), int(bounds[-1])) if len(texts) else (0, 0)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[first:last]
        bounds = bounds - first
        data = _LOWER[raw]
        kind = _KIND[data]
        starts = np.empty(len(data), dtype=bool)
        starts[1:] = _CUT[kind[:-1] * np.uint8(5) + kind[1:]]
        space = kind == 4
        begins = bounds[:-1][bounds[:-1] < bounds[1:]]
        starts[begins] = ~space[begins]
        for i in np.flatnonzero(pc.match_substring(texts, b"<|").to_numpy(zero_copy_only=False)):
            # special tokens are told by their letters' case
            a, b = bounds[i], bounds[i + 1]
            data[a:b] = raw[a:b]
            starts[a + 1 : b] = space[a : b - 1] & ~space[a + 1 : b]
        at = np.flatnonzero(starts)
        if len(at):
            odd = np.flatnonzero(np.maximum.reduceat(raw, at) >= 0x80)
            ends = np.append(at[1:], len(raw))[odd] - at[odd]
            inside = np.repeat(at[odd] - np.cumsum(ends) + ends, ends) + np.arange(ends.sum())
            data[inside] = raw[inside]
        kept = np.cumsum(~space, dtype=np.int32)
        offsets = np.append(kept[at] - 1, kept[-1:] if len(kept) else 0).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~space]))])
        return words, np.searchsorted(at, bounds[1:])


@lru_cache(maxsize=2)
def word_coder(path: str, end_id: int, letters: bool) -> WordCoder:
    """A worker's coder, with what it remembers from earlier tasks."""
    return WordCoder(path, end_id, letters)


def text_groups(batch: pa.RecordBatch, size: int = GROUP_BYTES, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by about ``size`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // size
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if high > low:
            yield batch.slice(low, high - low)


def _tokenised(docs: DataFrame, path: str, end_id: int, letters: bool, vocabulary: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents in order, and for each part one row with the counts of its ids."""
    names = ["part", "doc_id", "begin", "n", "ids", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = word_coder(path, end_id, letters), TaskContext.get().partitionId(), 0
        counts = np.zeros(vocabulary, dtype=np.int64)
        for rows in (rows for batch in batches for rows in text_groups(batch)):
            ids, bounds = coder.encode(rows.column(1))
            sizes, n = np.diff(bounds), rows.num_rows
            counts += np.bincount(ids, minlength=vocabulary)
            parts = pa.array(np.full(n, part, dtype=np.int32))
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([parts, rows.column(0), pa.array(at + bounds[:-1]), pa.array(sizes), data, pa.nulls(n, pa.binary())], names=names)
            at += int(bounds[-1])
        if at:
            one = [pa.array([part], pa.int32()), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()])]
            yield pa.RecordBatch.from_arrays(one, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("x"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("x")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("x"))
    return ordered.mapInArrow(work, "part int, doc_id long, begin long, n long, ids binary, counts binary")


def _counts(tokens: DataFrame) -> DataFrame:
    """``(id, count)`` over all parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for counts in batch.column(0):
                one = np.frombuffer(counts.as_py(), dtype="<i8")
                total = one if total is None else total + one
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "count"])

    return tokens.where("counts is not null").select("counts").mapInArrow(work, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def _table(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """All counts as one array; at most one row an id of the vocabulary."""
    out = np.zeros(vocabulary, dtype=np.int64)
    for row in counts.collect():
        out[row["id"]] = row["count"]
    return out


def _blocks(tokens: DataFrame, counts: np.ndarray, dtype: str, block_tokens: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(counts)

        def block(rows: list[tuple]) -> pa.RecordBatch:
            symbols = np.frombuffer(b"".join(r[4] for r in rows), dtype=dtype)
            values = [[rows[0][0]], [rows[0][2]], [[r[1] for r in rows]], [[r[3] for r in rows]], [rans.encode(symbols, table)]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "begin", "doc_ids", "sizes", "data"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (row[0] != held[0][0] or row[2] != held[-1][2] + held[-1][3] or size >= block_tokens):
                    yield block(held)
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield block(held)

    return tokens.select("part", "doc_id", "begin", "n", "ids").mapInArrow(work, "part int, begin long, doc_ids array<long>, sizes array<long>, data binary")


def write_stream(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of all documents, each with ``end_id`` behind it, below ``out``.

    Documents come in ascending id order, null ids first, repeated ids by the hash of their
    text.  Null and empty texts have the end id alone.  An empty table writes empty files; ids
    that are no integers are an error.
    """
    spark = with_integer_ids(docs, id_col).sparkSession
    coder = WordCoder(tokenizer_path, end_id)
    dtype, vocabulary = coder.dtype.str, max(coder.tokenizer.get_vocab_size(), end_id + 1)
    held = scratch_path(spark, "tokens")
    _tokenised(docs, tokenizer_path, end_id, coder.letters is not None, vocabulary, id_col, text_col).write.option("compression", "snappy").parquet(held)
    stored = spark.read.parquet(held)
    tokens = stored.where("counts is null")
    _counts(stored).write.parquet(f"{out}/counts")
    counts = _table(spark.read.parquet(f"{out}/counts"), vocabulary)
    ends = tokens.groupBy("part").agg(F.sum("n").alias("size"))
    offset = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.select("part", offset.alias("offset"))  # one row a partition
    blocks = _blocks(tokens, counts, dtype, block_tokens).join(offsets, "part").select((F.col("begin") + F.col("offset")).alias("start"), "doc_ids", "sizes", "data")
    blocks.write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    delete_path(spark, held)


def _decoded(spark: SparkSession, path: str, make, schema: str) -> DataFrame:
    stored = spark.read.parquet(f"{path}/counts")
    counts = _table(stored, (stored.agg(F.max("id")).first()[0] or 0) + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(counts)
        for batch in batches:
            for row in range(batch.num_rows):
                start, ids, sizes, data = (c[row] for c in batch.columns)
                symbols = rans.decode(data.as_py(), table).astype("<u4")
                ends = np.cumsum(sizes.values.to_numpy())
                begins = ends - sizes.values.to_numpy()
                pieces = [symbols[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield make(ids.values, pa.array(begins + start.as_py()), sizes.values, pieces)

    return spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "sizes", "data").mapInArrow(work, schema)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files."""

    def make(ids, start, sizes, pieces):
        return pa.RecordBatch.from_arrays([ids, start, sizes, pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])

    return _decoded(spark, path, make, "doc_id long, start long, n_tokens long, ids array<int>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)``, the checksum over the decoded ids as 32-bit little-endian integers."""

    def make(ids, start, sizes, pieces):
        return pa.RecordBatch.from_arrays([ids, start, sizes, pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _decoded(spark, path, make, "doc_id long, start long, n_tokens long, ids_crc32 long")
