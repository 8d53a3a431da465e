"""Token ids of a corpus packed into sequences of one length: concatenated and cut.

First pass: each task encodes the documents that it reads and writes their ids, numbered
through the task, as Parquet.  The tasks' totals (one row a task) are summed up to global
offsets.  Second pass: every document knows where it begins in the concatenation, so it is cut
at the windows' borders by columns alone; a piece at a border names the document, the place in
it and the place in its sequence, which is what joins it to the next piece.  No text and no id
is shuffled.  The last, short window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .token_stream import WordCoder, text_groups

_BYTES = np.arange(256)
#: Kinds of bytes: 1 letters, 2 digits, 3 punctuation but the apostrophe, 4 the apostrophe, 5 white space, 0 all others.
_KIND = np.zeros(256, dtype=np.uint8)
for _kind, _of in ((1, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'), (4, b"'"), (5, b" \t\n\v\f\r")):
    _KIND[np.frombuffer(_of, dtype=np.uint8)] = _kind
#: Whether a text may be parted between two kinds (six times the first, plus the second): where a piece of
#: the pre-tokeniser ends whatever stands around.  An apostrophe may begin a contraction, so letters stay with it.
_CUT = np.array([a in (1, 2, 3, 4) and b != 0 and a != b and (a, b) not in ((3, 4), (4, 3), (4, 1)) for a in range(6) for b in range(6)])


class PieceCoder(WordCoder):
    """Ids of texts by a byte-level tokenizer whose pre-tokeniser is the common pattern of contractions,
    letters, digits, others and white space, each with one space before it.

    A text is parted where white space begins after something else, and between runs of letters (ASCII
    and those of two bytes from C3), digits and punctuation: the pattern looks behind nowhere, and ahead only
    inside white space, so the parts' ids are those of the text.  Each different part is encoded once.
    Beside other bytes nothing is parted but at white space, and not after characters that may be white space.
    """

    def __init__(self, path: str, end_id: int):
        super().__init__(path, end_id, False)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]

    def _learn(self, new: list[bytes]) -> None:
        for low in range(0, len(new), 20_000):
            part = new[low : low + 20_000]
            self._add_encoded(part, [w.decode("utf-8", "replace") for w in part])

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = (int(bounds[0]), int(bounds[-1])) if len(texts) else (0, 0)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[first:last]
        bounds = bounds - first
        kind = _KIND[data]
        two = np.flatnonzero(data[:-1] == 0xC3)
        two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]  # signs of multiplication and division
        kind[two] = kind[two + 1] = 1
        starts = np.zeros(len(data), dtype=bool)
        starts[1:] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
        # after other characters only at white space, unless the character before may be white space itself
        after = np.flatnonzero((kind[1:] == 5) & (kind[:-1] == 0) & (data[:-1] >= 0x80)) + 1
        if len(after):
            lead2, lead3 = data[np.maximum(after - 2, 0)], data[np.maximum(after - 3, 0)]
            starts[after[(lead2 != 0xC2) & ((lead3 < 0xE1) | (lead3 > 0xE3))]] = True
        starts[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        for token in self.special:  # the tokenizer looks for these before all else
            for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)):
                at = int(bounds[i])
                while (at := texts[i].as_py().find(token, at - int(bounds[i])) + int(bounds[i])) >= bounds[i]:
                    end = at + len(token)
                    starts[at], starts[at + 1 : end] = True, False
                    if end < bounds[i + 1]:
                        starts[end] = True
                    at = end
        at = np.flatnonzero(starts)
        offsets = np.append(at, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        return words, np.searchsorted(at, bounds[1:])


@lru_cache(maxsize=2)
def piece_coder(path: str, end_id: int) -> PieceCoder:
    """A worker's coder, with what it remembers from earlier tasks."""
    return PieceCoder(path, end_id)


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``(part, doc_id, begin, n, ids)`` below ``out``: ``ids`` are little-endian unsigned 32-bit
    integers with ``end_id`` last, ``begin`` counts the ids before them in the part, one part a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = piece_coder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in text_groups(batch):
                ids, bounds = coder.encode(rows.column(1))
                n, wide = rows.num_rows, ids.astype("<u4")
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(wide)])
                parts = pa.array(np.full(n, part, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([parts, rows.column(0), pa.array(at + bounds[:-1]), pa.array(np.diff(bounds)), data], names=["part", "doc_id", "begin", "n", "ids"])
                at += int(bounds[-1])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("x"))
    kind = base.schema["doc_id"].dataType.simpleString()
    base.mapInArrow(work, f"part int, doc_id {kind}, begin long, n long, ids binary").write.option("compression", "zstd").parquet(out)


def tail_sizes(rest: int) -> list[int]:
    """A last window's ids as falling powers of two."""
    return [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def cut_tokens(stored: DataFrame, length: int = 1024) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` of what ``write_tokens`` wrote.

    ``ids`` are the piece's, as stored; ``start`` is its place in the document, ``offset`` that in its
    sequence.  All sequences hold ``length`` ids but the last ones, which are shorter powers of two.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("the length must be a power of two")
    sizes = stored.groupBy("part").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))  # one row a task of the first pass
    total = stored.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    full, tail, at = total // length, [], total // length * length
    for i, size in enumerate(tail_sizes(total - at)):
        tail.append(F.struct(F.lit(at).cast("long").alias("at"), F.lit(size).cast("long").alias("size"), F.lit(full + i).cast("long").alias("sequence_id")))
        at += size
    placed = stored.join(F.broadcast(offsets), "part").select("doc_id", "ids", "n", (F.col("begin") + F.col("before")).alias("g"))
    first, end = F.floor(F.col("g") / length).cast("long"), F.col("g") + F.col("n")
    last = F.floor((end - 1) / length).cast("long")
    whole = F.struct((F.col("w") * length).alias("at"), F.lit(length).cast("long").alias("size"), F.col("w").alias("sequence_id"))
    inner = placed.where(first < full).select("*", F.explode(F.sequence(first, F.least(last, F.lit(full - 1)))).alias("w")).select("doc_id", "ids", "n", "g", whole.alias("s"))
    if tail:
        outer = placed.where(end > full * length).select("doc_id", "ids", "n", "g", F.explode(F.array(*tail)).alias("s"))
        inner = inner.unionByName(outer.where((F.col("g") < F.col("s.at") + F.col("s.size")) & (F.col("g") + F.col("n") > F.col("s.at"))))
    low = F.greatest(F.col("g"), F.col("s.at"))
    high = F.least(F.col("g") + F.col("n"), F.col("s.at") + F.col("s.size"))
    start, size = low - F.col("g"), high - low
    return inner.select(
        "doc_id", start.alias("start"), size.alias("length"), _bytes(F.col("ids"), start, size).alias("ids"),
        F.col("n").alias("doc_tokens"), F.col("s.sequence_id").alias("sequence_id"), (low - F.col("s.at")).alias("offset"),
    )


def _bytes(ids: Column, start: Column, size: Column) -> Column:
    """The ids [start, start + size) of a packed array."""
    return F.substring(ids, (start * 4 + 1).cast("int"), (size * 4).cast("int"))


def pack_documents(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``cut_tokens`` of all documents, each with ``end_id`` behind it; their ids are written below ``out`` and stay there.

    Documents follow each other as ``docs`` is read.  Null and empty texts have the end id alone;
    null and repeated ids stay as they are; an empty table gives no pieces.
    Other columns of ``docs`` are not read.
    """
    write_tokens(docs, tokenizer_path, out, end_id, id_col, text_col)
    return cut_tokens(docs.sparkSession.read.parquet(out), length)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, tokens, pieces)``: each sequence's ids, packed as in the pieces, and its border records.

    A sequence has at most its length of pieces, so a group is bounded.
    """
    one = F.struct("offset", "doc_id", "start", "length", "ids")
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(one), lambda a, b: (a["offset"] - b["offset"]).cast("int")).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda done, x: F.concat(done, x["ids"]))
    return held.select("sequence_id", "n_tokens", joined.alias("tokens"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))
