"""Corpus-wide line dedup by a deletion-neighbourhood join, DataFrame operations only.

Lines are compared as they stand, by code points.  A line goes if an earlier
line equals it or lies within ``max_edits`` (0 or 1) insertions, deletions or
substitutions of it; the order is (doc_id, text hash, line number), so the
earliest of a group always stays.  Blank lines always stay.

1. Equal lines meet by a 128-bit hash; only hashes and positions are shuffled.
2. Whom can an edit reach?  If two lines are one edit apart and m is the longer
   length, the edited position lies in one segment of 1..m, and all that stands
   before and after that segment is equal.  A line keys its two halves that way,
   as the longer and as the shorter line of a pair; keys are counted, and only
   segments that another line shares go on.  These are cut into ``CUTS`` smaller
   ones, keyed and counted again, until at most ``SEGMENT`` positions are left.
   This loses no pair, and a line gives a few rows a round whatever its length.
3. The positions that remain emit their deletion variants as hashed keys.  A
   substitution at position i leaves equal variants *at that position*, so its
   key carries i; a deletion makes the longer line's variant equal to the shorter
   line, so its key is that of whole lines.  Distinct lines that share a key are
   bounded by the alphabet (times the length), never by the corpus.
4. Each line is joined with the earliest holder of its key only; the edit
   distance of that pair is verified on the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, delete_path, no_reserved_names, scratch_path

#: Line keys up to this many are broadcast (about 24 bytes each); beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
#: Positions of a segment that emits variants; a longer one is cut into so many parts and keyed again.
SEGMENT, CUTS = 8, 16


def _hash(*parts: Column | int | str) -> Column:
    return F.xxhash64(*[F.lit(x) if not isinstance(x, Column) else x for x in parts])


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line that isn't blank, with its place in the order."""
    base = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("x")).where("x is not null")
    rows = base.select("d", F.xxhash64("x").alias("th"), F.posexplode(F.split("x", "\n")).alias("i", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        F.struct("d", "th", "i").alias("at"), "line", _hash(F.col("line")).alias("h1"), _hash(1, F.col("line")).alias("h2"), F.length("line").alias("n")
    )


def _segment_key(m: Column, first: Column, last: Column) -> Column:
    """Hash of all that stands before and after positions first..last of the longer line of a pair, m being its length.

    The line at hand has n = m characters as the longer one, m - 1 as the shorter.
    """
    line, n = F.col("line"), F.col("n")
    return _hash(m, first, last, F.substring(line, F.lit(1), first - 1), F.substring(line, n - m + last + 1, m - last))


def _half_keys() -> list[Column]:
    """Keys of the first and the last half, as the longer line of a pair, then as the shorter."""
    out = []
    for m in (F.col("n"), F.col("n") + 1):
        middle = F.shiftright(m + 1, 1)
        out += [_segment_key(m, F.lit(1), middle), _segment_key(m, middle + 1, m)]
    return out


def _shared(keyed: DataFrame) -> DataFrame:
    """``keyed`` (with ``key`` and ``longer``) where another line has the key: ``same`` one as long, ``less`` one shorter.

    Rows of the shorter line stay where a longer one has the key.
    """
    counts = keyed.groupBy("key").agg(F.count_if("longer").alias("n_long"), F.count_if(~F.col("longer")).alias("n_short"))
    met = keyed.join(counts.where("n_long > 1 or (n_long > 0 and n_short > 0)"), "key")
    same, less = F.col("longer") & (F.col("n_long") > 1), F.col("longer") & (F.col("n_short") > 0)
    return met.withColumn("same", same).withColumn("less", less).where("same or less or (not longer and n_long > 0)").drop("key", "n_long", "n_short")


def _marked(distinct: DataFrame) -> DataFrame:
    """``(h1, halves)``: lines that share a half with another, and the halves ``(p, same, less)``.

    The first hash alone names a line here: a chance collision only marks one line more.
    """
    keyed = distinct.select("h1", F.posexplode("keys").alias("p", "key")).select("key", "h1", F.col("p").cast("tinyint").alias("p"), (F.col("p") < 2).alias("longer"))
    return _shared(keyed).groupBy("h1").agg(F.collect_set(F.struct("p", "same", "less")).alias("halves"))


def _first_segments() -> Column:
    """The marked halves as ``(longer, first, last, same, less)``."""

    def segment(h: Column) -> Column:
        longer = h["p"] < 2
        m = F.col("n") + F.when(longer, 0).otherwise(1)
        middle, early = F.shiftright(m + 1, 1), h["p"] % 2 == 0
        return F.struct(longer.alias("longer"), F.when(early, 1).otherwise(middle + 1).alias("first"), F.when(early, middle).otherwise(m).alias("last"), h["same"].alias("same"), h["less"].alias("less"))

    return F.transform("halves", segment)


def _parts(s: Column) -> Column:
    """A segment cut into smaller ones, each with its key."""
    m = F.col("n") + F.when(s["longer"], 0).otherwise(1)
    step = F.ceil((s["last"] - s["first"] + 1) / CUTS).cast("int")
    end = lambda x: F.least(x + step - 1, s["last"])
    return F.transform(F.sequence(s["first"], s["last"], step), lambda x: F.struct(_segment_key(m, x, end(x)).alias("key"), s["longer"].alias("longer"), x.alias("first"), end(x).alias("last")))


def _refined(texts: DataFrame) -> DataFrame:
    """``(h1, h2, longer, first, last, same, less)``: segments of at most ``SEGMENT`` positions that another line shares."""
    wide = lambda s: s["last"] - s["first"] >= SEGMENT
    whole = lambda df: df.select("h1", "h2", F.inline(F.filter("segs", lambda s: ~wide(s))))
    now, done = texts.select("h1", "h2", "line", "n", _first_segments().alias("segs")), []
    while True:
        done.append(whole(now))
        left = now.select("h1", "h2", F.inline(F.flatten(F.transform(F.filter("segs", wide), _parts))))
        found = cut(_shared(left))
        if found.isEmpty():
            break
        held = found.groupBy("h1", "h2").agg(F.collect_list(F.struct("longer", "first", "last", "same", "less")).alias("segs"))
        now = texts.select("h1", "h2", "line", "n").join(held, ["h1", "h2"])
    return reduce(DataFrame.unionByName, done)


def _variants(lines: DataFrame) -> DataFrame:
    """``(key, kind, at, h1, h2)``: kind 0 is a line itself, 1 a deletion, 2 a deletion with its position."""
    without = lambda i: F.concat(F.substring(F.col("line"), F.lit(1), i - 1), F.substring(F.col("line"), i + 1, F.col("n")))
    tried = lambda flag: F.flatten(F.transform(F.filter("segs", lambda s: s["longer"] & s[flag] & (s["first"] <= s["last"])), lambda s: F.sequence(s["first"], s["last"])))
    short = F.exists("segs", lambda s: ~s["longer"])
    whole = F.when(short, F.array(F.struct(_hash(F.col("n"), 0, F.col("line")).alias("key"), F.lit(0).alias("kind")))).otherwise(F.array())
    deleted = F.transform(tried("less"), lambda i: F.struct(_hash(F.col("n") - 1, 0, without(i)).alias("key"), F.lit(1).alias("kind")))
    placed = F.transform(tried("same"), lambda i: F.struct(_hash(F.col("n"), i, without(i)).alias("key"), F.lit(2).alias("kind")))
    rows = lines.select("at", "h1", "h2", F.explode(F.array_distinct(F.concat(whole, deleted, placed))).alias("v"))
    return rows.select("v.key", "v.kind", "at", "h1", "h2")


def _near(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """``(h1, h2)`` of distinct lines that lie one edit from an earlier line."""
    marked = cut(_marked(distinct))
    small = marked.count() <= BROADCAST_ROWS
    found = lines.join(F.broadcast(marked) if small else marked, "h1")
    texts = cut(found.groupBy("h1", "h2").agg(F.min("at").alias("at"), *[F.first(c).alias(c) for c in ("line", "n", "halves")]))
    segs = _refined(texts).groupBy("h1", "h2").agg(F.collect_list(F.struct("longer", "first", "last", "same", "less")).alias("segs"))
    asked = texts.select("at", "h1", "h2", "line", "n").join(segs, ["h1", "h2"])
    holder = F.struct("at", "h1", "h2")
    key = Window.partitionBy("key")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, holder)).over(key)
    held = _variants(asked).select("at", "h1", "h2", "kind", least(0).alias("w"), least(1).alias("x"), least(2).alias("p"))
    partner = F.when(F.col("kind") == 0, F.col("x")).when(F.col("kind") == 1, F.col("w")).otherwise(F.col("p"))
    pairs = held.select("at", "h1", "h2", partner.alias("e")).where(F.col("e.at") < F.col("at")).select("h1", "h2", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).distinct()
    mine = texts.select("h1", "h2", F.col("line").alias("mine"))
    theirs = texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("line").alias("theirs"))
    return pairs.join(mine, ["h1", "h2"]).join(theirs, ["e1", "e2"]).where(F.levenshtein("mine", "theirs", 1).between(0, 1)).select("h1", "h2").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1) -> DataFrame:
    """``(d, th, gone)``: for a document (id and text hash), its line numbers (from 0) that go."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    lines = _lines(docs, id_col, text_col)
    keys = [x.alias(f"k{i}") for i, x in enumerate(_half_keys())] if max_edits else []
    least = [F.min(f"k{i}").alias(f"k{i}") for i in range(len(keys))]
    distinct = lines.select("at", "h1", "h2", *keys).groupBy("h1", "h2").agg(F.min("at").alias("first"), (F.count("*") > 1).alias("repeated"), *least)
    repeated = lambda df: df.where("repeated").select("h1", "h2", "first", F.lit(False).alias("near"))
    if max_edits:
        held = scratch_path(docs.sparkSession, "lines")
        distinct.select("h1", "h2", "first", "repeated", F.array("k0", "k1", "k2", "k3").alias("keys")).write.option("compression", "zstd").parquet(held)
        distinct = docs.sparkSession.read.parquet(held)
        near = _near(lines, distinct).select("h1", "h2", F.lit(None).alias("first"), F.lit(True).alias("near"))
        both = repeated(distinct).unionByName(near).groupBy("h1", "h2").agg(F.max("first").alias("first"), F.max("near").alias("near"))
        doomed = cut(both)
        delete_path(docs.sparkSession, held)
    else:
        doomed = cut(repeated(distinct))
    small = doomed.count() <= BROADCAST_ROWS
    gone = lines.select("at", "h1", "h2").join(F.broadcast(doomed) if small else doomed, ["h1", "h2"]).where(F.col("near") | (F.col("at") > F.col("first")))
    return gone.groupBy("at.d", "at.th").agg(F.collect_set("at.i").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1) -> DataFrame:
    """``docs`` with the lines that go taken out of the text, plus ``__pw_lines`` and ``__pw_gone``.

    No row is dropped: a document all of whose lines go keeps an empty text.
    A null text stays null with 0 lines; an empty text stays.  Rows that repeat a doc_id
    and text are the same document and get the same result; a null doc_id
    comes first in the order.  ``__pw_lines`` counts the lines of a text (an
    empty one has one), ``__pw_gone`` those taken out.  An empty table stays empty;
    input columns named ``__pw_*`` are refused.
    """
    gone = removed_lines(docs, id_col, text_col, max_edits).select(F.col("d").alias("__pw_d"), F.col("th").alias("__pw_t"), F.col("gone").alias("__pw_list"))
    keyed = no_reserved_names(docs).withColumn("__pw_th", F.xxhash64(text_col))
    joined = keyed.join(gone, F.col(id_col).eqNullSafe(F.col("__pw_d")) & (F.col("__pw_th") == F.col("__pw_t")), "left").drop("__pw_d", "__pw_t", "__pw_th")
    pieces = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("__pw_list"))
    text = F.when(F.col("__pw_list").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), "\n"))
    counts = joined.withColumn("__pw_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(pieces))).withColumn("__pw_gone", F.coalesce(F.size("__pw_list"), F.lit(0)))
    return counts.withColumn(text_col, text).drop("__pw_list")
