"""Mixing sources to target weights by repetition rates.

Tokens are summed by source, each source gets a target, and a document of a
source with rate r = target / size is taken floor(r) times plus one more time
with probability r - floor(r), decided by a hash of its id.  Everything stays
in the JVM; per-source figures are partial aggregates (a hot source costs no
more than others) and one row a source is all that is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import no_reserved_names

#: Source tables up to this many rows are broadcast; beyond it the join is shuffled.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows, one a source.

    Sources in code-point order, null last, take the weights in turn and share
    the whole size by them.  A share above ``cap`` times its source's size
    stops there, and the excess is shared by weight among the others until
    none is above.  That ends at ``min(cap * size, level * weight)`` for one
    level, which is read off prefix sums over the sources ordered by cap /
    weight (one row a source).
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("long")
    weighed = totals.withColumn("w", weight).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = weighed.withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    total = F.sum("source_size").over(everything)
    level = (total - F.col("capped")).cast("double") / F.col("rest")
    stepped = filled.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("most"))
    settled = stepped.withColumn("at", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    target = F.least(F.col("most").cast("double"), F.col("at") * F.col("w"))
    return settled.select("source", "source_size", F.coalesce(target, F.col("most").cast("double")).alias("target"))


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone, for a null id on the text."""
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), unnamed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = SEED) -> DataFrame:
    """``docs`` with ``__pw_size``, ``__pw_source_size``, ``__pw_target``, ``__pw_copies``.

    Null and empty texts have size 0 and a rate like the rest of their source;
    a source of size 0 has rate 0.  Rows that repeat an id are decided alike, and
    of rows without an id those that repeat a text.
    A null source is a source of its own.  An empty table stays empty.  Columns named ``__pw_*`` are refused.
    """
    sized = no_reserved_names(docs).withColumn("__pw_size", word_count(F.col(text_col)))
    table = source_targets(sized.select(F.col(source_col).alias("source"), F.col("__pw_size").alias("size")), weights, cap)
    table = table.select(F.col("source").alias("__pw_source"), F.col("source_size").alias("__pw_source_size"), F.col("target").alias("__pw_target"))
    sources = docs.select(F.approx_count_distinct(source_col)).first()[0]
    joined = sized.join(F.broadcast(table) if sources <= BROADCAST_SOURCES else table, F.col(source_col).eqNullSafe(F.col("__pw_source"))).drop("__pw_source")
    rate = F.when(F.col("__pw_source_size") > 0, F.col("__pw_target") / F.col("__pw_source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(uniform(F.col(id_col), F.col(text_col), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("__pw_copies", copies.cast("long"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken, with its own columns."""
    taken = mix(docs, **options).where("__pw_copies > 0")
    repeated = taken.withColumn("__pw_copy", F.explode(F.sequence(F.lit(1), F.col("__pw_copies").cast("int"))))
    return repeated.select(*docs.columns)
