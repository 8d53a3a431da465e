"""Acronyms, section hierarchy and cross-references as relations.

Sections are rows ``(doc_id, section_seq, section_number, title, content, ...)``;
``doc_id`` keeps corpora apart and is the partitioning of every ordered step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.acronym_dictionary import COMMON_WORDS, KNOWN
from ..session import settled

#: Pattern, kind of reference; the pattern's place is the order of precedence.
XREF_PATTERNS = (
    (r"see\s+Section\s+(\d+(?:\.\d+)*)", "explicit"),
    (r"(?:described|discussed|shown|defined)\s+in\s+Section\s+(\d+(?:\.\d+)*)", "explicit"),
    (r"Section\s+(\d+(?:\.\d+)*)", "implicit"),
    (r"Chapter\s+(\d+)", "implicit"),
    (r"refer\s+to\s+Section\s+(\d+(?:\.\d+)*)", "see_also"),
)
#: Characters of context on either side of a reference, and how many neighbouring matches can lie in them: none is shorter than "Section 1".
_AROUND, _NEAR = 50, 6
#: A definition before its acronym, and after it.
_FORWARD = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*\(([A-Z]{2,})\)"
_REVERSE = r"\(([A-Z]{2,})\)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


def acronym_dictionary(spark: SparkSession) -> DataFrame:
    """``(acronym, definition)`` of the built-in dictionary."""
    return spark.createDataFrame(list(KNOWN.items()), "acronym string, definition string")


def definition_pairs(text: Column) -> Column:
    """``array<struct<acronym,definition>>``: a text's definitions in order, those before their acronym first."""

    def found(pattern: str, acronym: int, definition: int) -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), group) for group in (acronym, definition)]
        return F.zip_with(*parts, lambda a, d: F.struct(a.alias("acronym"), d.alias("definition")))

    return F.concat(found(_FORWARD, 2, 1), found(_REVERSE, 1, 2))


def _definitions(sections: DataFrame) -> DataFrame:
    """Every definition in the sections, in reading order: forward ones before reverse ones."""

    def found(pattern: str, acronym: int, definition: int, turn: int) -> DataFrame:
        pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), acronym).alias("a"), F.regexp_extract_all("content", F.lit(pattern), definition).alias("d"))
        rows = sections.select("doc_id", "section_seq", F.col("page_start").alias("page"), F.posexplode(pairs).alias("pos", "hit"))
        return rows.select("doc_id", "section_seq", "page", F.lit(turn).alias("turn"), "pos", F.col("hit.a").alias("acronym"), F.col("hit.d").alias("definition"))

    return found(_FORWARD, 2, 1, 0).unionByName(found(_REVERSE, 1, 2, 1))


def define_acronyms(sections: DataFrame) -> DataFrame:
    """``(doc_id, acronym, definition, first_page)``: the dictionary as the sections amend it.

    An acronym takes page and definition of its first definition on a page
    other than 0; while all are on page 0 each one replaces the one before.
    Acronyms of the dictionary that no section defines stay with page 0.
    """
    order = F.struct("section_seq", "turn", "pos")
    hits = _definitions(sections)
    decided = hits.groupBy("doc_id", "acronym").agg(
        F.min_by(F.struct("definition", "page"), F.when(F.col("page") != 0, order)).alias("paged"),
        F.max_by(F.struct("definition", "page"), order).alias("last"),
    )
    best = decided.select("doc_id", "acronym", F.coalesce("paged", "last").alias("b")).select("doc_id", "acronym", F.col("b.definition").alias("found"), F.col("b.page").alias("page"))
    known = sections.select("doc_id").distinct().crossJoin(F.broadcast(acronym_dictionary(sections.sparkSession)))  # 115 rows a document
    joined = known.join(best, ["doc_id", "acronym"], "full_outer")
    return joined.select("doc_id", "acronym", F.coalesce("found", "definition").alias("definition"), F.coalesce("page", F.lit(0)).alias("first_page"))


def acronym_counts(texts: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """``known`` (with column ``acronym``) and the frequency of each in all texts, common words left out."""
    hits = texts.select(F.explode(T.acronyms(F.col(text_col))).alias("acronym")).groupBy("acronym").agg(F.count("*").alias("frequency"))
    kept = known.where(~F.col("acronym").isin(*COMMON_WORDS))
    return kept.join(hits, "acronym", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))


def drop_common_words(acronyms: DataFrame) -> DataFrame:
    return acronyms.where(~F.col("acronym").isin(*COMMON_WORDS))


def top_acronyms(counted: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent, ties by name."""
    return counted.orderBy(F.desc("frequency"), "acronym").limit(n)


def expand_acronyms(text, pairs):
    """Column: for each ``(acronym, definition)`` of the array, in order, its first occurrence becomes ``definition (acronym)``.

    One pass over the text finds its acronyms; only pairs of these go on to the ordered fold, and
    those that it can't tell of: acronyms that a definition brings in, or not made of capitals alone.
    """

    def put(done, pair):
        at = F.regexp_instr(done, F.concat(F.lit(r"\b\Q"), pair["acronym"], F.lit(r"\E\b")))
        whole = F.concat(pair["definition"], F.lit(" ("), pair["acronym"], F.lit(")"))
        return F.when(at > 0, F.overlay(done, whole, at, F.length(pair["acronym"]))).otherwise(done)

    brought = F.flatten(F.transform(pairs, lambda p: T.acronyms(p["definition"])))
    named = F.array_distinct(F.concat(T.acronyms(text), brought))
    kept = lambda names: F.filter(pairs, lambda p: F.array_contains(names, p["acronym"]) | ~p["acronym"].rlike("^[A-Z]{2,}$"))
    return F.aggregate(F.transform(F.array(named), kept)[0], text, put)


def hierarchy(sections: DataFrame) -> DataFrame:
    """``(doc_id, section_number, title, level, parent, children)``, one row a number.

    The last section of a number decides its title, level and parent; children
    are numbers in section order, repeats kept.
    """
    last = sections.groupBy("doc_id", "section_number").agg(F.max_by(F.struct("title", "level", F.col("parent_section").alias("parent")), "section_seq").alias("s"))
    below = sections.where("parent_section is not null").groupBy("doc_id", F.col("parent_section").alias("section_number")).agg(F.array_sort(F.collect_list(F.struct("section_seq", F.col("section_number").alias("n")))).getField("n").alias("children"))
    joined = last.join(below, ["doc_id", "section_number"], "left")
    return joined.select("doc_id", "section_number", "s.title", "s.level", "s.parent", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def section_paths(nodes: DataFrame) -> DataFrame:
    """``(doc_id, section_number, path)``: numbers from the top to the section, at any depth.

    The walk over parents ends at the first that has no row of its own, which is still part of
    the path.  Every round puts before each path that of its first section's parent, so known paths double
    in length: one equi-join a round, as many as the depth has bits.  Parents that lead in a circle are an error.
    """
    walk = settled(nodes.select("doc_id", "section_number", F.array("section_number").alias("path"), F.col("parent").alias("next")))
    most, rounds = walk.count(), 0
    while walk.where("next is not null").limit(1).count():
        if 1 << rounds > 2 * most:
            raise ValueError("sections that are their own ancestors")
        up = walk.select("doc_id", F.col("section_number").alias("next"), F.col("path").alias("before"), F.col("next").alias("above"))
        met = walk.join(up, ["doc_id", "next"], "left")
        longer = F.when(F.col("next").isNotNull(), F.concat(F.coalesce("before", F.array("next")), F.col("path"))).otherwise(F.col("path"))
        walk = settled(met.select("doc_id", "section_number", longer.alias("path"), F.col("above").alias("next")))
        rounds += 1
    return walk.select("doc_id", "section_number", "path")


def section_paths_by_number(nodes: DataFrame) -> DataFrame:
    """The same paths where parents are the numbers' own prefixes: no walk, one join on exploded ancestors."""
    parts = F.split("section_number", r"\.")
    depth = F.size(parts)
    ancestors = F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    rows = nodes.select("doc_id", "section_number", F.posexplode(ancestors).alias("k", "a"))
    there = nodes.select("doc_id", F.col("section_number").alias("a"), F.lit(True).alias("there")).distinct()
    met = rows.join(there, ["doc_id", "a"], "left")
    # the path begins at the nearest missing ancestor, if there is one
    first = F.coalesce(F.max(F.when(F.col("there").isNull(), F.col("k"))).over(Window.partitionBy("doc_id", "section_number")), F.lit(0))
    kept = met.withColumn("first", first).where("k >= first")
    return kept.groupBy("doc_id", "section_number").agg(F.array_sort(F.collect_list(F.struct("k", "a"))).getField("a").alias("path"))


def section_context(nodes: DataFrame) -> DataFrame:
    """``(doc_id, section_number, parent_titles, siblings, breadcrumb)``.

    Titles of the path's sections that exist, top first; siblings are the
    parent's children without the section itself.
    """
    steps = section_paths_by_number(nodes).select("doc_id", "section_number", F.posexplode("path").alias("k", "at"))
    titles = nodes.select("doc_id", F.col("section_number").alias("at"), F.col("title").alias("step"))
    named = steps.join(titles, ["doc_id", "at"])
    crumbs = named.groupBy("doc_id", "section_number").agg(F.array_sort(F.collect_list(F.struct("k", "at", "step"))).alias("s"))
    above = F.transform(F.filter("s", lambda x: x["at"] != F.col("section_number")), lambda x: x["step"])
    kin = nodes.select("doc_id", F.col("section_number").alias("parent"), "children")
    base = nodes.select("doc_id", "section_number", "parent").join(kin, ["doc_id", "parent"], "left")
    joined = base.join(crumbs, ["doc_id", "section_number"])
    siblings = F.coalesce(F.filter("children", lambda x: x != F.col("section_number")), F.array().cast("array<string>"))
    return joined.select("doc_id", "section_number", above.alias("parent_titles"), siblings.alias("siblings"), F.array_join(F.transform("s", lambda x: x["step"]), " > ").alias("breadcrumb"))


def cross_references(sections: DataFrame) -> DataFrame:
    """``(doc_id, section_seq, source, target, kind, pattern, pos, context)``: every match of every pattern.

    ``context`` is the text up to 50 characters around the match, trimmed.
    A match sees only the ends of the pieces next to it, so the work grows with
    the text, also where one section holds all references of a document.
    """
    body = sections.select("doc_id", "section_seq", F.col("section_number").alias("source"), F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("title", F.lit(""))).alias("body"))
    found = None
    for place, (pattern, kind) in enumerate(XREF_PATTERNS):
        rows = body.select("doc_id", "section_seq", "source", F.posexplode(_matches(F.col("body"), f"(?i){pattern}")).alias("pos", "hit")).select(
            "doc_id", "section_seq", "source", F.col("hit.target").alias("target"), F.lit(kind).alias("kind"), F.lit(place).alias("pattern"), "pos", F.col("hit.context").alias("context"),
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def _matches(text: Column, pattern: str) -> Column:
    """``array<struct<target,context>>``: the matches of ``pattern`` in order, each with the text around it.

    The text is cut at its matches once.  These are bound as a lambda's argument, else each match would find them again.
    """
    pieces = F.split(text, pattern)  # one more than matches
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), 0).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), 1).alias("target"),
        F.transform(pieces, lambda p: F.left(p, F.lit(_AROUND))).alias("begin"),
        F.transform(pieces, lambda p: F.right(p, F.lit(_AROUND))).alias("end"),
    )

    def told(x: Column, i: Column) -> Column:
        before = [part for k in range(_NEAR, 0, -1) for part in (F.get(x["end"], i - k), F.get(x["whole"], i - k))]
        after = [part for k in range(1, _NEAR + 1) for part in (F.get(x["begin"], i + k), F.get(x["whole"], i + k))]
        before, after = F.concat_ws("", *before, F.get(x["end"], i)), F.concat_ws("", *after)
        context = F.concat(F.right(before, F.lit(_AROUND)), F.get(x["whole"], i), F.left(after, F.lit(_AROUND)))
        return F.struct(F.get(x["target"], i).alias("target"), T.strip(context).alias("context"))

    return F.transform(F.array(parts), lambda x: F.transform(x["whole"], lambda _, i: told(x, i)))[0]


def dedup_references(refs: DataFrame) -> DataFrame:
    """The first of each (source, target, kind) in the order section, pattern, place."""
    order = Window.partitionBy("doc_id", "source", "target", "kind").orderBy("section_seq", "pattern", "pos")
    return refs.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def references_by_section(refs: DataFrame) -> DataFrame:
    """``(doc_id, section_number, outgoing, incoming, total_outgoing, total_incoming)``; sets sorted."""
    out = refs.groupBy("doc_id", F.col("source").alias("section_number")).agg(F.array_sort(F.collect_set("target")).alias("outgoing"), F.count("*").alias("total_outgoing"))
    into = refs.groupBy("doc_id", F.col("target").alias("section_number")).agg(F.array_sort(F.collect_set("source")).alias("incoming"), F.count("*").alias("total_incoming"))
    none = F.array().cast("array<string>")
    return out.join(into, ["doc_id", "section_number"], "full_outer").select(
        "doc_id", "section_number", F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming"),
        F.coalesce("total_outgoing", F.lit(0)).alias("total_outgoing"), F.coalesce("total_incoming", F.lit(0)).alias("total_incoming"),
    )


def all_metadata(sections: DataFrame, tables: DataFrame, diagrams: DataFrame) -> dict[str, DataFrame]:
    """Acronyms, hierarchy and references of the sections, with the counts of all parts."""
    counts = [df.groupBy("doc_id").agg(F.count("*").alias(name)) for df, name in ((sections, "n_sections"), (tables, "n_tables"), (diagrams, "n_diagrams"))]
    summary = counts[0]
    for other in counts[1:]:
        summary = summary.join(other, "doc_id", "full_outer")
    return {
        "summary": summary.na.fill(0),
        "acronyms": drop_common_words(define_acronyms(sections)),
        "hierarchy": hierarchy(sections),
        "cross_references": dedup_references(cross_references(sections)),
    }
