"""Hybrid retrieval for a whole set of questions at once.

Hits are rows ``(query_id, doc_id, chunk_id, chunk_seq, score, pos, ...)``; ``pos``
is the place in its list, from 0, and decides ties, so no order is left to chance.
Chunks carry ``doc_id``, ``chunk_seq``, ``section_number``, ``content``; chunk ids and
section numbers name something within their document only.  Where no input carries
``doc_id``, all are of one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V
from ..session import settled
from . import vectors as S


#: The columns of a hit.
HIT = ["query_id", "doc_id", "chunk_id", "chunk_seq", "score", "pos"]


@dataclass(frozen=True)
class Retrieval:
    """Options of a retrieval; the defaults are those of the reference behaviour."""

    top_k: int = 5
    rerank_top_k: int = 15
    strategy: str = "hybrid"
    multi_hop: bool = True
    max_hops: int = 2
    parents: bool = True
    rerank: bool = True


def of_document(df: DataFrame) -> DataFrame:
    """``df`` with a ``doc_id``; without one its rows are of one document, 0."""
    return df if "doc_id" in df.columns else df.withColumn("doc_id", F.lit(0).cast("long"))


def _places(hits: DataFrame, *order: Column) -> DataFrame:
    return hits.withColumn("pos", (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).cast("long"))


def boost_factor(query: Column, section_number: Column, content: Column) -> Column:
    """1, plus 0.3 for each number in the question that the section number begins with, plus 0.2 for each acronym in the content."""
    return _factor(T.section_mentions(query), T.acronyms(query), section_number, content)


def _factor(mentions: Column, acronyms: Column, section_number: Column, content: Column) -> Column:
    sections = F.size(F.filter(mentions, lambda s: F.startswith(section_number, s)))
    names = F.size(F.filter(acronyms, lambda a: F.contains(content, a)))
    return F.lit(1.0) + 0.3 * sections + 0.2 * names


def keyword_boost(hits: DataFrame) -> DataFrame:
    """Hits with ``query, section_number, content``: scores times 0.7 + 0.3 x boost, sorted anew."""
    return _boosted(hits, boost_factor(F.col("query"), F.col("section_number"), F.col("content")))


def _boosted(hits: DataFrame, factor: Column) -> DataFrame:
    return _places(hits.withColumn("score", F.col("score") * (0.7 + 0.3 * factor)), F.desc("score"), F.col("pos"))


#: What names a chunk, and a section, among all documents.
CHUNK, SECTION = ["doc_id", "chunk_id"], ["doc_id", "section_number"]
#: Of all pairs of questions and chunks: the questions, or chunks, in a part; pairs that are worth a task.
PART_ROWS, TASK_PAIRS = 1_024, 1 << 22


def keyword_postings(chunks: DataFrame, longest: int) -> DataFrame:
    """``(kind, term, *CHUNK, chunk_seq)``: what a question can name a chunk by, each once.

    section: everything that the section's number begins with; acronym: every stretch of 2 to
    ``longest`` capitals in the content.
    """
    def stretches(run: Column, at: Column) -> Column:
        sizes = F.sequence(F.lit(2), F.least(F.lit(longest), F.length(run) - at + 1))
        return F.transform(sizes, lambda size: F.substring(run, at, size))

    rows = of_document(chunks).select(*CHUNK, "chunk_seq", "section_number", "content")
    prefixes = F.transform(F.sequence(F.lit(1), F.length("section_number")), lambda n: F.substring(F.col("section_number"), F.lit(1), n))
    section = rows.where(F.length("section_number") > 0).select(F.lit("section").alias("kind"), F.explode(prefixes).alias("term"), *CHUNK, "chunk_seq")
    runs = F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Z]{2,})"), 1))
    capitals = F.array_distinct(F.flatten(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda at: stretches(r, at))))))
    acronym = rows.select(F.lit("acronym").alias("kind"), F.explode(capitals).alias("term"), *CHUNK, "chunk_seq")
    return section.unionByName(acronym)


def boosted_pairs(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, *CHUNK, chunk_seq, factor)`` of all questions and chunks with a factor over 1, that of ``boost_factor``.

    Terms that questions name meet the chunks' postings by equality, so only pairs that share one arise.
    """
    named = lambda kind, terms: questions.select("query_id", F.lit(kind).alias("kind"), F.explode(terms).alias("term"))
    mentions = named("section", T.section_mentions(F.col("query"))).unionByName(named("acronym", T.acronyms(F.col("query"))))
    asked = settled(mentions.groupBy("query_id", "kind", "term").agg(F.count("*").alias("n")))
    longest = asked.where("kind = 'acronym'").agg(F.max(F.length("term"))).first()[0] or 2
    terms = asked.select("kind", "term").distinct()
    held = keyword_postings(chunks, longest).join(terms, ["kind", "term"], "left_semi")
    met = asked.join(held, ["kind", "term"]).groupBy("query_id", *CHUNK, "chunk_seq")
    counts = met.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind) for kind in ("section", "acronym")])
    return counts.select("query_id", *CHUNK, "chunk_seq", (F.lit(1.0) + 0.3 * F.col("section") + 0.2 * F.col("acronym")).alias("factor"))


def boosted_all(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, *CHUNK, chunk_seq, factor)`` of all pairs of questions and chunks: as many rows as there are pairs.

    Terms are found once a question, runs of capitals once a chunk.  A question without terms has the factor 1 with all
    chunks, so its pairs need no look at either; those of the others are looked at one by one.
    """
    asked = questions.select("query_id", T.section_mentions(F.col("query")).alias("mentions"), T.acronyms(F.col("query")).alias("names"))
    runs = F.array_join(F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Z]{2,})"), 1)), " ")  # an acronym in the content lies in one of them
    held = settled(of_document(chunks).select(*CHUNK, "chunk_seq", "section_number", runs.alias("runs")))
    bare = F.coalesce((F.size("mentions") == 0) & (F.size("names") == 0), F.lit(False))
    all_asked, all_bare = asked.agg(F.count("*"), F.count_if(bare)).first()
    n = held.count()
    columns = ["query_id", *CHUNK, "chunk_seq"]
    plain = _paired(asked.where(bare).select("query_id"), all_bare, held.select(*CHUNK, "chunk_seq"), n).select(*columns, F.lit(1.0).alias("factor"))
    named = _paired(asked.where(~bare), all_asked - all_bare, held, n)
    return plain.unionByName(named.select(*columns, _factor(F.col("mentions"), F.col("names"), F.col("section_number"), F.col("runs")).alias("factor")))


def _paired(asked: DataFrame, n_asked: int, held: DataFrame, n_held: int) -> DataFrame:
    """All pairs of ``asked (query_id, …)`` and ``held (*CHUNK, …)``: parts of both meet in the cells of a grid, some cells a task."""
    rows, columns = (-(-max(n, 1) // PART_ROWS) for n in (n_asked, n_held))
    tasks = -(-max(n_asked * n_held, 1) // TASK_PAIRS)

    def dealt(df: DataFrame, parts: int, keys: list[str], others: int, cell: Column) -> DataFrame:
        split = df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts))).repartition(parts, "part")
        return split.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("cell", cell).drop("part", "other").repartition(tasks, "cell")

    left = dealt(held, columns, CHUNK, rows, F.col("other") * columns + F.col("part"))
    right = dealt(asked, rows, ["query_id"], columns, F.col("part") * columns + F.col("other"))
    return left.join(right.hint("merge"), "cell").drop("cell")


def hop_sections(seeds: DataFrame, edges: DataFrame, max_hops: int = 2, also_visited: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, section_number, depth)`` reached over ``edges (doc_id, source, target)`` from ``seeds (query_id, doc_id, section_number)``.

    Breadth first, each section at its least depth, seeds and ``also_visited``
    left out; one equi-join and one anti-join a hop, none once a hop reaches nothing new.
    """
    edges = of_document(edges)
    frontier, found = of_document(seeds).select("query_id", *SECTION).distinct(), None
    visited = frontier if also_visited is None else frontier.unionByName(of_document(also_visited).select("query_id", *SECTION)).distinct()
    links = edges.select("doc_id", F.col("source").alias("section_number"), F.col("target").alias("to")).distinct()
    for depth in range(max_hops):
        reached = frontier.join(links, SECTION).select("query_id", "doc_id", F.col("to").alias("section_number")).distinct()
        frontier = settled(reached.join(visited, ["query_id", *SECTION], "left_anti"))
        if found is not None and not frontier.limit(1).count():
            break
        layer = frontier.withColumn("depth", F.lit(depth))
        found = layer if found is None else found.unionByName(layer)
        visited = visited.unionByName(frontier)
    return found


def hop_hits(seeds: DataFrame, edges: DataFrame, chunks: DataFrame, max_hops: int = 2, also_visited: DataFrame | None = None) -> DataFrame:
    """All chunks of the sections that references lead to, at 0.5 x 0.7^(depth + 1)."""
    hops = hop_sections(seeds, edges, max_hops, also_visited)
    met = hops.join(of_document(chunks).select(*CHUNK, "chunk_seq", "section_number"), SECTION)
    scored = met.withColumn("score", 0.5 * F.pow(F.lit(0.7), F.col("depth") + 1))
    return _places(scored, F.col("depth"), F.col("doc_id"), F.col("chunk_seq")).select(*HIT)


def parent_targets(hits: DataFrame) -> DataFrame:
    """``(query_id, doc_id, parent, score, turn)``: parents to fetch for ranked hits ``(query_id, doc_id, pos, section_number, score)``.

    One set of seen sections goes along the ranks: a section seen before, or
    without a parent, or whose parent was seen, fetches nothing; a fetched
    parent counts as seen.  An ordered fold over a question's few hits.
    """
    place = lambda number: F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(number, F.lit("")).alias("number"))
    one = F.struct("pos", place(F.col("section_number")).alias("own"), place(T.parent_number(F.col("section_number"))).alias("parent"), "score")
    lists = of_document(hits).groupBy("query_id").agg(F.array_sort(F.collect_list(one), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("h"))
    kind = "struct<doc_id:bigint,number:string>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("seen"), F.array().cast(f"array<struct<parent:{kind},score:double>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        known = F.array_contains(state["seen"], x["own"])
        with_own = F.when(known, state["seen"]).otherwise(F.concat(state["seen"], F.array(x["own"])))
        fetch = ~known & (x["parent"]["number"] != "") & ~F.array_contains(with_own, x["parent"])
        more = F.array(F.struct(x["parent"].alias("parent"), (x["score"] * 0.6).alias("score")))
        return F.struct(F.when(fetch, F.concat(with_own, F.array(x["parent"]))).otherwise(with_own).alias("seen"), F.when(fetch, F.concat(state["out"], more)).otherwise(state["out"]).alias("out"))

    fetched = lists.select("query_id", F.posexplode(F.aggregate("h", start, step, lambda s: s["out"])).alias("turn", "t"))
    return fetched.select("query_id", "t.parent.doc_id", F.col("t.parent.number").alias("parent"), F.col("t.score").alias("score"), "turn")


def parent_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    targets = parent_targets(hits).withColumnRenamed("parent", "section_number")
    met = targets.join(of_document(chunks).select(*CHUNK, "chunk_seq", "section_number"), SECTION)
    return _places(met, F.col("turn"), F.col("chunk_seq")).select(*HIT)


def fuse(*lists: DataFrame) -> DataFrame:
    """``(query_id, doc_id, chunk_id, chunk_seq, score, pos)``: each chunk once with its best score.

    Sorted by score; equals stand in the order of their first appearance in the lists.
    """
    rows = None
    for stage, hits in enumerate(lists):
        part = of_document(hits).select("query_id", *CHUNK, "chunk_seq", "score", F.struct(F.lit(stage).alias("stage"), "pos").alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("query_id", *CHUNK).agg(F.max("score").alias("score"), F.min("at").alias("first"), F.min("chunk_seq").alias("chunk_seq"))
    return _places(best, F.desc("score"), F.col("first")).select(*HIT)


def _asked_signals(query: Column) -> dict[str, Column]:
    """What ``_signals_met`` takes of a question."""
    q = F.lower(query)
    return {"q": q, "q_what": F.contains(q, F.lit("what are")), "q_shows": F.contains(q, F.lit("show")) | F.contains(q, F.lit("look like"))}


def _held_signals(content: Column, title: Column, chunk_type: Column) -> dict[str, Column]:
    """What ``_signals_met`` takes of a chunk; a caption's words of tables only."""
    caption = F.regexp_extract(T.strip(content), r"^\*\*([^*]+)\*\*", 1)
    return {"c": F.lower(content), "c_title": F.lower(title), "c_words": F.when(chunk_type == "table", T.words(caption)), "c_type": chunk_type}


def _signals_met(x: dict[str, Column]) -> Column:
    asked, named, table = T.words_of_lower(x["q"]), x["c_words"], x["c_type"] == "table"  # looked at with tables only
    overlap = F.when(table & (F.size(asked) > 0) & (F.size(named) > 0), F.size(F.array_intersect(named, asked)) / F.size(asked)).otherwise(0.0)
    return (
        F.when(F.contains(x["c"], x["q"]), 1.2).otherwise(1.0)
        * F.when(F.contains(x["c_title"], x["q"]), 1.15).otherwise(1.0)
        * F.when(overlap >= 0.35, 1.0 + overlap * 0.6).otherwise(1.0)
        * F.when(table & x["q_what"], 1.1).otherwise(1.0)
        * F.when((x["c_type"] == "diagram_ref") & x["q_shows"], 1.15).otherwise(1.0)
    )


def rerank_factor(query: Column, content: Column, title: Column, chunk_type: Column) -> Column:
    """Product of the keyword signals of a hit."""
    return _signals_met(_asked_signals(query) | _held_signals(content, title, chunk_type))


def rerank(hits: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits by (0.7 x cosine of question and raw content + 0.3 x score) x keyword factor.

    ``chunks.content_vec`` is the vector of the content alone, stored beside the context vector.
    Lengths of vectors and lower-cased texts are worked out once a question and once a chunk, not once a hit.
    """
    named = lambda columns: [c.alias(n) for n, c in columns.items()]
    told, held = _asked_signals(F.col("query")), _held_signals(F.col("content"), F.col("section_title"), F.col("chunk_type"))
    asked = questions.select("query_id", "query_vec", V.norm(F.col("query_vec")).alias("q_norm"), *named(told))
    known = of_document(chunks).select(*CHUNK, "content_vec", V.norm(F.col("content_vec")).alias("c_norm"), *named(held))
    met = of_document(hits).select(*HIT).join(asked, "query_id").join(known, CHUNK)
    similar = V.cosine(F.col("query_vec"), F.col("content_vec"), F.col("q_norm") * F.col("c_norm"))
    score = (0.7 * similar + 0.3 * F.col("score")) * _signals_met({n: F.col(n) for n in (*told, *held)})
    return _places(met.withColumn("score", score), F.desc("score"), F.col("pos")).select(*HIT)


def primary_hits(questions: DataFrame, chunks: DataFrame, options: Retrieval = Retrieval()) -> DataFrame:
    """The best chunks of each question by vector, in the hybrid strategy boosted by its section numbers and acronyms.

    Ties go to the smaller document, then chunk.
    """
    k, chunks = options.rerank_top_k if options.rerank else options.top_k, of_document(chunks)
    keyed = chunks.withColumn("key", F.struct("doc_id", "chunk_seq"))
    first = S.knn(keyed, questions, k, key="key", vector="context_vec").select("query_id", "key.*", "score", (F.col("rank") - 1).cast("long").alias("pos"))
    described = chunks.select(*CHUNK, "chunk_seq", "section_number", "content", "chunk_type")
    primary = first.join(described, ["doc_id", "chunk_seq"])
    if options.strategy != "hybrid":
        return primary.join(questions.select("query_id", "query"), "query_id")
    named = questions.select("query_id", "query", T.section_mentions(F.col("query")).alias("mentions"), T.acronyms(F.col("query")).alias("names"))  # once a question, not once a hit
    return _boosted(primary.join(named, "query_id"), _factor(F.col("mentions"), F.col("names"), F.col("section_number"), F.col("content"))).drop("mentions", "names")


def retrieve(questions: DataFrame, chunks: DataFrame, edges: DataFrame, options: Retrieval = Retrieval()) -> DataFrame:
    """``(query_id, pos, stage, doc_id, chunk_id, chunk_seq, score)``; stage is primary, xref, parent or final.

    ``questions (query_id, query, query_vec)``, ``chunks`` with ``context_vec`` and
    ``content_vec``, ``edges (doc_id, source, target)`` from text chunks' references.
    Hops and parents stay in the document of the hit that they start from.
    """
    # k rows a question, read by every later stage: without the texts of question and chunk, which none of them needs
    primary = settled(primary_hits(questions, chunks, options).select(*HIT, "section_number", "chunk_type"))
    lists, stages = [primary], ["primary"]
    if options.multi_hop:
        lists.append(hop_hits(primary.where("chunk_type = 'text'"), edges, chunks, options.max_hops, also_visited=primary))
        stages.append("xref")
    if options.parents:
        lists.append(parent_hits(primary, chunks))
        stages.append("parent")
    final = fuse(*lists)
    if options.rerank:
        final = rerank(final, questions, chunks)
    columns = HIT
    out = final.where(F.col("pos") < options.top_k).select(*columns, F.lit("final").alias("stage"))
    for hits, stage in zip(lists, stages, strict=True):
        out = out.unionByName(hits.select(*columns, F.lit(stage).alias("stage")))
    return out


def context_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, context, n_context)``: the final hits as one numbered text for an answer generator."""
    met = of_document(hits).join(of_document(chunks).drop("chunk_seq"), CHUNK)
    pages = F.concat(F.col("page_start").cast("string"), F.when(F.col("page_end") != F.col("page_start"), F.concat(F.lit("-"), "page_end")).otherwise(""))
    block = F.concat(
        F.lit("[Context "), F.col("pos") + 1, F.lit("]\nSection: "), "section_number", F.lit(" - "), "section_title", F.lit("\nPage: "), pages, F.lit("\nType: "), "chunk_type",
        F.lit("\nRelevance Score: "), F.format_string("%.3f", "score"), F.lit("\n\n"), "content", F.lit("\n" + "=" * 80 + "\n"),
    )
    return met.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).getField("b"), "\n").alias("context"), F.count("*").alias("n_context"))
