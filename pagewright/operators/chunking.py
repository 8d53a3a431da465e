"""Chunks of sections, tables and diagrams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .structure import confident_rows, table_markdown, table_summary

#: Tables or diagrams of one section that a task takes, about.
SECTION_ROWS = 50_000
_PIECE = "array<struct<content:string,tokens:int>>"


@dataclass(frozen=True)
class ChunkSizes:
    """Tokens of a chunk, of its overlap, and the least that a last piece must have."""

    size: int = 800
    overlap: int = 150
    least: int = 200


def split_text(text: Column, sizes: ChunkSizes = ChunkSizes(), separator: str = "\n\n", keep_tail: bool = False) -> Column:
    """``array<struct<content, tokens>>``: paragraphs packed greedily, each chunk beginning with the last one's tail.

    A chunk closes when the next paragraph would make it too large; a paragraph
    is never cut.  A last piece below the least size is lost unless ``keep_tail``.
    """
    start = F.struct(F.array().cast(_PIECE).alias("done"), F.lit("").alias("cur"))

    def piece(cur: Column) -> Column:
        return F.array(F.struct(T.strip(cur).alias("content"), T.token_count(cur).alias("tokens")))

    def step(state: Column, para: Column) -> Column:
        cur = state["cur"]
        full = (T.token_count(cur) + T.token_count(para) > sizes.size) & (cur != "")
        grown = F.when(cur == "", para).otherwise(F.concat(cur, F.lit(separator), para))
        carried = F.concat(T.overlap_tail(cur, sizes.overlap), F.lit(separator), para)
        return F.struct(F.when(full, F.concat(state["done"], piece(cur))).otherwise(state["done"]).alias("done"), F.when(full, carried).otherwise(grown).alias("cur"))

    def finish(state: Column) -> Column:
        kept = (state["cur"] != "") & ((T.token_count(state["cur"]) >= sizes.least) | F.lit(keep_tail))
        return F.when(kept, F.concat(state["done"], piece(state["cur"]))).otherwise(state["done"])

    return F.aggregate(F.split(text, separator), start, step, finish)


def _acronym_maps(chunks: DataFrame, acronyms: DataFrame, text_col: str) -> DataFrame:
    """``chunks`` with ``acronyms``: map of the known acronyms in the text to their definitions, null if none."""
    key = ["doc_id", "kind_ord", "kind_seq", "local_seq"]
    seen = chunks.select(*key, F.explode(F.array_distinct(T.acronyms(F.col(text_col)))).alias("acronym"))
    known = seen.join(acronyms.select("doc_id", "acronym", "definition"), ["doc_id", "acronym"])
    maps = known.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("acronym", "definition")))).alias("acronyms"))
    return chunks.join(maps, key, "left")


def chunk_sections(sections: DataFrame, nodes: DataFrame, paths: DataFrame, refs: DataFrame, sizes: ChunkSizes = ChunkSizes(), separator: str = "\n\n") -> DataFrame:
    """Text chunks of sections with content, under their title.

    ``nodes``, ``paths``, ``refs`` are hierarchy, section paths and references by section.
    """
    titles = nodes.select("doc_id", F.col("section_number").alias("parent_section"), F.col("title").alias("parent_title"))
    info = nodes.select("doc_id", "section_number", F.col("parent").alias("node_parent")).join(paths, ["doc_id", "section_number"])
    full = F.concat(F.lit("# "), F.col("title"), F.lit(separator), F.col("content"))
    base = sections.where(F.length(T.strip(F.col("content"))) > 0).drop("parent_section").join(info, ["doc_id", "section_number"], "left").withColumnRenamed("node_parent", "parent_section")
    base = base.withColumn("full", full).withColumn("total", T.token_count(F.col("full")))
    whole = F.array(F.struct(F.col("full").alias("content"), F.col("total").alias("tokens")))
    pieces = F.when(F.col("total") <= sizes.size, whole).otherwise(split_text(F.col("full"), sizes, separator))
    rows = base.withColumn("split", F.col("total") > sizes.size).select("*", F.posexplode(pieces).alias("local_seq", "piece"))
    rows = rows.join(titles, ["doc_id", "parent_section"], "left").join(refs.select("doc_id", "section_number", "outgoing", "incoming"), ["doc_id", "section_number"], "left")
    none = F.array().cast("array<string>")
    meta = F.struct(
        F.coalesce("parent_title", F.lit("")).alias("parent_title"),
        F.when(F.col("split"), F.col("local_seq")).alias("chunk_index"),
        F.when(F.col("split"), F.col("local_seq") > 0).alias("is_continuation"),
        F.struct(F.coalesce("outgoing", none).alias("outgoing"), F.coalesce("incoming", none).alias("incoming")).alias("cross_references"),
    )
    return rows.select(
        "doc_id", F.lit(0).alias("kind_ord"), F.col("section_seq").alias("kind_seq"), F.col("local_seq").cast("int").alias("local_seq"), F.col("piece.content").alias("content"), F.lit("text").alias("chunk_type"),
        "section_number", F.col("title").alias("section_title"), F.col("level").alias("section_level"), "parent_section", F.coalesce(F.col("path"), F.array("section_number")).alias("section_path"),
        "page_start", "page_end", F.col("piece.tokens").alias("token_count"), meta.alias("text_meta"),
    )


def rows_per_chunk(sizes: ChunkSizes = ChunkSizes()) -> Column:
    """How many rows of a table fit, judged by the markdown of its first one."""
    sample = T.token_count(table_markdown(F.lit(0), F.lit(1)))
    return F.greatest(F.lit(5), F.floor((sizes.size - 100) / F.greatest(F.lit(10), sample - 100)).cast("int"))


def _with_section(rows: DataFrame, info: DataFrame, seq: str) -> DataFrame:
    """``rows`` with ``info`` of their section, null where there is none.

    A section that holds more than ``SECTION_ROWS`` rows is dealt to several tasks by ``seq``, its info to each of them; such
    sections are few, one in so many rows at most.
    """
    key = ["doc_id", "section_number"]
    large = rows.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > SECTION_ROWS).select(*key, F.ceil(F.col("__n") / SECTION_ROWS).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(F.broadcast(large), key, "left").withColumn("__part", F.pmod(F.xxhash64(seq), parts).cast("int")).drop("__parts")
    held = info.join(F.broadcast(large), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(held, [*key, "__part"], "left").drop("__part")


def chunk_tables(tables: DataFrame, nodes: DataFrame, paths: DataFrame, sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """A chunk for a table that fits and stands on one page, else parts with the header repeated."""
    scored = F.col("confidence").isNotNull() & (F.size("confidence") > 0)
    kept = confident_rows(tables.withColumn("filtered", scored)).where(F.size("rows") > 0)
    named = kept.withColumn("section_number", T.or_else(F.col("section_number"), "unknown")).withColumn("section_title", T.or_else(F.col("section_title"), "Unknown Section"))
    info = nodes.select("doc_id", "section_number", F.col("level").alias("node_level"), F.col("parent").alias("parent_section")).join(paths, ["doc_id", "section_number"])
    joined = _with_section(named, info, "table_seq").withColumn("markdown", table_markdown())
    single = (T.token_count(F.col("markdown")) <= sizes.size) & (F.size("page_range") == 1)
    step = F.when(single, F.size("rows")).otherwise(rows_per_chunk(sizes))
    parts = joined.withColumn("single", single).withColumn("step", step).select("*", F.posexplode(F.sequence(F.lit(0), F.size("rows") - 1, F.col("step"))).alias("local_seq", "first"))
    parts = parts.withColumn("last", F.least(F.col("first") + F.col("step"), F.size("rows")))
    content = F.when(F.col("single"), F.col("markdown")).otherwise(table_markdown(F.col("first"), F.col("last"), part_info=True))
    meta = F.struct(
        table_summary().alias("table"), F.col("single").alias("is_complete_table"), F.when(~F.col("single"), F.col("local_seq")).alias("chunk_index"),
        F.when(~F.col("single"), F.ceil(F.size("rows") / F.col("step")).cast("int")).alias("total_chunks"), F.when(~F.col("single"), F.array("first", "last")).alias("row_range"), F.col("filtered").alias("confidence_filtered"),
    )
    return parts.withColumn("content", content).select(
        "doc_id", F.lit(1).alias("kind_ord"), F.col("table_seq").cast("long").alias("kind_seq"), F.col("local_seq").cast("int").alias("local_seq"), "content", F.lit("table").alias("chunk_type"),
        "section_number", "section_title", F.coalesce("node_level", F.lit(0)).alias("section_level"), "parent_section", F.coalesce(F.col("path"), F.array("section_number")).alias("section_path"),
        F.col("page_range")[0].alias("page_start"), F.element_at("page_range", -1).alias("page_end"), T.token_count(F.col("content")).alias("token_count"), meta.alias("table_meta"),
    )


def chunk_diagrams(diagrams: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """A chunk for each diagram: caption, description, key elements that the description lacks, page."""
    description, extracted = T.blank_to_null(F.col("diagram_description")), T.blank_to_null(F.col("extracted_text"))
    elements = F.when((T.strip(extracted) != "") & ~F.contains(F.coalesce(description, F.lit("")), extracted), F.concat(F.lit("\n**Key Elements**: "), extracted))
    content = F.concat_ws("\n", F.concat(F.lit("**"), "caption", F.lit("**")), F.concat(F.lit("\n"), description), elements, F.concat(F.lit("\n*Located on page "), "page", F.lit("*")))
    info = nodes.select("doc_id", "section_number", F.col("title").alias("node_title"), F.col("level").alias("node_level"), F.col("parent").alias("parent_section")).join(paths, ["doc_id", "section_number"])
    named = diagrams.withColumn("section_number", T.or_else(F.col("section_number"), "unknown"))
    named = _with_section(named, info, "diagram_seq").withColumn("content", content)
    meta = F.struct("diagram_id", F.col("caption").alias("diagram_caption"), "figure_number", description.isNotNull().alias("has_relationship_analysis"), extracted.isNotNull().alias("has_extracted_data"))
    return named.select(
        "doc_id", F.lit(2).alias("kind_ord"), F.col("diagram_seq").cast("long").alias("kind_seq"), F.lit(0).alias("local_seq"), "content", F.lit("diagram_ref").alias("chunk_type"),
        "section_number", F.coalesce("node_title", T.or_else(F.col("section_title"), "Unknown Section")).alias("section_title"), F.coalesce("node_level", F.lit(0)).alias("section_level"), "parent_section",
        F.coalesce(F.col("path"), F.array("section_number")).alias("section_path"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), T.token_count(F.col("content")).alias("token_count"), meta.alias("diagram_meta"),
    )


def chunk_document(texts: DataFrame, tables: DataFrame | None = None, diagrams: DataFrame | None = None, acronyms: DataFrame | None = None) -> DataFrame:
    """All chunks of each document, ordered by page, then text, table, diagram; numbered from 0."""
    rows = texts
    for more in (tables, diagrams):
        rows = rows if more is None else rows.unionByName(more, allowMissingColumns=True)
    if acronyms is not None:
        rows = _acronym_maps(rows, acronyms, "content")
    order = Window.partitionBy("doc_id").orderBy("page_start", "kind_ord", "kind_seq", "local_seq")
    numbered = rows.withColumn("chunk_seq", (F.row_number().over(order) - 1).cast("long"))
    return numbered.withColumn("chunk_id", F.concat(F.lit("chunk_"), "chunk_seq")).drop("kind_ord", "kind_seq", "local_seq")


def context_string(chunks: DataFrame) -> Column:
    """What is embedded of a chunk: place and kind on one line, a blank line, the content."""
    caption = T.blank_to_null(T.strip(F.regexp_extract(T.strip(F.col("content")), r"^\*\*([^*]+)\*\*", 1)))
    has_title = F.col("text_meta").isNotNull() if "text_meta" in chunks.columns else F.lit(False)
    under = F.col("text_meta.parent_title") if "text_meta" in chunks.columns else F.lit(None).cast("string")
    line = F.concat_ws(
        " | ",
        F.when(F.size("section_path") > 0, F.concat(F.lit("Chapter "), F.get("section_path", F.lit(0)))),
        F.when(F.col("chunk_type") == "table", F.concat(F.lit("Table: "), caption)),
        F.concat(F.lit("Section "), "section_number", F.lit(": "), "section_title"),
        F.concat(F.lit("Type: "), "chunk_type"),
        F.when((F.length("parent_section") > 0) & has_title, F.concat(F.lit("Under: "), under)),
    )
    return F.concat(line, F.lit("\n\n"), F.col("content"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n_chunks"))


def acronym_coverage(chunks: DataFrame) -> DataFrame:
    """One row: chunks with and without acronyms (a map column ``acronyms``), and how many different ones."""
    size = F.coalesce(F.size("acronyms"), F.lit(0))
    seen = chunks.select(F.explode(F.map_keys("acronyms")).alias("a")).agg(F.count_distinct("a").alias("n_acronyms"))
    return chunks.agg(F.count_if(size > 0).alias("with_acronyms"), F.count_if(size <= 0).alias("without_acronyms")).crossJoin(seen)  # one row each


def acronym_listing(chunks: DataFrame, n: int = 30) -> DataFrame:
    """The first n acronyms by name with the definition of the first chunk that has them."""
    rows = chunks.select("chunk_seq", F.explode("acronyms").alias("acronym", "definition"))
    return rows.groupBy("acronym").agg(F.min_by("definition", "chunk_seq").alias("definition")).orderBy("acronym").limit(n)
