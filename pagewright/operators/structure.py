"""From page text and raw tables to sections, tables and diagrams.

Input contracts: pages ``(doc_id, page_no, text)``; sections with
``section_seq``; tables and diagrams with a ``*_seq`` that carries their order.
Every ordered step is partitioned by document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def page_offsets(pages: DataFrame) -> DataFrame:
    """Pages with the character offset at which each begins in the whole text."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long"))


def toc_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("is_toc", T.is_toc_page(F.col("text")))


def page_of_position(positions: DataFrame, pages: DataFrame) -> DataFrame:
    """``positions`` (doc_id, pos) with the page whose offset is the last at or before each.

    An as-of join without a non-equi join: offsets and positions of a document
    are sorted together and the last offset is carried on.
    """
    starts = page_offsets(pages).select("doc_id", F.col("offset").alias("at"), F.lit(0).alias("kind"), F.col("page_no").alias("page"), F.lit(None).cast("long").alias("pos"))
    asked = positions.select("doc_id", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("page"), "pos")
    order = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(asked).withColumn("page", F.last("page", ignorenulls=True).over(order)).where("kind = 1").select("doc_id", "pos", F.coalesce("page", F.lit(1)).alias("page"))


def _lines(pages: DataFrame) -> DataFrame:
    """Lines of all pages with their offset in the document's text and what is a heading."""
    rows = toc_pages(page_offsets(pages)).select("doc_id", "page_no", "offset", "is_toc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = Window.partitionBy("doc_id", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.col("offset") + F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def sections_from_text(pages: DataFrame) -> DataFrame:
    """Sections of the concatenated text of each document.

    A heading is a line of number and title outside table-of-contents pages and
    without dotted leaders.  A section's content are the lines up to the next
    heading, trimmed; lines of contents pages inside it are kept.
    """
    lines = _lines(pages)
    head = F.col("line").rlike(T.HEADING) & ~F.col("is_toc") & ~F.col("line").rlike(r"\.{3,}")
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    flagged = lines.withColumn("head", head).withColumn("section_seq", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(order)).where("section_seq > 0")
    full = F.length(T.strip(F.col("line"))) > 0
    grouped = flagged.groupBy("doc_id", "section_seq").agg(
        F.max(F.when(F.col("head"), F.col("line"))).alias("heading"),
        F.min(F.when(F.col("head"), F.col("page_no"))).alias("page_start"),
        F.max(F.when(full, F.col("page_no"))).alias("page_end"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("page_no", "line_no", "line")))).getField("line").alias("lines"),
    )
    number = F.regexp_extract("heading", T.HEADING, 1)
    return grouped.select(
        "doc_id", F.col("section_seq").cast("long").alias("section_seq"), number.alias("section_number"), T.strip(F.regexp_extract("heading", T.HEADING, 2)).alias("title"),
        T.strip(F.array_join("lines", "\n")).alias("content"), "page_start", "page_end", T.level_of(number).alias("level"), T.parent_number(number).alias("parent_section"),
    )


def sections_from_pages(pages: DataFrame) -> DataFrame:
    """Sections page by page, lines trimmed: a page with several headings gives each of them the rest of that page.

    A section's content runs from its heading line; on later pages it goes on up
    to the next heading, whose page is its last.
    """
    lines = _lines(pages).withColumn("line", T.strip(F.col("line"))).withColumn("head", F.col("line").rlike(T.HEADING) & ~F.col("is_toc") & ~F.col("line").rlike(r"\.{3,}"))
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    placed = lines.withColumn("section_seq", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(order).cast("long"))
    placed = placed.withColumn("head_page", F.max(F.when(F.col("head"), F.col("page_no"))).over(order)).where("section_seq > 0")
    heads = placed.where("head").select("doc_id", "page_no", "line_no", "line", "section_seq").withColumn("next", F.lead(F.struct("page_no", "line_no")).over(order))
    body = placed.select("doc_id", "section_seq", "head_page", F.col("page_no").alias("p"), F.col("line_no").alias("l"), F.col("line").alias("x"))
    # on its own page a section takes all that follows; on later ones what stands before the next heading, so that of the last heading alone
    on_page = body.where("p = head_page").drop("section_seq", "head_page").join(heads.select("doc_id", "section_seq", F.col("page_no").alias("p"), "line_no"), ["doc_id", "p"]).where("l >= line_no")
    met = on_page.select("doc_id", "section_seq", "p", "l", "x").unionByName(body.where("p > head_page").drop("head_page"))
    texts = met.groupBy("doc_id", "section_seq").agg(F.array_sort(F.collect_list(F.struct("p", "l", "x"))).getField("x").alias("lines"), F.max("p").alias("last_page"))
    number = F.regexp_extract("line", T.HEADING, 1)
    return heads.join(texts, ["doc_id", "section_seq"]).select(
        "doc_id", "section_seq", number.alias("section_number"), T.strip(F.regexp_extract("line", T.HEADING, 2)).alias("title"), T.strip(F.array_join("lines", "\n")).alias("content"),
        F.col("page_no").alias("page_start"), F.coalesce("next.page_no", "last_page").alias("page_end"), T.level_of(number).alias("level"), T.parent_number(number).alias("parent_section"),
    )


def body_font(spans: DataFrame, size_col: str = "size") -> DataFrame:
    """``(doc_id, body_size)``: the commonest font size rounded to a tenth, the smaller of equals."""
    counted = spans.groupBy("doc_id", F.round(F.col(size_col), 1).alias("s")).agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id").agg(F.max_by("s", F.struct("n", -F.col("s"))).alias("body_size"))


def heading_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks ``(doc_id, block_seq, page_no, text, spans array<struct<size,flags>>)`` that are headings.

    A heading matches the pattern and is half a point larger than the body or bold (flag 16).
    """
    spans = blocks.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.size").alias("size"))
    largest = F.array_max(F.transform("spans", lambda s: s["size"]))
    bold = F.exists("spans", lambda s: s["flags"].bitwiseAND(16) > 0)
    met = blocks.join(body_font(spans), "doc_id")
    return met.where(T.strip(F.col("text")).rlike(T.HEADING) & ((largest >= F.col("body_size") + 0.5) | bold)).drop("body_size")


def sections_from_blocks(blocks: DataFrame) -> DataFrame:
    """Sections of ``blocks`` told by their type: each heading block with the texts of those up to the next.

    Blocks before the first heading belong to none.  A section ends on the page of its last block.
    """
    heads = heading_blocks(blocks).select("doc_id", "block_seq", F.lit(True).alias("head"))
    order = Window.partitionBy("doc_id").orderBy("block_seq")
    flagged = blocks.select("doc_id", "block_seq", "page_no", "text").join(heads, ["doc_id", "block_seq"], "left").withColumn("section_seq", F.count("head").over(order)).where("section_seq > 0")
    heading, page = F.max(F.when(F.col("head"), T.strip(F.col("text")))), F.min(F.when(F.col("head"), F.col("page_no")))
    body = F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("block_seq", "text")))).getField("text")
    grouped = flagged.groupBy("doc_id", "section_seq").agg(heading.alias("heading"), page.alias("page_start"), F.max("page_no").alias("page_end"), body.alias("texts"))
    number = F.regexp_extract("heading", T.HEADING, 1)
    return grouped.select(
        "doc_id", "section_seq", number.alias("section_number"), T.strip(F.regexp_extract("heading", T.HEADING, 2)).alias("title"), T.strip(F.array_join("texts", "\n")).alias("content"),
        "page_start", "page_end", T.level_of(number).alias("level"), T.parent_number(number).alias("parent_section"),
    )


def sections_from_items(items: DataFrame) -> DataFrame:
    """Sections of a layout parser's items ``(doc_id, seq, label, level, text, page)``: those labelled as sections.

    Content is a stub; numbers come from the text or from counters of the levels.
    """
    heads = items.where(F.contains(F.lower("label"), F.lit("section"))).withColumn("level", section_level())
    return number_sections(heads).select("doc_id", F.col("seq").alias("section_seq"), "section_number", F.col("text").alias("title"), F.concat(F.lit("Content for section "), "section_number").alias("content"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), "level", T.parent_number(F.col("section_number")).alias("parent_section"))


def section_level() -> Column:
    """The item's level, else that of its label, else 1."""
    label = F.lower("label")
    named = F.when(label.isin("h1", "title"), 1).when(label == "h2", 2).when(label == "h3", 3).when(label == "h4", 4)
    return F.coalesce(F.col("level"), named, F.lit(1))


def number_sections(heads: DataFrame) -> DataFrame:
    """``heads`` with ``section_number``: the number that begins the text, else counters of the levels.

    A counter begins anew when a shallower heading comes; only headings without
    a number of their own count.  An ordered fold over one document's headings.
    """
    own = T.blank_to_null(F.regexp_extract("text", r"^(\d+(?:\.\d+)*)", 1))
    gathered = heads.withColumn("own", own).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "level", "own"))).alias("h"))
    start = F.struct(F.array().cast("array<int>").alias("counts"), F.array().cast("array<struct<seq:bigint,number:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        level = x["level"]
        held = F.slice(F.concat(state["counts"], F.array_repeat(F.lit(0), level)), F.lit(1), level)
        counts = F.transform(held, lambda c, i: F.when(i == level - 1, c + 1).otherwise(c))
        after = F.when(x["own"].isNull(), counts).otherwise(state["counts"])
        number = F.coalesce(x["own"], F.array_join(F.transform(counts, lambda c: c.cast("string")), "."))
        return F.struct(after.alias("counts"), F.concat(state["out"], F.array(F.struct(x["seq"].cast("bigint").alias("seq"), number.alias("number")))).alias("out"))

    numbers = gathered.select("doc_id", F.explode(F.aggregate("h", start, step, lambda s: s["out"])).alias("n")).select("doc_id", "n.seq", F.col("n.number").alias("section_number"))
    return heads.join(numbers, ["doc_id", "seq"])


def document_titles(docs: DataFrame, items: DataFrame, default: str = "Document") -> DataFrame:
    """``(doc_id, title)``: the document's name, else its first title item, else the default."""
    first = items.where(F.lower("label") == "title").groupBy("doc_id").agg(F.min_by("text", "seq").alias("t"))
    return docs.join(first, "doc_id", "left").select("doc_id", F.coalesce(T.blank_to_null(F.col("name")), "t", F.lit(default)).alias("title"))


def parse_tables(raw: DataFrame) -> DataFrame:
    """Raw grids ``(doc_id, table_seq, page, caption, grid array<array<string>>)`` as tables.

    The first row is the header; null cells are empty; blank rows go.  A grid
    of fewer than two rows is skipped but counts for the default caption.
    """
    clean = F.transform("grid", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_seq"))
    rows = raw.withColumn("nth", nth).withColumn("g", clean).where(F.size("grid") >= 2)
    caption = F.coalesce(T.blank_to_null(T.strip(F.col("caption"))), F.concat(F.lit("Table "), F.col("nth")))
    body = F.filter(F.slice("g", 2, F.size("g")), lambda r: F.exists(r, lambda c: T.strip(c) != ""))
    return rows.select("doc_id", "table_seq", F.concat(F.lit("table_"), F.col("nth")).alias("table_id"), caption.alias("caption"), F.array("page").alias("page_range"), F.col("g")[0].alias("headers"), body.alias("rows"), T.table_number(caption).alias("table_number"))


def tables_from_items(raw: DataFrame) -> DataFrame:
    """Layout tables ``(…, pages array<int>, grid)``: pages sorted and distinct, rows of another width dropped."""
    headers = F.col("grid")[0]
    rows = F.filter(F.slice("grid", 2, F.size("grid")), lambda r: F.size(r) == F.size(headers))
    return raw.where(F.size("grid") > 0).withColumn("headers", headers).withColumn("rows", rows).withColumn("page_range", F.array_sort(F.array_distinct("pages"))).drop("grid", "pages")


def merge_tables(tables: DataFrame) -> DataFrame:
    """Consecutive fragments of one table joined.

    A fragment goes on with the table before it if it has as many columns,
    begins on the page after that table's last one, and its caption is empty or
    begins with "Table ", or its number is the same.  A repeated header row is dropped.
    The test looks at what has been joined so far, so it is an ordered fold.
    """
    fields = ("table_id", "caption", "page_range", "headers", "rows", "table_number")
    kind = "struct<table_seq:bigint,table_id:string,caption:string,page_range:array<int>,headers:array<string>,rows:array<array<string>>,table_number:string>"
    one = F.struct(F.col("table_seq").cast("bigint").alias("table_seq"), *fields).cast(kind)
    gathered = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["table_seq"] < b["table_seq"], -1).when(a["table_seq"] > b["table_seq"], 1).otherwise(0)).alias("t"))

    def step(done: Column, nxt: Column) -> Column:
        cur = F.try_element_at(done, F.lit(-1))
        follows = F.array_min(nxt["page_range"]) == F.array_max(cur["page_range"]) + 1
        caption = F.coalesce(nxt["caption"], F.lit(""))
        alike = (caption == "") | F.startswith(caption, F.lit("Table ")) | F.coalesce(nxt["table_number"] == cur["table_number"], F.lit(False))
        goes_on = F.coalesce((F.size(nxt["headers"]) == F.size(cur["headers"])) & follows & alike, F.lit(False))
        first = F.get(nxt["rows"], F.lit(0))
        more = F.when(F.coalesce(first == cur["headers"], F.lit(False)), F.slice(nxt["rows"], 2, F.greatest(F.size(nxt["rows"]) - 1, F.lit(0)))).otherwise(nxt["rows"])
        joined = F.struct(cur["table_seq"], cur["table_id"], cur["caption"], F.array_sort(F.array_distinct(F.concat(cur["page_range"], nxt["page_range"]))), cur["headers"], F.concat(cur["rows"], more), cur["table_number"]).cast(kind)
        return F.when(goes_on, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(nxt)))

    merged = gathered.select("doc_id", F.explode(F.aggregate("t", F.array().cast(f"array<{kind}>"), step)).alias("m"))
    return merged.select("doc_id", "m.*")


def confident_rows(tables: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Tables (with ``confidence array<struct<row,col,score>>``) with the rows that have any cell at or over the threshold.

    Without scores all rows stay.
    """
    sure = F.filter("rows", lambda r, i: F.exists("confidence", lambda c: (c["row"] == i) & (c["score"] >= threshold)))
    return tables.withColumn("rows", F.when(F.col("confidence").isNull() | (F.size("confidence") == 0), F.col("rows")).otherwise(sure))


def table_markdown(first: Column | None = None, last: Column | None = None, part_info: bool = False) -> Column:
    """Markdown of a table's rows [first, last), numbered from 1 through the whole table."""
    named = F.concat(F.lit("**Table "), F.col("table_number"), F.lit(": "), F.coalesce("caption", F.lit("")), F.lit("**"))
    caption = F.when(F.length("table_number") > 0, named).otherwise(F.concat(F.lit("**"), F.coalesce("caption", F.lit("")), F.lit("**")))
    begin = F.lit(0) if first is None else first
    if part_info and first is not None:
        caption = F.concat(caption, F.lit(" (Rows "), begin + 1, F.lit("-"), last, F.lit(")"))
    rows = F.col("rows") if first is None else F.slice("rows", begin + 1, F.greatest(last - begin, F.lit(0)))
    lines = F.transform(rows, lambda r, i: F.concat(F.lit("| "), begin + i + 1, F.lit(" | "), F.array_join(r, " | ", ""), F.lit(" |")))
    head = F.when(
        F.size("headers") > 0,
        F.array(F.concat(F.lit("| # | "), F.array_join("headers", " | ", ""), F.lit(" |")), F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.size("headers") + 1), "|"), F.lit("|"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(caption, F.lit("")), head, lines), "\n")


def table_summary() -> Column:
    """What a table's chunks carry as metadata."""
    return F.struct("table_id", "table_number", "caption", F.col("page_range").alias("pages"), "section_number", "section_title", F.size("rows").alias("num_rows"), F.coalesce(F.size("headers"), F.lit(0)).alias("num_columns"), "headers")


def _sweep(sections: DataFrame, asked: DataFrame, deepest: bool) -> DataFrame:
    """``(doc_id, page, around, before)`` for each of ``asked (doc_id, page)``, as ``struct<n,t>``.

    ``around``: the section open on the page, the deepest or else the first in order, the
    first of equals; ``before``: the last in order of those that end at or before the page.
    Sections are rows where they open and where they end; these and the pages asked for are sorted
    by document and page, and a task that reads them in order holds the open sections alone.
    """
    named = ("section_seq", "level", F.col("section_number").alias("n"), F.col("title").alias("t"), F.greatest("page_start", "page_end").alias("until"))
    opens = sections.select("doc_id", F.col("page_start").alias("page"), F.lit(0).alias("kind"), *named)
    ends = sections.select("doc_id", F.col("page_end").alias("page"), F.lit(1).alias("kind"), *named)
    pages = asked.select("doc_id", "page").distinct().withColumn("kind", F.lit(2))
    events = opens.unionByName(ends).unionByName(pages, allowMissingColumns=True).where("page is not null")
    ordered = events.repartition("doc_id").sortWithinPartitions("doc_id", "page", "kind", "section_seq")
    ids = asked.schema["doc_id"].dataType.simpleString()
    name = pa.struct([("n", pa.string()), ("t", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, opened, ended = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if row["doc_id"] != doc:
                    doc, opened, ended = row["doc_id"], [], None
                if row["kind"] == 0:
                    heapq.heappush(opened, (-(row["level"] or 0) if deepest else 0, row["section_seq"], row["until"], row["n"], row["t"]))
                elif row["kind"] == 1:
                    if ended is None or row["section_seq"] > ended[0]:
                        ended = (row["section_seq"], row["n"], row["t"])
                else:
                    while opened and opened[0][2] < row["page"]:
                        heapq.heappop(opened)
                    out.append((doc, row["page"], opened[0][3:] if opened else None, ended[1:] if ended else None))
            names = [[None if x[i] is None else {"n": x[i][0], "t": x[i][1]} for x in out] for i in (2, 3)]
            columns = [pa.array([x[0] for x in out], batch.schema.field("doc_id").type), pa.array([x[1] for x in out], batch.schema.field("page").type), *[pa.array(n, name) for n in names]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "page", "around", "before"])

    kind = "struct<n:string,t:string>"
    return ordered.mapInArrow(work, f"doc_id {ids}, page {events.schema['page'].dataType.simpleString()}, around {kind}, before {kind}")


def sections_of_tables(tables: DataFrame, sections: DataFrame) -> DataFrame:
    """``tables`` with number and title of the deepest section around their first page, the first of equals.

    Without one it is the last section, in order, that ends at or before that page.
    """
    asked = tables.withColumn("__page", F.coalesce(F.get("page_range", F.lit(0)), F.lit(1)))
    found = _sweep(sections, asked.select("doc_id", F.col("__page").alias("page")), deepest=True)
    met = asked.join(found.withColumnRenamed("page", "__page"), ["doc_id", "__page"], "left")
    return met.withColumn("section_number", F.coalesce("around.n", "before.n")).withColumn("section_title", F.coalesce("around.t", "before.t")).drop("around", "before", "__page")


def sections_of_diagrams(diagrams: DataFrame, sections: DataFrame) -> DataFrame:
    """``diagrams`` with number and title of the first section, in order, around their page."""
    found = _sweep(sections, diagrams, deepest=False).select("doc_id", "page", F.col("around").alias("s"))
    return diagrams.join(found, ["doc_id", "page"], "left").withColumn("section_number", F.col("s.n")).withColumn("section_title", F.col("s.t")).drop("s")


def pick_diagrams(captions: DataFrame, min_bytes: int = 8_000) -> DataFrame:
    """Diagrams of caption candidates ``(doc_id, seq, page, y, text, n_drawings, image_bytes)``.

    The caption names a figure, has drawings above it and stands below the
    page's top band; of a figure number the candidate with most drawings is
    kept, the first of equals; small images go.
    """
    caption = T.strip(F.regexp_extract("text", r"(?i)((?:FIGURE|FIG\.?)\s+\d[\d.\-]+\b.*)", 1))
    rows = captions.withColumn("caption", caption).where((F.col("caption") != "") & (F.col("n_drawings") >= 1) & (F.col("y") >= 155))
    rows = rows.withColumn("figure_number", T.figure_number(F.col("caption")))
    key = F.coalesce("figure_number", F.concat_ws("|", "page", "y"))
    best = rows.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.desc("n_drawings"), "seq"))).where("rn = 1").where(F.col("image_bytes") >= min_bytes)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "seq"))
    return best.select("doc_id", nth.alias("diagram_seq"), F.concat(F.lit("diagram_p"), "page", F.lit("_f"), F.coalesce("figure_number", F.lit("unknown"))).alias("diagram_id"), "caption", "page", "figure_number", F.col("image_bytes").alias("image_size_bytes"))


def diagrams_from_items(items: DataFrame) -> DataFrame:
    """Layout items labelled figure or picture, numbered in order."""
    found = items.where(F.lower("label").isin("figure", "picture"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return found.select("doc_id", nth.alias("diagram_seq"), F.concat(F.lit("diagram_"), nth).alias("diagram_id"), F.coalesce("text", F.lit("")).alias("caption"), "page", T.figure_number(F.col("text")).alias("figure_number"))


def pick_images(images: DataFrame) -> DataFrame:
    """Embedded images large enough in bytes and pixels and with a caption, one a cross-reference number."""
    fit = images.where((F.col("n_bytes") >= 10_000) & (F.col("width") >= 100) & (F.col("height") >= 100) & (F.coalesce("caption", F.lit("")) != ""))
    return fit.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "xref").orderBy("page", "seq"))).where("rn = 1").drop("rn")


def image_captions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """``images`` (doc_id, seq, page, top, bottom) with a caption from the text blocks of their page.

    First the nearest block that names a figure within 200 points, then the
    nearest text within 120 points below, then above.
    """
    met = images.join(blocks.select("doc_id", "page", F.col("y").alias("by"), F.col("text").alias("bt")), ["doc_id", "page"], "left")
    gap = F.least(F.abs(F.col("by") - F.col("bottom")), F.abs(F.col("top") - F.col("by")))
    rank = F.when(T.figure_number(F.col("bt")).isNotNull() & (gap <= 200), 1).when(F.col("by").between(F.col("bottom"), F.col("bottom") + 120), 2).when(F.col("by").between(F.col("top") - 120, F.col("top")), 3)
    best = met.groupBy("doc_id", "seq").agg(F.min_by("bt", F.when(rank.isNotNull(), F.struct(rank.alias("r"), gap.alias("g"), F.col("by").alias("y")))).alias("found_caption"))
    return images.join(best, ["doc_id", "seq"])


def image_counts(images: DataFrame, min_bytes: int = 10_000) -> DataFrame:
    """``(doc_id, page, n_images)`` of images of at least ``min_bytes``; page null: the document's total."""
    return images.where(F.col("n_bytes") >= min_bytes).rollup("doc_id", "page").agg(F.count("*").alias("n_images")).where("doc_id is not null")
