"""Queries of parsing, tables, diagrams, chunks, sources and sinks, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from ..operators import chunking, metadata, structure
from ..operators.chunking import ChunkSizes
from ..session import shared_dir
from ..sources import parsers, tables
from ..sources.tables import table
from . import catalogue as base
from . import corpus, pipeline
from .registry import query


def _scratch(spark) -> str:
    """A fresh folder in the shared place of intermediate tables."""
    return f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"


# --- layout items -----------------------------------------------------------

#: Suppliers as items of a layout parser, one document a nation; some texts begin with a number of their own.
_ITEMS = """
SELECT s_nationkey AS doc_id, s_suppkey AS seq, CASE s_suppkey % 7 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'Title' WHEN 2 THEN 'h2' WHEN 3 THEN 'Figure' ELSE 'section_header' END AS label,
       CASE WHEN s_suppkey % 5 < 3 THEN CAST(s_suppkey % 4 + 1 AS INT) END AS level,
       CASE WHEN s_suppkey % 6 = 0 THEN concat(s_suppkey % 9 + 1, '.', s_suppkey % 4, ' ', s_name) WHEN s_suppkey % 7 = 3 THEN concat('Figure ', s_suppkey % 9, '-2 of ', s_name) ELSE s_name END AS text,
       CAST(s_suppkey % 30 + 1 AS INT) AS page
FROM supplier
"""
_LEVEL = "coalesce(level, CASE lower(label) WHEN 'title' THEN 1 WHEN 'h1' THEN 1 WHEN 'h2' THEN 2 WHEN 'h3' THEN 3 WHEN 'h4' THEN 4 END, 1)"


def _items(spark, sf_dir) -> DataFrame:
    return corpus.sql(spark, sf_dir, _ITEMS)


def _numbered(heads: str) -> str:
    """SQL for the numbers of headings: how many of a level have come since the last shallower one."""
    since = ", ".join(f"max(CASE WHEN own IS NULL AND lv < {j} THEN seq END) OVER o AS since{j}" for j in range(1, 5))
    counts = ", ".join(f"sum(CASE WHEN own IS NULL AND lv = {j} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, since{j} ORDER BY seq) AS n{j}" for j in range(1, 5))
    return f"""h AS ({heads}), w AS (SELECT *, {since} FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY seq)), c AS (SELECT *, {counts} FROM w WHERE own IS NULL),
numbered AS (SELECT doc_id, seq, array_to_string([n1, n2, n3, n4][1:lv], '.') AS section_number FROM c UNION ALL SELECT doc_id, seq, own FROM h WHERE own IS NOT NULL)"""


_HEADS = f"SELECT doc_id, seq, text, page, {_LEVEL} AS lv, nullif(regexp_extract(text, '^(\\d+(?:\\.\\d+)*)', 1), '') AS own FROM ({_ITEMS}) i"


@query(f"SELECT doc_id, seq, {_LEVEL}::INT AS level FROM ({_ITEMS}) i")
def section_level(spark, sf_dir):
    return _items(spark, sf_dir).select("doc_id", "seq", structure.section_level().cast("int").alias("level"))


@query(f"WITH {_numbered(_HEADS)} SELECT doc_id, seq, section_number FROM numbered")
def section_numbering(spark, sf_dir):
    """All items as headings, numbered by counters of their levels."""
    return structure.number_sections(_items(spark, sf_dir).withColumn("level", structure.section_level())).select("doc_id", "seq", "section_number")


@query(
    f"""WITH {_numbered(_HEADS + " WHERE contains(lower(label), 'section')")}
SELECT doc_id, seq AS section_seq, section_number, text AS title, 'Content for section ' || section_number AS content, page AS page_start, page AS page_end, lv::INT AS level,
 CASE WHEN contains(section_number, '.') THEN regexp_replace(section_number, '\\.[^.]+$', '') END AS parent_section FROM h JOIN numbered USING (doc_id, seq)"""
)
def sections_docling(spark, sf_dir):
    return structure.sections_from_items(_items(spark, sf_dir)).withColumn("level", F.col("level").cast("int"))


@query(
    f"""WITH i AS ({_ITEMS}), d AS (SELECT DISTINCT s_nationkey AS doc_id, CASE s_nationkey % 3 WHEN 0 THEN concat('Document ', s_nationkey) WHEN 1 THEN '' END AS name FROM supplier),
t AS (SELECT doc_id, arg_min(text, seq) AS t FROM i WHERE lower(label) = 'title' GROUP BY 1)
SELECT doc_id, coalesce(nullif(name, ''), t, 'Document') AS title FROM d LEFT JOIN t USING (doc_id)"""
)
def doc_title(spark, sf_dir):
    docs = corpus.sql(spark, sf_dir, "SELECT DISTINCT s_nationkey AS doc_id, CASE s_nationkey % 3 WHEN 0 THEN concat('Document ', s_nationkey) WHEN 1 THEN '' END AS name FROM supplier")
    return structure.document_titles(docs, _items(spark, sf_dir))


@query(
    f"""WITH {_numbered(_HEADS + " WHERE contains(lower(label), 'section')")},
heads AS (SELECT n.doc_id, n.seq, i.page, n.section_number, i.text FROM numbered n JOIN ({_ITEMS}) i ON i.doc_id = n.doc_id AND i.seq = n.seq),
d AS (SELECT doc_id, page, 'diagram_' || row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS diagram_id FROM ({_ITEMS}) i WHERE lower(label) IN ('figure', 'picture'))
SELECT d.doc_id, diagram_id, d.page, arg_min(section_number, seq) AS section_number, arg_min(text, seq) AS section_title FROM d LEFT JOIN heads h ON h.doc_id = d.doc_id AND h.page = d.page GROUP BY ALL"""
)
def diagram_section_docling(spark, sf_dir):
    """Diagrams of a layout parser with the first of its sections on their page."""
    items = _items(spark, sf_dir)
    rows = structure.sections_of_diagrams(structure.diagrams_from_items(items), structure.sections_from_items(items))
    return rows.select("doc_id", "diagram_id", "page", "section_number", "section_title")


@query(f"SELECT doc_id, 'diagram_' || row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS diagram_id, text AS caption, page, (seq % 9) || '-2' AS figure_number FROM ({_ITEMS}) i WHERE seq % 7 = 3 AND seq % 6 <> 0 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL WHERE FALSE")
def diagram_docling(spark, sf_dir):
    found = structure.diagrams_from_items(_items(spark, sf_dir).where("seq % 6 <> 0"))
    return found.select("doc_id", "diagram_id", "caption", "page", "figure_number")


# --- headings by font -------------------------------------------------------

#: Blocks of pages: a section's heading in large or bold type, then its text, then a line in small type.
_BLOCKS = f"""
SELECT doc_id, section_seq * 3 + k AS block_seq, CAST(FLOOR(section_seq / 2) AS INT) + 1 AS page_no, CASE k WHEN 0 THEN concat(section_number, ' ', title) WHEN 1 THEN content ELSE concat('note ', section_seq) END AS text,
       CAST(CASE k WHEN 0 THEN CASE WHEN section_seq % 3 = 0 THEN 10.0 ELSE 14.0 END WHEN 1 THEN 10.0 ELSE 8.0 END AS DOUBLE) AS size, CASE WHEN k = 0 AND section_seq % 3 = 0 AND section_seq % 2 = 0 THEN 16 ELSE 0 END AS flags
FROM ({corpus.SECTIONS}) s CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) p
"""


@query(
    f"""WITH b AS ({_BLOCKS}), h AS (SELECT *, size >= 10.5 OR flags = 16 AS head FROM b), g AS (SELECT *, count(*) FILTER (head) OVER (ORDER BY block_seq) AS section_seq FROM h)
SELECT section_seq, string_split(max(text) FILTER (head), ' ')[1] AS section_number, trim(regexp_replace(max(text) FILTER (head), '^\\S+', '')) AS title, coalesce(string_agg(text, chr(10) ORDER BY block_seq) FILTER (NOT head), '') AS content,
 min(page_no) FILTER (head) AS page_start, max(page_no) AS page_end FROM g WHERE section_seq > 0 GROUP BY 1"""
)
def sections_blocks(spark, sf_dir):
    """Sections by type size: headings larger than the body or bold, each with the text of the blocks up to the next."""
    blocks = corpus.sql(spark, sf_dir, _BLOCKS).withColumn("spans", F.array(F.struct("size", "flags"))).drop("size", "flags")
    return structure.sections_from_blocks(blocks).select("section_seq", "section_number", "title", "content", "page_start", "page_end")


# --- raw tables -------------------------------------------------------------

#: Order lines as raw grids: a header, lines with missing cells, a blank line; short orders have fewer than two rows.
_GRIDS = """
SELECT l_suppkey % 50 AS doc_id, l_orderkey AS table_seq, l_linenumber AS i, l_partkey % 10 AS k, CAST(l_partkey AS VARCHAR) AS a, CASE WHEN l_quantity > 25 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS b FROM lineitem
"""
_GRID_SQL = f"""g AS (SELECT doc_id, table_seq, row_number() OVER (PARTITION BY doc_id, table_seq ORDER BY i, a) AS i, CASE WHEN k = 0 THEN ' ' ELSE a END AS a, coalesce(b, '') AS b FROM ({_GRIDS}) r),
t AS (SELECT doc_id, table_seq, count(*) AS n FROM g GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY table_seq) AS nth FROM t)"""


def _grids(spark, sf_dir) -> DataFrame:
    rows = corpus.sql(spark, sf_dir, _GRIDS.replace("VARCHAR", "STRING"))
    row = F.struct("i", "a", F.array(F.when(F.col("k") == 0, " ").otherwise(F.col("a")), F.col("b")).alias("cells"))
    return rows.groupBy("doc_id", "table_seq").agg(F.array_sort(F.collect_list(row)).getField("cells").alias("grid"))


@query(
    f"""WITH {_GRID_SQL} SELECT doc_id, table_seq, 'table_' || nth AS table_id, CASE WHEN table_seq % 3 = 0 THEN 'Table 4.' || (table_seq % 9) ELSE 'Table ' || nth END AS caption,
 CASE WHEN table_seq % 3 = 0 THEN '4.' || (table_seq % 9) ELSE nth::VARCHAR END AS table_number, max(a || '|' || b) FILTER (i = 1) AS headers, coalesce(string_agg(a || '|' || b, chr(10) ORDER BY i) FILTER (i > 1 AND (trim(a) <> '' OR b <> '')), '') AS rows
FROM g JOIN n USING (doc_id, table_seq) WHERE n >= 2 GROUP BY ALL"""
)
def tables_raw(spark, sf_dir):
    """Raw grids as tables: the first row is the header, missing cells are empty, blank rows go."""
    caption = F.when(F.col("table_seq") % 3 == 0, F.concat(F.lit("Table 4."), F.col("table_seq") % 9)).otherwise(" ")
    found = structure.parse_tables(_grids(spark, sf_dir).withColumn("caption", caption).withColumn("page", F.lit(1)))
    lines = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return found.select("doc_id", "table_seq", "table_id", "caption", "table_number", F.array_join("headers", "|").alias("headers"), lines.alias("rows"))


@query(
    f"""WITH {_GRID_SQL} SELECT doc_id, table_seq, CASE WHEN table_seq % 2 = 0 THEN '3,4' ELSE '2' END AS pages, max(a || '|' || b) FILTER (i = 1) AS headers, count(*) FILTER (i > 1 AND i % 3 <> 0) AS n_rows FROM g GROUP BY ALL"""
)
def tables_docling(spark, sf_dir):
    """Layout tables: pages sorted and told once, rows of another width than the header's dropped."""
    odd = F.transform("grid", lambda r, i: F.when((i + 1) % 3 == 0, F.slice(r, 1, 1)).otherwise(r))
    pages = F.when(F.col("table_seq") % 2 == 0, F.array(F.lit(4), F.lit(3), F.lit(4))).otherwise(F.array(F.lit(2)))
    found = structure.tables_from_items(_grids(spark, sf_dir).select("doc_id", "table_seq", odd.alias("grid"), pages.alias("pages")))
    return found.select("doc_id", "table_seq", F.array_join(F.transform("page_range", lambda p: p.cast("string")), ",").alias("pages"), F.array_join("headers", "|", "").alias("headers"), F.size("rows").cast("long").alias("n_rows"))


_LINE_ROWS = "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey, l_suppkey FROM lineitem"


@query(f"WITH r AS ({_LINE_ROWS}) SELECT l_orderkey, coalesce(string_agg(l_partkey || '|' || l_suppkey, chr(10) ORDER BY i) FILTER (l_orderkey % 4 = 0 OR i % 3 = 1 OR i % 3 = 2 AND l_orderkey % 2 = 0), '') AS rows FROM r GROUP BY 1")
def table_rows_ok(spark, sf_dir):
    """Rows with a cell that was read surely enough; tables without scores keep all."""
    score = lambda i: F.when(i % 3 == 0, 0.9).when((i % 3 == 1) & (F.col("l_orderkey") % 2 == 0), 0.8).otherwise(0.79)
    scores = F.transform("rows", lambda r, i: F.struct(i.alias("row"), F.lit(1).alias("col"), score(i).alias("score")))
    scored = base._order_tables(spark, sf_dir).withColumn("confidence", F.when(F.col("l_orderkey") % 4 != 0, scores))
    return structure.confident_rows(scored).select("l_orderkey", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


@query(f"WITH r AS ({_LINE_ROWS}) SELECT l_orderkey, l_orderkey::VARCHAR AS table_number, 'Lines' AS caption, '1,2' AS pages, '1.1' AS section_number, 'Parts' AS section_title, count(*)::INT AS num_rows, 2 AS num_columns, 'part,supplier' AS headers FROM r GROUP BY 1")
def table_dict(spark, sf_dir):
    """What a table's chunks say of it."""
    rows = base._order_tables(spark, sf_dir).withColumn("table_id", F.lit("t")).withColumn("page_range", F.array(F.lit(1), F.lit(2))).withColumn("section_number", F.lit("1.1")).withColumn("section_title", F.lit("Parts"))
    return rows.select("l_orderkey", structure.table_summary().alias("t")).select(
        "l_orderkey", "t.table_number", "t.caption", F.array_join(F.transform("t.pages", lambda p: p.cast("string")), ",").alias("pages"), "t.section_number", "t.section_title", "t.num_rows", "t.num_columns", F.array_join("t.headers", ",").alias("headers")
    )


@query(f"SELECT p_partkey, coalesce(nullif(regexp_extract(caption, '[Tt]able\\s+([A-Z0-9]+[-.]?[0-9]*)', 1), ''), nullif(regexp_extract(caption, '^([0-9]+\\.[0-9]+)', 1), '')) AS table_number FROM (SELECT p_partkey, {base._CAPTIONS} AS caption FROM part)")
def table_number(spark, sf_dir):
    """Numbers of table captions; all-capital ones give none."""
    return table(spark, sf_dir, "part").select("p_partkey", T.table_number(F.expr(base._CAPTIONS)).alias("table_number"))


# --- images -----------------------------------------------------------------

#: Order lines as images of pages; parts as text blocks beside them.
_IMAGES = """
SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS seq, CAST(l_linenumber AS INT) AS page, l_orderkey % 40 AS xref, CAST(l_quantity * 1000 AS BIGINT) AS n_bytes, CAST(l_partkey % 300 AS INT) AS width,
       CAST(l_suppkey % 5 * 60 AS INT) AS height, CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('Figure ', l_linenumber) END AS caption, CAST(l_partkey % 500 AS DOUBLE) AS top FROM lineitem
"""


@query(f"WITH i AS ({_IMAGES}), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, xref ORDER BY page, seq) AS rn FROM i WHERE n_bytes >= 10000 AND width >= 100 AND height >= 100 AND coalesce(caption, '') <> '') SELECT doc_id, seq, page, caption, md5('image ' || seq || ' of ' || xref) AS image_md5 FROM f WHERE rn = 1")
def image_extract(spark, sf_dir):
    """Images large enough and with a caption, one a number, with their bytes."""
    image = F.encode(F.concat(F.lit("image "), "seq", F.lit(" of "), "xref"), "UTF-8")
    found = structure.pick_images(corpus.sql(spark, sf_dir, _IMAGES).withColumn("image", image))
    return found.select("doc_id", "seq", "page", "caption", F.md5("image").alias("image_md5"))


@query(
    f"""WITH i AS (SELECT doc_id, seq, page, top, top + 50 AS bottom FROM ({_IMAGES}) x), b AS (SELECT DISTINCT doc_id, page, (doc_id * 7 + page * 13 + k * 90) % 700 AS y, CASE WHEN k % 3 = 0 THEN 'Figure ' || page || '-' || k ELSE 'text ' || k END AS t FROM i CROSS JOIN range(0, 6) r(k)),
m AS (SELECT i.doc_id, i.seq, t, y, least(abs(y - bottom), abs(top - y)) AS gap, CASE WHEN t LIKE 'Figure%' AND least(abs(y - bottom), abs(top - y)) <= 200 THEN 1 WHEN y BETWEEN bottom AND bottom + 120 THEN 2 WHEN y BETWEEN top - 120 AND top THEN 3 END AS r FROM i JOIN b ON i.doc_id = b.doc_id AND i.page = b.page),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY r, gap, y) AS n FROM m WHERE r IS NOT NULL) SELECT i.doc_id, i.seq, best.t AS found_caption FROM i LEFT JOIN best ON best.doc_id = i.doc_id AND best.seq = i.seq AND n = 1"""
)
def image_caption(spark, sf_dir):
    """The caption of each image from the text blocks of its page."""
    images = corpus.sql(spark, sf_dir, _IMAGES).select("doc_id", "seq", "page", "top", (F.col("top") + 50).alias("bottom"))
    k = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")
    blocks = images.select("doc_id", "page").distinct().select("doc_id", "page", k)
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit("Figure "), "page", F.lit("-"), "k")).otherwise(F.concat(F.lit("text "), "k"))
    blocks = blocks.select("doc_id", "page", ((F.col("doc_id") * 7 + F.col("page") * 13 + F.col("k") * 90) % 700).alias("y"), text.alias("text"))
    return structure.image_captions(images, blocks).select("doc_id", "seq", "found_caption")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS page, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 7)::INT END AS image FROM part")
def diagram_locate(spark, sf_dir):
    """Page and number within the page of images, from their ids; ids of another form give none."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("diagram_f"), "p_size")).otherwise(F.concat(F.lit("diagram_p"), "p_size", F.lit("_i"), F.col("p_partkey") % 7))
    return table(spark, sf_dir, "part").select("p_partkey", T.diagram_page(name).alias("d")).select("p_partkey", F.col("d.page").cast("int").alias("page"), F.col("d.image").cast("int").alias("image"))


class Vision:
    """A describer for tests: the caption in the four parts of a reply, or an error for an image without bytes."""

    def describe(self, image: bytes, caption: str) -> str:
        if not image:
            raise ValueError("no image")
        return f"VISUALIZATION_TYPE: flow\nRELATIONSHIPS_AND_DATA: {caption} leads on\nKEY_INSIGHTS: {len(image)} bytes\nCONTEXT: none given"


def _vision() -> Vision:
    return Vision()


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN 'flow' END AS kind, CASE WHEN p_partkey % 5 > 0 THEN p_name || ' leads on' END AS relationships, CASE WHEN p_partkey % 5 > 0 THEN length(p_name) || ' bytes' END AS insights, CASE WHEN p_partkey % 5 > 0 THEN
 '**Type**: flow' || chr(10) || chr(10) || '**Relationships**: ' || p_name || ' leads on' || chr(10) || chr(10) || '**Key Insights**: ' || length(p_name) || ' bytes' || chr(10) || chr(10) || '**Context**: none given' END AS description, CASE WHEN p_partkey % 5 = 0 THEN 'no image' END AS describe_error FROM part"""
)
def diagram_llm(spark, sf_dir):
    """Replies of a plugged-in vision model, told apart in their parts; a failure is data."""
    image = F.when(F.col("p_partkey") % 5 > 0, F.encode("p_name", "UTF-8"))
    rows = parsers.describe_images(table(spark, sf_dir, "part").select("p_partkey", image.alias("image"), F.col("p_name").alias("caption")), _vision)
    return rows.select("p_partkey", "analysis.kind", "analysis.relationships", "analysis.insights", "analysis.description", "describe_error")


# --- chunks -----------------------------------------------------------------

_DEFINED = base.ORACLES["acr_define"]
_IN_CHUNKS = "in_chunk AS (SELECT DISTINCT chunk_seq, unnest(regexp_extract_all(content, '[\\p{L}\\p{N}_]+')) AS w FROM rows_)"
_MAPS = f"{_IN_CHUNKS}, m AS (SELECT chunk_seq, string_agg(acronym || '=' || definition, ';' ORDER BY acronym) AS acronyms FROM in_chunk JOIN defined ON in_chunk.w = defined.acronym GROUP BY 1)"


def _told(maps: str):
    """A map of acronyms as text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(maps)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query(
    f"""WITH RECURSIVE {base._PATHS.removeprefix("RECURSIVE ")}, defined AS (SELECT * FROM ({_DEFINED}) z WHERE acronym NOT IN {base._COMMON_SQL}),
rows_ AS (SELECT section_seq - 1 AS chunk_seq, '# ' || trim(title) || chr(10) || chr(10) || content AS content, section_number, trim(title) AS section_title, level, parent_section, ((section_seq - 1) // 2 + 2)::INT AS page FROM s), {_MAPS}
SELECT 1::BIGINT AS doc_id, chunk_seq, 'chunk_' || chunk_seq AS chunk_id, content, 'text' AS chunk_type, section_number, section_title, level AS section_level, parent_section, path AS section_path, page AS page_start, page AS page_end, (length(content) // 4)::INT AS token_count, acronyms
FROM rows_ JOIN p USING (section_number) LEFT JOIN m USING (chunk_seq)"""
)
def chunk_doc(spark, sf_dir):
    """Chunks of the whole program: pages to sections, metadata and chunks."""
    rows = pipeline.ingest(corpus.pages(spark, sf_dir)).chunks.withColumn("section_path", F.array_join("section_path", "/")).withColumn("acronyms", _told("acronyms"))
    return rows.select("doc_id", "chunk_seq", "chunk_id", "content", "chunk_type", "section_number", "section_title", "section_level", "parent_section", "section_path", "page_start", "page_end", "token_count", "acronyms")


@query(f"WITH {base._KNOWN_SQL}, defined AS (SELECT * FROM known), rows_ AS ({corpus.CHUNKS}), {_MAPS} SELECT chunk_seq, acronyms FROM rows_ LEFT JOIN m USING (chunk_seq)")
def chunk_acr(spark, sf_dir):
    """The acronyms of each chunk with their definitions."""
    rows = corpus.chunks(spark, sf_dir).withColumn("kind_ord", F.lit(0)).withColumn("kind_seq", F.col("chunk_seq")).withColumn("local_seq", F.lit(0))
    known = metadata.acronym_dictionary(spark).withColumn("doc_id", F.lit(1).cast("long"))
    return chunking._acronym_maps(rows, known, "content").select("chunk_seq", _told("acronyms").alias("acronyms"))


#: Sizes at which the small sections of the corpus are cut, and the SQL for two paragraphs: a heading and a text.
_SIZES = ChunkSizes(size=33, overlap=8, least=10)
_CUT = """f AS (SELECT *, '# ' || title AS head, '# ' || title || chr(10) || chr(10) || content AS body FROM s), k AS (SELECT *, length(body) // 4 AS total, length(head) // 4 + length(content) // 4 > 33 AS apart FROM f),
t AS (SELECT *, (CASE WHEN length(head || '. ') // 4 <= 8 THEN head || '.' ELSE '' END) || chr(10) || chr(10) || content AS carried FROM k),
cut AS (SELECT section_number, 0 AS local_seq, body AS content, total AS tokens, FALSE AS split FROM t WHERE total <= 33
 UNION ALL SELECT section_number, 0, body, total, TRUE FROM t WHERE total > 33 AND NOT apart AND total >= 10 UNION ALL SELECT section_number, 0, head, length(head) // 4, TRUE FROM t WHERE total > 33 AND apart
 UNION ALL SELECT section_number, 1, trim(carried, ' ' || chr(10)), length(carried) // 4, TRUE FROM t WHERE total > 33 AND apart AND length(carried) // 4 >= 10)"""


@query(
    f"""WITH RECURSIVE {base._PATHS.removeprefix("RECURSIVE ")}, {_CUT} SELECT cut.section_number, cut.local_seq::INT AS local_seq, cut.content, cut.tokens::INT AS token_count, p.path AS section_path, coalesce(u.title, '') AS parent_title, CASE WHEN split THEN cut.local_seq > 0 END AS is_continuation
FROM cut JOIN p USING (section_number) JOIN s ON s.section_number = cut.section_number LEFT JOIN s u ON u.section_number = s.parent_section"""
)
def chunk_section(spark, sf_dir):
    """Sections cut into chunks at small sizes, with their place in the hierarchy."""
    nodes = corpus.nodes(spark, sf_dir)
    rows = chunking.chunk_sections(corpus.sections(spark, sf_dir), nodes, metadata.section_paths_by_number(nodes), metadata.references_by_section(corpus.references(spark, sf_dir)), _SIZES)
    return rows.select("section_number", "local_seq", "content", "token_count", F.array_join("section_path", "/").alias("section_path"), F.col("text_meta.parent_title").alias("parent_title"), F.col("text_meta.is_continuation").alias("is_continuation"))


_TABLE_SIZES = ChunkSizes(size=30, overlap=5, least=5)
_MARKDOWN = "'| # | part | supplier |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || i || ' | ' || l_partkey || ' | ' || l_suppkey || ' |', chr(10) ORDER BY i)"


def _section_tables(spark, sf_dir) -> DataFrame:
    number = F.when(F.col("l_orderkey") % 3 > 0, F.concat(F.lit(""), F.col("l_orderkey") % 5 + 1))
    pages = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit(4))).otherwise(F.array(F.lit(4), F.lit(5)))
    none = F.lit(None).cast("array<struct<row:int,col:int,score:double>>")
    return base._order_tables(spark, sf_dir).select(F.lit(1).cast("long").alias("doc_id"), F.col("l_orderkey").alias("table_seq"), F.lit("t").alias("table_id"), "table_number", "caption", "headers", "rows", pages.alias("page_range"), number.alias("section_number"), F.lit("").alias("section_title"), none.alias("confidence"))


def _table_sql(table_rows: str) -> str:
    return f"""r AS ({_LINE_ROWS}), whole AS (SELECT l_orderkey, '**Table ' || l_orderkey || ': Lines**' || chr(10) || chr(10) || {_MARKDOWN} AS content, count(*) AS n FROM r GROUP BY 1),
parts AS (SELECT l_orderkey, (i - 1) // 5 AS part, '**Table ' || l_orderkey || ': Lines** (Rows ' || ((i - 1) // 5 * 5 + 1) || '-' || max(i) || ')' || chr(10) || chr(10) || {_MARKDOWN} AS content FROM r GROUP BY l_orderkey, (i - 1) // 5),
single AS (SELECT l_orderkey, length(content) // 4 <= 30 AND l_orderkey % 2 = 0 AS single, n FROM whole),
cut AS (SELECT l_orderkey, 0 AS part, content, TRUE AS is_complete_table, NULL AS total_chunks FROM whole JOIN single USING (l_orderkey) WHERE single UNION ALL SELECT l_orderkey, part, p.content, FALSE, (n + 4) // 5 FROM parts p JOIN single USING (l_orderkey) WHERE NOT single)
{table_rows}"""


@query(
    f"""WITH {_table_sql(f''', s AS ({corpus.SECTIONS})
SELECT l_orderkey, part::INT AS local_seq, cut.content, (length(cut.content) // 4)::INT AS token_count, is_complete_table, total_chunks::INT AS total_chunks, coalesce(s.section_number, 'unknown') AS section_number, 'Unknown Section' AS section_title, coalesce(s.level, 0) AS section_level, 4 AS page_start, CASE WHEN l_orderkey % 2 = 0 THEN 4 ELSE 5 END AS page_end
FROM cut LEFT JOIN s ON l_orderkey % 3 > 0 AND s.section_number = (l_orderkey % 5 + 1)::VARCHAR''')}"""
)
def chunk_tables(spark, sf_dir):
    """Tables as chunks: whole where they fit on one page, else in parts."""
    nodes = corpus.nodes(spark, sf_dir)
    rows = chunking.chunk_tables(_section_tables(spark, sf_dir), nodes, metadata.section_paths_by_number(nodes), _TABLE_SIZES)
    return rows.select(F.col("kind_seq").alias("l_orderkey"), "local_seq", "content", "token_count", "table_meta.is_complete_table", "table_meta.total_chunks", "section_number", "section_title", F.col("section_level").cast("int").alias("section_level"), "page_start", "page_end")


@query(
    f"""WITH {_table_sql("")} SELECT l_orderkey, part::INT AS local_seq, part * 5 AS first_row, least(part * 5 + 5, n)::BIGINT AS last_row, cut.content AS markdown FROM cut JOIN single USING (l_orderkey) WHERE NOT is_complete_table"""
)
def chunk_table_split(spark, sf_dir):
    """Tables that do not fit, in parts of the least number of rows, each with the header."""
    nodes = corpus.nodes(spark, sf_dir)
    rows = chunking.chunk_tables(_section_tables(spark, sf_dir), nodes, metadata.section_paths_by_number(nodes), _TABLE_SIZES).where("not table_meta.is_complete_table")
    span = F.col("table_meta.row_range")
    return rows.select(F.col("kind_seq").alias("l_orderkey"), "local_seq", span[0].cast("long").alias("first_row"), span[1].cast("long").alias("last_row"), F.col("content").alias("markdown"))


#: Parts as diagrams, some without a description or key elements, some in a section.
_DIAGRAMS = """
SELECT CAST(1 AS BIGINT) AS doc_id, p_partkey AS diagram_seq, concat('diagram_', p_partkey) AS diagram_id, p_name AS caption, concat('2-', p_size) AS figure_number, CAST(p_size AS INT) AS page, CASE WHEN p_partkey % 3 > 0 THEN concat('', p_partkey % 5 + 1) END AS section_number,
       CASE WHEN p_partkey % 2 = 0 THEN 'Some title' END AS section_title, CASE p_partkey % 4 WHEN 0 THEN concat('Flow of ', p_name) WHEN 1 THEN '' WHEN 2 THEN concat('It shows ', p_size, ' steps') END AS diagram_description, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat(p_size, ' steps') WHEN 2 THEN 'boxes' END AS extracted_text
FROM part
"""


@query(
    f"""WITH d AS ({_DIAGRAMS}), s AS ({corpus.SECTIONS}), c AS (SELECT *, nullif(diagram_description, '') AS dd, nullif(extracted_text, '') AS et FROM d)
SELECT diagram_id, concat_ws(chr(10), '**' || caption || '**', chr(10) || dd, CASE WHEN et IS NOT NULL AND NOT contains(coalesce(dd, ''), et) THEN chr(10) || '**Key Elements**: ' || et END, chr(10) || '*Located on page ' || page || '*') AS content,
 coalesce(c.section_number, 'unknown') AS section_number, coalesce(s.title, c.section_title, 'Unknown Section') AS section_title, coalesce(s.level, 0) AS section_level, dd IS NOT NULL AS has_relationship_analysis, et IS NOT NULL AS has_extracted_data FROM c LEFT JOIN s ON s.section_number = c.section_number"""
)
def chunk_diagrams(spark, sf_dir):
    nodes = corpus.nodes(spark, sf_dir)
    rows = chunking.chunk_diagrams(corpus.sql(spark, sf_dir, _DIAGRAMS), nodes, metadata.section_paths_by_number(nodes))
    return rows.select("diagram_meta.diagram_id", "content", "section_number", "section_title", F.col("section_level").cast("int").alias("section_level"), "diagram_meta.has_relationship_analysis", "diagram_meta.has_extracted_data")


# --- all metadata, sources, sinks -------------------------------------------

@query(f"WITH s AS ({corpus.SECTIONS}) SELECT (SELECT count(*) FROM s) AS n_sections, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_tables, (SELECT count(*) FROM part) AS n_diagrams, (SELECT count(*) FROM ({base.ORACLES['acr_define']}) a WHERE acronym NOT IN {base._COMMON_SQL}) AS n_acronyms, (SELECT count(*) FROM ({base.ORACLES['xref_dedup']}) x) AS n_references")
def meta_all(spark, sf_dir):
    """Counts of all that is extracted of the corpus."""
    found = metadata.all_metadata(corpus.sections(spark, sf_dir), _section_tables(spark, sf_dir), corpus.sql(spark, sf_dir, _DIAGRAMS))
    counted = lambda name: found[name].agg(F.count("*").alias(f"n_{name}"))
    sums = found["summary"].agg(*[F.sum(c).alias(c) for c in ("n_sections", "n_tables", "n_diagrams")])
    return sums.crossJoin(counted("acronyms")).crossJoin(counted("cross_references").withColumnRenamed("n_cross_references", "n_references"))  # one row each


@query(f"SELECT chunk_id, content, section_number FROM ({corpus.CHUNKS}) c")
def sink_store(spark, sf_dir):
    """Chunks stored with their settings and loaded again."""
    path, settings = _scratch(spark), {"dimension": 64, "index_type": "flat"}
    tables.save_store(corpus.chunks(spark, sf_dir), path, settings)
    return tables.load_store(spark, path, settings).select("chunk_id", "content", "section_number")


@query(f"SELECT chunk_type, chunk_id, content FROM ({corpus.CHUNKS}) c")
def sink_chunks(spark, sf_dir):
    """Chunks written and read again."""
    path = _scratch(spark)
    tables.write_chunks(corpus.chunks(spark, sf_dir), path)
    return spark.read.parquet(path).select("chunk_type", "chunk_id", "content")


@query(f"SELECT chunk_id, chunk_type, section_number, page_start, content FROM ({corpus.CHUNKS}) c")
def src_json_chunks(spark, sf_dir):
    """Chunks of JSON arrays, a file for the chunks of each part of the corpus."""
    path, columns = _scratch(spark), ["chunk_id", "chunk_type", "section_number", "page_start", "content"]
    rows = corpus.chunks(spark, sf_dir).select(_part(F.col("section_number")).alias("part"), F.struct(*columns).alias("c"))
    rows.groupBy("part").agg(F.to_json(F.collect_list("c")).alias("value")).write.partitionBy("part").text(path)
    return tables.read_chunks(spark, path).select(columns)


def _part(number):
    """The first two numbers of a section: the parts that the corpus is stored in, one document each."""
    return F.substring_index(number, ".", 2)


@query(
    f"""WITH s AS (SELECT *, array_to_string(string_split(section_number, '.')[1:2], '.') AS part FROM ({corpus.SECTIONS}) x)
SELECT part AS title, row_number() OVER (PARTITION BY part ORDER BY section_seq) - 1 AS section_seq, section_number, s.title AS section_title, content, page_start, level, parent_section FROM s"""
)
def src_json_doc(spark, sf_dir):
    """Sections of parsed documents in JSON, one file a document."""
    path, part = _scratch(spark), _part(F.col("section_number")).alias("part")
    one = F.struct("section_seq", "section_number", "title", "content", "page_start", "page_end", "level", "parent_section")
    docs = corpus.sections(spark, sf_dir).groupBy(part).agg(F.array_sort(F.collect_list(one)).alias("sections"))
    docs = docs.select("part", F.to_json(F.struct(F.col("part").alias("title"), "sections", F.lit("raw").alias("raw_text"))).alias("value"))
    docs.repartition("part").write.partitionBy("part").text(path)
    held = tables.read_documents(spark, path)
    rows = held["sections"].withColumnRenamed("title", "section_title").join(held["documents"].select("doc_id", "title"), "doc_id")
    return rows.select("title", "section_seq", "section_number", "section_title", "content", "page_start", "level", "parent_section")


@query(f"SELECT 'sections' AS part, section_number AS name, title, content FROM ({corpus.SECTIONS}) s UNION ALL SELECT 'chunks', chunk_id, section_title, content FROM ({corpus.CHUNKS}) c")
def sink_doc(spark, sf_dir):
    """The relations of documents written as one folder each, and the rows that are found there."""
    path = _scratch(spark)
    tables.write_documents({"sections": corpus.sections(spark, sf_dir), "chunks": corpus.chunks(spark, sf_dir)}, path)
    part = lambda name, key, title: spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("part"), F.col(key).alias("name"), F.col(title).alias("title"), "content")
    return part("sections", "section_number", "title").unionByName(part("chunks", "chunk_id", "section_title"))


@query(base.ORACLES["xref_dedup"])
def sink_meta(spark, sf_dir):
    """Metadata written as JSON and read again."""
    path = _scratch(spark)
    tables.write_metadata({"references": corpus.references(spark, sf_dir)}, path)
    return spark.read.json(f"{path}/references").select("source", "target", "kind", F.col("pattern").cast("int").alias("pattern"), "context")


@query(f"SELECT query_id, query, 'kind' || (query_id % 5) AS category, (query_id % 5 + 1)::VARCHAR AS expected_sections FROM ({corpus.QUESTIONS}) q")
def src_queries(spark, sf_dir):
    """Gold questions of JSON arrays, a file for a hundred conversations."""
    path = _scratch(spark)
    kind, expected = F.concat(F.lit("kind"), F.col("query_id") % 5), F.array((F.col("query_id") % 5 + 1).cast("string"))
    gold = F.struct(F.col("query_id").cast("int").alias("id"), "query", kind.alias("category"), expected.alias("expected_sections"))
    asked = corpus.questions(spark, sf_dir).select(F.floor(F.col("query_id") / 10_000).alias("block"), gold.alias("q"))
    asked.groupBy("block").agg(F.to_json(F.collect_list("q")).alias("value")).write.partitionBy("block").text(path)
    return tables.read_questions(spark, path).select(F.col("query_id").cast("long").alias("query_id"), "query", "category", F.array_join("expected_sections", ",").alias("expected_sections"))


def _broken(spark, path):
    raise ValueError(f"no parser for {path}")


_TEXT_OF = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '(?i)<(br|/p|/h\\d|/li|/tr|/div)[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g')"


@query(f"SELECT page_id AS doc_id, {_TEXT_OF} AS text FROM pages")
def src_parse(spark, sf_dir):
    """Pages by the second parser, as the first one fails."""
    read = tables.parse_with_fallback(_broken, lambda spark, path: tables.page_tables(spark.read.parquet(path)))
    return read(spark, f"{sf_dir}/pages.parquet").select("doc_id", "text")


@query(f"SELECT page_id AS doc_id, 1 AS page_no, {_TEXT_OF} AS text FROM pages")
def src_pdf_pages(spark, sf_dir):
    """Page texts of the HTML table."""
    return tables.page_tables(table(spark, sf_dir, "pages")).select("doc_id", "page_no", "text")


class FormFeeds:
    """A page parser for plain text: pages part at form feeds."""

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")


class Headed:
    """A layout parser for plain text: a line that begins with # is a section."""

    def items(self, content: bytes) -> list[dict]:
        lines = content.decode("utf-8").split("\n")
        return [{"label": "section_header" if x.startswith("#") else "text", "level": len(x) - len(x.lstrip("#")) or None, "text": x.lstrip("# "), "page": 1} for x in lines]


def _form_feeds() -> FormFeeds:
    return FormFeeds()


def _headed() -> Headed:
    return Headed()


@query("SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(12)), 1)::INT AS page_no, unnest(string_split(coalesce(text, ''), chr(12))) AS text FROM documents")
def src_binary_pages(spark, sf_dir):
    """Pages of files by a plugged-in page parser."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return parsers.parse_pages(files, _form_feeds).select("doc_id", "page_no", "text")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents WHERE text IS NOT NULL) SELECT doc_id, seq, CASE WHEN starts_with(line, '#') THEN 'section_header' ELSE 'text' END AS label, ltrim(line, '# ') AS text FROM l")
def src_docling(spark, sf_dir):
    """Items of files by a plugged-in layout parser."""
    files = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return parsers.parse_layout(files, _headed).select("doc_id", "seq", "label", "text")


_SETTINGS = {"chunking": {"chunk_size": 500}, "retrieval": {"strategy": "vector"}}


@query("SELECT doc_id, ceil((length(text) // 4) / 500)::BIGINT AS parts, (length(text) // 4) > 150 AS overlaps, 'vector' AS strategy, 5 AS top_k, 'key' AS api_key, NULL::VARCHAR AS missing FROM documents")
def src_config(spark, sf_dir):
    """Settings over defaults, with a key from the environment, at work on documents."""
    held = config.Config.load(_SETTINGS, {"GROQ_API_KEY": "key"})
    tokens = T.token_count(F.col("text"))
    parts, overlaps = F.ceil(tokens / held.get("chunking.chunk_size")), tokens > held.get("chunking.chunk_overlap")
    kept = {"strategy": "retrieval.strategy", "top_k": "retrieval.top_k", "api_key": "groq.api_key"}
    missing = F.lit(held.get("no.such")).cast("string").alias("missing")
    return table(spark, sf_dir, "documents").select("doc_id", parts.alias("parts"), overlaps.alias("overlaps"), *[F.lit(held.get(p)).alias(n) for n, p in kept.items()], missing)


@query("SELECT doc_id, (length(text) // 4) >= 50 AS enough, round((length(text) // 4) * 0.5, 6)::DOUBLE AS weight, TRUE AS whole, lang FROM documents WHERE lang = 'en'")
def src_env(spark, sf_dir):
    """Environment strings as the kinds of their settings, at work on documents."""
    least, share, whole = config.cast("50", int), config.cast("0.5", float), config.cast(" On ", bool)
    tokens = T.token_count(F.col("text"))
    rows = table(spark, sf_dir, "documents").where(F.col("lang") == config.cast("en", str))
    return rows.select("doc_id", (tokens >= least).alias("enough"), F.round(tokens * share, 6).alias("weight"), F.lit(whole).alias("whole"), "lang")
