"""Sections of tables, diagrams and pages by an ordered sweep, against plain code."""

from __future__ import annotations

import random

from pagewright.operators import structure

SECTIONS = "doc_id long, section_seq long, level int, section_number string, title string, page_start int, page_end int"


def plain_place(sections, doc, page):
    mine = [s for s in sections if s[0] == doc]
    around = [s for s in mine if s[5] <= page <= max(s[5], s[6])]
    deepest = min(around, key=lambda s: (-s[2], s[1]), default=None)
    before = max((s for s in mine if s[6] <= page), key=lambda s: s[1], default=None)
    return (deepest or before or (None,) * 7)[3], min(around, key=lambda s: s[1], default=(None,) * 7)[3]


def test_tables_and_diagrams_find_their_section(spark):
    rng = random.Random(8)
    sections = []
    for doc in (1, 2, 3):
        for seq in range(1, 40):
            start = rng.randint(1, 60)
            sections.append((doc, seq, rng.randint(1, 4), f"{doc}.{seq}", f"t{seq}", start, start + rng.choice([-2, 0, 0, 1, 5, 30])))
    frame = spark.createDataFrame(sections, SECTIONS).repartition(3)
    asked = [(doc, page) for doc in (1, 2, 3, 4) for page in range(0, 100)] + [(1, 5), (None, 3)]
    tables = spark.createDataFrame([(d, i, [p, p + 1]) for i, (d, p) in enumerate(asked)] + [(1, 9_999, None)], "doc_id long, table_seq long, page_range array<int>")
    got = {r["table_seq"]: r["section_number"] for r in structure.sections_of_tables(tables, frame).collect()}
    assert got == {i: plain_place(sections, d, p)[0] for i, (d, p) in enumerate(asked)} | {9_999: plain_place(sections, 1, 1)[0]}
    diagrams = spark.createDataFrame([(d, i, p) for i, (d, p) in enumerate(asked)], "doc_id long, diagram_seq long, page int")
    got = {r["diagram_seq"]: r["section_number"] for r in structure.sections_of_diagrams(diagrams, frame).collect()}
    assert got == {i: plain_place(sections, d, p)[1] for i, (d, p) in enumerate(asked)}


def test_a_section_of_many_pages_is_two_rows(spark):
    frame = spark.createDataFrame([(1, 1, 1, "1", "all", 1, 100_000_000), (1, 2, 2, "1.1", "some", 500, 600)], SECTIONS)
    tables = spark.createDataFrame([(1, 1, [550]), (1, 2, [99_000_000])], "doc_id long, table_seq long, page_range array<int>")
    found = structure.sections_of_tables(tables, frame)
    assert {r["table_seq"]: r["section_number"] for r in found.collect()} == {1: "1.1", 2: "1"}
    assert structure.sections_of_tables(tables.limit(0), frame).count() == 0
    assert structure.sections_of_diagrams(tables.selectExpr("doc_id", "table_seq", "5 as page"), frame.limit(0)).where("section_number is null").count() == 2


def plain_sections(pages):
    """Headings in order; the rest of a heading's page, then later lines up to the next heading."""
    lines = [(p, i, x.strip()) for p, text in pages for i, x in enumerate(text.split("\n"))]
    heads = [(k, p) for k, (p, _, x) in enumerate(lines) if x[:1].isdigit() and " T" in x]
    out = []
    for n, (k, page) in enumerate(heads):
        end = heads[n + 1][0] if n + 1 < len(heads) else len(lines)
        mine = [x for j, (p, _, x) in enumerate(lines) if j >= k and (p == page or j < end)]
        last = max(p for j, (p, _, _) in enumerate(lines) if j >= k and (p == page or j < end))
        out.append(("\n".join(mine).strip(), page, heads[n + 1][1] if n + 1 < len(heads) else last))
    return out


def test_sections_page_by_page(spark):
    rng = random.Random(9)
    docs = {}
    for doc in range(12):
        docs[doc] = [(p + 1, "\n".join(rng.choice(["1.2 Title here", "text of it", "more", "", "3 Third one", "4.5 Title ......"]) for _ in range(rng.randint(1, 6)))) for p in range(rng.randint(1, 6))]
    rows = [(d, p, t) for d, pages in docs.items() for p, t in pages]
    got = structure.sections_from_pages(spark.createDataFrame(rows, "doc_id long, page_no int, text string").repartition(3))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
    want = {d: [x for x in plain_sections([(p, t.replace("4.5 Title ......", "4.5 dots")) for p, t in pages])] for d, pages in docs.items()}
    found: dict = {d: [] for d in docs}
    for r in got.orderBy("doc_id", "section_seq").collect():
        found[r["doc_id"]].append((r["content"].replace("4.5 Title ......", "4.5 dots"), r["page_start"], r["page_end"]))
    assert found == want
