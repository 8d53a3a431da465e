"""Licences by compression: the ranking decides, loses nothing that an exact search finds, and any template may be passed."""

from __future__ import annotations

import random

import pytest

from pagewright.llm import licenses

BOTH = licenses.TEMPLATES | licenses.PASSAGES


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[at] = f"zq{rng.randrange(999)}x"
        elif kind < 0.75 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, f"ins{rng.randrange(99)}")
    return out


def exact(text, templates):
    """Names and differences by edit distance over the whole text, without any compression."""
    mine, out = licenses.words(text), set()
    for name, template in templates.items():
        theirs = licenses.words(template)
        found = licenses.stretches(mine, theirs, int(licenses.MAX_DIFFERENCE * len(theirs)))
        out |= {(name, cost) for cost, _, _ in found}
    return out


def test_the_ranking_loses_no_edited_notice():
    rng, prose, missed, n = random.Random(11), [f"w{i}" for i in range(400)], [], 0
    common = "the of and under this is to in for with any work file you may public general software version license copyright".split()
    for name, text in BOTH.items():
        words = licenses.words(text)
        for _ in range(60):
            around = [rng.choice(common if rng.random() < 0.3 else prose) for _ in range(rng.choice([0, 20, 400]))]
            at = rng.randint(0, len(around))
            mine = " ".join(around[:at] + edited(rng, words, int(licenses.MAX_DIFFERENCE * len(words))) + around[at:])
            wanted = exact(mine, BOTH)
            got = {(x[2], x[4]) for x in licenses.scan_text(mine, BOTH)}
            n += len(wanted)
            missed += wanted - got
            assert got <= wanted
    print("recall", 1 - len(missed) / n)
    assert len(missed) <= n / 200


def test_without_savings_nothing_is_found(monkeypatch):
    text = "before " + licenses.TEMPLATES["MIT"] + " after " + licenses.TEMPLATES["GPL-3.0"]
    assert {x[2] for x in licenses.scan_text(text, BOTH)} == {"MIT", "GPL-3.0"}
    ranked = licenses.Scanner.ranked
    monkeypatch.setattr(licenses.Scanner, "ranked", lambda self, window, templates: [(0.0, 0, t) for _, _, t in ranked(self, window, templates)])
    assert licenses.scan_text(text, BOTH) == []


def test_templates_are_ranked_by_what_they_save():
    for name, text in licenses.TEMPLATES.items():
        assert licenses.savings(text)[0][1] == name


@pytest.mark.parametrize("n", [50, 10_000])
def test_templates_without_a_licence_word(spark, n):
    own = {"note": "Nur für den internen Gebrauch bestimmt, Weitergabe untersagt.", "short": "all rights reserved"}
    filler = " ".join(f"w{i % 977}" for i in range(n))
    rows = [(1, f"{filler} Nur für den internen GEBRAUCH bestimmt,\n# Weitergabe untersagt. {filler}"), (2, filler), (3, f"{filler} All  rights, reserved {filler}"), (4, None), (5, "rights")]
    got = {(r.doc_id, r.license, r.differences) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=own).collect()}
    assert got == {(1, "note", 0), (3, "short", 0)}
    assert licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates={}).count() == 0


def test_anchors_outlive_the_differences():
    for t in licenses.Scanner(BOTH, licenses.MAX_DIFFERENCE).templates:
        assert sum(t.words.count(w) for w in t.anchors) > t.most and len(t.words) + t.most <= t.reach
