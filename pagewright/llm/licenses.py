"""License scan by conditional compression.

A template's anchors are so many of its longest words that a notice within the bound of
differences keeps one of them; a text without any is no candidate (native filter; the text is never
cut).  A candidate's lines are read on as one sequence of words, so that notices may be
wrapped, and cut into overlapping windows of which one holds any notice whole.  Each window
with an anchor is compressed alone and with each template as a raw zstandard dictionary.
The templates are ranked by how much of their own size they save; those that save
``LEAST_SAVING`` of it or more are put to exact word edit distance, in that order, and what is within
the bound is a notice.  Windows fit their templates' lengths, in classes by powers of two.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices of common licences, by SPDX identifier.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Passages by which the texts of licences are known, as files and source headers carry them; what stands behind # tells a passage from the notice.
PASSAGES: dict[str, str] = {
    "Apache-2.0#header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "GPL-3.0#header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC#grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT#grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "Unlicense#grant": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}
#: Differing words that a confirmed notice may have, as a share of the template's words.
MAX_DIFFERENCE = 0.2
#: What a template must save on a window to be put to the exact test, as a share of what it saves on its own words.
LEAST_SAVING = 0.05
_WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")


def words(text: str) -> list[str]:
    """Lower-cased words without punctuation at their ends; marks that hold no letter or digit, as of comments, are none."""
    return _WORD.findall(text.lower())


def _compressor(**more) -> zstandard.ZstdCompressor:
    """The same parameters for all inputs and dictionaries, so that sizes can be compared."""
    fixed = zstandard.ZstdCompressionParameters(
        window_log=14, chain_log=12, hash_log=12, search_log=4, min_match=3, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False
    )
    return zstandard.ZstdCompressor(compression_params=fixed, **more)


class Template:
    """A template's words, the differences it allows, its anchors, its compressor and what it saves on itself."""

    def __init__(self, name: str, text: str, max_difference: float, plain: zstandard.ZstdCompressor):
        self.name, self.words = name, words(text)
        self.most = int(max_difference * len(self.words))
        different = sorted(set(self.words), key=lambda w: (-len(w), w))
        count, kept = Counter(self.words), 0
        self.anchors: list[str] = []
        for word in different:  # differences may take away ``most`` words, wherever they stand
            if kept > self.most:
                break
            self.anchors.append(word)
            kept += count[word]
        data = " ".join(self.words).encode("utf-8", "surrogatepass")
        self.primed = _compressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) if len(data) >= 8 else plain
        self.own = max(1, len(plain.compress(data)) - len(self.primed.compress(data)))
        #: Words of a window half; a notice is no longer.
        self.reach = 1 << max(3, (len(self.words) + self.most - 1).bit_length())

    @property
    def always(self) -> bool:
        """Whether so many differences are allowed that nothing need be kept."""
        return len(self.words) <= self.most


class Scanner:
    """Templates by the length of their windows."""

    def __init__(self, templates: Mapping[str, str], max_difference: float):
        self.plain = _compressor()
        self.templates = [t for t in (Template(n, x, max_difference, self.plain) for n, x in sorted(templates.items())) if t.words and not t.always]
        self.classes: dict[int, list[Template]] = defaultdict(list)
        for t in self.templates:
            self.classes[t.reach].append(t)

    def pattern(self) -> str:
        """A pattern for texts that may hold an anchor, as Spark's engine reads it."""
        anchors = sorted({w for t in self.templates for w in t.anchors})
        return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in anchors) + ")" if anchors else "(?!)"

    def ranked(self, window: list[str], templates: list[Template]) -> list[tuple[float, int, Template]]:
        """``(share of its own size that it saves, bytes saved, template)``, best first, ties by name."""
        data = " ".join(window).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(data))
        saved = [(alone - len(t.primed.compress(data)), t) for t in templates]
        return sorted(((n / t.own, n, t) for n, t in saved), key=lambda x: (-x[0], x[2].name))

    def notices(self, mine: list[str]) -> list[tuple[str, int, int, int, int]]:
        """``(template, bytes saved, differing words, begin, end)`` of every confirmed stretch."""
        out = []
        for reach, templates in self.classes.items():
            anchors = {w: [t for t in templates if w in t.anchors] for t in templates for w in t.anchors}
            marked: dict[int, set[str]] = defaultdict(set)
            for i, word in enumerate(mine):
                for t in anchors.get(word, ()):
                    marked[i // reach].add(t.name)
                    if i >= reach:
                        marked[i // reach - 1].add(t.name)
            near: dict[str, list[tuple[int, int, int, int]]] = defaultdict(list)
            for w, names in sorted(marked.items()):
                window = mine[w * reach : (w + 2) * reach]
                held = Counter(window)
                for share, saved, t in self.ranked(window, [t for t in templates if t.name in names]):
                    if share < LEAST_SAVING:
                        break
                    if (Counter(t.words) & held).total() >= len(t.words) - t.most:
                        near[t.name] += [(cost, w * reach + a, w * reach + b, -saved) for cost, a, b in stretches(window, t.words, t.most)]
            for name, found in near.items():
                out += [(name, -less, cost, a, b) for cost, a, b, less in _disjoint(found)]
        return out


@lru_cache(maxsize=8)
def scanner(templates: tuple[tuple[str, str], ...], max_difference: float) -> Scanner:
    """A worker's scanner for given templates."""
    return Scanner(dict(templates), max_difference)


def savings(block: str, templates: Mapping[str, str] = TEMPLATES) -> list[tuple[int, str]]:
    """``(bytes saved, template)`` by compression of a block's words, in the order of ``Scanner.ranked``."""
    held = scanner(tuple(sorted(templates.items())), MAX_DIFFERENCE)
    return [(saved, t.name) for _, saved, t in held.ranked(words(block), held.templates)]


def _disjoint(found: list[tuple]) -> list[tuple]:
    """Of ``(differences, begin, end, …)`` that overlap the closest, the first of equals."""
    taken: list[tuple] = []
    for one in sorted(found):
        at = bisect(taken, one[1], key=lambda x: x[1])
        if (at == 0 or taken[at - 1][2] <= one[1]) and (at == len(taken) or one[2] <= taken[at][1]):
            taken.insert(at, one)
    return taken


def stretches(mine: list[str], theirs: list[str], most: int) -> list[tuple[int, int, int]]:
    """``(differences, begin, end)`` of the stretches of ``mine`` that are ``theirs`` up to ``most`` words.

    Differences are words to delete, insert or replace.  Of overlapping stretches
    the closest one counts; what lies before and after a stretch is no difference.
    """
    costs, begins, near = list(range(len(theirs) + 1)), [0] * (len(theirs) + 1), []
    for j, other in enumerate(mine, 1):
        last, first, costs[0], begins[0] = costs[0], begins[0], 0, j
        for i, word in enumerate(theirs, 1):
            cost, begin = last + (word != other), first
            if costs[i] + 1 < cost:
                cost, begin = costs[i] + 1, begins[i]
            if costs[i - 1] + 1 < cost:
                cost, begin = costs[i - 1] + 1, begins[i - 1]
            last, first, costs[i], begins[i] = costs[i], begins[i], cost, begin
        if costs[-1] <= most and begins[-1] < j:
            near.append((costs[-1], begins[-1], j))
    return _disjoint(near)


def differences(block: str, template: str) -> int:
    """Words to delete, insert or replace between the template and its closest stretch of the block."""
    theirs = words(template)
    return min((x[0] for x in stretches(words(block), theirs, len(theirs))), default=len(theirs))


def scan_block(block: str, templates: Mapping[str, str] = TEMPLATES, max_difference: float = MAX_DIFFERENCE) -> list[tuple[str, int, int]]:
    """``(template, bytes saved, differing words)`` of every confirmed notice of a block, best first."""
    return sorted((x[2:] for x in scan_text(block, templates, max_difference)), key=lambda x: (x[2], -x[1], x[0]))


def scan_text(text: str, templates: Mapping[str, str] = TEMPLATES, max_difference: float = MAX_DIFFERENCE) -> list[tuple[int, int, str, int, int]]:
    """``(line, number on that line, template, bytes saved, differing words)`` of every confirmed notice, by the line where it begins."""
    lines = [words(x) for x in text.split("\n")]
    mine, line_of = [w for line in lines for w in line], [i for i, line in enumerate(lines) for _ in line]
    held = scanner(tuple(sorted(templates.items())), max_difference)
    found = [(line_of[begin], edits, -saved, name, begin) for name, saved, edits, begin, _ in held.notices(mine)]
    out: list[tuple[int, int, str, int, int]] = []
    for line, edits, cost, name, _ in sorted(found):
        out.append((line, out[-1][1] + 1 if out and out[-1][0] == line else 0, name, -cost, edits))
    return out


def _scan(docs: DataFrame, id_col: str, text_col: str, templates: Mapping[str, str] = TEMPLATES, max_difference: float = MAX_DIFFERENCE) -> DataFrame:
    held = Scanner(templates, max_difference)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(held.pattern()))
    fixed = dict(templates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, text in enumerate(batch.column("text")) for x in scan_text(text.as_py(), fixed, max_difference)]
            at = pa.array([r[0] for r in rows], pa.int64())
            found = [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.string()), (4, pa.int32()), (5, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *found], names=["doc_id", "line", "nth", "license", "saved_bytes", "differences"])

    return base.mapInArrow(work, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, line int, nth int, license string, saved_bytes int, differences int")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, max_difference: float = MAX_DIFFERENCE) -> DataFrame:
    """``(doc_id, line, license, saved_bytes, differences)``, one row a confirmed notice.

    ``line``, from 0, is that where the notice begins.  Where templates share words,
    each one within the bound has its row.  Null and empty texts have none; rows that
    repeat an id each give their own; an empty table gives an empty one.
    """
    return _scan(docs, id_col, text_col, templates, max_difference).drop("nth")


def document_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(doc_id, n_lines, licenses, least_differences)`` for every document id.

    ``n_lines`` counts the lines where notices begin; ``licenses`` joins the sorted names, up to any ``#``, with ``;`` (empty: none found),
    ``least_differences`` is null then.  Repeated ids give one row; an empty table gives an empty one.
    """
    found = _scan(docs, id_col, text_col, **options)
    summed = found.groupBy("doc_id").agg(
        F.count_if(F.col("nth") == 0).alias("n_lines"), F.array_join(F.array_sort(F.collect_set(F.substring_index("license", "#", 1))), ";").alias("licenses"), F.min("differences").alias("least_differences")
    )
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    joined = ids.join(summed.withColumnRenamed("doc_id", "__pw_id"), F.col("doc_id").eqNullSafe(F.col("__pw_id")), "left")
    return joined.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("licenses", F.lit("")).alias("licenses"), "least_differences")
