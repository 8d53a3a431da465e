"""Packing: ids of the library for any text, and every id in exactly one piece."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"abzABZ019.,'\"(-<|>_/#", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x00", "\x85", "\xa0", " ", " ", " ", " ", "　", "’", "«"]
ALPHABET += ["é", "ß", "×", "÷", "Ñ", "ª", "µ", "²", "½", "é", "̈", "Ж", "д", "ż", "漢", "字", "٣", "😀", "​", "﻿", "᠎", "'s", "'ll", "n't", "<|endoftext|>", "the", " House", "2024"]


@pytest.fixture(scope="module")
def library():
    return packing.PieceCoder(PATH, 0).tokenizer


def wanted(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_of_odd_strings_equal_the_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    coder = packing.PieceCoder(PATH, 0)
    ids, bounds = coder.encode(pa.array(texts))
    found = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    wrong = [t for t, a, b, w in zip(texts, bounds[:-1], bounds[1:], found, strict=True) if ids[a:b].tolist() != [*w, 0]]
    assert wrong == []


def test_a_slice_of_an_array_and_no_texts(library):
    coder = packing.PieceCoder(PATH, 0)
    ids, bounds = coder.encode(pa.array(["skip me", "a<|endoftext|> b", None, ""]).slice(1))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [wanted(library, "a<|endoftext|> b"), [0], [0]]


def test_tail_sizes():
    assert packing.tail_sizes(0) == [] and packing.tail_sizes(700) == [512, 128, 32, 16, 8, 4] and packing.tail_sizes(1) == [1]


@pytest.mark.parametrize("length", [16, 1024])
def test_every_id_is_in_one_piece(spark, tmp_path, library, length):
    rng = random.Random(length)
    rows = [(i if i != 7 else None, " ".join(rng.choice(["one", "two,", "drei", "é"]) for _ in range(rng.randint(0, 60))), "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "long word " * 4000, "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5, "text")
    pieces = packing.pack_documents(docs, PATH, f"{tmp_path}/tokens", length=length)
    got = [r.asDict() for r in pieces.collect()]
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    sizes = []
    for _, held in sorted(by_sequence.items()):
        held.sort(key=lambda r: r["offset"])
        at = 0
        for r in held:
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"] > 0
            at += r["length"]
        sizes.append(at)
    total = sum(len(wanted(library, r[1])) for r in rows)
    assert sum(sizes) == total and sizes[: total // length] == [length] * (total // length) and sizes[total // length :] == packing.tail_sizes(total % length)
    # the pieces of the concatenation, in its order, are whole documents
    documents, held = [], b""
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["start"] * 4 == len(held)
        held += bytes(r["ids"])
        if len(held) == 4 * r["doc_tokens"]:
            documents.append((r["doc_id"], np.frombuffer(held, "<u4").tolist()))
            held = b""
    assert held == b""
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(documents, key=key) == sorted([(r[0], wanted(library, r[1])) for r in rows], key=key)
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    for k, held in by_sequence.items():
        assert bytes(whole[k]["tokens"]) == b"".join(bytes(r["ids"]) for r in held) and whole[k]["n_tokens"] == sizes[k]
        assert [(p["doc_id"], p["start"], p["length"], p["offset"]) for p in whole[k]["pieces"]] == [(r["doc_id"], r["start"], r["length"], r["offset"]) for r in held]


def test_empty_table_and_odd_length(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty, PATH, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        packing.cut_tokens(empty, 1000)


def test_ids_may_be_names(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one"), ("b", "two")], "doc_id string, text string")
    assert {r["doc_id"] for r in packing.pack_documents(docs, PATH, f"{tmp_path}/named").collect()} == {"a", "b"}


def test_the_query_covers_the_table(spark, library):
    rows = queries.op12_pack(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    total = 0
    for r in rows:
        ids = wanted(library, texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
        total += r["length"]
    assert total == sum(len(wanted(library, t)) for t in texts.values())
    assert spark.createDataFrame(rows).agg(F.countDistinct("doc_id")).first()[0] == len(texts)
