"""Packing against the tokenizer on whole texts."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tonegrid.llm import packing, queries
from tonegrid.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(queries.word_tokenizer())
    t.encode_special_tokens = True
    return t


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abC' sS.!-_1²é̸́ \x1c\t\n<|>eΣ日\U0001f600"), max_size=60))
def test_words_encode_like_the_text(tokenizer, text):
    known = packing.codes(queries.word_tokenizer())
    old, packing.PART = packing.PART, 7
    try:
        assert np.frombuffer(known.text(text), "<u4").tolist() == plain_ids(tokenizer, text)[:-1]
    finally:
        packing.PART = old


def test_memory_of_words_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    known = packing.Codes(queries.word_tokenizer())
    text = " ".join(f"w{i}" for i in range(50)) + " " + "l" * 100
    assert np.frombuffer(known.text(text), "<u4").tolist() == plain_ids(tokenizer, text)[:-1]
    assert len(known) <= 10 and "l" * 100 not in known


def odd_docs():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["storm", "x-y", "l'été", "<|endoftext|>", "12.5"]) for _ in range(rng.randrange(40)))) for i in range(100)]
    return rows + [(100, None), (101, ""), (102, " \n "), (103, "long words. " * 9000), (104, "same"), (104, "same"), (None, "no id")]


@pytest.mark.parametrize("length", [4096, 50])
def test_pieces(spark, tokenizer, length):
    rows = odd_docs()
    df = spark.createDataFrame([(i, t, 1, "clash", b"x") for i, t in rows], "doc_id long, text string, at int, part string, ids binary").repartition(5)
    pieces = packing.pack(df, queries.word_tokenizer(), length)
    found = pieces.collect()
    want = Counter((i, tuple(plain_ids(tokenizer, t))) for i, t in rows)
    line = sorted(found, key=lambda r: (r["sequence_id"], r["offset"]))
    at, docs, open_ids = 0, Counter(), []
    for r in line:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["sequence_id"] * length + r["offset"], r["start"], r["length"]) == (at, len(open_ids), len(ids)) and ids
        at += len(ids)
        open_ids += ids
        if len(open_ids) == r["doc_tokens"]:
            docs[r["doc_id"], tuple(open_ids)] += 1
            open_ids = []
    assert docs == want and not open_ids
    made = {r["sequence_id"]: r for r in packing.sequences(pieces, length).collect()}
    last = max(made)
    assert sorted(made) == list(range(last + 1)) and all(r["n"] == length for k, r in made.items() if k < last)
    whole = [i for r in line for i in np.frombuffer(r["ids"], "<u4").tolist()]
    for k, r in made.items():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids[: r["n"]] == whole[k * length : (k + 1) * length]
        assert ids[r["n"] :] == [] if r["n"].bit_count() == 1 else len(ids) == length and set(ids[r["n"] :]) <= {packing.END}
        assert [(b["doc_id"], b["start"], b["offset"], b["length"]) for b in r["boundaries"]] == [(p["doc_id"], p["start"], p["offset"], p["length"]) for p in line if p["sequence_id"] == k]


def test_query(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for r in queries.op12(spark, SF).collect():
        ids = plain_ids(tokenizer, texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    pieces = packing.pack(none, queries.word_tokenizer())
    assert pieces.collect() == [] and packing.sequences(pieces).collect() == []
