"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tonegrid.llm import variants


def near(a, b):
    """Exactly one edit between two different words."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def counted(docs, every=31):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            counts[low[: h % len(low)] + low[h % len(low) + 1 :] if h % every == 0 else low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def grouped(words, factor=10):
    form, out = {}, {}
    for w, n in words.items():
        around = sorted((-m, v) for v, m in words.items() if near(w, v))
        best = around[0] if around and -around[0][0] >= factor * n else None
        form[w] = best and best[1]
        out[w] = [w, form[w], None, n, len(around), best and -best[0]]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w][2] = root
    return sorted((tuple(r) for r in out.values()), key=repr)


word_lists = st.lists(st.text("abé", min_size=3, max_size=9), min_size=1, max_size=60, unique=True)


@settings(max_examples=150, deadline=None)
@given(word_lists, st.integers(3, 8))
def test_sets_are_those_one_edit_away(words, size):
    some = [w for w in words if len(w) in (size, size + 1)]
    if not some:
        return
    front, back = (variants.near_sets(some, some, size, side) for side in (True, False))
    for a, row_f, row_b in zip(some, front, back):
        has = lambda row, i: bool(row[i // 64] >> i % 64 & 1)
        for i, b in enumerate(some):
            want = near(a, b) and min(len(a), len(b)) == size
            same = a[: size // 2] == b[: size // 2]
            assert (has(row_f, i), has(row_b, i)) == (want and same, want and not same)


def noisy(words, docs):
    rng = random.Random(4)
    for i in range(docs):
        text = []
        for _ in range(60):
            w = rng.choice(words[: rng.choice([3, 20, len(words)])])
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", "xy", "é"]) + w[at + rng.randint(0, 1) :]
            text.append(w.title() if rng.random() < 0.2 else w)
        yield i, " ".join(text)


WORDS = ["organise", "organize", "colouring", "coloring", "harbour", "harbours", "neighbour", "naïveté", "straßen", "Érablier", "internationalisation", "q" * 70, "short"]
ODD = [(None, "organise organise"), (7, None), (8, ""), (9, "no-long, w0rds here 1234567"), (10, "Éclairée" * 3 + " " + "z" * 30_000), (11, "z" * 30_000 + " " + "z" * 30_001), (12, ("y" * 30_001 + ". ") * 40)]


@pytest.mark.parametrize("hot", [variants.HOT, 5])
def test_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(variants, "HOT", hot)
    monkeypatch.setattr(variants, "BLOCK", 1024 if hot > 5 else 4)
    docs = [*noisy(WORDS, 120), *noisy(WORDS, 10), *ODD]
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in docs], "doc_id long, text string, word string, n int")
    words = variants.vocabulary(df, delete_every=31)
    assert {r["word"]: r["n"] for r in words.collect()} == counted(docs)
    got = sorted((tuple(r) for r in variants.group_variants(words).collect()), key=repr)
    assert got == grouped(counted(docs))
    assert any(r[1] for r in got)


def test_chains_of_forms(spark):
    chain = ["abcdefg" + "x" * i for i in range(7)]
    rows = [(w, 2 * 10**i) for i, w in enumerate(chain)] + [("abcdefy", 20_000_000), ("tiefirst", 40), ("tiesfirst", 400), ("tiefirsts", 400)]
    got = {r["word"]: r for r in variants.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert [got[w]["root"] for w in chain] == ["abcdefy"] + [chain[-1]] * 6
    assert (got["tiefirst"]["form"], got["tiefirst"]["n_near"]) == ("tiefirsts", 2)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.vocabulary(none)).collect() == []
