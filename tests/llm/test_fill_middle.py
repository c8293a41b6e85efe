"""Fill-in-the-middle against a plain version, and back to the text."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tonegrid.llm import fill_middle

TEXTS = [None, "", "\n", "\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "has <P> in it\nx", "<S>", "x\n<M>", "<P\nS>\n<", "<\n<S\nS>", "é\U0001f600\n日本\r\nz\x00\n", "l\n" * 50_000 + "t" * 100_000, "same\ntwo\n", "same\ntwo\n"]


def plain_version(doc_id, text, seed=7, rate=100, share=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < share:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "share"), [(100, 50), (30, 0), (0, 100)])
def test_every_row(spark, rate, share):
    rows = [(i, t) for i in range(12) for t in TEXTS] + [(None, "no\nid\n")]
    df = spark.createDataFrame([(i, t, "clash", "x", 5) for i, t in rows], "doc_id long, text string, output string, _fim0 string, N int")
    made = fill_middle.rearrange(df, rate=rate, suffix_first=share)
    assert made.columns == ["doc_id", "text", "_fim0", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fill_middle.restore()).collect()
    assert sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr) == sorted(((i, t, *plain_version(i, t, rate=rate, share=share)) for i, t in rows), key=repr)
    assert all(r["back"] == (r["text"] or "") for r in got)


def test_other_ids_and_empty(spark):
    df = spark.createDataFrame([("k1", "a\nb\n"), ("k2", "c")], "key string, body string")
    got = {r["key"]: r["output"] for r in fill_middle.rearrange(df, id_col="key", text_col="body").collect()}
    assert got == {k: plain_version(k, t)[4] for k, t in (("k1", "a\nb\n"), ("k2", "c"))}
    assert fill_middle.rearrange(df.limit(0), id_col="key", text_col="body").collect() == []


def test_half_have_the_suffix_first(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text"))
    share = fill_middle.rearrange(docs, rate=60).groupBy("form").count().collect()
    counts = {r["form"]: r["count"] / 2000 for r in share}
    assert abs(counts["plain"] - 0.4) < 0.05 and abs(counts["spm"] - counts["psm"]) < 0.06
