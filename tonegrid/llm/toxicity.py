"""Toxicity: a factorization machine over hashed terms, fitted on labelled documents."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.common import slices, whole
from tonegrid.session import materialize

#: Hash buckets of terms.
BUCKETS = 1 << 20
#: Besides whole words, their beginnings of these lengths are terms: compounds and inflections share them.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Characters worked on at once.
SLICE = 1 << 20


def word_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of some texts: per token its text and its distinct word, and per distinct word its term buckets (-1: none)."""
    letters = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pM]+", " ")
    lists = pc.utf8_split_whitespace(letters)
    of_text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    tokens = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    terms = np.full((len(words), len(BEGINNINGS) + 1), -1, np.int64)

    def hashed(strings: pa.Array, seed: int) -> np.ndarray:
        return np.fromiter((crc32(b, seed) % BUCKETS for b in strings.cast(pa.binary()).to_pylist()), np.int64, len(strings))

    terms[:, 0] = np.where(filled, hashed(words, 0), -1)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for i, n in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(lengths > n)
        starts = pc.utf8_slice_codeunits(words.take(pa.array(longer)), 0, n).dictionary_encode()
        terms[longer, i] = hashed(starts.dictionary, n)[starts.indices.to_numpy(zero_copy_only=False)]
    return of_text, tokens, terms


def text_features(texts: pa.Array, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the terms; features are buckets, or places in ``slots`` where that is not -1."""
    of_text, tokens, terms = word_terms(texts)
    if slots is not None:
        terms = np.where(terms >= 0, slots[terms], -1)
    of_word, column = np.nonzero(terms >= 0)
    order = np.bincount(of_word, minlength=len(terms))
    starts = np.cumsum(order) - order
    flat = terms[of_word, column]
    times = order[tokens]
    places = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[tokens], times)
    key, counts = np.unique(np.repeat(of_text, times) * BUCKETS + flat[places], return_counts=True)
    return key // BUCKETS, key % BUCKETS, counts


def strength(counts: np.ndarray) -> np.ndarray:
    """How much a term that occurs so often counts."""
    return np.minimum(np.log2(1.0 + counts), 3.0)


class Machine:
    """Bias, weights and factors of the chosen buckets."""

    def __init__(self, buckets: np.ndarray, factors: int, seed: int = 7):
        self.buckets = np.asarray(buckets, np.int64)
        self.bias = 0.0
        self.weights = np.zeros(len(self.buckets))
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (len(self.buckets), factors))

    def slots(self) -> np.ndarray:
        table = np.full(BUCKETS, -1, np.int64)
        table[self.buckets] = np.arange(len(self.buckets))
        return table

    def raw(self, of_text, feature, x, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the factor sums they come from."""
        xv = self.factors[feature] * x[:, None]
        sums = np.stack([np.bincount(of_text, xv[:, f], n) for f in range(xv.shape[1])], 1) if len(feature) else np.zeros((n, self.factors.shape[1]))
        squares = np.bincount(of_text, (xv**2).sum(1), n)
        linear = np.bincount(of_text, self.weights[feature] * x, n)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def fit(self, of_text, feature, x, y, epochs: int, rate: float, decay: float, batch: int, seed: int = 11) -> None:
        """Logistic loss, mini-batches with per-parameter step sizes; rows are sorted by text."""
        rng = np.random.default_rng(seed)
        n = len(y)
        starts = np.searchsorted(of_text, np.arange(n + 1))
        g_w, g_v, g_b = np.full(len(self.weights), 1e-2), np.full(self.factors.shape, 1e-2), 1e-2
        for _ in range(epochs):
            mixed = rng.permutation(n)
            for at in range(0, n, batch):
                some = mixed[at : at + batch]
                sizes = starts[some + 1] - starts[some]
                rows = np.repeat(starts[some], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                of, feat, xs = np.repeat(np.arange(len(some)), sizes), feature[rows], x[rows]
                raw, sums = self.raw(of, feat, xs, len(some))
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) / len(some)
                g = error.sum()
                g_b += g * g
                self.bias -= rate * g / np.sqrt(g_b)
                pull = error[of] * xs
                used, place = np.unique(feat, return_inverse=True)
                d_w = np.bincount(place, pull, len(used)) + decay * self.weights[used]
                own = self.factors[feat] * xs[:, None]
                pulls = pull[:, None] * (sums[of] - own)
                d_v = np.stack([np.bincount(place, pulls[:, f], len(used)) for f in range(own.shape[1])], 1) + decay * self.factors[used]
                g_w[used] += d_w**2
                g_v[used] += d_v**2
                self.weights[used] -= rate * d_w / np.sqrt(g_w[used])
                self.factors[used] -= rate * d_v / np.sqrt(g_v[used])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_docs: int = 20_000, features: int = 2048, factors: int = 8, epochs: int = 40, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """Fit the machine on at most about ``max_docs`` labelled documents, taken by the hash of their id.

    Rows of ``labels`` with a null id or label are left out; several labels of one id count as their largest, several
    texts of one id as their smallest. Over the sample, Spark counts in how many documents each bucket occurs, and in how
    many toxic ones; the ``features`` buckets that differ most from chance enter the machine, all others weigh nothing.
    What the driver holds is bounded by these parameters, whatever the corpus. Without labels the score is constant.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    known = marks.count()
    if known > max_docs:
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * max_docs / known))
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"))
    # the labels of the sample are at most about max_docs rows of two numbers
    sample = rows.join(F.broadcast(marks), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
    sample = materialize(sample.select("_y", "_text"), "toxicity")

    def count(batches):
        for batch in batches:
            y, texts = batch.column(0).to_numpy(), batch.column(1)
            for a, b in slices(pc.utf8_length(texts).to_pylist(), SLICE):
                of_text, bucket, _ = text_features(texts.slice(a, b - a))
                found, place = np.unique(bucket, return_inverse=True)
                toxic = np.bincount(place, y[a:b][of_text], len(found))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(found), "n": pa.array(np.bincount(place, minlength=len(found)).astype(np.int64)), "toxic": pa.array(toxic.astype(np.int64))})

    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("toxic")).head()
    base = total["toxic"] / max(total["n"], 1)
    if not 0 < base < 1:
        machine = Machine(np.zeros(0), factors)
        machine.bias = float(np.log((total["toxic"] + 0.5) / (total["n"] - total["toxic"] + 1.5)))
        return machine
    counts = sample.mapInArrow(count, "bucket long, n long, toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    odd = F.abs(F.col("toxic") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)) + 1)
    chosen = [r["bucket"] for r in counts.orderBy(odd.desc(), "bucket").limit(features).collect()]
    machine = Machine(np.array(sorted(chosen)), factors)
    slots = machine.slots()

    def gather(batches):
        for batch in batches:
            y, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(pc.utf8_length(texts).to_pylist(), SLICE):
                of_text, feature, times = text_features(texts.slice(a, b - a), slots)
                cut = np.searchsorted(of_text, np.arange(b - a + 1)).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(cut), pa.array(v.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(y[a:b], pa.int32()), lists(feature), lists(times)], ["y", "feature", "times"])

    got = sample.mapInArrow(gather, "y int, feature array<int>, times array<int>").toArrow()
    lists = got.column("feature").combine_chunks()
    of_text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    machine.fit(of_text, lists.flatten().to_numpy(), strength(got.column("times").combine_chunks().flatten().to_numpy()), got.column("y").to_numpy(), epochs, rate, decay, 256)
    return machine


def score(text: Column, machine: Machine) -> Column:
    """Chance from 0 to 1 that a whole text is toxic; a null text counts as empty, which has the bias alone."""
    slots_of = machine.buckets

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        slots = np.full(BUCKETS, -1, np.int64)
        slots[slots_of] = np.arange(len(slots_of))
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        out = np.zeros(len(texts))
        for a, b in slices(pc.utf8_length(texts).to_pylist(), SLICE):
            of_text, feature, times = text_features(texts.slice(a, b - a), slots)
            raw, _ = machine.raw(of_text, feature, strength(times), b - a)
            out[a:b] = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
        return pa.array(out)

    return scored(whole(text))
