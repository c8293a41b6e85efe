"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.common import slices, whole
from tonegrid.session import materialize

#: Characters worked on at once.
SLICE = 1 << 21
#: Mean documents of a block of candidates, and mean n-grams.
BLOCK, BLOCK_GRAMS = 256, 200_000
#: Odd multipliers that mix 64 bits.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def banding(threshold: float, recall: float, hashes: int = 256) -> tuple[int, int]:
    """Bands and rows per band: the most rows, and so the fewest false candidates, whose bands still reach the recall.

    Two sets of similarity s share a band with chance 1 - (1 - s^rows)^bands; at the threshold that must be the recall.
    """
    best = None
    for rows in range(1, hashes + 1):
        bands = 1 if threshold >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


@functools.lru_cache(maxsize=4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    return (x ^ (x >> np.uint64(27))) * MIX[0]


def gram_sets(texts: pa.Array, n: int):
    """Sorted 64-bit hashes of every text's different n-grams of lower-case words between ASCII blanks.

    A text of fewer words has one gram, of all its words; a text without words has none.
    """
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    filled = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    indices = coded.indices.to_numpy(zero_copy_only=False)
    used = filled[indices]
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(used)])[ends]  # without the empty words at a text's ends
    words = hashes[indices[used]]
    grams = words.copy()
    for k in range(1, n):
        m = max(len(words) - k, 0)
        grams[:m] = mixed(grams[:m] * MIX[0] + words[k : k + m])
    start = 0
    for end in ends:
        if end - start >= n:
            yield np.unique(grams[start : end - n + 1])
        elif end > start:
            short = np.array([end - start], np.uint64)
            for k in range(start, end):
                short = mixed(short * MIX[0] + words[k])
            yield short
        else:
            yield np.zeros(0, np.uint64)
        start = end


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit hash per band, different between bands, of the minima of its rows' permutations."""
    a, b = permutations(bands * rows)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 4096):
        np.minimum(least, (high[at : at + 4096, None] * a + b).min(0), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64) * MIX[0]
    for column in least.reshape(bands, rows).T:
        out = mixed(out * MIX[0] + column)
    return out.view(np.int64)


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Per document ``_id, _row, _key`` (of its set; null without words), ``_size`` and ``_bands``."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(pc.utf8_length(texts).to_pylist(), SLICE):
                sets = list(gram_sets(texts.slice(a, b - a), n))
                known: dict[bytes, np.ndarray] = {}
                keys = [set_key(s) if len(s) else None for s in sets]
                for key, s in zip(keys, sets, strict=True):
                    if key is not None and key not in known:
                        known[key] = band_hashes(s, bands, rows)
                signs = [known[k] if k is not None else np.zeros(0, np.int64) for k in keys]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in signs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(signs)))],
                    ["_id", "_row", "_key", "_size", "_bands"],
                )

    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), whole(F.col(text_col))).alias("_row"), whole(F.col(text_col)).alias("_text"))
    return source.mapInArrow(run, f"_id {dict(source.dtypes)['_id']}, _row long, _key binary, _size long, _bands array<long>")


def similar(a: list[np.ndarray], b: list[np.ndarray], mask: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the masked pairs of sets have the Jaccard similarity: exact counts of what they share."""
    i, j = np.nonzero(mask)
    out = np.zeros_like(mask)
    if not len(i):
        return out
    sizes_a, sizes_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    fits = np.minimum(sizes_a[i], sizes_b[j]) >= threshold * np.maximum(sizes_a[i], sizes_b[j]) - 1e-9
    i, j = i[fits], j[fits]
    if len(i) <= 4 * (len(a) + len(b)):
        both = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:
        shared = np.zeros((len(a), len(b)), np.float32)
        left, right = np.concatenate(a), np.concatenate(b)
        rows_l, rows_r = np.repeat(np.arange(len(a)), sizes_a), np.repeat(np.arange(len(b)), sizes_b)
        grams = np.intersect1d(left, right)
        keep_l, keep_r = np.isin(left, grams), np.isin(right, grams)
        at_l, at_r = np.searchsorted(grams, left[keep_l]), np.searchsorted(grams, right[keep_r])
        rows_l, rows_r = rows_l[keep_l], rows_r[keep_r]
        for start in range(0, len(grams), 8192):  # products of 0/1 matrices over a stretch of grams
            stop = min(start + 8192, len(grams))
            of_l, of_r = (at_l >= start) & (at_l < stop), (at_r >= start) & (at_r < stop)
            x, y = np.zeros((len(a), stop - start), np.float32), np.zeros((len(b), stop - start), np.float32)
            x[rows_l[of_l], at_l[of_l] - start] = 1
            y[rows_r[of_r], at_r[of_r] - start] = 1
            shared += x @ y.T
        both = shared[i, j].astype(np.int64)
    hit = both >= threshold * (sizes_a[i] + sizes_b[j] - both) - 1e-9
    out[i[hit], j[hit]] = True
    return out


def roots(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Smallest member of each one's component among n places."""
    owner = list(range(n))

    def find(x):
        while owner[x] != x:
            owner[x] = x = owner[owner[x]]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            owner[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def linked(blocks_a: list[dict], blocks_b: list[dict] | None, threshold: float, tell) -> None:
    """Verify the candidates of one block, or between two, and tell each member its links and a member it reaches."""
    members = [*blocks_a, *(blocks_b or [])]
    sets = [np.frombuffer(m["grams"], np.uint64) for m in members]
    bands = np.stack([np.frombuffer(m["bands"], np.int64) for m in members])
    copies = np.array([m["copies"] for m in members])
    n = len(blocks_a)
    left, right = slice(0, n), slice(n, None) if blocks_b else slice(0, n)
    mask = np.zeros((n, len(members[right])), bool)
    for band in range(bands.shape[1]):
        mask |= bands[left, band, None] == bands[right, band]
    if not blocks_b:
        mask = np.triu(mask, 1)
    hits = similar(sets[left], sets[right], mask, threshold)
    i, j = np.nonzero(hits)
    j = j + (n if blocks_b else 0)
    if not len(i):
        return
    links = np.bincount(i, copies[j], len(members)) + np.bincount(j, copies[i], len(members))
    order = np.argsort([m["key"] for m in members])  # roots are the smallest keys
    rank = np.empty(len(members), int)
    rank[order] = np.arange(len(members))
    root = roots(len(members), rank[i], rank[j])
    for place in np.flatnonzero(links):
        tell(members[place]["key"], int(links[place]), members[order[root[rank[place]]]]["key"])


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``_key, _root`` of all ends of the edges (``_a, _b``): the smallest key of its component.

    Every root hooks onto its smallest neighbour, paths are halved, edges are redrawn between the roots that are left and
    lose those within one root; each round is written. Ends when no edge is left.
    """
    both = edges.select("_a", "_b").unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).where("_a <> _b").distinct()
    left = materialize(both, "edges")
    labels = materialize(left.select(F.col("_a").alias("_key"), F.col("_a").alias("_root")).distinct(), "labels")
    for _ in range(rounds):
        if not left.limit(1).count():
            return labels
        up = left.groupBy("_a").agg(F.least(F.col("_a"), F.min("_b")).alias("_up"))
        up = materialize(up, "up")
        higher = up.select(F.col("_a").alias("_up"), F.col("_up").alias("_top"))
        up = up.join(higher, "_up", "left").select(F.col("_a").alias("_from"), F.coalesce("_top", "_up").alias("_to"))
        labels = materialize(labels.join(up, labels["_root"] == up["_from"], "left").select("_key", F.coalesce("_to", "_root").alias("_root")), "labels")
        other = up.select(F.col("_from").alias("_from2"), F.col("_to").alias("_to2"))
        moved = left.join(up, left["_a"] == up["_from"]).join(other, left["_b"] == other["_from2"])
        left = materialize(moved.select(F.col("_to").alias("_a"), F.col("_to2").alias("_b")).where("_a <> _b").distinct(), "edges")
    raise RuntimeError("components did not settle")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``_row``, ``_set``, ``class_id`` and ``n_links``.

    ``n_links`` counts the other documents whose n-gram sets have at least the similarity, copies included; ``class_id``
    is the smallest id that links, one after another, lead to. Documents of equal sets are one member with a count, so
    copies are never paired. Members that share a band hash are candidates. They are packed into blocks of a few hundred,
    neighbours together; two blocks meet once if they share a band hash, and give per member a count and one member it
    reaches, never pairs. A large group of near copies is so verified in full by matrix products.

    Texts without words have no links and their own class; null texts are empty. Repeated ids are separate documents;
    rows with a null id keep it as class id if nothing else is linked to them. ``_row`` hashes id and text; ``_set`` names the class also where
    several have the same smallest id, and is null for texts without words.
    """
    spark = docs.sparkSession
    bands, rows = banding(threshold, recall)
    signs = materialize(signed(docs, n, bands, rows, id_col, text_col), "signs")
    members = signs.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_id").alias("_first"), F.count("*").alias("_copies"), F.min("_row").alias("_row"), F.first("_bands").alias("_bands"), F.first("_size").alias("_size"))
    members = materialize(members, "members")
    banded = members.select("_key", F.explode("_bands").alias("_band"))
    shared = banded.groupBy("_band").agg(F.count("*").alias("_n"), F.min("_key").alias("_least")).where("_n > 1").drop("_n")
    met = materialize(banded.join(shared, "_band"), "met")
    # members of one neighbourhood are dealt into its blocks by their hash
    near = met.groupBy("_key").agg(F.min("_least").alias("_near")).join(members, "_key")
    wide = near.groupBy("_near").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("_size") / BLOCK_GRAMS)).alias("_of"))
    placed = near.join(wide, "_near").withColumn("_block", F.xxhash64("_near", F.pmod(F.xxhash64("_key"), F.col("_of"))))
    placed = materialize(placed.select("_key", "_row", "_copies", "_block", F.col("_bands").alias("_b")), "placed")

    def grams(batches):
        for batch in batches:
            texts = batch.column(4)
            for a, b in slices(pc.utf8_length(texts).to_pylist(), SLICE):
                sets = [s.tobytes() for s in gram_sets(texts.slice(a, b - a), n)]
                marks = [np.asarray(x.values, np.int64).tobytes() for x in batch.column(3).slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(marks, pa.binary()), pa.array(sets, pa.binary())], ["_block", "key", "copies", "bands", "grams"])

    texts = docs.select(whole(F.col(text_col)).alias("_text"), F.xxhash64(F.col(id_col), whole(F.col(text_col))).alias("_row"))
    full = texts.join(placed, "_row").select("_block", "_key", "_copies", "_b", "_text").mapInArrow(grams, "_block long, key binary, copies long, bands binary, grams binary")
    # equal rows are met once
    blocks = full.groupBy("_block", "key").agg(*[F.first(c).alias(c) for c in ("copies", "bands", "grams")])
    blocks = materialize(blocks.groupBy("_block").agg(F.collect_list(F.struct("key", "copies", "bands", "grams")).alias("_members")), "blocks")
    of = met.join(placed.select("_key", "_block"), "_key").select("_band", "_block").distinct()
    many = of.groupBy("_band").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    of = materialize(of.join(many, "_band"), "crossed")
    pairs = of.join(of.select("_band", F.col("_block").alias("_other")), "_band").where("_block < _other").select("_block", "_other").distinct()
    across = pairs.join(blocks, "_block").join(blocks.select(F.col("_block").alias("_other"), F.col("_members").alias("_others")), "_other").select("_members", "_others")

    def verify(batches):
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                others = batch.column(1)[i].as_py()
                linked(batch.column(0)[i].as_py(), others, threshold, lambda *x: out.append(x))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary()))], ["_a", "links", "_b"])

    alone = blocks.where(F.size("_members") > 1).select("_members", F.lit(None).cast(dict(blocks.dtypes)["_members"]).alias("_others"))
    links = materialize(alone.unionByName(across).mapInArrow(verify, "_a binary, links long, _b binary"), "links")
    counts = links.groupBy(F.col("_a").alias("_key")).agg(F.sum("links").alias("_links"))
    labels = components(links).join(members.select("_key", "_first"), "_key")
    firsts = labels.groupBy("_root").agg(F.min("_first").alias("_class"))
    labels = labels.join(firsts, "_root").select("_key", "_root", "_class")
    classes = members.select("_key", "_first", "_copies").join(labels, "_key", "left").join(counts, "_key", "left")
    classes = classes.select("_key", F.coalesce("_root", "_key").alias("_set"), F.coalesce("_class", "_first").alias("_class"), (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"))
    return signs.join(classes, "_key", "left").select(F.col("_id").alias(id_col), "_row", "_set", F.coalesce("_class", "_id").alias("class_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))
