"""Document fingerprints: quartile codes of hashed byte-triplet counts, and a bounded likeness of two of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrid.llm.common import whole

#: Buckets of the triplet counts; two bits each.
BUCKETS = 256
#: Bytes worked on at once.
STRIDE = 1 << 20
#: Share of the likeness that the length can take away.
LENGTH_WEIGHT = 0.1
#: Fixed value: an odd multiplier that spreads three bytes over 32 bits.
SPREAD = np.uint32(0x9E3779B1)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many byte triplets (each byte with the next two) fall into each bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(len(data) - 2, 0), STRIDE):
        part = np.frombuffer(data, np.uint8, min(STRIDE + 2, len(data) - start), start).astype(np.uint32)
        triplets = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        counts += np.bincount((triplets * SPREAD) >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint_bytes(data: bytes) -> str:
    """Hexadecimal: two digits of the length on a logarithmic scale, then two bits per bucket.

    A bucket's code is the number of quartiles of all bucket counts that its count is above; equal counts have equal
    codes. Texts of under three bytes have no triplet and all codes 0.
    """
    counts = bucket_counts(data)
    quartiles = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(1).astype(np.uint8)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, round(8 * np.log2(1 + len(data))))
    return f"{length:02x}{packed.astype(np.uint8).tobytes().hex()}"


def codes_of(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), -1)
    body = raw[:, 1:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    return raw[:, 0].astype(np.int64), body.reshape(len(raw), -1).astype(np.int64)


def likeness_of(a: list[str], b: list[str]) -> np.ndarray:
    """From 0 to 1: one less the mean code distance over its largest value, less a bounded share for the length."""
    (la, ca), (lb, cb) = codes_of(a), codes_of(b)
    apart = np.abs(ca - cb).sum(1) / (3 * ca.shape[1])
    longer = np.minimum(np.abs(la - lb), 32) / 32
    return (1 - apart) * (1 - LENGTH_WEIGHT * longer)


@F.arrow_udf(T.StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """Fingerprint of a text's UTF-8 bytes; null stays null."""
    return pa.array([None if x is None else fingerprint_bytes(x) for x in texts.cast(pa.binary()).to_pylist()], pa.string())


@F.arrow_udf(T.DoubleType())
def likeness(left: pa.Array, right: pa.Array) -> pa.Array:
    """Likeness of two fingerprints; null if one is null."""
    pairs = [(i, x, y) for i, (x, y) in enumerate(zip(left.to_pylist(), right.to_pylist(), strict=True)) if x is not None and y is not None]
    out: list[float | None] = [None] * len(left)
    if pairs:
        for (i, _, _), v in zip(pairs, likeness_of([x for _, x, _ in pairs], [y for _, _, y in pairs]), strict=True):
            out[i] = float(v)
    return pa.array(out, pa.float64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id column, ``text`` (null: empty) and ``fingerprint`` of every whole text; rows are independent of each other."""
    rows = docs.select(F.col(id_col), whole(F.col(text_col)).alias("text"))
    return rows.withColumn("fingerprint", fingerprint("text"))


def with_next(rows: DataFrame, id_col: str, columns: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """Every row with ``next_<column>`` of the row that follows it by the numeric id, the first row following the last.

    The ids are cut into ranges at approximate quantiles; each range is one sorted window, and the rows of a range's
    smallest id are also handed to the range before. So each row moves once, plus those. Null ids come first; rows of
    one id go by the hash and value of the first column, so only equal rows have no order of their own. The driver holds
    two numbers per range.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(F.col(id_col).cast("double"), [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("c")).head()["c"] or []
    cut = Bucketizer(splits=[-math.inf, *(sorted(set(cuts)) or [0.0]), math.inf], inputCol="_at", outputCol="_range", handleInvalid="keep")

    def ranged(df: DataFrame) -> DataFrame:
        placed = cut.transform(df.withColumn("_at", F.coalesce(F.col(id_col).cast("double"), F.lit(-math.inf))))
        return placed.withColumn("_range", F.col("_range").cast("int")).drop("_at")

    def same(value) -> Column:
        return F.col(id_col).eqNullSafe(F.lit(value))

    # compared in their own type: doubles only cut the ranges, and ids of one double share a range
    least = F.min(F.struct(F.col(id_col).isNotNull().alias("has"), F.col(id_col).alias("id")))
    firsts = ranged(rows.select(id_col)).groupBy("_range").agg(least["id"].alias("id")).orderBy("_range").collect()
    if not firsts:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    to = {f["id"]: firsts[i - 1]["_range"] for i, f in enumerate(firsts)}
    if None in to:
        back = F.when(same(None), F.lit(to[None]))
    else:
        back = F.when(F.lit(False), F.lit(0))
    if known := {k: v for k, v in to.items() if k is not None}:
        back = F.coalesce(back, F.element_at(F.map_from_arrays(F.lit(list(known)), F.lit(list(known.values()))), F.col(id_col)))
    copies = F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("x")), F.struct(back.alias("r"), F.lit(True).alias("x")))
    dealt = ranged(rows).withColumn("_to", F.explode(F.filter(copies, lambda c: c["r"].isNotNull())))
    order = Window.partitionBy("_to.r").orderBy("_to.x", id_col, F.xxhash64(columns[0]), columns[0])
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(~F.col("_to.x")).drop("_to", "_range")
