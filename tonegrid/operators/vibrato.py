"""Vibrato of a pitch contour: prominent peaks found chunk by chunk.

A peak counts when the contour falls at least ``prominence`` cents below it on both sides before rising above it.
Scanning with "last turning point" states finds these peaks: going up until the contour drops far enough below the
running maximum, which then was a peak, then down until it rises far enough. After the first confirmed turn inside
a chunk the state no longer depends on what came before, so a chunk is scanned alone; its head, the part before
that turn, is summed up by its lowest and highest value and settled when the chunk summaries are chained.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrid.functions.scalars import to_cents
from tonegrid.operators.ordered import CHUNK, dense_index, halo_window
from tonegrid.session import materialize, plain

_D = T.DoubleType()


def _scan(t, v, p: float):
    """One chunk: head low/high (with the times of the high), first turn, peaks after it, final state."""
    low = high = v[0]
    high_at = [t[0]]
    turn, mode, ext, ext_at, peaks = "", "", v[0], [t[0]], []
    for at, x in zip(t, v):
        if not mode:
            if x > high:
                high, high_at = x, [at]
            elif x == high and at != high_at[-1]:
                high_at.append(at)
            low = min(low, x)
            if x >= low + p:
                turn = mode = "up"
                ext, ext_at = x, [at]
            elif x <= high - p:
                turn = mode = "down"
                ext = x
        elif mode == "up":
            if x > ext:
                ext, ext_at = x, [at]
            elif x == ext:
                ext_at.append(at)
            elif x <= ext - p:
                peaks += ext_at
                mode, ext = "down", x
        else:
            ext = min(ext, x)
            if x >= ext + p:
                mode, ext, ext_at = "up", x, [at]
    return low, high, high_at, turn, peaks, mode, ext, ext_at


def _chain(rows, p: float) -> list[float]:
    """Peaks settled across chunk heads, from the chunk summaries in order."""
    mode, ext, ext_at, low, high, out = "start", None, [], None, None, []
    for r in rows:
        merged = list(r.high_at) if ext is None or r.high > ext else [*ext_at, *(r.high_at if r.high == ext else [])]
        if mode == "start":
            low0 = r.low if low is None else low
            risen = low is not None and r.high >= low0 + p
            fallen = high is not None and r.low <= high - p
            if r.turn == "down" and risen:
                out.extend(r.high_at)
            elif not r.turn:
                if risen:
                    mode, ext, ext_at = "up", r.high, list(r.high_at)
                elif fallen:
                    mode, ext = "down", r.low
                low, high = min(low0, r.low), r.high if high is None else max(high, r.high)
        elif mode == "up":
            if r.turn == "down":
                out.extend(merged)
            elif r.low <= ext - p:
                out.extend(ext_at)
                mode, ext = "down", r.low
            elif not r.turn:
                ext, ext_at = max(ext, r.high), merged
        else:
            risen = r.high >= ext + p
            if r.turn == "down" and risen:
                out.extend(r.high_at)
            elif not r.turn:
                mode, ext, ext_at = ("up", r.high, list(r.high_at)) if risen else ("down", min(ext, r.low), [])
        if r.turn:
            mode, ext, ext_at = r.mode, r.ext, list(r.ext_at)
    return out


def prominent_peaks(contour: DataFrame, keys: Sequence[str], order: str, t: str, x: str, prominence: float, chunk: int = CHUNK) -> DataFrame:
    """Times of the peaks with at least the given prominence: keys, ``t``."""
    names = list(keys)
    fields = [f for f in contour.schema.fields if f.name in names]
    flat = halo_window(contour.select(*keys, order, t, x), keys, order, 1, 0, {"_prev": lambda w: F.lag(x).over(w)}, chunk)
    flat = flat.where(F.col("_prev").isNull() | (F.col("_prev") != F.col(x))).withColumn("_chunk", F.floor(F.col(order) / chunk))
    times = T.ArrayType(_D)
    summary = T.StructType([*fields, T.StructField("_chunk", T.LongType()), T.StructField("low", _D), T.StructField("high", _D), T.StructField("high_at", times),
                            T.StructField("turn", T.StringType()), T.StructField("peaks", times), T.StructField("mode", T.StringType()),
                            T.StructField("ext", _D), T.StructField("ext_at", times)])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        row = _scan(pdf[t].tolist(), pdf[x].tolist(), prominence)
        cols = dict(zip(("low", "high", "high_at", "turn", "peaks", "mode", "ext", "ext_at"), ([c] for c in row)))
        return plain(pd.DataFrame({**{n: [pdf[n].iloc[0]] for n in [*names, "_chunk"]}, **cols}))

    parts = materialize(flat.groupBy(*keys, "_chunk").applyInPandas(scan, summary), "contour-chunks")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _chain(pdf.sort_values("_chunk").itertuples(index=False), prominence)
        return plain(pd.DataFrame({**{n: [pdf[n].iloc[0]] * len(out) for n in names}, t: out}))

    # one row per chunk: what a chunk adds across its head
    edges = parts.drop("peaks").groupBy(*keys).applyInPandas(chain, T.StructType([*fields, T.StructField(t, _D)]))
    return parts.select(*keys, F.explode("peaks").alias(t)).unionByName(edges)


def vibrato(f0_frames: DataFrame, keys: Sequence[str], order: str, t: str, f0: str, prominence: float = 10.0, chunk: int = CHUNK) -> DataFrame:
    """detected, rate_hz, depth_cents, regularity per series, over its voiced frames only.

    Fewer than ten voiced frames or two peaks mean none. Detected: 4 to 8 Hz and deeper than 20 cents.
    """
    every = f0_frames.select(*keys).distinct()
    voiced = f0_frames.where(F.col(f0) > 0).select(*keys, order, t, f0)
    mean = voiced.groupBy(*keys).agg(F.avg(f0).alias("_mean"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 10)
    c = dense_index(voiced, keys, [order], F.floor(F.col(order) / chunk), "_i").join(mean, list(keys))
    c = materialize(c.select(*keys, "_i", F.col(t).cast("double").alias("_t"), to_cents(F.col(f0), F.col("_mean")).alias("_c")), "contour")
    depth = c.groupBy(*keys).agg((F.stddev_pop("_c") * 2).alias("depth_cents"))
    peaks = dense_index(prominent_peaks(c, keys, "_i", "_t", "_c", prominence, chunk), keys, ["_t"], F.floor(F.col("_t") / 64), "_k")
    gaps = halo_window(materialize(peaks, "peaks"), keys, "_k", 1, 0, {"_gap": lambda w: F.col("_t") - F.lag("_t").over(w)})
    rate = gaps.groupBy(*keys).agg(F.avg("_gap").alias("_g"), F.stddev_pop("_gap").alias("_s"))
    d = every.join(depth.join(rate.where(F.col("_g").isNotNull()), list(keys)), list(keys), "left")
    # rates and depths on a limit do not hang on the order of summation
    hz = F.when(F.col("_g") > 0, F.round(1.0 / F.col("_g"), 9)).otherwise(0.0)
    none = F.col("_g").isNull()
    return d.select(*keys, F.when(none, False).otherwise(hz.between(4.0, 8.0) & (F.round("depth_cents", 9) > 20)).alias("detected"),
                    F.when(none, 0.0).otherwise(hz).alias("rate_hz"), F.when(none, 0.0).otherwise(F.col("depth_cents")).alias("depth_cents"),
                    F.when(~none & (F.col("_g") > 0), 1.0 - F.col("_s") / F.col("_g")).alias("regularity"))
