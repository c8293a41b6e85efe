"""Greedy minimum-distance selection along a series, split into position chunks.

The rule is sequential: a point is taken when it lies at least ``gap`` behind the last taken one. A
chunk is summed up as a small step table "first allowed position on entry -> first allowed position
on exit"; chaining these tables (one row per chunk) gives every chunk its entry state, after which
the chunks are picked independently. A series within one chunk has no step table and never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrid.session import materialize, plain


def _chain(p: np.ndarray, gap: float) -> np.ndarray:
    """Index of the next pick after each point."""
    return np.searchsorted(p, p + gap, side="left")


def spaced_points(points: DataFrame, keys: Sequence[str], pos: str, gap: float,
                  width: float = 65536.0) -> DataFrame:
    """Points kept by the greedy rule, first point of a series always kept: keys, ``pos``."""
    if width < gap:
        raise ValueError("a chunk must be at least as wide as the gap")
    d = (points.select(*keys, F.col(pos).cast("double").alias("_p")).distinct()
         .withColumn("_chunk", F.floor(F.col("_p") / width).cast("bigint")))
    d = materialize(d.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list("_p")).alias("_ps")), "spaced-points")
    # a series within one chunk has no state to hand on
    several = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    key_fields = [f for f in d.schema.fields if f.name in keys]
    names = list(keys)

    def step_table(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.asarray(pdf["_ps"].iloc[0])
        nxt = _chain(p, gap)
        last = np.arange(len(p))
        for i in range(len(p) - 1, -1, -1):
            if nxt[i] < len(p):
                last[i] = last[nxt[i]]
        reach = pdf["_chunk"].iloc[0] * width + gap
        k = min(int(np.searchsorted(p, reach, side="left")) + 1, len(p))
        out = p[last[:k]] + gap
        edge = np.append(out[1:] != out[:-1], True)
        row = {n: [pdf[n].iloc[0]] for n in [*names, "_chunk"]}
        return plain(pd.DataFrame({**row, "_upto": [p[:k][edge].tolist()], "_exit": [out[edge].tolist()]}))

    steps = d.join(several, names, "left_semi").groupBy(*keys, "_chunk").applyInPandas(step_table, T.StructType([
        *key_fields, T.StructField("_chunk", T.LongType()), T.StructField("_upto", T.ArrayType(T.DoubleType())),
        T.StructField("_exit", T.ArrayType(T.DoubleType()))]))

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        state, found = -np.inf, []
        for upto, leave in zip(pdf["_upto"], pdf["_exit"]):
            found.append(state)
            i = int(np.searchsorted(np.asarray(upto), state, side="left"))
            if i < len(upto):
                state = leave[i]
        return pdf[[*names, "_chunk"]].assign(_entry=found)

    entry = steps.groupBy(*keys).applyInPandas(entries, T.StructType([
        *key_fields, T.StructField("_chunk", T.LongType()), T.StructField("_entry", T.DoubleType())]))

    def pick(state, p):
        taken = F.struct((p + gap).alias("next"), F.concat(state["taken"], F.array(p)).alias("taken"))
        return F.when(p >= state["next"], taken).otherwise(state)

    first = F.struct(F.coalesce("_entry", F.lit(float("-inf"))).alias("next"), F.array().cast("array<double>").alias("taken"))
    picked = d.join(entry, [*keys, "_chunk"], "left").select(*keys, F.explode(F.aggregate("_ps", first, pick, lambda state: state["taken"])).alias("_p"))
    kind = dict(points.dtypes)[pos]
    return picked.select(*keys, F.col("_p").cast(kind).alias(pos))
