"""Ordered-series building blocks that never gather a whole series in one task.

A series is ``keys`` plus a dense integer ``order`` column (frame, beat, bar, bin). One series may
hold a large share of all rows, so every function cuts a series into position chunks and works on
``(keys, chunk)``:

* ``halo_window``  bounded look-back/look-ahead: rows near a chunk edge are copied to the neighbour
* ``carry``        unbounded "last known value": chunk-local window plus one summary row per chunk
* ``runs``         islands of consecutive positions, merged across chunk edges
* ``dense_index``  row_number computed as chunk-local rank plus chunk offset
* ``quantiles``    exact interpolated percentiles through sketch brackets
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536
_C = "_chunk"


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                out: str) -> DataFrame:
    """0-based position of each row in its series.

    ``bucket`` must be monotone in ``order``; it cuts a series into parts that are ranked apart and
    shifted by the row count of the parts before them.
    """
    d = df.withColumn(_C, bucket)
    sizes = d.groupBy(*keys, _C).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(_C).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, _C, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, _C).orderBy(*order)
    return (d.withColumn("_rn", F.row_number().over(local) - 1)
            .join(offsets, [*keys, _C])
            .withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint"))
            .drop(_C, "_rn", "_off"))


def halo_window(df: DataFrame, keys: Sequence[str], order: str, before: int, after: int,
                columns: dict[str, Callable], chunk: int = CHUNK) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    Each callable gets a window ordered by ``order`` and returns a Column. Rows are copied to a
    neighbouring chunk only when they lie within reach of its edge.
    """
    lo = F.greatest(F.floor((F.col(order) - after) / chunk), F.lit(0)).cast("bigint")
    hi = F.floor((F.col(order) + before) / chunk).cast("bigint")
    w = Window.partitionBy(*keys, _C).orderBy(order)
    d = df.withColumn(_C, F.explode(F.sequence(lo, hi)))
    for name, build in columns.items():
        d = d.withColumn(name, build(w))
    return d.where(F.col(_C) == F.floor(F.col(order) / chunk)).drop(_C)


def carry(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str,
          backward: bool = False, inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Last (or, backward, next) non-null ``value`` at or before each row of its series."""
    d = df.withColumn(_C, F.floor(F.col(order) / chunk)).withColumn("_v", value)
    by = F.col(order).desc() if backward else F.col(order).asc()
    reach = Window.partitionBy(*keys, _C).orderBy(by).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    known = F.when(F.col("_v").isNotNull(), F.col(order))
    pick = F.min_by("_v", known) if backward else F.max_by("_v", known)
    summary = d.groupBy(*keys, _C).agg(pick.alias("_edge"))
    chunk_by = F.col(_C).desc() if backward else F.col(_C).asc()
    over = Window.partitionBy(*keys).orderBy(chunk_by).rowsBetween(Window.unboundedPreceding, -1)
    incoming = summary.select(*keys, _C, F.last("_edge", True).over(over).alias("_in"))
    return (d.withColumn("_local", F.last("_v", True).over(reach))
            .join(incoming, [*keys, _C])
            .withColumn(out, F.coalesce("_local", "_in"))
            .drop(_C, "_v", "_local", "_in"))


def runs(df: DataFrame, keys: Sequence[str], order: str,
         aggs: dict[str, tuple[str, Column]] | None = None, gap: int = 0,
         chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of ``order`` values at most ``gap`` missing positions apart (gap < chunk).

    Gives keys, run_start, run_end, run_length and ``aggs``: output name to ("sum" | "min" | "max",
    Column). Every chunk folds its rows into partial runs; only partial runs that reach a chunk edge
    meet again to be joined up.
    """
    aggs = aggs or {}
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    d = df.select(*keys, F.col(order).cast("bigint").alias("_o"),
                  *[c.alias(n) for n, (_, c) in aggs.items()])
    d = d.withColumn(_C, F.floor(F.col("_o") / chunk))
    local = Window.partitionBy(*keys, _C).orderBy("_o")
    starts = F.coalesce((F.col("_o") - F.lag("_o").over(local) > gap + 1).cast("int"), F.lit(1))
    parts = (d.withColumn("_new", starts).withColumn("_isl", F.sum("_new").over(local))
             .groupBy(*keys, _C, "_isl")
             .agg(F.min("_o").alias("run_start"), F.max("_o").alias("run_end"),
                  *[fold[f](n).alias(n) for n, (f, _) in aggs.items()]))
    at_edge = ((F.pmod("run_start", F.lit(chunk)) <= gap)
               | (F.pmod("run_end", F.lit(chunk)) >= chunk - 1 - gap))
    parts = parts.withColumn("_anchor", F.when(at_edge, F.lit(-1)).otherwise(F.col("run_start")))
    w = Window.partitionBy(*keys, "_anchor").orderBy("run_start")
    fresh = F.coalesce((F.col("run_start") - F.lag("run_end").over(w) > gap + 1).cast("int"), F.lit(1))
    joined = parts.withColumn("_fresh", fresh).withColumn("_grp", F.sum("_fresh").over(w))
    return (joined.groupBy(*keys, "_anchor", "_grp")
            .agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"),
                 *[fold[f](n).alias(n) for n, (f, _) in aggs.items()])
            .withColumn("run_length", F.col("run_end") - F.col("run_start") + 1)
            .drop("_anchor", "_grp"))


def with_group_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Attach per-group aggregates: partial aggregation plus a join, no whole-group window."""
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys), "left")


#: The sketch's ranks are off by at most one part in so many.
_ACCURACY = 100_000
#: Half widths of the brackets, as shares of the ranks; the last holds the whole group.
_WIDTHS = (5e-5, 2e-3, 5e-2, 1.0)


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, ps: dict[str, float],
              *extra: Column) -> DataFrame:
    """Exact linear-interpolated percentiles per group: keys, one column per entry of ``ps``.

    ``extra`` are further aggregates over the values (named ``_v``), computed on the way.

    A mergeable sketch brackets each wanted rank; values outside the brackets only get counted, so
    what reaches the final ranking is a thin slice of the group, and repeated values travel as one
    row with a count. The bracket is the narrowest that is wider than the sketch's error by three
    ranks, so by the sketch's bound it holds the rank; a rank outside is an error, never a value.
    Nulls are skipped, groups without values are absent, infinities are values like others.
    """
    d = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    names = list(ps)
    n = F.col("_n")
    edges = [p + side * e for p in ps.values() for e in _WIDTHS for side in (-1, 1)]
    sketch = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", F.array(*[F.lit(float(min(max(q, 0.0), 1.0))) for q in edges]),
                            F.lit(_ACCURACY)).alias("_q"), *extra)
    more = [c for c in sketch.columns if c not in {*keys, "_n", "_q"}]
    rung = F.lit(len(_WIDTHS) - 1)
    for r in range(len(_WIDTHS) - 2, -1, -1):
        rung = F.when(n * (_WIDTHS[r] - 1 / _ACCURACY) >= 3, r).otherwise(rung)
    sketch = sketch.withColumn("_r", 2 * rung)
    for i, _ in enumerate(names):
        at = 2 * len(_WIDTHS) * i + 1 + F.col("_r")
        sketch = sketch.withColumn(f"_lo{i}", F.element_at("_q", at)).withColumn(f"_hi{i}", F.element_at("_q", at + 1))
    sketch = sketch.drop("_q", "_r")
    j = d.join(sketch, list(keys))
    inside = reduce(lambda a, b: a | b,
                    [F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(names))])
    # a counted-only value is filed just below the nearest bracket above it
    below = [F.when(F.col("_v") < F.col(f"_lo{i}"), F.col(f"_lo{i}")) for i in range(len(names))]
    above = F.least(*below) if len(below) > 1 else below[0]
    binned = (j.withColumn("_in", inside.cast("int"))
              .withColumn("_anchor", F.when(F.col("_in") == 1, F.col("_v")).otherwise(above))
              .where(F.col("_anchor").isNotNull())
              .groupBy(*keys, "_anchor", "_in").agg(F.count(F.lit(1)).alias("_cnt"), F.max("_n").alias("_n"),
                                                    *[F.max(c).alias(c) for c in more]))
    upto = Window.partitionBy(*keys).orderBy("_anchor", "_in").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.withColumn("_cum", F.sum("_cnt").over(upto)).withColumn("_at", F.struct("_anchor", "_in"))
    picks = []
    for i, p in enumerate(ps.values()):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        picks += [F.min(F.when(F.col("_cum") > F.floor(pos), F.col("_at"))).alias(f"_a{i}"),
                  F.min(F.when(F.col("_cum") > F.ceil(pos), F.col("_at"))).alias(f"_b{i}")]
    out = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(c).alias(c) for c in more], *picks)
    cols = []
    for i, (name, p) in enumerate(ps.items()):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        a, b = F.col(f"_a{i}._anchor"), F.col(f"_b{i}._anchor")
        held = F.coalesce((F.col(f"_a{i}._in") == 1) & (F.col(f"_b{i}._in") == 1), F.lit(False))
        between = F.when(a == b, a).otherwise(a + (b - a) * frac)
        cols.append(F.when(held, between).otherwise(F.raise_error(F.lit("percentile rank outside its bracket")).cast("double")).alias(name))
    return out.select(*keys, *cols, *more)


def with_quantiles(df: DataFrame, keys: Sequence[str], value: Column, ps: dict[str, float]) -> DataFrame:
    """Attach exact percentiles of ``value`` to every row of the group."""
    return df.join(quantiles(df, keys, value, ps), list(keys), "left")


def argmax_first(df: DataFrame, keys: Sequence[str], score: Column, order: Column,
                 payload: dict[str, Column]) -> DataFrame:
    """Row with the highest score per group; on equal scores the lowest ``order`` wins."""
    best = F.max_by(F.struct(*[c.alias(n) for n, c in payload.items()]), F.struct(score, -order))
    return (df.where(score.isNotNull() & ~F.isnan(score)).groupBy(*keys).agg(best.alias("_b"))
            .select(*keys, *[F.col(f"_b.{n}").alias(n) for n in payload]))
