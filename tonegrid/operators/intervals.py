"""Interval and nearest-point joins through position buckets (equi keys, no nested loops)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_B = "_bucket"


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], pos: str,
                  start: str, end: str, width: float, closed_end: bool = False) -> DataFrame:
    """Pair every point with the intervals of its series holding it: start <= pos < end (or <=).

    An interval is listed once per bucket it touches, a point sits in one bucket, so a long series
    spreads over its buckets.
    """
    spans = intervals.withColumn(_B, F.explode(F.sequence(
        F.floor(F.col(start) / width).cast("bigint"), F.floor(F.col(end) / width).cast("bigint"))))
    pts = points.withColumn(_B, F.floor(F.col(pos) / width).cast("bigint"))
    upper = F.col(pos) <= F.col(end) if closed_end else F.col(pos) < F.col(end)
    return pts.join(spans, [*keys, _B]).where((F.col(pos) >= F.col(start)) & upper).drop(_B)


def nearest(points: DataFrame, grid: DataFrame, keys: Sequence[str], t: str, grid_t: str,
            out: str, width: float = 64.0) -> DataFrame:
    """Nearest grid value to each point of the same series; ties go to the earlier one, no grid gives null."""
    pts = points.withColumn("_t", F.col(t).cast("double")).withColumn("_g", F.lit(None).cast("double"))
    marks = grid.select(*keys, F.col(grid_t).cast("double").alias("_t"),
                        F.col(grid_t).cast("double").alias("_g")).where(F.col("_g").isNotNull())
    marks = marks.dropDuplicates([*keys, "_g"])
    both = (pts.withColumn("_side", F.lit(1))
            .unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
            .withColumn(_B, F.floor(F.col("_t") / width).cast("bigint")))
    fwd = Window.partitionBy(*keys, _B).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, _B).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(
        Window.unboundedPreceding, 0)
    edge = both.groupBy(*keys, _B).agg(F.min("_g").alias("_lo"), F.max("_g").alias("_hi"))
    up = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc(_B)).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*keys, _B, F.last("_hi", True).over(up).alias("_pin"),
                       F.last("_lo", True).over(down).alias("_nin"))
    found = (both.withColumn("_p", F.last("_g", True).over(fwd))
             .withColumn("_n", F.last("_g", True).over(back))
             .where(F.col("_side") == 1)
             .join(edge, [*keys, _B])
             .withColumn("_p", F.coalesce("_p", "_pin")).withColumn("_n", F.coalesce("_n", "_nin")))
    pick = (F.when(F.col("_p").isNull(), F.col("_n"))
            .when(F.col("_n").isNull(), F.col("_p"))
            .when(F.col("_n") - F.col("_t") < F.col("_t") - F.col("_p"), F.col("_n"))
            .otherwise(F.col("_p")))
    return found.withColumn(out, pick).drop("_t", "_g", "_side", _B, "_p", "_n", "_pin", "_nin")
