"""K-means of many series at once: every series has its own number of clusters, all share one aggregate per round.

Rows are laid out once by (series, stretch of positions) and kept; a round sends each stretch the centres of its series,
takes the nearest centre per row and hands back sums per (series, cluster), combined before the shuffle. A series of any
length is many stretches, so it is spread over tasks; series whose centres rest leave the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegrid.operators.ordered import CHUNK, dense_index
from tonegrid.session import materialize


def tenth_of_rows(n: Column) -> Column:
    """One cluster per ten rows, two to eight."""
    return F.least(F.lit(8), F.greatest(F.lit(2), F.floor(n / 10))).cast("int")


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _nearest(centres: str, vec: str) -> Column:
    """Number of the nearest centre; ties go to the smaller number."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(_distance(c, F.col(vec)).alias("d"), i.alias("i"))))["i"]


def series_kmeans(rows: DataFrame, keys: Sequence[str], order: str, vec: str, dims: int, clusters: Callable[[Column], Column] = tenth_of_rows,
                  rounds: int = 20, out: str = "cluster", stretch: int = 8192, rest: float = 1e-9) -> DataFrame:
    """Adds ``out``: the cluster of each row within its series.

    ``order`` is the position of a row, ``vec`` an array of ``dims`` finite numbers; ``clusters`` gives the number of
    clusters from the row count. The first centres are rows at even distances, so reruns agree. A cluster without rows
    keeps its centre. A series ends when no centre moves by more than ``rest``, all end after ``rounds``. Rows whose vector
    is null, holds a null or has another length are left out.
    """
    keys = list(keys)
    spark = rows.sparkSession
    good = (F.size(vec) == dims) & F.forall(vec, lambda x: x.isNotNull())
    whole = dense_index(rows.where(good).withColumn("_v", F.col(vec).cast("array<double>")), keys, [order], F.floor(F.col(order) / CHUNK), "_i")
    whole = materialize(whole.withColumn("_part", F.floor(F.col("_i") / stretch)), "cluster-rows")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = whole.repartition(parts, *keys, "_part").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stretches = materialize(laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")), "stretches")
        size = stretches.groupBy(*keys).agg(F.sum("_n").alias("_n")).withColumn("_k", clusters(F.col("_n")))
        seed = size.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        seed = seed.select(*keys, "_j", F.floor((2 * F.col("_j") + 1) * F.col("_n") / (2 * F.col("_k"))).cast("bigint").alias("_i"))
        first = whole.select(*keys, "_i", "_v").join(seed, [*keys, "_i"])
        # at most as many rows per series as it has clusters
        state = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_j", "_v"))).alias("_s"))
        state = materialize(state.select(*keys, F.transform("_s", lambda s: s["_v"]).alias("_centres"), F.lit(True).alias("_moves")), "centres")

        def placed(centres: DataFrame) -> DataFrame:
            sent = stretches.select(*keys, "_part").join(centres.select(*keys, "_centres"), keys)
            return laid.join(sent.hint("shuffle_hash"), [*keys, "_part"]).withColumn(out, _nearest("_centres", "_v"))

        for _ in range(rounds):
            moving = state.where("_moves")
            if moving.isEmpty():
                break
            mean = F.array(*[F.avg(F.col("_v")[i]) for i in range(dims)])
            means = placed(moving).groupBy(*keys, out).agg(mean.alias("_mean"))
            means = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(out, "_mean"))).alias("_means"))
            fresh = moving.join(means, keys).select(*keys, F.col("_centres").alias("_old"), F.transform(
                "_centres", lambda c, i: F.coalesce(F.element_at("_means", i), c)).alias("_centres"))
            way = F.array_max(F.zip_with("_centres", "_old", _distance))
            state = materialize(fresh.select(*keys, "_centres", (way > rest * rest).alias("_moves")).unionByName(state.where(~F.col("_moves"))), "centres")
        return materialize(placed(state).select(*rows.columns, out), "clusters")
    finally:
        laid.unpersist()
