"""Structured Streaming forms: arriving files, ratings and live frames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from tonegrid.functions.scalars import clamp_rating
from tonegrid.operators.learning import latest_ratings
from tonegrid.operators.similarity import top_matches
from tonegrid.sources.tables import absent

POLL = "5 seconds"


def _start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table that may not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not absent(error):
            raise
        return spark.createDataFrame([], schema)


def stream_new(stream: DataFrame, done_path: str, key: str, process: Callable[[DataFrame], DataFrame], checkpoint: str,
               once: bool = False) -> StreamingQuery:
    """Handle every arriving entry once and skip those already in the result table.

    The table is read again for every batch, so entries finished by earlier batches count. ``process`` maps the new
    entries to result rows, which are appended; a batch repeated after a failure finds its rows and does nothing.
    """
    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(done_path).select(key), key, "left_anti")
        except AnalysisException as error:
            if not absent(error):
                raise
        process(fresh).write.mode("append").parquet(done_path)

    return _start(stream.writeStream.foreachBatch(handle), checkpoint, once)


def stream_best_match(stream: DataFrame, emb_path: str, out_path: str, embed: Callable[[DataFrame], DataFrame], checkpoint: str,
                      once: bool = False) -> StreamingQuery:
    """Embed each arriving song, store it, and report its best match among all songs stored so far.

    ``embed`` maps a batch to song_id (bigint), embedding. Songs of a batch arrive in the order of their ids, each once;
    the first song has no match, a song that is stored already is left out. Every batch has a folder of its own, so a
    batch repeated after a failure sees what it saw before.
    """
    schema = T.StructType([T.StructField("song_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("batch", T.LongType())])

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = stored(spark, emb_path, schema).where(F.col("batch") < batch_id)
        new = embed(batch).select(F.col("song_id").cast("bigint").alias("song_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        new.dropDuplicates(["song_id"]).join(known.select("song_id"), "song_id", "left_anti").write.mode("overwrite").parquet(f"{emb_path}/batch={batch_id}")
        new = stored(spark, emb_path, schema).where(F.col("batch") == batch_id)
        # stored songs came before any of the batch
        placed = lambda d, at: d.where(F.col("embedding").isNotNull()).select(F.col("song_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), at.alias("came"))
        asked = placed(new, F.col("song_id"))
        earlier = lambda q, b, row, col, dots, least: np.where(b["came"].to_numpy()[col] < q["came"].to_numpy()[row], dots, -np.inf)
        m = top_matches(asked, asked.unionByName(placed(known, F.lit(-(1 << 62)))), 1, ["came"], earlier).where(F.col("score") > float("-inf"))
        res = new.select(F.col("song_id").alias("id")).join(m, "id", "left").select(F.col("id").alias("song_id"), F.col("match").alias("match_id"), F.col("score").alias("similarity"))
        res.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return _start(stream.writeStream.foreachBatch(handle), checkpoint, once)


def stream_ratings(stream: DataFrame, params: Callable[[], DataFrame], path: str, checkpoint: str,
                   on_batch: Callable[[DataFrame], None] | None = None, once: bool = False) -> StreamingQuery:
    """Accept ratings of known mixes into an append-only log and put the others aside.

    ``params`` reads the pending parameters anew per batch. Each batch owns a folder, so repeating one replaces
    it. ``on_batch`` gets the current ratings, e.g. to train once three are there.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        known = params()
        good = batch.withColumn("rating", clamp_rating(F.col("rating"))).join(known.select("mix_id"), "mix_id", "left_semi")
        good.write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")
        batch.join(known.select("mix_id"), "mix_id", "left_anti").write.mode("overwrite").parquet(f"{path}/rejects/batch={batch_id}")
        if on_batch:
            on_batch(current_ratings(batch.sparkSession, path))

    return _start(stream.writeStream.foreachBatch(handle), checkpoint, once)


def current_ratings(spark: SparkSession, path: str, order: tuple[str, ...] = ("rated_at",)) -> DataFrame:
    """Latest rating per mix from the log."""
    return latest_ratings(spark.read.parquet(f"{path}/log").drop("batch"), order)


def activity_windows(frames: DataFrame, keys: list[str], ts: str, x: str, size: str, slide: str | None = None, late: str = "10 seconds") -> DataFrame:
    """RMS per tumbling or hopping event-time window; the same plan runs on a stream and on a table."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (frames.withWatermark(ts, late).groupBy(*keys, w.alias("w"))
            .agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.count(F.lit(1)).alias("n"))
            .select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rms", "n"))


def activity_sessions(frames: DataFrame, keys: list[str], ts: str, x: str, active: Column, gap: str, min_s: float, late: str = "10 seconds") -> DataFrame:
    """Phrases on live frames: active frames closer than ``gap`` form a session, sessions under ``min_s`` seconds go.

    A session ends ``gap`` after its last frame, which does not count into its length.
    """
    s = (frames.where(active).withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
         .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("energy"), F.count(F.lit(1)).alias("n")))
    length = F.unix_micros("end") - F.unix_micros("start")
    return s.where(length >= int(min_s * 1_000_000)).drop("w")


def unrated_mixes(mixes: DataFrame, ratings: DataFrame, timeout_s: int = 300, late: str = "1 minute") -> DataFrame:
    """Every mix with the ratings it got within the time limit, or none: mix_id, created_at, rating, rated.

    Stream-stream left outer join; a mix without rating comes out once the watermark has passed its limit.
    """
    m = mixes.withWatermark("created_at", late)
    r = ratings.select(F.col("mix_id").alias("_mix"), "rated_at", "rating").withWatermark("rated_at", late)
    on = ((F.col("mix_id") == F.col("_mix")) & (F.col("rated_at") >= F.col("created_at"))
          & (F.col("rated_at") <= F.col("created_at") + F.expr(f"interval {timeout_s} seconds")))
    return m.join(r, on, "left_outer").select("mix_id", "created_at", "rating", F.col("_mix").isNotNull().alias("rated"))


def rating_state(ratings: DataFrame) -> DataFrame:
    """Running count, mean and latest rating per mix (update mode on a stream)."""
    return ratings.groupBy("mix_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean_rating"),
                                         F.max_by("rating", "rated_at").alias("latest"), F.max("rated_at").alias("rated_at"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str, once: bool = True) -> StreamingQuery:
    """Write a result stream as Parquet.

    Append goes through the file sink; complete replaces the table with every batch; update keeps one folder per
    batch, of which ``latest_state`` picks the newest row per key.
    """
    if mode == "append":
        return _start(stream.writeStream.format("parquet").outputMode("append").option("path", path), checkpoint, once)

    def save(batch: DataFrame, batch_id: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    return _start(stream.writeStream.outputMode(mode).foreachBatch(save), checkpoint, once)


def latest_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key of an update-mode table."""
    d = spark.read.parquet(path)
    rest = [c for c in d.columns if c not in keys and c != "batch"]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")
