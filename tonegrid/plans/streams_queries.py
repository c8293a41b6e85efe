"""Streaming queries: the given tables are replayed as streams until used up, the results are read back."""

from pyspark.sql import functions as F

from tonegrid.plans.adapters import sql
from tonegrid.plans.learning_queries import LATEST
from tonegrid.plans.registry import query
from tonegrid.plans.similarity_queries import DOTS
from tonegrid.session import scratch_path
from tonegrid.streaming import jobs as J


def r6(c):
    return F.round(c, 6)


def replay(t, name):
    """A given table as a file stream. A pattern names a folder of parts as well as a single file."""
    schema = t.raw(name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.dir}/{name}.parque[t]")


def replay_df(t, df, name):
    """A derived table as a file stream."""
    path = scratch_path(t.spark, name)
    df.write.parquet(path)
    return t.spark.readStream.schema(df.schema).parquet(path)


def paths(t, name):
    return scratch_path(t.spark, f"{name}-out"), scratch_path(t.spark, f"{name}-checkpoint")


@query("k01_new_entries", "select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id where l.doc_id is null")
def _(t):
    out, cp = paths(t, "new")
    t.raw("labels").select("doc_id", F.lit(True).alias("old")).write.parquet(out)
    J.stream_new(replay(t, "documents").select("doc_id"), out, "doc_id", lambda d: d.withColumn("old", F.lit(False)), cp, once=True).awaitTermination()
    return t.spark.read.parquet(out).where(~F.col("old")).select("doc_id")


@query("k02_stream_best_match", sql("", "select a as song_id, b as match_id, round(sim,6) as similarity from (select v.vec_id as a, d.b, d.sim, row_number() over(partition by v.vec_id order by sim desc, b) as rn from embeddings v left join dots d on d.a=v.vec_id and d.b<d.a) q where rn=1", dots=DOTS))
def _(t):
    out, cp = paths(t, "match")
    emb = scratch_path(t.spark, "match-embeddings")
    # songs arrive by id, in three files of which every batch reads one
    arriving = scratch_path(t.spark, "match-arriving")
    songs = t.raw("embeddings").select(F.col("vec_id").alias("song_id"), "embedding")
    low, high = songs.agg(F.percentile_approx("song_id", [1 / 3, 2 / 3]).alias("c")).head()["c"] or (0, 0)
    at = F.col("song_id")
    for part in (at.isNull() | (at <= low), (at > low) & (at <= high), at > high):  # open at both ends
        songs.where(part).coalesce(1).write.mode("append").parquet(arriving)
    stream = t.spark.readStream.schema(songs.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    J.stream_best_match(stream, emb, out, lambda d: d, cp, once=True).awaitTermination()
    return t.spark.read.parquet(out).select("song_id", "match_id", r6("similarity").alias("similarity"))


@query("k03_stream_ratings", sql("ratings_in", "select mix_id, cast(greatest(1,least(5,rating)) as int) as rating, seq from latest where mix_id%6<>0", latest=LATEST))
def _(t):
    out, cp = paths(t, "ratings")
    k = F.col("o_orderkey")
    stream = replay(t, "orders").select((F.floor(k / F.lit(2.0)).cast("bigint") * 2).alias("mix_id"), (k % 7).cast("int").alias("rating"),
                                        F.col("o_orderdate").alias("rated_at"), k.alias("seq"))
    J.stream_ratings(stream, lambda: t.mix_params.where(F.col("mix_id") % 6 != 0), out, cp, once=True).awaitTermination()
    return J.current_ratings(t.spark, out, ("rated_at", "seq")).select("mix_id", "rating", "seq")


def live_frames(t):
    """The events as a stream of frames; one far-future row moves the watermark past all of them, so every window closes."""
    given = t.raw("events").select(F.col("user_id").alias("song_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500.0).alias("rms"))
    mark = t.spark.range(1).select(F.lit(-1).cast(dict(given.dtypes)["song_id"]).alias("song_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(1.0).alias("rms"))
    return replay_df(t, given.unionByName(mark), "frames")


@query("k04_activity_windows", """select user_id as song_id, strftime(date_trunc('day',ts),'%Y-%m-%d') as day, round(sqrt(avg(value/500e0*value/500e0)),6) as rms, count(*) as n
 from events group by user_id, date_trunc('day',ts)""")
def _(t):
    out, cp = paths(t, "windows")
    J.to_table(J.activity_windows(live_frames(t), ["song_id"], "ts", "rms", "1 day"), out, cp, "append").awaitTermination()
    return t.spark.read.parquet(out).where("song_id >= 0").select("song_id", F.date_format("start", "yyyy-MM-dd").alias("day"), r6("rms").alias("rms"), "n")


@query("k04_activity_sessions", """select song_id, round(sqrt(avg(rms*rms)),6) as energy, count(*) as n, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us from (
 select *, sum(case when ts-p<interval 12 hours then 0 else 1 end) over(partition by song_id order by ts) as g from (select user_id as song_id, ts, value/500e0 as rms, lag(ts) over(partition by user_id order by ts) as p
 from events where value/500e0>0.02e0) a) b group by song_id, g having max(ts)-min(ts)>=interval 1 hour""")
def _(t):
    out, cp = paths(t, "sessions")
    s = J.activity_sessions(live_frames(t), ["song_id"], "ts", "rms", F.col("rms") > 0.02, "12 hours", 3600.0)
    J.to_table(s, out, cp, "append").awaitTermination()
    d = t.spark.read.parquet(out).where("song_id >= 0")
    return d.select("song_id", r6("energy").alias("energy"), "n", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"))


@query("k05_unrated_mixes", """select o_orderkey as mix_id, case when o_orderkey%3<>0 and o_orderkey%7<>6 then cast(1+o_orderkey%5 as int) end as rating, o_orderkey%3<>0 and o_orderkey%7<>6 as rated from orders""")
def _(t):
    out, cp = paths(t, "unrated")
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    end = F.lit("2100-01-01").cast("timestamp")
    mixes = t.raw("orders").select(k.alias("mix_id"), at.alias("created_at"))
    ratings = t.raw("orders").where(k % 3 != 0).select(k.alias("mix_id"), (at + F.make_dt_interval(secs=(k % 7) * 60)).alias("rated_at"), (1 + k % 5).cast("int").alias("rating"))
    # one far-future row on either side moves both watermarks past all given rows
    mark = t.spark.range(1).select(F.lit(-1).cast("bigint").alias("mix_id"), end.alias("at"))
    m = replay_df(t, mixes.unionByName(mark.withColumnRenamed("at", "created_at")), "mixes")
    r = replay_df(t, ratings.unionByName(mark.withColumnRenamed("at", "rated_at").withColumn("rating", F.lit(None).cast("int"))), "mix-ratings")
    J.to_table(J.unrated_mixes(m, r), out, cp, "append").awaitTermination()
    return t.spark.read.parquet(out).where(F.col("mix_id") >= 0).select("mix_id", "rating", "rated")


@query("k06_rating_state", sql("ratings_in", """select mix_id, count(*) as n, round(avg(rating),6) as mean_rating from ratings_in group by mix_id"""))
def _(t):
    out, cp = paths(t, "state")
    k = F.col("o_orderkey")
    stream = replay(t, "orders").select((F.floor(k / F.lit(2.0)).cast("bigint") * 2).alias("mix_id"), (k % 7).cast("int").alias("rating"), F.col("o_orderdate").alias("rated_at"))
    J.to_table(J.rating_state(stream), out, cp, "update").awaitTermination()
    return J.latest_state(t.spark, out, ["mix_id"]).select("mix_id", "n", r6("mean_rating").alias("mean_rating"))
