"""Catalogue queries."""

from pyspark.sql import functions as F

from tonegrid import constants as K
from tonegrid.operators import catalogue as C
from tonegrid.operators import quality as Q
from tonegrid.plans.adapters import sql
from tonegrid.plans.quality_queries import OVERALL
from tonegrid.plans.registry import query
from tonegrid.session import scratch_path
from tonegrid.sources import tables as IO


@query("a03_read_songs", sql("songs", """select cast(song_id as varchar) as song_id, duration, tempo, key, case when vocal_centroid>3000 then 'soprano'
 when vocal_centroid>2400 then 'alto' when vocal_centroid>1800 then 'tenor' else 'baritone' end as voice_type from songs
 union all select 'shelf=-1', null, null, null, null"""))
def _(t):
    # files of up to 200 songs in folders, one of them broken: its row has the folder's name
    from tonegrid.functions.scalars import voice_type_centroid

    path = scratch_path(t.spark, "songs-json")
    s = t.songs.select(F.col("song_id").cast("string").alias("song_id"), "duration", "tempo", "key",
                       F.struct(voice_type_centroid(F.col("vocal_centroid")).alias("voice_type")).alias("vocals"))
    shelves = s.groupBy(F.floor(F.col("song_id").cast("bigint") / 200).alias("shelf")).agg(F.to_json(F.collect_list(F.struct(*s.columns))).alias("value"))
    broken = t.spark.range(1).select(F.lit(-1).cast("bigint").alias("shelf"), F.lit('{"song_id": "cut o').alias("value"))
    shelves.unionByName(broken).write.partitionBy("shelf").text(path)
    return IO.read_songs(t.spark, path).select("song_id", "duration", "tempo", "key", F.col("vocals.voice_type").alias("voice_type"))


@query("c01_missing_songs", sql("song_pairs", """select pair_id from (select pair_id, song_b+(select count(*)//2 from embeddings) as song_b from song_pairs) p
 where song_b not in (select vec_id from embeddings)"""))
def _(t):
    pairs = t.song_pairs.withColumn("song_b", F.col("song_b") + t.n_songs // 2)
    return IO.missing_songs(pairs, t.songs).select("pair_id")


@query("a04_read_embeddings", sql("song_pairs", """select pair_id, a.vec_id is not null as has_a, b.vec_id is not null as has_b from (select pair_id, song_a, song_b+250 as song_b from song_pairs) p
 left join embeddings a on a.vec_id=p.song_a left join embeddings b on b.vec_id=p.song_b"""))
def _(t):
    path = scratch_path(t.spark, "embeddings")
    t.embeddings.select("song_id", "embedding").write.parquet(path)
    e = IO.read_embeddings(t.spark, path)
    side = lambda s: e.select(F.col("song_id").alias(f"song_{s}"), F.col("embedding").isNotNull().alias(f"has_{s}"))
    p = t.song_pairs.withColumn("song_b", F.col("song_b") + 250)
    d = p.join(side("a"), "song_a", "left").join(side("b"), "song_b", "left")
    return d.select("pair_id", *[F.coalesce(f"has_{s}", F.lit(False)).alias(f"has_{s}") for s in "ab"])


@query("a06_write_songs", sql("songs", "select song_id, tempo from songs"))
def _(t):
    path = scratch_path(t.spark, "songs")
    IO.write_songs(t.songs.select("song_id", "tempo"), path)
    return t.spark.read.parquet(path)


@query("a07_append_mixes", sql("mix_scores", "select mix_id, round(beat_coherence,6) as score from mix_scores union all select mix_id+1000000, round(vocal_clarity,6) from mix_scores"))
def _(t):
    path = scratch_path(t.spark, "mixes")
    IO.append_mixes(t.mix_scores.select("mix_id", F.round("beat_coherence", 6).alias("score")), path)
    IO.append_mixes(t.mix_scores.select(F.col("mix_id") + 1000000, F.round("vocal_clarity", 6).alias("score")).toDF("mix_id", "score"), path)
    return t.spark.read.parquet(path)


@query("a08_to_json", sql("mix_scores", f"""select mix_id, round(cast(j->>'overall' as double),6) as overall, round(cast(j->>'vocal_clarity' as double),6) as vocal_clarity, (j->>'note') is null as note_is_null,
 j like '%"note":null%' as note_kept from (select mix_id, cast(json_object('overall', {OVERALL}, 'vocal_clarity', vocal_clarity, 'note', null) as varchar) as j from mix_scores) q"""))
def _(t):
    s = Q.overall_score(t.mix_scores).withColumn("note", F.lit(None).cast("string"))
    j = s.select("mix_id", C.to_json_col([*K.SCORE_WEIGHTS, "overall", "note"]).alias("j"))
    get = lambda n: F.round(F.get_json_object("j", f"$.{n}").cast("double"), 6)
    return j.select("mix_id", get("overall").alias("overall"), get("vocal_clarity").alias("vocal_clarity"),
                    F.get_json_object("j", "$.note").isNull().alias("note_is_null"), F.col("j").contains('"note":null').alias("note_kept"))


@query("a09_list_songs", sql("songs", """select song_id, case when bad then 0e0 else coalesce(duration,0e0) end as duration, case when bad then '?' else coalesce(key,'?') end as key, case when bad then 0e0 else tempo end as tempo,
 case when bad then '?' when song_id%3=0 then 'none' else 'tenor' end as voice_type from (select song_id, song_id%11=0 as bad, tempo, case when song_id%5=0 then null else duration end as duration,
 case when song_id%7=0 then null else key end as key from songs) q order by song_id"""))
def _(t):
    i = F.col("song_id")
    s = t.songs.select("song_id", F.when(i % 5 != 0, F.col("duration")).alias("duration"), F.when(i % 7 != 0, F.col("key")).alias("key"), "tempo",
                       F.struct(F.when(i % 3 != 0, "tenor").alias("voice_type")).alias("vocals"), F.when(i % 11 == 0, "{").alias("_corrupt_record"))
    return C.list_songs(s)


@query("a10_list_mixes", sql("mix_params", """select mix_id, song_a, song_b, case when mix_id%4=0 then 0e0 else vox_rms end as overall, cast(mix_id as varchar) as created_at,
 cast(song_a as varchar) || '_' || cast(song_b as varchar) as directory from mix_params"""))
def _(t):
    m = t.mix_params.select("mix_id", F.col("song_a").alias("song_a_id"), F.col("song_b").alias("song_b_id"),
                            F.struct(F.when(F.col("mix_id") % 4 != 0, F.col("vox_rms")).alias("overall")).alias("quality_scores"),
                            F.col("mix_id").cast("string").alias("created_at"), F.concat_ws("_", "song_a", "song_b").alias("directory"))
    return C.list_mixes(m)


@query("a11_delete_songs", sql("songs", """select 'songs' as tbl, count(*) as n from songs where song_id%9<>0 union all select 'embeddings', count(*) from embeddings where vec_id%9<>0
 union all select 'ratings', count(*) from orders"""))
def _(t):
    ids = t.songs.where(F.col("song_id") % 9 == 0).select("song_id")
    out = C.delete_songs({"songs": t.songs, "embeddings": t.embeddings, "ratings": t.raw("orders").select(F.col("o_orderkey").alias("song_id"))}, ids)
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n") for n, d in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a12_pending_songs", "select d.doc_id from documents d left join labels l on d.doc_id=l.doc_id where l.doc_id is null")
def _(t):
    return C.pending(t.raw("documents").select("doc_id"), t.raw("labels"), "doc_id")


@query("a13_ensure_embeddings", sql("songs", """select song_id, round(list_extract(v,1),6) as first_value, len(v) as width from (select vec_id as song_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
 where vec_id%4<>0 union all select song_id, list_value(tempo/200, overall_energy) from songs where song_id%4=0) q"""))
def _(t):
    emb = t.embeddings.where(F.col("song_id") % 4 != 0).select("song_id", F.col("embedding").cast("array<double>").alias("embedding"))
    make = lambda d: d.select("song_id", F.array(F.col("tempo") / 200, F.col("overall_energy")).alias("embedding"))
    d = C.ensure_embeddings(t.songs, emb, make)
    return d.select("song_id", F.round(F.col("embedding")[0], 6).alias("first_value"), F.size("embedding").cast("bigint").alias("width"))


@query("l01_union_ratings", sql("ratings_in", "select mix_id, rating from ratings_in where seq%2=0 union all select mix_id, rating from ratings_in where seq%2=1"))
def _(t):
    r = t.ratings_in
    return r.where(F.col("seq") % 2 == 0).select("mix_id", "rating").unionByName(r.where(F.col("seq") % 2 == 1).select("mix_id", "rating"))


@query("l02_distinct_boundaries", sql("sections", "select distinct song_id, t from (select song_id, start_time as t from sections union all select song_id, end_time from sections) q"))
def _(t):
    s = t.sections
    return s.select("song_id", F.col("start_time").alias("t")).unionByName(s.select("song_id", F.col("end_time").alias("t"))).dropDuplicates(["song_id", "t"])


@query("a05_read_ratings", sql("mix_params", """select cast(mix_id as varchar) as mix_id, cast(song_a as varchar) as song_a, direction, key_shift, round(vox_rms,6) as vox_rms, cast(1+mix_id%5 as int) as rating from mix_params"""))
def _(t):
    path = scratch_path(t.spark, "ratings-json")
    p = t.mix_params.select(F.col("mix_id").cast("string").alias("mix_id"), F.col("song_a").cast("string").alias("song_a"), F.col("song_b").cast("string").alias("song_b"),
                            "direction", "key_shift", "vox_rms", "inst_rms", (1 + F.col("mix_id") % 5).cast("int").alias("rating"))
    p.write.json(path)
    r = IO.read_ratings(t.spark, path, lines=True)
    return r.select("mix_id", "song_a", "direction", "key_shift", F.round("vox_rms", 6).alias("vox_rms"), "rating")


@query("a05_read_mix_params", sql("mix_params", """select cast(mix_id as varchar) as mix_id, cast(song_a as varchar) as song_a, direction, key_shift, round(vox_rms,6) as vox_rms from mix_params"""))
def _(t):
    path = scratch_path(t.spark, "params-json")
    entry = F.struct(F.col("song_a").cast("string").alias("song_a"), F.col("song_b").cast("string").alias("song_b"), "direction", "key_shift", "vox_rms")
    t.mix_params.select(F.to_json(F.create_map(F.col("mix_id").cast("string"), entry)).alias("value")).write.text(path)
    r = IO.read_mix_params(t.spark, path, lines=True)
    return r.select("mix_id", "song_a", "direction", "key_shift", F.round("vox_rms", 6).alias("vox_rms"))
