"""Scalar function queries."""

from pyspark.sql import functions as F

from tonegrid import constants as K
from tonegrid.functions import arrays as A
from tonegrid.functions import scalars as S
from tonegrid.operators import signal
from tonegrid.plans.adapters import NOTES_SQL, sql
from tonegrid.plans.registry import query

PAIR_SQL = """select p.pair_id, p.song_a, p.song_b, a.tempo as ta, b.tempo as tb, a.key as ka, b.key as kb
 from song_pairs p join songs a on p.song_a=a.song_id join songs b on p.song_b=b.song_id"""


def paired(t):
    s = t.songs.select("song_id", "tempo", "key")
    a = s.select(F.col("song_id").alias("song_a"), F.col("tempo").alias("ta"), F.col("key").alias("ka"))
    b = s.select(F.col("song_id").alias("song_b"), F.col("tempo").alias("tb"), F.col("key").alias("kb"))
    return t.song_pairs.join(a, "song_a").join(b, "song_b")


def r6(c):
    return F.round(c, 6)


@query("b01_mono_mix", sql("samples", """select song_id, pos//2 as pos, round(avg(x),6) as x
 from samples group by song_id, pos//2"""))
def _(t):
    two = t.samples.select("song_id", (F.col("pos") % 2).alias("channel"), F.floor(F.col("pos") / 2).alias("pos"), "x")
    return signal.mono_mix(two, ["song_id"], "pos", "x").select("song_id", "pos", r6("x").alias("x"))


@query("b02_voice_type_centroid", sql("songs", """select song_id, vocal_centroid, case when vocal_centroid>3000 then 'soprano'
 when vocal_centroid>2400 then 'alto' when vocal_centroid>1800 then 'tenor' else 'baritone' end as voice_type from songs"""))
def _(t):
    return t.songs.select("song_id", "vocal_centroid", S.voice_type_centroid(F.col("vocal_centroid")).alias("voice_type"))


@query("b03_voice_type_pitch", sql("frames", """select song_id, round(f0,6) as mean_f0, case when f0 is null then 'unknown'
 when f0>300 then 'soprano' when f0>220 then 'mezzo-soprano' when f0>180 then 'alto' when f0>130 then 'tenor'
 when f0>100 then 'baritone' else 'bass' end as voice_type from (select song_id, round(avg(case when stem='vocals' and rms>0 then rms*1000 end),6) as f0
 from frames group by song_id) q"""))
def _(t):
    f0 = t.frames.select("song_id", F.when(F.col("stem") == "vocals", F.col("rms") * 1000).otherwise(0.0).alias("f0"))
    out = signal.mean_pitch(f0, ["song_id"], "f0").withColumn("mean_f0", r6("mean_f0"))
    return out.select("song_id", "mean_f0", S.voice_type_pitch(F.col("mean_f0")).alias("voice_type"))


@query("b04_fold_tempo", sql("songs", """select song_id, round(case when x<70 then x*2 when x>180 then x/2 else x end,6) as tempo
 from (select song_id, tempo*1.6e0-60 as x from songs) q"""))
def _(t):
    return t.songs.select("song_id", r6(S.fold_tempo(F.col("tempo") * 1.6 - 60)).alias("tempo"))


@query("b05_bar_duration", sql("songs", """select song_id, round(60e0/tempo*4,6) as bar_s,
 round(60e0/greatest(tempo-tempo,60e0)*4,6) as fallback_s from songs"""))
def _(t):
    return t.songs.select("song_id", r6(S.bar_duration(F.col("tempo"))).alias("bar_s"),
                          r6(S.bar_duration(F.col("tempo") - F.col("tempo"))).alias("fallback_s"))


TEMPO_CASE = """case when r<1.05 then 1e0 when r<1.10 then 0.9e0 when r<1.20 then 0.7e0 when r<1.50 then 0.4e0
 when r<2.05 and r>1.95 then 0.6e0 else 0.2e0 end"""
TEMPO_NOTE = f"""case {' '.join(f"when r<{b} then '{n}'" for b, _, n in K.TEMPO_STEPS)}
 when r<2.05 and r>1.95 then '{K.TEMPO_DOUBLE[3]}' else '{K.TEMPO_FAR[1]}' end"""
RATIO = "greatest(ta,tb)/greatest(least(ta,tb),1e0)"


@query("b06_tempo_score", sql("songs song_pairs", f"""select pair_id, {TEMPO_CASE} as score, {TEMPO_NOTE} as note
 from (select *, {RATIO} as r from pairs) q""", pairs=PAIR_SQL))
def _(t):
    s = S.tempo_score(F.col("ta"), F.col("tb"))
    return paired(t).select("pair_id", s["score"].alias("score"), s["note"].alias("note"))


# C at position 1 -> pitch class 0; the adapter only names sharps
ROOT = lambda k: f"coalesce(list_position({NOTES_SQL}, split_part({k},' ',1))-1, 0)"
REL = lambda k: f"(({ROOT(k)} + case when {k} like '%min%' then 3 else 0 end) % 12)"
INTERVAL_CASE = "case iv " + " ".join(f"when {k} then {v}e0" for k, v in K.INTERVAL_SCORES.items()) + " end"
NOTE_CASE = "case iv " + " ".join(f"when {k} then '{v}'" for k, v in K.INTERVAL_NOTES.items()) + " end"


@query("b07_key_relative", sql("songs", f"select song_id, key, cast({REL('key')} as int) as root from songs"))
def _(t):
    return t.songs.select("song_id", "key", S.parse_key_relative(F.col("key")).alias("root"))


@query("b08_parse_key", sql("songs", f"""select song_id, key, cast({ROOT('key')} as int) as root,
 case when key like '%min%' then 'minor' else 'major' end as mode from songs"""))
def _(t):
    k = S.parse_key(F.col("key"))
    return t.songs.select("song_id", "key", k["root"].alias("root"), k["mode"].alias("mode"))


@query("b09_key_interval_score", sql("songs song_pairs", f"""select pair_id, {INTERVAL_CASE} as score,
 ka || ' / ' || kb || ': ' || {NOTE_CASE} as note from (select *, abs({REL('ka')}-{REL('kb')}) as iv from pairs) q""", pairs=PAIR_SQL))
def _(t):
    s = S.key_interval_score(F.col("ka"), F.col("kb"))
    return paired(t).select("pair_id", s["score"].alias("score"), s["note"].alias("note"))


SCORED = f"""select *, {TEMPO_CASE} as ts, {INTERVAL_CASE} as ks
 from (select *, {RATIO} as r, abs({REL('ka')}-{REL('kb')}) as iv from pairs) q"""


def scored(t):
    a, b = F.col("ta"), F.col("tb")
    return (paired(t).withColumn("r", S.tempo_ratio(a, b)).withColumn("ts", S.tempo_score(a, b)["score"])
            .withColumn("ks", S.key_interval_score(F.col("ka"), F.col("kb"))["score"]))


@query("b10_recommended_mode", sql("songs song_pairs", f"""select pair_id, case when r>1.3 or ks<0.4 then 'a_vocals_b_inst' else 'blend' end as mode,
 case when r>1.3 then '{K.MODE_REASONS["tempo"]}' when ks<0.4 then '{K.MODE_REASONS["key"]}' else '{K.MODE_REASONS["blend"]}' end as reason
 from scored""", pairs=PAIR_SQL, scored=SCORED))
def _(t):
    m = S.recommended_mode(F.col("r"), F.col("ks"))
    return scored(t).select("pair_id", m["mode"].alias("mode"), m["reason"].alias("reason"))


@query("b11_predicted_quality", sql("songs song_pairs", """select pair_id, round(ts*0.4e0+ks*0.4e0+0.1e0,6) as quality
 from scored""", pairs=PAIR_SQL, scored=SCORED))
def _(t):
    return scored(t).select("pair_id", r6(S.predicted_quality(F.col("ts"), F.col("ks"))).alias("quality"))


@query("b12_best_config", sql("songs song_pairs", """select pair_id, mode, round(score,6) as score from (
 select *, row_number() over(partition by pair_id order by score desc, ord) as rn from (
 select pair_id, 0 as ord, 'a_vocals_b_inst' as mode, q as score from quality union all
 select pair_id, 1, 'b_vocals_a_inst', q from quality union all
 select pair_id, 2, 'blend', case when r>1.15 then q*0.7e0 else q end from quality where r<1.2) u) v where rn=1""",
 pairs=PAIR_SQL, scored=SCORED, quality="select *, ts*0.4e0+ks*0.4e0+0.1e0 as q from scored"))
def _(t):
    c = S.best_config(F.col("ta"), F.col("tb"), S.predicted_quality(F.col("ts"), F.col("ks")))
    return scored(t).select("pair_id", c["mode"].alias("mode"), r6(c["score"]).alias("score"))


def _pick_sql(options):
    union = " union all ".join(f"select pair_id, {i} as ord, '{n}' as name, {e} as ratio from pairs" for i, (n, e) in enumerate(options))
    return f"""select pair_id, name, round(ratio,6) as ratio from (select *, row_number() over(
 partition by pair_id order by abs(ratio-1), ord) as rn from ({union}) u) v where rn=1"""


@query("b13_tempo_strategy", sql("songs song_pairs", _pick_sql([
    ("direct", "ta/tb"), ("half_b", "ta/(tb/2)"), ("double_b", "ta/(tb*2)"), ("half_a", "(ta/2)/tb"), ("double_a", "(ta*2)/tb")]), pairs=PAIR_SQL))
def _(t):
    s = S.tempo_strategy(F.col("ta"), F.col("tb"))
    return paired(t).select("pair_id", s["name"].alias("name"), r6(s["ratio"]).alias("ratio"))


@query("b14_otac_ratio", sql("songs song_pairs", f"""select pair_id, ratio from ({_pick_sql([
    ("direct", "ta/tb"), ("double", "(ta*2)/tb"), ("half", "ta/(tb*2)")])}) w""", pairs=PAIR_SQL))
def _(t):
    return paired(t).select("pair_id", r6(S.otac_ratio(F.col("ta"), F.col("tb"))).alias("ratio"))


@query("b15_stretch_decision", sql("songs song_pairs", """select pair_id, case when abs(r-1)<0.005 then 'none_needed'
 when r<0.86 or r>1.16 then 'out_of_range' else 'stretch' end as action,
 round(case when abs(r-1)<0.005 or r<0.86 or r>1.16 then 1e0 else r end,6) as ratio
 from (select pair_id, case when q between 1.85 and 2.15 then q/2 when q between 0.47 and 0.54 then q*2 else q end as r
 from (select pair_id, tb/ta as q from pairs) x) y""", pairs=PAIR_SQL))
def _(t):
    s = S.stretch_decision(F.col("ta"), F.col("tb"))
    return paired(t).select("pair_id", s["action"].alias("action"), r6(s["ratio"]).alias("ratio"))


@query("b16_semitone_shift", sql("songs song_pairs", f"""select pair_id, cast(case when d>6 then d-12 when d<-6 then d+12 else d end as int) as shift
 from (select pair_id, {ROOT('kb')}-{ROOT('ka')} as d from pairs) q""", pairs=PAIR_SQL))
def _(t):
    return paired(t).select("pair_id", S.semitone_shift(F.col("ka"), F.col("kb")).alias("shift"))


@query("b19_auto_rating", sql("mix_scores", """select mix_id, cast(greatest(1, least(5, round_even(beat_coherence*4+1, 0))) as int) as rating from mix_scores"""))
def _(t):
    return t.mix_scores.select("mix_id", S.auto_rating(F.col("beat_coherence")).alias("rating"))


@query("b20_clamp_rating", sql("ratings_in", "select seq, cast(greatest(1, least(5, rating)) as int) as rating from ratings_in"))
def _(t):
    return t.ratings_in.select("seq", S.clamp_rating(F.col("rating")).alias("rating"))


DUR_CASE = "case when d>=2 then 1e0 when d>=1 then 0.6e0+0.4e0*(d-1) when d>=0.5 then 0.6e0*(d-0.5e0)/0.5e0 else 0e0 end"


@query("b21_duration_score", sql("frames", f"select song_id, frame, round({DUR_CASE},6) as score from (select song_id, frame, rms*3e0 as d from frames) q"))
def _(t):
    return t.frames.select("song_id", "frame", r6(S.duration_score(F.col("rms") * 3)).alias("score"))


@query("b22_phrase_quality", sql("frames", f"""select song_id, frame, round(0.5e0*rms+0.3e0*(1-rms)+0.2e0*({DUR_CASE}),6) as quality
 from (select song_id, frame, rms, rms*3e0 as d from frames) q"""))
def _(t):
    q = S.phrase_quality(F.col("rms"), 1 - F.col("rms"), S.duration_score(F.col("rms") * 3))
    return t.frames.select("song_id", "frame", r6(q).alias("quality"))


@query("b23_to_db", sql("frames", """select song_id, frame, round(20*log10(rms+1e-10),6) as db,
 round(greatest(-55e0, least(-25e0, 20*log10(rms+1e-10))),6) as gate from frames"""))
def _(t):
    db = S.to_db(F.col("rms"))
    return t.frames.select("song_id", "frame", r6(db).alias("db"), r6(S.clip(db, -55, -25)).alias("gate"))


@query("b24_hz_to_midi", sql("songs", """select song_id, round(69+12*log2(vocal_centroid/440e0),6) as midi,
 round(1200*log2(vocal_centroid/2000e0),6) as cents from songs"""))
def _(t):
    hz = F.col("vocal_centroid")
    return t.songs.select("song_id", r6(S.hz_to_midi(hz)).alias("midi"), r6(S.to_cents(hz, F.lit(2000.0))).alias("cents"))


PARAM_EMB_SQL = """select m.*, a.embedding as ea, b.embedding as eb from mix_params m
 join embeddings a on m.song_a=a.vec_id join embeddings b on m.song_b=b.vec_id"""


def with_vectors(t, df):
    e = t.embeddings
    return (df.join(e.select(F.col("song_id").alias("song_a"), F.col("embedding").alias("ea")), "song_a")
            .join(e.select(F.col("song_id").alias("song_b"), F.col("embedding").alias("eb")), "song_b"))


@query("b25_feature_vector", sql("mix_params", """select mix_id, len(v) as width, round(list_sum(v),6) as total,
 round(list_extract(v,1),6) as first_value, round(list_extract(v,129),6) as direction_flag, round(list_extract(v,130),6) as shift_value
 from (select mix_id, list_concat(list_transform(list_concat(ea,eb), lambda x: cast(x as double)),
 list_value(case when direction='a_vocals' then 1e0 else 0e0 end, key_shift/6e0)) as v from p) q""", p=PARAM_EMB_SQL))
def _(t):
    v = A.feature_vector(F.col("ea"), F.col("eb"), F.col("direction"), F.col("key_shift"))
    return with_vectors(t, t.mix_params).select("mix_id", v.alias("v")).select(
        "mix_id", F.size("v").cast("bigint").alias("width"),
        r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.col("v")[0]).alias("first_value"),
        r6(F.element_at("v", 129)).alias("direction_flag"), r6(F.element_at("v", 130)).alias("shift_value"))


DOT = lambda a, b: f"list_sum(list_transform(range(1,len({a})+1), lambda i: cast(list_extract({a},i) as double)*cast(list_extract({b},i) as double)))"


@query("b26_dot_cosine", sql("song_pairs", f"""select pair_id, round(ab,6) as dot, round(ab/(sqrt(aa)*sqrt(bb)+1e-10),6) as cosine
 from (select pair_id, {DOT('ea','eb')} as ab, {DOT('ea','ea')} as aa, {DOT('eb','eb')} as bb from (
 select p.pair_id, a.embedding as ea, b.embedding as eb from song_pairs p join embeddings a on p.song_a=a.vec_id
 join embeddings b on p.song_b=b.vec_id) q) w"""))
def _(t):
    return with_vectors(t, t.song_pairs).select("pair_id", r6(A.dot(F.col("ea"), F.col("eb"))).alias("dot"),
                                                r6(A.cosine(F.col("ea"), F.col("eb"))).alias("cosine"))


@query("b27_normalize_pad_clip", sql("", """select vec_id as song_id, round(list_sum(list_transform(n, lambda x: x*x)),6) as unit,
 round(list_extract(n,3),6) as third, 128::bigint as width, round(list_sum(list_transform(v, lambda x: greatest(-3e0, least(3e0, x*30)))),6) as clipped_sum
 from (select vec_id, v, list_transform(v, lambda x: x/s) as n from (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x*x))) as s
 from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings) a) b) c"""))
def _(t):
    v = F.transform("embedding", lambda x: x.cast("double") * 30)
    clipped = A.clip_array(A.pad(v, 128), -3, 3)
    n = A.l2_normalize(v)
    return t.embeddings.select(
        "song_id", r6(A.norm(n)).alias("unit"), r6(F.element_at(n, 3)).alias("third"),
        F.size(clipped).cast("bigint").alias("width"),
        r6(F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)).alias("clipped_sum"))


@query("b28_simple_key", sql("chromas", f"""select song_id, list_extract({NOTES_SQL}, list_position(chroma, list_max(chroma))) as key from chromas"""))
def _(t):
    return t.chromas.select("song_id", A.simple_key(F.col("chroma")).alias("key"))


@query("b29_positions", sql("beats", """select song_id, beat_idx, cast(trunc(t*44100) as bigint) as pos, round(trunc(t*44100)/44100e0,6) as sec,
 cast(floor(trunc(t*44100)/88200e0) as bigint) as bar from beats"""))
def _(t):
    pos = S.sec_to_pos(F.col("t"))
    return t.beats.select("song_id", "beat_idx", pos.alias("pos"), r6(S.pos_to_sec(pos)).alias("sec"),
                          S.pos_to_bar(pos, F.lit(88200.0)).alias("bar"))
