"""Framed-signal queries."""

from pyspark.sql import functions as F

from tonegrid.functions import scalars as S
from tonegrid.operators import signal as X
from tonegrid.plans.adapters import sql
from tonegrid.plans.registry import query

SONG = ["song_id"]


def r6(c):
    return F.round(c, 6)


WIN = "select song_id, pos//16 as frame, sqrt(avg(x*x)) as rms, max(pos) as last_pos from samples group by song_id, pos//16"
LEN = "select song_id, max(pos)+1 as len from samples group by song_id"


@query("d01_window_rms", sql("samples", """select song_id, frame, round(rms,6) as rms from win join lens using(song_id)
 where (frame+1)*16<=len or frame=0""", win=WIN, lens=LEN))
def _(t):
    return X.window_rms(t.stored("samples"), SONG, "pos", "x", 16).select("song_id", "frame", r6("rms").alias("rms"))


@query("d01_window_rms_open_end", sql("samples", """select song_id, frame, round(rms,6) as rms from win join lens using(song_id)
 where (frame+1)*16<len""", win=WIN, lens=LEN))
def _(t):
    return X.window_rms(t.samples, SONG, "pos", "x", 16, drop_last=True).select("song_id", "frame", r6("rms").alias("rms"))


@query("d02_sum_stems", sql("samples", "select song_id, bar as pos, round(sum(x),6) as x from (select song_id, pos//4 as bar, x from samples) q group by song_id, bar"))
def _(t):
    four = t.samples.select("song_id", F.floor(F.col("pos") / 4).alias("pos"), "x")
    return X.sum_stems(four, SONG, "pos", "x").select("song_id", "pos", r6("x").alias("x"))


@query("d05_max_normalize", sql("frames", """select song_id, frame, round(case when mx>0 then rms/mx else rms end,6) as level,
 round(mean_e,6) as overall from (select *, max(rms) over(partition by song_id) as mx,
 avg(rms) over(partition by song_id)/max(rms) over(partition by song_id) as mean_e from frames) q"""))
def _(t):
    d = X.max_normalize(t.frames, SONG, "rms", "level")
    return X.with_group_stats(d, SONG, F.avg("level").alias("overall")).select(
        "song_id", "frame", r6("level").alias("level"), r6("overall").alias("overall"))


@query("d06_minmax_normalize", sql("frames", """select song_id, frame, round(case when mx-mn<1e-10 then 0 else (rms-mn)/(mx-mn) end,6) as rms
 from (select *, max(rms) over(partition by song_id) as mx, min(rms) over(partition by song_id) as mn from frames) q"""))
def _(t):
    return X.minmax_normalize(t.frames, SONG, ["rms"]).select("song_id", "frame", r6("rms").alias("rms"))


@query("d32_loudest_window", sql("samples", """select song_id, case when len<=160 then 0 else s*16 end as start_pos,
 case when len<=160 then len else s*16+160 end as end_pos from (select *, row_number() over(partition by song_id
 order by round(e,9) desc, s) as rn from roll where len<=160 or s*16<len-160) q where rn=1""",
 sec="select song_id, pos//16 as s, sum(x*x) as e from samples group by song_id, pos//16", lens=LEN,
 roll="""select song_id, s, len, sum(e) over(partition by song_id order by s rows between current row and 9 following) as e
 from sec join lens using(song_id)"""))
def _(t):
    return X.loudest_window(t.stored("samples"), SONG, "pos", "x", 10, sr=16)


@query("c12_beat_energy", sql("samples beats", """select song_id, beat_idx, round(t,6) as t, round(case when mx>0 then e/mx else e end,6) as energy
 from (select *, max(e) over(partition by song_id) as mx from (select * from on_beats union all select * from on_windows) u) q""",
 lens=LEN, mybeats="select b.* from beats b join lens using(song_id)",
 spans="""select song_id, beat_idx, t, greatest(0, least(cast(trunc(t*40) as bigint), len-1)) as s,
 greatest(greatest(0, least(cast(trunc(t*40) as bigint), len-1))+1, least(cast(trunc(nt*40) as bigint), len)) as e
 from (select *, lead(t) over(partition by song_id order by beat_idx) as nt from mybeats) q join lens using(song_id) where nt is not null""",
 on_beats="""select s.song_id, s.beat_idx, s.t, sqrt(avg(x*x)) as e from spans s join samples p on p.song_id=s.song_id
 and p.pos>=s.s and p.pos<s.e group by s.song_id, s.beat_idx, s.t""",
 on_windows="""select song_id, pos//20 as beat_idx, (pos//20)*0.5e0 as t, sqrt(avg(x*x)) as e from samples join lens using(song_id)
 where song_id not in (select song_id from spans) and ((pos//20+1)*20<=len or pos<20) group by song_id, pos//20"""))
def _(t):
    b = X.beat_energy(t.stored("samples"), t.stored("beats"), SONG, "pos", "x", "t", "beat_idx", sr=40)
    return b.select("song_id", "beat_idx", r6("t").alias("t"), r6("energy").alias("energy"))


@query("e01_moving_average", sql("frames", """select song_id, frame, round(case when n<16 then rms else s/16 end,9) as rms from (
 select *, count(*) over(partition by song_id) as n, sum(rms) over(partition by song_id order by frame
 rows between 8 preceding and 7 following) as s from frames) q"""))
def _(t):
    return X.moving_average(t.frames, SONG, "frame", ["rms"], 16).select("song_id", "frame", F.round("rms", 9).alias("rms"))


@query("e02_smooth3", sql("frames", """select song_id, frame, round(case when n<3 then rms else
 0.25e0*coalesce(p,0)+0.5e0*rms+0.25e0*coalesce(x,0) end,6) as rms from (select *, count(*) over(partition by song_id) as n,
 lag(rms) over(partition by song_id order by frame) as p, lead(rms) over(partition by song_id order by frame) as x from frames) q"""))
def _(t):
    return X.smooth3(t.frames, SONG, "frame", "rms").select("song_id", "frame", r6("rms").alias("rms"))


def vector_frames(t):
    """Frames with two small vectors standing for timbre and harmony."""
    tone = F.when(F.col("stem") == "vocals", 1.0).otherwise(0.25)
    return t.frames.select("song_id", "frame", "rms", F.array(F.col("rms"), F.col("rms") * F.col("rms")).alias("mfcc"),
                           F.array(tone, 1 - F.col("rms")).alias("chroma"))


VECTOR = "select song_id, frame, rms, rms*rms as m2, case when stem='vocals' then 1e0 else 0.25e0 end as tone, 1-rms as inv from frames"
NOVEL = """select song_id, frame, sqrt((n1-rms)*(n1-rms)+(n2-m2)*(n2-m2)) as a, sqrt((nt-tone)*(nt-tone)+(ni-inv)*(ni-inv)) as b,
 abs(n1-rms) as c from (select *, lead(rms) over w as n1, lead(m2) over w as n2, lead(tone) over w as nt, lead(inv) over w as ni
 from vec window w as (partition by song_id order by frame)) q where n1 is not null"""


@query("e03_vector_novelty", sql("frames", "select song_id, frame, round(a,6) as mfcc_novelty, round(b,6) as chroma_novelty, round(c,6) as rms_novelty from nov", vec=VECTOR, nov=NOVEL))
def _(t):
    n = X.vector_novelty(vector_frames(t), SONG, "frame", ["mfcc", "chroma"], ["rms"])
    return n.select("song_id", "frame", *[r6(f"{c}_novelty").alias(f"{c}_novelty") for c in ("mfcc", "chroma", "rms")])


_MA = lambda c: f"case when count(*) over(partition by song_id)<16 then {c} else sum({c}) over(partition by song_id order by frame rows between 8 preceding and 7 following)/16 end"
_MM = lambda c: f"case when max({c}) over(partition by song_id)-min({c}) over(partition by song_id)<1e-10 then 0 else ({c}-min({c}) over(partition by song_id))/(max({c}) over(partition by song_id)-min({c}) over(partition by song_id)) end"
COMBINED = dict(vec=VECTOR, nov=NOVEL, sm=f"select song_id, frame, {_MA('a')} as a, {_MA('b')} as b, {_MA('c')} as c from nov",
                mm=f"select song_id, frame, {_MM('a')} as a, {_MM('b')} as b, {_MM('c')} as c from sm",
                cmb="select song_id, frame, a*0.40e0+b*0.35e0+c*0.25e0 as novelty from mm",
                lim="select song_id, quantile_cont(novelty,0.5)+0.5e0*stddev_pop(novelty) as threshold from cmb group by song_id")

PEAK_ROWS = """select song_id, frame from (select song_id, frame, novelty, lag(novelty) over w as p, lead(novelty) over w as n, threshold
 from cmb join lim using(song_id) window w as (partition by song_id order by frame)) q where novelty>p and novelty>n and novelty>threshold"""


@query("e04_combined_novelty", sql("frames", "select song_id, frame, round(novelty,6) as novelty, round(threshold,6) as threshold from cmb join lim using(song_id)", **COMBINED))
def _(t):
    n = X.combined_novelty(vector_frames(t), SONG, "frame", "mfcc", "chroma", "rms")
    return n.select("song_id", "frame", r6("novelty").alias("novelty"), r6("threshold").alias("threshold"))


@query("e05_local_maxima", sql("frames", """select song_id, frame, round(rms,6) as rms from (select *, lag(rms) over(partition by song_id order by frame) as p,
 lead(rms) over(partition by song_id order by frame) as n from frames) q where rms>p and rms>n and rms>0.3e0"""))
def _(t):
    return X.local_maxima(t.frames, SONG, "frame", "rms", F.lit(0.3)).select("song_id", "frame", r6("rms").alias("rms"))


ACT = dict(
    lv="select *, case when mx>=1e-6 then rms/mx else 0e0 end as level from (select *, max(rms) over(partition by song_id) as mx from frames) q",
    md="select song_id, quantile_cont(level,0.5) filter(where level>0.01) as med from lv group by song_id",
    act="""select song_id, frame, rms, mx, level, greatest(0.10e0, coalesce(med,0.1e0)*0.5e0) as threshold,
 mx>=1e-6 and level>greatest(0.10e0, coalesce(med,0.1e0)*0.5e0) as active from lv join md using(song_id)""",
    near="""select *, max(case when active then frame end) over(partition by song_id order by frame rows between unbounded preceding and 1 preceding) as prv,
 min(case when active then frame end) over(partition by song_id order by frame rows between 1 following and unbounded following) as nxt from act""",
    br="""select song_id, frame, rms, case when active then 1e0 when nxt-prv-1<=6 and frame-prv>=nxt-prv-1-2 then 0.5e0 else 0e0 end as activity from near""",
    isl="""select *, activity>0 as onn, frame-row_number() over(partition by song_id, activity>0 order by frame) as g from br""",
    sh="""select song_id, frame, rms, case when onn and count(*) over(partition by song_id, onn, g)<2 then 0e0 else activity end as activity from isl""",
    ph="""select song_id, min(frame)*0.25e0 as start_time, (max(frame)+1)*0.25e0 as end_time, sqrt(avg(rms*rms)) as energy from (
 select *, frame-row_number() over(partition by song_id order by frame) as g from sh where activity>0) q group by song_id, g""")


def upto(last):
    keys = list(ACT)
    return {k: ACT[k] for k in keys[:keys.index(last) + 1]}


@query("e06_active_phrases", sql("frames", """select song_id, round(start_time,6) as start_time, round(end_time,6) as end_time,
 round(energy,6) as energy, energy>0.03 as is_strong from ph""", **upto("ph")))
def _(t):
    p = X.active_phrases(t.stored("frames"), SONG, "frame", "rms")
    return p.select("song_id", r6("start_time").alias("start_time"), r6("end_time").alias("end_time"),
                    r6("energy").alias("energy"), "is_strong")


@query("e07_bridge_gaps", sql("frames", "select song_id, frame, activity from br", **upto("br")))
def _(t):
    a = X.activity_rms(t.stored("frames"), SONG, "frame", "rms")
    return X.bridge_gaps(a, SONG, "frame", "active").select("song_id", "frame", "activity")


@query("e08_drop_short_runs", sql("frames", "select song_id, frame, activity from sh", **upto("sh")))
def _(t):
    a = X.bridge_gaps(X.activity_rms(t.stored("frames"), SONG, "frame", "rms"), SONG, "frame", "active")
    return X.drop_short_runs(a, SONG, "frame", "activity", 2).select("song_id", "frame", "activity")


@query("e09_activity_rms", sql("frames", "select song_id, frame, round(level,6) as level, round(threshold,6) as threshold, active from act", **upto("act")))
def _(t):
    a = X.activity_rms(t.stored("frames"), SONG, "frame", "rms")
    return a.select("song_id", "frame", r6("level").alias("level"), r6("threshold").alias("threshold"), "active")


@query("e10_db_gate_phrases", sql("frames", """select song_id, start, stop as "end", round((stop-start)/100e0,6) as duration, round(energy,6) as energy from (
 select p.song_id, p.s*10 as start, (p.e+1)*10 as stop, sqrt(avg(f.rms*f.rms)) as energy from ph p join frames f on f.song_id=p.song_id
 and f.frame between p.s and p.e group by p.song_id, p.s, p.e) q""",
 db="select song_id, frame, rms, 20*log10(rms+1e-8) as db from frames",
 gate="select song_id, greatest(-55e0, least(-25e0, quantile_cont(db,0.15))) as thr from db group by song_id",
 onf="select song_id, frame, lag(frame) over(partition by song_id order by frame) as pf from db join gate using(song_id) where db>thr",
 grp="select *, sum(case when frame-pf<=3 then 0 else 1 end) over(partition by song_id order by frame) as g from onf",
 ph="select song_id, min(frame) as s, max(frame) as e from grp group by song_id, g having max(frame)-min(frame)+1>=4"))
def _(t):
    p = X.db_gate_phrases(t.stored("frames"), SONG, "frame", "rms", sr=100, hop=10, bridge_s=0.2, min_s=0.4)
    return p.select("song_id", "start", "end", r6("duration").alias("duration"), r6("energy").alias("energy"))


@query("e11_hysteresis", sql("frames", """select song_id, frame, coalesce(last_value(sw ignore nulls) over(partition by song_id order by frame
 rows between unbounded preceding and current row),0)=1 as active from (select song_id, frame, case when rms>coalesce(p,0.001e0)*1.2e0 then 1
 when rms<coalesce(p,0.001e0)*0.6e0 then 0 end as sw from frames left join (select song_id, quantile_cont(rms,0.2) as p from frames
 where rms>0.001e0 group by song_id) q using(song_id)) w"""))
def _(t):
    return X.hysteresis(t.stored("frames"), SONG, "frame", "rms").select("song_id", "frame", "active")


@query("e12_ramp_mask", sql("frames", """select song_id, frame, round(greatest(0e0,least(1e0,case when pt is null then m when hi-lo>1 then case when fall is not null then 1-(frame-lo)/(hi-lo-1e0) else (frame-lo)/(hi-lo-1e0) end
 when fall is not null then 1e0 else 0e0 end)),6) as mask from (select *, greatest(pt-3,0) as lo, least(pt+3,len) as hi from near) q""",
    pr="select song_id, quantile_cont(rms,0.2) as p from frames where rms>0.001e0 group by song_id",
    sw="select song_id, frame, case when rms>coalesce(p,0.001e0)*1.2e0 then 1 when rms<coalesce(p,0.001e0)*0.6e0 then 0 end as sw from frames left join pr using(song_id)",
    mk="select song_id, frame, cast(coalesce(last_value(sw ignore nulls) over(partition by song_id order by frame rows between unbounded preceding and current row),0) as double) as m from sw",
    st="select *, count(*) over(partition by song_id) as len, lead(m) over(partition by song_id order by frame)-m as step from mk",
    # the last switch whose ramp reaches a row
    near="""select a.song_id, a.frame, a.m, a.len, max(b.frame) filter (where b.step<0) as fall, coalesce(max(b.frame) filter (where b.step<0), max(b.frame) filter (where b.step>0)) as pt
 from st a left join st b on b.song_id=a.song_id and b.step<>0 and a.frame>=b.frame-3 and a.frame<b.frame+3 group by 1,2,3,4"""))
def _(t):
    m = X.hysteresis(t.stored("frames"), SONG, "frame", "rms").withColumn("mask", F.col("active").cast("double"))
    return X.ramp_mask(m, SONG, "frame", "mask", 6).select("song_id", "frame", r6("mask").alias("mask"))


PHQ = dict(q="""select *, case when end_time-start_time>=0.5e0 then 0.5e0*(1-energy)+0.5e0*least(1e0,(end_time-start_time)/8) end as quality from ph""",
           n="select *, count(quality) over(partition by song_id) as n from q",
           rk="select *, row_number() over(partition by song_id order by -quality, -energy, start_time) as rn from n where quality is not null")


@query("e17_keep_top_ratio", sql("frames", """select song_id, round(start_time,6) as start_time, round(quality,6) as quality
 from rk where rn<=greatest(1,cast(trunc(n*0.7e0) as int)) union all select song_id, round(start_time,6), null from n where n=0""", **upto("ph"), **PHQ))
def _(t):
    p = X.active_phrases(t.stored("frames"), SONG, "frame", "rms")
    d = F.col("end_time") - F.col("start_time")
    p = p.withColumn("quality", 0.5 * (1 - F.col("energy")) + 0.5 * F.least(F.lit(1.0), d / 8))
    p = p.withColumn("quality", F.when(d >= 0.5, F.col("quality")))
    return X.keep_top_ratio(p, SONG, "quality", "energy", "start_time", d >= 0.5).select(
        "song_id", r6("start_time").alias("start_time"), r6("quality").alias("quality"))


@query("e19_notes", sql("frames", """select song_id, 'note_' || lpad(cast(row_number() over(partition by song_id order by st) as varchar),3,'0') as note_id,
 round(69+12*log2(f/440e0),6) as midi_number, round(f,6) as frequency, round(sd,6) as frequency_std, round(st,6) as start_time,
 round(en,6) as end_time, round(en-st,6) as duration, round(1-sd/f,6) as confidence from (
 select song_id, g, avg(f0) as f, stddev_pop(f0) as sd, min(frame)*0.25e0 as st, max(frame)*0.25e0 as en from (
 select *, frame-row_number() over(partition by song_id order by frame) as g from (select song_id, frame, rms*400 as f0 from frames where stem<>'noise' and rms>0) a) b
 group by song_id, g) c"""))
def _(t):
    f0 = t.stored("frames").select("song_id", "frame", (F.col("frame") * 0.25).alias("t"),
                         F.when(F.col("stem") != "noise", F.col("rms") * 400).otherwise(0.0).alias("f0"))
    n = X.notes(f0, SONG, "frame", "t", "f0")
    return n.select("song_id", "note_id", *[r6(c).alias(c) for c in n.columns if c not in ("song_id", "note_id")])


@query("e20_energy_phrases", sql("frames", """select song_id, 'phrase_' || lpad(cast(row_number() over(partition by song_id order by st) as varchar),3,'0') as phrase_id,
 round(st,6) as start_time, round(en,6) as end_time, round(en-st,6) as duration, round(m,6) as energy_mean, round(sd,6) as energy_std from (
 select song_id, g, avg(rms) as m, stddev_pop(rms) as sd, min(frame)*0.4e0 as st, max(frame)*0.4e0 as en from (
 select *, frame-row_number() over(partition by song_id order by frame) as g from (select f.* from frames f join (
 select song_id, quantile_cont(rms,0.4) as p from frames group by song_id) q using(song_id) where rms>p) a) b
 group by song_id, g having count(*)>=3 and max(frame)*0.4e0-min(frame)*0.4e0>0.5e0) c"""))
def _(t):
    f = t.stored("frames").withColumn("t", F.col("frame") * 0.4)
    p = X.energy_phrases(f, SONG, "frame", "t", "rms")
    return p.select("song_id", "phrase_id", *[r6(c).alias(c) for c in p.columns if c not in ("song_id", "phrase_id")])


@query("e21_onset_strength", sql("frames", """select song_id, frame, round(coalesce((greatest(rms-lag(rms) over w,0)+greatest(m2-lag(m2) over w,0))/2,0),6) as onset
 from vec window w as (partition by song_id order by frame)""", vec=VECTOR))
def _(t):
    return X.onset_strength(vector_frames(t), SONG, "frame", "mfcc").select("song_id", "frame", r6("onset").alias("onset"))


@query("e22_change_points", sql("frames", "select song_id, frame, stem from (select *, lag(stem) over(partition by song_id order by frame) as p from frames) q where p<>stem"))
def _(t):
    return X.change_points(t.frames, SONG, "frame", "stem").select("song_id", "frame", "stem")
