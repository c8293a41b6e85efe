"""Beat, section and bar queries."""

from pyspark.sql import functions as F

from tonegrid.operators import signal as X
from tonegrid.operators import structure as B
from tonegrid.operators.folds import spaced_points
from tonegrid.plans.adapters import sql
from tonegrid.plans.registry import query
from tonegrid.session import materialize
from tonegrid.plans.series_queries import COMBINED, PEAK_ROWS, SONG, r6, upto, vector_frames

IV = dict(iv="select *, t-lag(t) over(partition by song_id order by beat_idx) as d from beats")


@query("d21_tempo_from_beats", sql("beats", """select song_id, round(coalesce(case when x<70 then x*2 when x>180 then x/2 else x end,120e0),6) as tempo
 from (select song_id, 60e0/nullif(quantile_cont(d,0.5),0) as x from iv group by song_id) q""", **IV))
def _(t):
    return B.tempo_from_beats(t.stored("beats"), SONG, "beat_idx", "t").select("song_id", r6("tempo").alias("tempo"))


@query("d22_tempo_stable", sql("beats", """select song_id, case when count(*)>4 then (case when avg(d)>0 then round(stddev_pop(d)/avg(d),12) else 1 end)<0.6e0 else true end as stable
 from iv group by song_id""", **IV))
def _(t):
    return B.tempo_stable(t.beats, SONG, "beat_idx", "t", cv=0.6)


PHASE = lambda extra="": f"""select song_id, phase from (select *, row_number() over(partition by song_id order by case when n>=4 then round(s,12) else -phase end desc, phase) as rn
 from (select song_id, cast(beat_idx%4 as int) as phase, avg(strength) as s, sum(count(*)) over(partition by song_id) as n from beats {extra} group by song_id, beat_idx%4) q) w where rn=1"""


@query("d23_downbeat_phase", sql("beats", "select a.song_id, a.phase as phase_first16, b.phase as phase_all from p16 a join pall b using(song_id)",
                                 p16=PHASE("where beat_idx<16"), pall=PHASE()))
def _(t):
    a = B.downbeat_phase(t.stored("beats"), SONG, "beat_idx", "strength", 16).withColumnRenamed("phase", "phase_first16")
    b = B.downbeat_phase(t.stored("beats"), SONG, "beat_idx", "strength").withColumnRenamed("phase", "phase_all")
    return a.join(b, "song_id")


@query("d23_downbeats", sql("beats", """select song_id, beat_idx, t from beats join (select song_id, count(*) as n from beats group by song_id) c using(song_id)
 join pall using(song_id) where n<4 or beat_idx%4=phase""", pall=PHASE()))
def _(t):
    return B.downbeats(t.stored("beats"), SONG, "beat_idx", "strength").select("song_id", "beat_idx", "t")


@query("d24_first_strong_beat", sql("beats", """select song_id, beat_idx from (select *, row_number() over(partition by song_id order by strength desc, beat_idx) as rn
 from beats where beat_idx<8) q where rn=1"""))
def _(t):
    return B.first_strong_beat(t.beats, SONG, "beat_idx", "strength")


DOWN = dict(pall=PHASE(), dn="""select song_id, t from beats join (select song_id, count(*) as n from beats group by song_id) c using(song_id)
 join pall using(song_id) where n<4 or beat_idx%4=phase""")


@query("c06_snap_nearest", sql("sections beats", """select song_id, section_idx, coalesce(g, end_time) as snapped from (
 select s.song_id, s.section_idx, s.end_time, d.t as g, row_number() over(partition by s.song_id, s.section_idx order by abs(d.t-s.end_time), d.t) as rn
 from sections s left join dn d on s.song_id=d.song_id) q where rn=1""", **DOWN))
def _(t):
    p = t.stored("sections").select("song_id", "section_idx", "end_time")
    d = B.downbeats(t.stored("beats"), SONG, "beat_idx", "strength")
    return B.snap_nearest(p, d, t.stored("beats"), SONG, "end_time", "t", "t", "snapped").select("song_id", "section_idx", "snapped")


@query("c07_beats_in_range", sql("sections beats", """select s.song_id, s.section_idx, count(b.t) as n_beats, cast(floor(count(b.t)/4e0) as bigint) as n_bars
 from sections s left join beats b on s.song_id=b.song_id and b.t>=s.start_time and b.t<=s.end_time group by s.song_id, s.section_idx"""))
def _(t):
    return B.beats_in_range(t.stored("sections"), t.stored("beats"), SONG, "section_idx", "start_time", "end_time", "t").select(
        "song_id", "section_idx", "n_beats", "n_bars")


@query("c10_vocal_density", sql("sections", """select s.song_id, s.section_idx, round(coalesce(avg(case when b.activity>0 then 1e0 else 0e0 end) filter(where b.frame is not null),0),6) as vocal_density,
 coalesce(avg(case when b.activity>0 then 1e0 else 0e0 end) filter(where b.frame is not null),0)>0.25 as has_vocals from sections s left join br b on b.song_id=s.song_id
 and b.frame>=cast(trunc(s.start_time/0.25e0) as bigint) and b.frame<cast(trunc(s.end_time/0.25e0) as bigint) group by s.song_id, s.section_idx""", **upto("br")))
def _(t):
    a = X.bridge_gaps(X.activity_rms(t.stored("frames"), SONG, "frame", "rms"), SONG, "frame", "active")
    return B.vocal_density(t.stored("sections"), a, SONG, "frame", "activity").select(
        "song_id", "section_idx", r6("vocal_density").alias("vocal_density"), "has_vocals")


@query("c11_drum_dominance", sql("sections beats", """select song_id, section_idx, coalesce(m>mean*1.1e0,false) as drum_dominant from (
 select s.song_id, s.section_idx, w.mean, avg(b.strength) as m from sections s join (select song_id, greatest(max(end_time),1e0) as dur from sections group by song_id) d using(song_id)
 left join (select song_id, count(*) as n, avg(strength) as mean from beats group by song_id) w using(song_id)
 left join beats b on b.song_id=s.song_id and b.beat_idx>=greatest(0,cast(trunc(s.start_time/d.dur*w.n) as bigint))
 and b.beat_idx<least(cast(trunc(s.end_time/d.dur*w.n) as bigint), w.n) group by s.song_id, s.section_idx, w.mean) q"""))
def _(t):
    return B.drum_dominance(t.stored("sections"), t.stored("beats"), SONG, "beat_idx", "strength").select("song_id", "section_idx", "drum_dominant")


@query("d09_section_energy", sql("sections", """select song_id, section_idx, round(case when mx>0 then e/mx else e end,6) as energy, round(c,6) as spectral_centroid
 from (select *, max(e) over(partition by song_id) as mx from (select s.song_id, s.section_idx, sqrt(avg(f.rms*f.rms)) as e, avg(1000+f.rms*5000) as c
 from sections s join frames f on f.song_id=s.song_id and f.frame*0.25e0>=s.start_time and f.frame*0.25e0<s.end_time
 where s.end_time-s.start_time>=2 group by s.song_id, s.section_idx) a) b"""))
def _(t):
    f = t.frames.select("song_id", (F.col("frame") * 0.25).alias("t"), "rms", (1000 + F.col("rms") * 5000).alias("centroid"))
    s = t.stored("sections").select("song_id", "section_idx", "start_time", "end_time")
    return B.section_energy(s, f, SONG, "t", "rms", "centroid").select(
        "song_id", "section_idx", r6("energy").alias("energy"), r6("spectral_centroid").alias("spectral_centroid"))


@query("e13_label_bars", sql("frames", """select song_id, frame as bar, case when rms>=p75 then 'drop' when rms>=p40 then 'groove' when rms>=p20 then 'build' else 'breakdown' end as label
 from frames join (select song_id, quantile_cont(rms,0.75) as p75, quantile_cont(rms,0.4) as p40, quantile_cont(rms,0.2) as p20 from frames group by song_id) q using(song_id)"""))
def _(t):
    return B.label_bars(t.stored("frames").select("song_id", F.col("frame").alias("bar"), F.col("rms").alias("energy")), SONG).select("song_id", "bar", "label")


@query("e14_label_phrases", sql("frames", """select song_id, round(start_time,6) as start_time, case when energy>=p75 then 'hook' when energy>=p50 then 'groove' else 'atmosphere' end as type
 from ph join (select song_id, quantile_cont(energy,0.75) as p75, quantile_cont(energy,0.5) as p50 from ph group by song_id) q using(song_id)""", **upto("ph")))
def _(t):
    return B.label_phrases(X.active_phrases(t.stored("frames"), SONG, "frame", "rms"), SONG).select("song_id", r6("start_time").alias("start_time"), "type")


CLASSIFIED = """select *, case when pos<0.08 and energy<p40 then 'intro' when pos>0.90 and energy<p40 then 'outro' when energy<=p20 then 'breakdown'
 when building and not has_vocals then 'buildup' when energy>=p75 and not has_vocals then 'drop' when energy>=p75 then 'chorus' when has_vocals then 'verse'
 when energy>=p40 then 'instrumental' else 'verse' end as classification from (select s.*, q.p75, q.p40, q.p20,
 section_idx/greatest(count(*) over(partition by song_id)-1,1) as pos,
 coalesce(energy>0 and lead(energy) over(partition by song_id order by section_idx)>energy*1.2e0,false) as building from sections s join (
 select song_id, quantile_cont(energy,0.75) as p75, quantile_cont(energy,0.4) as p40, quantile_cont(energy,0.2) as p20 from sections group by song_id) q using(song_id)) w"""


@query("e15_classify_sections", sql("sections", "select song_id, section_idx, classification from cl", cl=CLASSIFIED))
def _(t):
    return B.classify_sections(t.stored("sections"), SONG).select("song_id", "section_idx", "classification")


@query("e16_label_sections_median", sql("sections", """select song_id, section_idx, case when section_idx=0 and energy<m*0.75e0 then 'intro' when section_idx=top and energy<m*0.75e0 then 'outro'
 when energy>m*1.3e0 then 'chorus' when energy<m*0.65e0 then 'breakdown' else 'verse' end as label from sections join (
 select song_id, quantile_cont(energy,0.5) as m, max(section_idx) as top from sections group by song_id) q using(song_id)"""))
def _(t):
    return B.label_sections_median(t.stored("sections"), SONG).select("song_id", "section_idx", "label")


LABELLED = "select song_id, floor(frame/4e0) as bar, round(avg(rms),12) as energy from frames group by song_id, floor(frame/4e0)"
LBL = """select song_id, cast(bar as bigint) as bar, case when energy>=p75 then 'drop' when energy>=p40 then 'groove' when energy>=p20 then 'build' else 'breakdown' end as label
 from b join (select song_id, quantile_cont(energy,0.75) as p75, quantile_cont(energy,0.4) as p40, quantile_cont(energy,0.2) as p20 from b group by song_id) q using(song_id)"""


def labelled_bars(t):
    b = t.frames.groupBy("song_id", F.floor(F.col("frame") / 4).alias("bar")).agg(F.round(F.avg("rms"), 12).alias("energy"))
    return B.label_bars(materialize(b, "bars"), SONG)


@query("e18_drop_starts", sql("frames", """select song_id, bar from (select *, lag(label) over(partition by song_id order by bar) as p from lbl) q
 where label='drop' and p<>'drop'""", b=LABELLED, lbl=LBL))
def _(t):
    return B.drop_starts(labelled_bars(t), SONG).select("song_id", "bar")


@query("d36_label_counts", sql("frames", "select song_id, label, count(*) as n from lbl group by song_id, label", b=LABELLED, lbl=LBL))
def _(t):
    return B.label_counts(labelled_bars(t), SONG)


@query("h07_sweep_schedule", sql("frames", """select song_id, bar as drop_bar, cast(seg as int) as segment, cast(s+seg*n as bigint) as start, cast(least(s+seg*n+n, bar*64) as bigint) as "end",
 round(least(300e0+seg/16e0*(22050e0*0.9e0-300e0), 22050e0*0.9e0),6) as cutoff from (select song_id, bar, greatest(0,bar-2)*64 as s, floor((bar*64-greatest(0,bar-2)*64)/16e0) as n
 from (select *, lag(label) over(partition by song_id order by bar) as p from lbl) q where label='drop' and p<>'drop') w, range(0,16) r(seg) where n>0""", b=LABELLED, lbl=LBL))
def _(t):
    d = B.sweep_schedule(labelled_bars(t), SONG, 64)
    return d.withColumn("cutoff", r6("cutoff"))


PEAKS = dict(COMBINED, pk=PEAK_ROWS,
    pick="""select song_id, min(frame) as frame from pk group by song_id union all select p.song_id, min(k.frame) from pick p join pk k
 on k.song_id=p.song_id and k.frame-p.frame>=6 group by p.song_id, p.frame""")


@query("g01_boundary_peaks", sql("frames", "select song_id, frame from pick", **PEAKS))
def _(t):
    return B.boundary_peaks(vector_frames(t), SONG, "frame", "mfcc", "chroma", "rms", 6)


@query("g02_clean_boundaries", sql("sections beats", """select song_id, t, cast(row_number() over(partition by song_id order by t)-1 as bigint) as edge_idx from (
 select song_id, t from keep where t<last or fin-last>=2.25 union all select song_id, fin from fin) z""", **DOWN,
 lens="select song_id, max(end_time) as duration from sections group by song_id",
 snp="""select song_id, coalesce(g, end_time) as t from (select s.song_id, s.end_time, d.t as g, row_number() over(partition by s.song_id, s.section_idx order by abs(d.t-s.end_time), d.t) as rn
 from (select * from sections join lens using(song_id) where end_time<duration) s left join dn d on s.song_id=d.song_id) q where rn=1""",
 pts="select distinct song_id, t from (select song_id, t from snp union all select song_id, 0e0 from lens union all select song_id, duration from lens) u",
 fin="select song_id, max(t) as fin from pts group by song_id",
 body="select p.* from pts p join fin f using(song_id) where p.t<f.fin",
 pick="""select song_id, min(t) as t from body group by song_id union all select p.song_id, min(k.t) from pick p join body k
 on k.song_id=p.song_id and k.t-p.t>=2.25 group by p.song_id, p.t""",
 keep="select p.*, f.fin, max(p.t) over(partition by p.song_id) as last from pick p join fin f using(song_id)"))
def _(t):
    lens = t.stored("sections").groupBy("song_id").agg(F.max("end_time").alias("duration"))
    inner = t.stored("sections").join(lens, "song_id").where(F.col("end_time") < F.col("duration")).select("song_id", "end_time")
    d = B.downbeats(t.stored("beats"), SONG, "beat_idx", "strength")
    s = B.snap_nearest(inner, d, t.stored("beats"), SONG, "end_time", "t", "t", "t").select("song_id", "t")
    return B.clean_boundaries(s, lens, SONG, "t", "duration", 2.25)


BARS = dict(per="""select song_id, pos//20 as bar, sqrt(avg(case when stem='drums' then x*x end)) as drums, sqrt(avg(case when stem='bass' then x*x end)) as bass,
 sqrt(avg(case when stem='other' then x*x end)) as other from samples group by song_id, pos//20""",
    ln="select song_id, max(pos)+1 as len from samples group by song_id",
    br3="""select song_id, bar, coalesce(drums,0) as drums, coalesce(bass,0) as bass, coalesce(other,0) as other from per join ln using(song_id) where bar<greatest(1,len//20)""",
    w="""select song_id, stddev_pop(drums)/(avg(drums)+1e-8) as d, stddev_pop(bass)/(avg(bass)+1e-8) as b, stddev_pop(other)/(avg(other)+1e-8) as o from br3 group by song_id""",
    abe="""select song_id, bar, drums*(d/(d+b+o+1e-8))+bass*(b/(d+b+o+1e-8))+other*(o/(d+b+o+1e-8)) as energy from br3 join w using(song_id)""",
    sm="""select song_id, bar, case when n<3 then energy else 0.25e0*coalesce(p,0)+0.5e0*energy+0.25e0*coalesce(x,0) end as energy from (
 select *, count(*) over(partition by song_id) as n, lag(energy) over(partition by song_id order by bar) as p, lead(energy) over(partition by song_id order by bar) as x from abe) q""",
    nm="select song_id, bar, case when mx>0 then energy/mx else energy end as energy from (select *, max(energy) over(partition by song_id) as mx from sm) q")


@query("d03_bar_rms", sql("samples", "select song_id, bar, round(drums,6) as drums, round(bass,6) as bass, round(other,6) as other from br3", **{k: BARS[k] for k in ("per", "ln", "br3")}))
def _(t):
    b = B.bar_rms(t.stored("samples"), SONG, "pos", "stem", "x", 20)
    return b.select("song_id", "bar", *[r6(c).alias(c) for c in ("drums", "bass", "other")])


@query("d04_adaptive_bar_energy", sql("samples", "select song_id, bar, round(energy,6) as energy from abe", **{k: BARS[k] for k in ("per", "ln", "br3", "w", "abe")}))
def _(t):
    b = B.adaptive_bar_energy(B.bar_rms(t.stored("samples"), SONG, "pos", "stem", "x", 20), SONG)
    return b.select("song_id", "bar", r6("energy").alias("energy"))


@query("d04_analyze_bars", sql("samples", """select song_id, bar, round(energy,6) as energy, case when energy>=p75 then 'drop' when energy>=p40 then 'groove'
 when energy>=p20 then 'build' else 'breakdown' end as label from nm join (select song_id, quantile_cont(energy,0.75) as p75, quantile_cont(energy,0.4) as p40,
 quantile_cont(energy,0.2) as p20 from nm group by song_id) q using(song_id)""", **BARS))
def _(t):
    return B.analyze_bars(t.stored("samples"), SONG, "pos", "stem", "x", 20).select("song_id", "bar", r6("energy").alias("energy"), "label")


@query("d37_strength_flags", sql("frames", """select song_id, coalesce(bool_or(energy>0.5),false) as has_strong_vocals, coalesce(max(d)>0.02,false) as has_strong_drums from (
 select song_id, energy, null as d from ph union all select song_id, null, sqrt(avg(case when stem='drums' then rms*rms end)) from frames group by song_id) u group by song_id""", **upto("ph")))
def _(t):
    p = X.active_phrases(t.stored("frames"), SONG, "frame", "rms").withColumn("is_strong", F.col("energy") > 0.5)
    return B.strength_flags(p, t.stored("frames"), SONG, "stem", "rms")


@query("d38_music_summary", sql("beats", """select f.song_id, round(loudness,6) as loudness, round(dance,6) as danceability, round(coalesce(n,0)/dur,6) as onset_rate,
 round(m1,6) as mfcc_1, round(m2,6) as mfcc_2 from (select song_id, avg(rms) as loudness, avg(onset) as dance, (max(frame)+1)*0.25e0 as dur, avg(rms) as m1, avg(rms*rms) as m2
 from (select *, coalesce((greatest(rms-lag(rms) over w,0)+greatest(rms*rms-lag(rms*rms) over w,0))/2,0) as onset from frames
 window w as (partition by song_id order by frame)) o group by song_id) f left join (select song_id, count(*) as n from beats group by song_id) b using(song_id)"""))
def _(t):
    f = X.onset_strength(vector_frames(t), SONG, "frame", "mfcc")
    s = B.music_summary(f, t.beats, SONG, "rms", "onset", [F.col("mfcc")[0], F.col("mfcc")[1]], (F.max("frame") + 1) * 0.25)
    return s.select("song_id", r6("loudness").alias("loudness"), r6("danceability").alias("danceability"),
                    r6("onset_rate").alias("onset_rate"), r6(F.col("mfcc")[0]).alias("mfcc_1"), r6(F.col("mfcc")[1]).alias("mfcc_2"))
