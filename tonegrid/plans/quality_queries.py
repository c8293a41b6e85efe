"""Mix quality queries."""

from pyspark.sql import functions as F

from tonegrid import constants as K
from tonegrid.operators import quality as Q
from tonegrid.operators import signal as X
from tonegrid.plans.adapters import sql
from tonegrid.plans.registry import query
from tonegrid.plans.structure_queries import SONG


def r6(c):
    return F.round(c, 6)


@query("d07_dynamic_range", sql("frames", """select song_id, round(case when coalesce(c,0)<10 then 0.5e0 else greatest(0e0,least(1e0, case when r<3 then 0.2e0 when r<6 then 0.2e0+(r-3)/3*0.5e0
 when r<=14 then 0.7e0+0.3e0*(1-abs(r-10)/4) when r<=20 then 0.7e0-(r-14)/6*0.3e0 else 0.3e0 end)) end,6) as dynamic_range from (select distinct song_id from frames) k left join (
 select song_id, count(*) as c, quantile_cont(db,0.9)-quantile_cont(db,0.1) as r from (select song_id, 20*log10(rms+1e-10) as db from frames where rms>1e-6) a group by song_id) q using(song_id)"""))
def _(t):
    return Q.dynamic_range_score(t.stored("frames"), SONG, "rms").select("song_id", r6("dynamic_range").alias("dynamic_range"))


@query("d08_energy_consistency", sql("frames", """select song_id, round(case when n<4 or mx<1e-10 then 0.5e0 else greatest(0e0,least(1e0,(1-least(1e0,a/0.15e0))*0.6e0+(1-least(0.5e0,j*5))*0.4e0)) end,6) as energy_consistency
 from (select song_id, count(*) as n, max(mx) as mx, avg(d/mx) as a, avg(case when d/mx>0.3 then 1e0 else 0e0 end) filter(where d is not null) as j from (select *, max(rms) over(partition by song_id) as mx,
 abs(rms-lag(rms) over(partition by song_id order by frame)) as d from frames) q group by song_id) w"""))
def _(t):
    return Q.energy_consistency(t.frames, SONG, "frame", "rms").select("song_id", r6("energy_consistency").alias("energy_consistency"))


@query("d10_chroma_profile", sql("chromas", "select label as song_id, " + ", ".join(
    f"round(avg(list_extract(chroma,{i + 1})),6) as c{i}" for i in range(12)) + " from chromas join embeddings on vec_id=song_id group by label"))
def _(t):
    f = t.embeddings.select(F.col("label").alias("song_id"), F.slice("embedding", 1, 12).cast("array<double>").alias("chroma"))
    return Q.chroma_profile(f, SONG, "chroma").select("song_id", *[r6(F.col("chroma")[i]).alias(f"c{i}") for i in range(12)])


def _band(i, j):
    return f"list_sum(list_transform(list_slice(mag,{i + 1},{j + 1}), lambda v: v*v))"


SPANS = [Q._bins(low, high, 250.0, 64) for _, low, high, _ in K.BANDS]
SHARES = ", ".join(f"avg({_band(i, j)})/{j - i + 1} as e{b}" if j >= i else f"0e0 as e{b}" for b, (i, j) in enumerate(SPANS))
TOTAL = "(" + "+".join(f"e{b}" for b in range(7)) + ")"
OFF = "(" + "+".join(f"abs(e{b}/{TOTAL}-{K.BANDS[b][3]}e0)" for b in range(7)) + ")/7"
SILENT = "(" + "+".join(f"case when e{b}/{TOTAL}<0.01 then 1 else 0 end" for b in range(7)) + ")"
BIGGEST = "greatest(" + ",".join(f"e{b}/{TOTAL}" for b in range(7)) + ")"


@query("d11_spectral_balance", sql("spectra", f"""select song_id, round(greatest(0.05e0,least(1e0,(1-{OFF}*4)*case when {BIGGEST}>0.6 then 0.7e0 else 1e0 end-{SILENT}*0.05e0)),6) as spectral_balance
 from (select song_id, {SHARES} from spectra group by song_id) q"""))
def _(t):
    return Q.spectral_balance(t.spectra, SONG, "mag", 250.0, 64).select("song_id", r6("spectral_balance").alias("spectral_balance"))


@query("d12_harmonic_clarity", sql("chromas", """select song_id, round(greatest(0e0,least(1e0,greatest(0e0,least(1e0,(top3-0.3e0)/0.35e0))-least(0.4e0,clash*10))),6) as harmonic_clarity from (
 select song_id, list_sum(list_slice(list_reverse_sort(c),1,3)) as top3, list_sum(list_transform(range(1,13), lambda i: case when list_extract(c,i)>0.1e0 and list_extract(c,i%12+1)>0.1e0
 then list_extract(c,i)*list_extract(c,i%12+1) else 0e0 end)) as clash from (select song_id, list_transform(p, lambda v: v/list_sum(p)) as c from (
 select song_id, list_transform(chroma, lambda v: abs(v)) as p from chromas) a) b) d"""))
def _(t):
    p = F.transform("chroma", lambda v: F.abs(v))
    return t.chromas.select("song_id", p.alias("p")).select("song_id", r6(Q.harmonic_clarity(F.col("p"))).alias("harmonic_clarity"))


@query("d13_vocal_clarity_mix", sql("spectra", f"""select song_id, round(0.2e0+0.8e0*exp(-0.5e0*((v/f-0.2e0)/0.1e0)*((v/f-0.2e0)/0.1e0)),6) as vocal_clarity from (
 select song_id, avg({_band(4, 16)})/13 as v, avg({_band(1, 63)})/63 as f from spectra group by song_id) q"""))
def _(t):
    return Q.vocal_clarity_mix(t.spectra, SONG, "mag", 250.0, 64).select("song_id", r6("vocal_clarity").alias("vocal_clarity"))


@query("d14_vocal_clarity_stems", sql("spectra", f"""select song_id, round(greatest(0e0,least(1e0,case when snr<-3 then 0.2e0 when snr<0 then 0.2e0+(snr+3)/3*0.3e0 when snr<3 then 0.5e0+snr/3*0.3e0
 when snr<=8 then 0.8e0+0.2e0*(1-abs(snr-5)/3) else greatest(0.5e0,1-(snr-8)*0.05e0) end)),6) as vocal_clarity from (
 select song_id, 10*log10(avg({_band(4, 16)}) filter(where frame%2=0)*(1+song_id*0.4e0)*(1+song_id*0.4e0)/avg({_band(4, 16)}) filter(where frame%2=1)+1e-10) as snr from spectra group by song_id) q"""))
def _(t):
    voc = t.spectra.where(F.col("frame") % 2 == 0).withColumn("mag", F.transform("mag", lambda v: v * (1 + F.col("song_id") * 0.4)))
    return Q.vocal_clarity_stems(voc, t.spectra.where(F.col("frame") % 2 == 1), SONG, "mag", 250.0, 64).select("song_id", r6("vocal_clarity").alias("vocal_clarity"))


@query("d15_phase_coherence_mix", sql("spectra", """select song_id, round(1-least(0.6e0,avg(case when la-db>2*6 then 1e0 else 0e0 end)*20),6) as phase_coherence from (
 select *, sum(db) over(partition by song_id order by bin rows between 10 preceding and 9 following)/20 as la from (
 select song_id, bin, 20*log10(a/max(a) over(partition by song_id)+1e-10) as db from (select song_id, i.i as bin, avg(power(list_extract(mag,i.i+1),3+song_id%4)) as a
 from spectra, range(0,64) i(i) group by song_id, i.i) x) y) z group by song_id"""))
def _(t):
    s = t.spectra.withColumn("mag", F.transform("mag", lambda v: F.pow(v, 3 + F.col("song_id") % 4)))
    return Q.phase_coherence_mix(s, SONG, "mag").select("song_id", r6("phase_coherence").alias("phase_coherence"))


@query("d16_phase_coherence_stems", sql("samples", """select song_id, round(greatest(0e0,least(1e0,case when r is null then 0.5e0 when r<0.3 then 0.2e0 when r<0.5 then 0.2e0+(r-0.3e0)/0.2e0*0.4e0 when r<=0.95 then 0.6e0+0.4e0*(1-abs(r-0.75e0)/0.2e0)
 else 0.8e0 end)),6) as phase_coherence from (select song_id, case when sqrt(avg(s*s))>=1e-10 then round(sqrt(avg(m*m))/sqrt(avg(s*s)),12) end as r from (select song_id, pos//4 as p, sum(x) as s, avg(x)*(1+song_id%4) as m from samples group by song_id, pos//4) a group by song_id) b"""))
def _(t):
    stems = t.samples.select("song_id", F.floor(F.col("pos") / 4).alias("pos"), "x")
    mix = stems.groupBy("song_id", "pos").agg((F.avg("x") * (1 + F.col("song_id") % 4)).alias("x"))
    return Q.phase_coherence_stems(mix, stems, SONG, "pos", "x").select("song_id", r6("phase_coherence").alias("phase_coherence"))


@query("d17_spectral_separation", sql("frames", """select song_id, round(case when n<2 then 0.5e0 else least(1e0,sd/0.1e0)*case when m>0.5 then 0.5e0 else 1e0 end*0.5e0+greatest(0e0,least(1e0,c/30))*0.5e0 end,6) as spectral_separation
 from (select song_id, count(*) as n, stddev_pop(rms) as sd, avg(rms) as m, avg(rms*40) as c from frames group by song_id) q"""))
def _(t):
    f = t.frames.select("song_id", F.col("rms").alias("flatness"), (F.col("rms") * 40).alias("contrast"))
    return Q.spectral_separation(f, SONG, "flatness", "contrast").select("song_id", r6("spectral_separation").alias("spectral_separation"))


OVERALL = "(" + "+".join(f"{c}*{w}e0" for c, w in K.SCORE_WEIGHTS.items()) + ")"


@query("d18_overall_score", sql("mix_scores", f"select mix_id, round({OVERALL},6) as overall from mix_scores"))
def _(t):
    return Q.overall_score(t.mix_scores).select("mix_id", r6("overall").alias("overall"))


@query("d18_evaluate_mix")
def _(t):
    f = t.stored("frames").select("song_id", "frame", "rms")
    spectra = f.select("song_id", "frame", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("rms") / (1 + i)).alias("mag"))
    chroma = f.select("song_id", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.pmod(F.col("frame") + i, F.lit(12)) * F.col("rms")).alias("chroma"))
    feats = f.select("song_id", F.col("rms").alias("flatness"), (F.col("rms") * 40).alias("contrast"))
    onset = f.withColumn("onset", F.col("rms"))
    d = Q.evaluate_mix(SONG, rms_100ms=f, rms_500ms=f, onset=onset, spectra=spectra, chroma=chroma, features=feats, bin_hz=250.0, n_bins=64, sr=20, hop=1)
    return d.select("song_id", *[r6(c).alias(c) for c in [*K.SCORE_WEIGHTS, "overall"]])


UNPIVOT = " union all ".join(f"select mix_id, {i} as ord, '{c}' as dimension, {c} as score from mix_scores" for i, c in enumerate(K.SCORE_WEIGHTS))


@query("d19_worst_dimensions", sql("mix_scores", """select mix_id, cast(rn as int) as rank, dimension, round(score,6) as score from (
 select *, row_number() over(partition by mix_id order by score, ord) as rn from u) q where rn<=3""", u=UNPIVOT))
def _(t):
    return Q.worst_dimensions(t.mix_scores, "mix_id").withColumn("score", r6("score"))


DUE = " union all ".join(
    f"select mix_id, {i} as ord, '{d}' as dimension, '{a}' as action, '{p}' as parameter, '{c}' as current_value, '{s}' as suggested_value, '{why}' as reason, {pri} as priority from mix_scores where round({d},12)<{b}"
    for i, (d, b, a, p, c, s, why, pri) in enumerate(K.RECOMMENDATIONS))


@query("b18_recommend", sql("mix_scores", """select mix_id, cast(row_number() over(partition by mix_id order by priority, ord)-1 as int) as position, dimension, action, parameter, current_value, suggested_value, reason, priority from u""", u=DUE))
def _(t):
    return Q.recommend(t.mix_scores, "mix_id")


@query("d20_beat_coherence", sql("frames", """select n.song_id, round(coalesce(greatest(0e0,least(1e0,case when p is not null and q is not null then least(1e0,greatest(0e0,r/0.6e0))*0.7e0+greatest(0e0,least(1e0,(r-0.5e0*(p+q))/0.3e0))*0.3e0
 else greatest(0e0,least(1e0,r/0.6e0)) end)),0.5e0),6) as beat_coherence, lag as best_lag from n left join (select * from (select *, row_number() over(partition by song_id order by r desc, lag) as rn from (
 select song_id, lag, r, lag(r) over(partition by song_id order by lag) as p, lead(r) over(partition by song_id order by lag) as q from nrm where lag>=4 and lag<least(25,n-1)) a) b where rn=1) c using(song_id)""",
 n="select song_id, count(*) as n from frames group by song_id",
 ac="select a.song_id, cast(b.frame-a.frame as int) as lag, sum(a.rms*b.rms) as s from frames a join frames b on a.song_id=b.song_id and b.frame>=a.frame and b.frame<=a.frame+25 group by 1,2",
 nrm="select ac.song_id, ac.lag, round(ac.s/z.s,12) as r, n.n from ac join ac z on z.song_id=ac.song_id and z.lag=0 and z.s<>0 join n on n.song_id=ac.song_id and n.n>=10"))
def _(t):
    d = Q.beat_coherence(t.stored("frames"), SONG, "frame", "rms", sr=20, hop=1)
    return d.select("song_id", r6("beat_coherence").alias("beat_coherence"), "best_lag")


@query("d33_mix_quality", sql("samples", """select song_id, round(case when r<1e-8 then 0e0 else 0.5e0*greatest(0e0,1-c*50)+0.5e0*greatest(0e0,least(1e0,1-abs(log10(greatest(p/r,0.1e0))-0.78e0)/0.6e0)) end,6) as mix_quality
 from (select song_id, avg(case when abs(x)>0.95 then 1e0 else 0e0 end) as c, sqrt(avg(x*x)) as r, max(abs(x)) as p from samples group by song_id) q"""))
def _(t):
    return Q.mix_quality(t.samples, SONG, "x").select("song_id", r6("mix_quality").alias("mix_quality"))


@query("d34_snr_vs_reference", sql("samples", """select song_id, round(case when p<1e-10 then 0e0 else greatest(0e0,least(1e0,(10*log10(p/(e+1e-8))+10)/40)) end,6) as snr_score from (
 select song_id, avg(x*x) as p, avg((x*0.9e0+0.01e0-x)*(x*0.9e0+0.01e0-x)) as e from samples where pos%5<>0 group by song_id) q"""))
def _(t):
    # the mix misses every fifth position, which the join leaves out on both sides
    mix = t.samples.where(F.col("pos") % 5 != 0).select("song_id", "pos", (F.col("x") * 0.9 + 0.01).alias("x"))
    return Q.snr_vs_reference(mix, t.samples.select("song_id", "pos", "x"), SONG, "pos", "x").select("song_id", r6("snr_score").alias("snr_score"))
