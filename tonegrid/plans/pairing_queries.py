"""Pair compatibility, section pairing and alignment queries."""

from pyspark.sql import functions as F

from tonegrid import constants as K
from tonegrid.functions import scalars as S
from tonegrid.operators import pairing as P
from tonegrid.operators import structure as B
from tonegrid.plans.adapters import sql
from tonegrid.plans.registry import query
from tonegrid.plans.scalars_queries import PAIR_SQL, TEMPO_CASE, paired
from tonegrid.plans.similarity_queries import ROT
from tonegrid.plans.structure_queries import CLASSIFIED, PHASE
from tonegrid.session import materialize


def r6(c):
    return F.round(c, 6)


@query("c01_pair_compatibility", sql("songs song_pairs chromas", f"""select pair_id, song_a, song_b, round(ts,6) as tempo_compatibility, round(ks,6) as key_compatibility, round(tim,6) as timbre_compatibility,
 round(rng,6) as range_compatibility, round(str,6) as structure_compatibility, round(greatest(0e0,least(1e0,ts*0.35e0+ks*0.35e0+tim*0.15e0+rng*0.10e0+0.05e0)),6) as overall_score,
 round(greatest(0e0,least(1e0,ks*0.6e0+ts*0.4e0)),6) as vocal_blend_score from sc""", rot=ROT,
 kc="select pair_id, greatest(0e0, least(1e0, (max(r)+0.5e0)/1.5e0)) as ks from rot group by pair_id",
 bth="""select p.*, greatest(a.tempo,b.tempo)/greatest(least(a.tempo,b.tempo),1e0) as r, a.overall_energy as ea, b.overall_energy as eb, a.n_sections as na, b.n_sections as nb,
 list_dot_product(ca.chroma,cb.chroma)/(sqrt(list_dot_product(ca.chroma,ca.chroma))*sqrt(list_dot_product(cb.chroma,cb.chroma))+1e-10) as cs
 from song_pairs p join songs a on a.song_id=p.song_a join songs b on b.song_id=p.song_b join chromas ca on ca.song_id=p.song_a join chromas cb on cb.song_id=p.song_b""",
 sc=f"""select pair_id, song_a, song_b, {TEMPO_CASE} as ts, ks, greatest(0e0,least(1e0,(cs+1)/2)) as tim, greatest(0e0,least(1e0,1-abs(ea-eb))) as rng,
 1-abs(na-nb)/cast(greatest(na,nb) as double) as str from bth join kc using(pair_id)"""))
def _(t):
    songs = t.songs.join(t.chromas.withColumnRenamed("chroma", "key_chroma"), "song_id")
    d = P.pair_compatibility(t.song_pairs, songs)
    return d.select("pair_id", "song_a", "song_b", *[r6(c).alias(c) for c in d.columns if c not in ("pair_id", "song_a", "song_b")])


# section pairs: every song with the next one by id
SPAIRS = "select song_id as pair_id, song_id as song_a, nxt as song_b from (select song_id, lead(song_id) over(order by song_id) as nxt from (select distinct song_id from sections) u) v where nxt is not null"
KEYSC = "select pair_id, (pair_id%11)/10e0 as key_score from sp"
BONUS = "case " + " ".join(f"when vt='{v}' and bt='{b}' then {s}e0" for v, b, s in K.SECTION_BONUS) + " else 0e0 end"
PAIRED = dict(cl=CLASSIFIED, sp=SPAIRS, kc=KEYSC,
    pr="""select p.pair_id, p.song_a, p.song_b, a.section_idx as section_a, b.section_idx as section_b, d.direction, k.key_score, a.spectral_centroid as ca, b.spectral_centroid as cb,
 case when d.direction='a_vocals' then a.energy else b.energy end as ve, case when d.direction='a_vocals' then b.energy else a.energy end as be,
 case when d.direction='a_vocals' then a.has_vocals else b.has_vocals end as vv, case when d.direction='a_vocals' then b.has_vocals else a.has_vocals end as bv,
 case when d.direction='a_vocals' then a.classification else b.classification end as vt, case when d.direction='a_vocals' then b.classification else a.classification end as bt
 from sp p join kc k using(pair_id) join cl a on a.song_id=p.song_a join cl b on b.song_id=p.song_b, (select unnest(['a_vocals','b_vocals']) as direction) d""",
    s1="""select *, case when be>ve then least(1e0, greatest(0e0,1-abs(ve-be)*1.5e0)+0.1e0) else greatest(0e0,1-abs(ve-be)*1.5e0) end as energy_score,
 case when vv and not bv then 1e0 else (0.5e0+case when vv then 0.3e0 else 0 end+case when not bv then 0.2e0 else 0 end)*case when vv and bv then 0.5e0 else 1e0 end end as role_score,
 least(1e0, abs(ca-cb)/greatest(ca,cb,1e0)+0.3e0) as spectral_score from pr""",
    s2=f"select *, least(1e0, energy_score*0.25e0+role_score*0.35e0+spectral_score*0.15e0+key_score*0.25e0+{BONUS}) as overall_score from s1",
    bd="""select pair_id, avg(case when direction='a_vocals' then overall_score end) as sa, avg(case when direction='b_vocals' then overall_score end) as sb from s2 group by pair_id""")


def section_sides(t):
    """Song pairs, classified sections and key scores."""
    s = materialize(B.classify_sections(t.stored("sections"), ["song_id"]), "classified")
    ids = s.select("song_id").distinct()
    # the partner is the next id: a self join on the dense rank of the id
    ranked = B.dense_index(ids, [], ["song_id"], F.floor(F.col("song_id") / 1024), "_r")
    nxt = ranked.select(F.col("song_id").alias("song_b"), (F.col("_r") - 1).alias("_r"))
    sp = ranked.join(nxt, "_r").select(F.col("song_id").alias("pair_id"), F.col("song_id").alias("song_a"), "song_b")
    return sp, s, sp.select("pair_id", ((F.col("pair_id") % 11) / F.lit(10.0)).alias("key_score"))


@query("c05_section_pairings", sql("sections", """select pair_id, song_a, song_b, section_a, section_b, direction, round(energy_score,6) as energy_score, round(role_score,6) as role_score,
 round(spectral_score,6) as spectral_score, round(key_score,6) as key_score, round(overall_score,6) as overall_score from s2""", **{k: v for k, v in PAIRED.items() if k != "bd"}))
def _(t):
    d = P.section_pairings(*section_sides(t))
    return d.select(*[r6(c).alias(c) if c.endswith("_score") else c for c in d.columns])


@query("b17_section_type_bonus", sql("sections", f"""select song_id, section_idx, {BONUS} as bonus from (select *, classification as vt,
 lead(classification) over(partition by song_id order by section_idx) as bt from cl) q where bt is not null""", cl=CLASSIFIED))
def _(t):
    c = materialize(B.classify_sections(t.stored("sections"), ["song_id"]), "classified")
    n = c.select("song_id", (F.col("section_idx") - 1).alias("section_idx"), F.col("classification").alias("bt"))
    return P.section_type_bonus(c.join(n, ["song_id", "section_idx"]), "classification", "bt").select(
        "song_id", "section_idx", F.col("type_bonus").alias("bonus"))


@query("d25_best_direction", sql("sections", """select pair_id, round(sa,6) as direction_score_a, round(sb,6) as direction_score_b,
 case when round(sa,12)>=round(sb,12) then 'a_vocals' else 'b_vocals' end as best_direction from bd""", **PAIRED))
def _(t):
    d = P.best_direction(P.pairing_summary(*section_sides(t)))
    return d.select("pair_id", r6("direction_score_a").alias("direction_score_a"), r6("direction_score_b").alias("direction_score_b"), "best_direction")


@query("f02_top_pairings", sql("sections", """select pair_id, section_a, section_b, direction, round(overall_score,6) as overall_score, cast(rank as int) as rank from (
 select s.*, row_number() over(partition by s.pair_id order by round(overall_score,12) desc, section_a, section_b) as rank from s2 s join bd using(pair_id)
 where s.direction=case when round(sa,12)>=round(sb,12) then 'a_vocals' else 'b_vocals' end) q where rank<=10""", **PAIRED))
def _(t):
    return P.top_pairings(P.pairing_summary(*section_sides(t))).select("pair_id", "section_a", "section_b", "direction", r6("overall_score").alias("overall_score"), "rank")


MATCHED = dict({k: v for k, v in PAIRED.items() if k in ("cl", "sp")}, rot=ROT.replace("song_pairs", "sp"),
    kc="select pair_id, greatest(0e0, least(1e0, (max(r)+0.5e0)/1.5e0)) as key_score from rot group by pair_id", **{k: PAIRED[k] for k in ("pr", "s1", "s2", "bd")},
    tp="select p.pair_id, a.tempo as ta, b.tempo as tb from sp p join songs a on a.song_id=p.song_a join songs b on b.song_id=p.song_b",
    ts="""select pair_id, name, ratio from (select *, row_number() over(partition by pair_id order by abs(ratio-1), ord) as rn from (
 select pair_id, unnest(['direct','half_b','double_b','half_a','double_a']) as name, unnest([ta/tb,ta/(tb/2),ta/(tb*2),(ta/2)/tb,(ta*2)/tb]) as ratio, unnest(range(0,5)) as ord from tp) q) w where rn=1""",
    rk="""select s.pair_id, first(round(key_score,6)) as key_score, first(round(sa,6)) as direction_score_a, first(round(sb,6)) as direction_score_b, first(s.direction) as best_direction,
 string_agg(section_a || '/' || section_b, ',' order by rank) as best_pairings from (select s.*, sa, sb, row_number() over(partition by s.pair_id order by round(overall_score,12) desc, section_a, section_b) as rank
 from s2 s join bd using(pair_id) where s.direction=case when round(sa,12)>=round(sb,12) then 'a_vocals' else 'b_vocals' end) s where rank<=10 group by s.pair_id""")


@query("m01_match_songs", sql("songs sections chromas", "select sp.pair_id, song_a, song_b, ts.name as tempo_strategy, round(ts.ratio,6) as stretch_ratio, key_score, direction_score_a, direction_score_b, best_direction, best_pairings from sp join ts using(pair_id) join rk using(pair_id)", **MATCHED))
def _(t):
    sp, s, _ = section_sides(t)
    d = P.match_songs(sp, t.songs.join(t.chromas.withColumnRenamed("chroma", "key_chroma"), "song_id"), s)
    listed = F.array_join(F.transform("pairings", lambda p: F.concat_ws("/", p["section_a"], p["section_b"])), ",")
    return d.select("pair_id", "song_a", "song_b", "tempo_strategy", *[r6(c).alias(c) for c in ("stretch_ratio", "key_score", "direction_score_a", "direction_score_b")], "best_direction", listed.alias("best_pairings"))


@query("c16_beat_f_measure", sql("beats", """select song_id, round(case when p+q>0 then 2*p*q/(p+q) else 0 end,6) as f_measure from (
 select song_id, sum(hit)*1e0/nullif(sum(est),0) as p, sum(hit)*1e0/count(*) as q from (select song_id, case when beat_idx%3<>2 then 1 else 0 end as est,
 case when beat_idx%3=0 then 1 else 0 end as hit from beats) a group by song_id) b"""))
def _(t):
    # estimates: every third beat off by 20 ms, every third off by 100 ms, every third missing
    off = F.when(F.col("beat_idx") % 3 == 0, 0.02).otherwise(0.1)
    est = t.beats.where(F.col("beat_idx") % 3 != 2).select("song_id", (F.col("t") + off).alias("t"))
    d = P.beat_f_measure(t.beats, est, ["song_id"], "t")
    return d.select("song_id", r6(F.coalesce("f_measure", F.lit(0.0))).alias("f_measure"))


PC = lambda k: f"(list_position(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], split_part({k},' ',1))-1)"


@query("c17_key_weighted_score", sql("songs song_pairs", f"""select pair_id, case when m1=m2 and up=0 then 1e0 when m1=m2 and up=7 then 0.5e0
 when (m1='major' and m2='minor' and up=9) or (m1='minor' and m2='major' and up=3) then 0.3e0 when m1<>m2 and up=0 then 0.2e0 else 0e0 end as score from (
 select pair_id, split_part(ka,' ',2) as m1, split_part(kb,' ',2) as m2, ({PC('kb')}-{PC('ka')}+12)%12 as up from pairs) q""", pairs=PAIR_SQL))
def _(t):
    return paired(t).select("pair_id", S.key_weighted_score(F.col("ka"), F.col("kb")).alias("score"))


@query("c18_best_lag", sql("frames", """select song_id, coalesce(lag,0) as lag from (select distinct song_id from sz) u left join (select song_id, lag from (
 select *, row_number() over(partition by song_id order by round(s,9) desc, lag) as rn from (select a.song_id, cast(l.l as int) as lag, sum(a.rms*b.y) as s
 from (select f.* from frames f join sz using(song_id) where frame<n) a, range(-4,4) l(l), bb b where b.song_id=a.song_id and b.frame+l.l=a.frame and a.song_id in (select song_id from sz where n>=8) group by a.song_id, l.l) q) w where rn=1) z using(song_id)""",
 bsrc="select song_id, frame-2 as frame, rms as y from frames where frame>=2", sz="select song_id, count(*) as n from bsrc group by song_id",
 bb="select b.* from bsrc b join sz using(song_id) where frame<n"))
def _(t):
    f = t.stored("frames").select("song_id", "frame", "rms")
    b = f.where(F.col("frame") >= 2).withColumn("frame", F.col("frame") - 2)
    return P.best_lag(f, b, ["song_id"], "frame", "rms", 4)


ALIGN = dict(dn=PHASE(), fd="""select b.song_id, cast(trunc(min(b.t)*44100) as bigint) as first_pos from beats b join dn using(song_id) where b.beat_idx%4=dn.phase group by b.song_id""",
             al="""select pair_id, song_a, song_b, case when abs(b-a)<lim then b-a else 0 end as "offset" from (select p.pair_id, p.song_a, p.song_b, x.first_pos as a, y.first_pos as b,
 cast(trunc(4*(60e0/greatest(s.tempo,1e0))*4*44100) as bigint) as lim from song_pairs p join fd x on x.song_id=p.song_a join fd y on y.song_id=p.song_b join songs s on s.song_id=p.song_b) q""")


def aligned(t):
    first = B.downbeats(t.stored("beats"), ["song_id"], "beat_idx", "strength").groupBy("song_id").agg(
        S.sec_to_pos(F.min("t")).alias("first_pos"))
    side = lambda s: first.select(F.col("song_id").alias(f"song_{s}"), F.col("first_pos").alias(f"first_{s}"))
    d = t.song_pairs.join(side("a"), "song_a").join(side("b"), "song_b")
    d = d.join(t.songs.select(F.col("song_id").alias("song_b"), "tempo"), "song_b")
    return P.align_offset(d, "first_a", "first_b", "tempo")


@query("c19_align_offset", sql("beats songs song_pairs", 'select pair_id, "offset" from al', **ALIGN))
def _(t):
    return aligned(t).select("pair_id", "offset")


@query("c19_shift_positions", sql("samples", """select song_id, pos, round(x,6) as x from (select song_id, pos+(song_id%7-3)*5 as pos, x from samples) q where pos>=0"""))
def _(t):
    off = t.samples.select("song_id").distinct().withColumn("offset", (F.col("song_id") % 7 - 3) * 5)
    return P.shift_positions(t.samples, off, ["song_id"], "pos").select("song_id", "pos", r6("x").alias("x"))
