"""Mix timeline queries."""

from pyspark.sql import functions as F

from tonegrid import constants as K
from tonegrid.operators import quality as Q
from tonegrid.operators import signal as X
from tonegrid.operators import structure as B
from tonegrid.operators import timeline as L
from tonegrid.operators.ordered import dense_index
from tonegrid.plans.adapters import sql
from tonegrid.plans.registry import query
from tonegrid.plans.series_queries import upto
from tonegrid.plans.structure_queries import BARS, CLASSIFIED, SONG
from tonegrid.session import materialize


def r6(c):
    return F.round(c, 6)


def xs(t, *cols):
    return t.stored("samples").select("song_id", *(cols or ("pos", "x")))


LEN = "select song_id, max(pos)+1 as total from samples group by song_id"


@query("h01_cut_region", sql("samples", """select k.song_id, cast(g.g as bigint) as pos, round(coalesce(s.x,0),6) as x from (select distinct song_id from samples) k
 cross join range(0,600) g(g) left join samples s on s.song_id=k.song_id and s.pos=g.g+50"""))
def _(t):
    return L.cut_region(xs(t), SONG, "pos", "x", 50, 600).select("song_id", F.col("pos").cast("bigint").alias("pos"), r6("x").alias("x"))


def _ramp(i, n):
    return f"(case when {n}>1 then ({i})*1e0/({n}-1) else 0e0 end)"


def _bars(b):
    return f"least({b * 16}, total//4)"


def _entry(s, f):
    sil = _bars(s) if s else "0"
    end = f"least({sil}+{_bars(f)}, total)"
    return f"case when pos<{sil} then 0e0 when pos<{end} then {_ramp(f'pos-{sil}', f'({end}-{sil})')} else 1e0 end"


@query("h02_stem_envelopes", sql("samples", f"""select song_id, stem, pos, round(x*case stem when 'drums' then {_entry(0, 4)} when 'bass' then {_entry(2, 2)} when 'other' then {_entry(4, 4)} else 1e0 end
 *case when pos>=greatest(0,total-{_bars(8)}) then 1-{_ramp(f'pos-greatest(0,total-{_bars(8)})', f'(total-greatest(0,total-{_bars(8)}))')} else 1e0 end,6) as x from samples join ln using(song_id)""", ln=LEN))
def _(t):
    return L.stem_envelopes(xs(t, "stem", "pos", "x"), SONG, "stem", "pos", "x", 16).select("song_id", "stem", "pos", r6("x").alias("x"))


@query("h03_set_rms", sql("samples", """select song_id, pos, round(x*case when r<1e-8 then 1e0 else least(0.12e0/r,8e0) end,6) as x from (
 select *, sqrt(avg(x*x) over(partition by song_id)) as r from samples) q"""))
def _(t):
    return L.set_rms(xs(t), SONG, "x", F.lit(0.12)).select("song_id", "pos", r6("x").alias("x"))


@query("h04_set_rms_active", sql("samples", """select song_id, pos, round(x*case when n<200 then 1e0 else least(0.5e0/r,8e0) end,6) as x from (select song_id, pos, case when pos%3=0 then x else 0e0 end as x from samples) s join (
 select song_id, sqrt(avg(x*x)) as r, count(*) as n from samples where pos%3=0 and abs(x)>1e-6 group by song_id) q using(song_id)"""))
def _(t):
    s = xs(t).withColumn("x", F.when(F.col("pos") % 3 == 0, F.col("x")).otherwise(0.0))
    return L.set_rms_active(s, SONG, "x", F.lit(0.5), sr=2000).select("song_id", "pos", r6("x").alias("x"))


@query("h05_stem_levels", sql("samples", """select song_id, stem, pos, round(x*case when stem='vocals' then 1e0 else least(case stem when 'drums' then 1e0 when 'bass' then 0.85e0 else 0.25e0 end*0.12e0/r,8e0) end
 *case when stem='other' and pos%4<2 then 1-0.9e0 else 1e0 end,6) as x from (select *, sqrt(avg(x*x) over(partition by song_id, stem)) as r from samples) q"""))
def _(t):
    act = xs(t, "pos").withColumn("active", (F.col("pos") % 4 < 2).cast("double"))
    return L.stem_levels(xs(t, "stem", "pos", "x"), act, SONG, "stem", "pos", "x", 0.12).select("song_id", "stem", "pos", r6("x").alias("x"))


LBL16 = "select song_id, pos//16 as bar, case (pos//16)%5 when 0 then 'drop' when 1 then 'groove' when 2 then 'build' when 3 then 'breakdown' else 'free' end as label from samples group by 1,2"


@query("h06_label_gain", sql("samples", """select song_id, pos, round(x*sum(g) over(partition by song_id order by pos rows between 4 preceding and 3 following)/8,6) as x from (
 select s.*, case b.label when 'drop' then 1.25e0 when 'groove' then 1e0 when 'build' then 0.8e0 when 'breakdown' then 0e0 else 1e0 end as g from samples s join lbl b on b.song_id=s.song_id and b.bar=s.pos//16) q""", lbl=LBL16))
def _(t):
    n = F.col("bar") % 5
    bars = xs(t).select("song_id", F.floor(F.col("pos") / 16).alias("bar")).distinct().withColumn(
        "label", F.when(n == 0, "drop").when(n == 1, "groove").when(n == 2, "build").when(n == 3, "breakdown").otherwise("free"))
    return L.label_gain(xs(t), bars, SONG, "pos", "x", 16).select("song_id", "pos", r6("x").alias("x"))


# placements: a span for every hundred positions of a song, copied to overlapping places
PLACE = """select song_id as pair_id, song_id, o as ord, o*100 as vocal_start, o*100+90 as vocal_end, 40+o*60 as dest_start, 40+o*60+50 as dest_end, len
 from (select song_id, max(pos)+1 as len, unnest(range(0, max(pos)//100+1)) as o from samples group by song_id) o"""
REACH = "(select 100+60*(max(pos)//100) from samples)"
_EDGE = lambda i, n, f: f"(case when {i}<least({f},{n}//4) then {_ramp(i, f'least({f},{n}//4)')} else 1e0 end*case when {i}>={n}-least({f},{n}//4) then 1-{_ramp(f'({i}-({n}-least({f},{n}//4)))', f'least({f},{n}//4)')} else 1e0 end)"


def reach(t):
    """Positions of a mix that ends with the last placement of the longest song."""
    return 100 + 60 * (xs(t, "pos").agg(F.max("pos")).head()[0] // 100)


def placements(t):
    o = F.col("ord")
    spans = xs(t, "pos").groupBy("song_id").agg(F.floor(F.max("pos") / 100).alias("_last"))
    return (spans.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")))
            .select(F.col("song_id").alias("pair_id"), "song_id", "ord", (o * 100).alias("vocal_start"), (o * 100 + 90).alias("vocal_end"),
                    (40 + o * 60).alias("dest_start"), (40 + o * 60 + 50).alias("dest_end")))


@query("c20_place", sql("samples", f"""select pair_id, pos, round(x,6) as x from (select pair_id, p.dest_start+s.pos-p.vocal_start as pos, s.x*{_EDGE('(s.pos-p.vocal_start)', f'least(90,p.len-p.vocal_start,{REACH}-p.dest_start)', 12)} as x,
 row_number() over(partition by pair_id, p.dest_start+s.pos-p.vocal_start order by ord desc) as rn from samples s join pl p on p.song_id=s.song_id and s.pos>=p.vocal_start and s.pos<p.vocal_end
 where s.pos-p.vocal_start<{REACH}-p.dest_start) q where rn=1""", pl=PLACE))
def _(t):
    d = L.place(xs(t), placements(t), "pair_id", "song_id", "pos", "x", reach(t), fade=12)
    return d.select("pair_id", "pos", r6("x").alias("x"))


@query("h08_edge_fades", sql("samples", f"""select s.song_id, s.pos, round(s.x*coalesce({_EDGE('(s.pos-p.dest_start)', '50', 9)},1e0),6) as x from samples s left join pl p on p.song_id=s.song_id
 and s.pos>=p.dest_start and s.pos<p.dest_end""", pl=PLACE))
def _(t):
    return L.edge_fades(xs(t), placements(t), SONG, "pos", "x", 9).select("song_id", "pos", r6("x").alias("x"))


@query("f03_order_placements", sql("samples", "select pair_id, ord, dest_start, row_number() over(order by dest_start desc, pair_id)-1 as place from pl", pl=PLACE))
def _(t):
    p = placements(t).select("pair_id", "ord", "dest_start").withColumn("_down", -F.col("dest_start"))
    return dense_index(p, [], ["_down", "pair_id"], F.col("_down"), "place").drop("_down")


@query("h09_mixdown", sql("samples", "select song_id, pos//4 as pos, round(case when bool_or(pos%97=0) then 0e0 else sum(x) end,6) as x from samples group by song_id, pos//4"))
def _(t):
    s = xs(t).select("song_id", F.floor(F.col("pos") / 4).alias("pos"), F.when(F.col("pos") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("x")).alias("x"))
    return L.mixdown(s, SONG, "pos", "x").select("song_id", "pos", r6("x").alias("x"))


VI = dict(v="select song_id, pos//2 as pos, x from samples where pos%2=0", i="select song_id, pos//2 as pos, x from samples where pos%2=1 and pos>40")


def halves(t):
    at = F.floor(F.col("pos") / 2).alias("pos")
    return (xs(t).where(F.col("pos") % 2 == 0).select("song_id", at, "x"),
            xs(t).where((F.col("pos") % 2 == 1) & (F.col("pos") > 40)).select("song_id", at, "x"))


@query("h09_quick_mix", sql("samples", """select song_id, pos, round(case when pk>0.15 then m*0.15e0/pk else m end,6) as x from (select *, max(abs(m)) over(partition by song_id) as pk from (
 select v.song_id, v.pos, v.x*least(0.09e0/rv,8e0)+i.x*least(0.12e0/ri,8e0) as m from v join i using(song_id,pos) join (select song_id, sqrt(avg(x*x)) as rv from v group by song_id) a on a.song_id=v.song_id
 join (select song_id, sqrt(avg(x*x)) as ri from i group by song_id) b on b.song_id=v.song_id) q) w""", **VI))
def _(t):
    v, i = halves(t)
    return L.peak_scale(L.quick_mix(v, i, SONG, "pos", "x"), SONG, "x", 0.15).select("song_id", "pos", r6("x").alias("x"))


@query("h10_light_master", sql("samples", """select song_id, pos, round(y*g*case when pk*g>0.891 then 0.891e0/(pk*g) else 1e0 end,6) as x from (select *, least(power(10e0,-14/20e0)/r,5e0) as g from (
 select *, sqrt(avg(y*y) over(partition by song_id)) as r, max(abs(y)) over(partition by song_id) as pk from (select song_id, pos, tanh(x/0.9e0)*0.9e0 as y from samples) a) b) c"""))
def _(t):
    return L.light_master(xs(t), SONG, "x").select("song_id", "pos", r6("x").alias("x"))


@query("h11_loudness_normalize", sql("samples", """select song_id, pos, round(x*power(10e0, greatest(-12e0,least(12e0,-14-20*log10(r)))/20e0),6) as x from (select *, sqrt(avg(x*x) over(partition by song_id)) as r from samples) q"""))
def _(t):
    return L.loudness_normalize(xs(t), SONG, "x").select("song_id", "pos", r6("x").alias("x"))


@query("h12_crossfade", sql("samples", f"""select song_id, pos, round(sum(x),6) as x from (select v.song_id, v.pos, case when v.pos>=la-30 then x*cos({_ramp('v.pos-(la-30)', '30')}*pi()/2) else x end as x from v join n using(song_id)
 union all select i.song_id, i.pos+la-30, case when i.pos<30 then x*sin({_ramp('i.pos', '30')}*pi()/2) else x end from i join n using(song_id)) u group by song_id, pos""", **VI,
 n="select song_id, max(pos)+1 as la from v group by song_id"))
def _(t):
    v, i = halves(t)
    return L.crossfade(v, i, SONG, "pos", "x", 30).select("song_id", "pos", r6("x").alias("x"))


@query("h13_mask_blend", sql("samples", """select song_id, pos, round(case when ma>0.5 and mb>0.5 then a*ma*0.75e0+b*mb*0.35e0 when ma>0.5 then a*ma when mb>0.5 then b*mb else 0e0 end,6) as x from (
 select song_id, pos, coalesce(v.x,0) as a, coalesce(i.x,0) as b, case when v.x is null then 0e0 else (pos%4)/3e0 end as ma, case when i.x is null then 0e0 else (pos%3)/2e0 end as mb from v full join i using(song_id,pos)) q""", **VI).replace(" v as (", " v as materialized (").replace(" i as (", " i as materialized ("))
def _(t):
    v, i = halves(t)
    d = L.mask_blend(v.withColumn("m", (F.col("pos") % 4) / 3), i.withColumn("m", (F.col("pos") % 3) / 2), SONG, "pos", "x", "m")
    return d.select("song_id", "pos", r6("x").alias("x"))


@query("h14_pan", sql("samples", """select song_id, pos, round(x*cos(1.3e0*pi()/4),6) as "left", round(coalesce(lag(x,3) over(partition by song_id order by pos),0)*sin(1.3e0*pi()/4),6) as "right" from samples"""))
def _(t):
    d = L.pan(xs(t), SONG, "pos", "x", 0.3, 1.0, sr=10001)
    return d.select("song_id", "pos", r6("left").alias("left"), r6("right").alias("right"))


# the whole track of a song as one list, echoed phrase by phrase
@query("h15_echo_tails", sql("samples", "select song_id, i-1 as pos, round(tr[i],6) as x from (select song_id, tr, unnest(range(1, len(tr)+1)) as i from (select * from ec qualify row_number() over(partition by song_id order by ord desc)=1) e) u where tr[i] is not null", pl=PLACE,
 tot=f"select {REACH} as total",
 dr="select k.song_id, list(s.x order by k.g) as tr from (select song_id, unnest(range(0, greatest(max(pos)+1, any_value(total)))) as g from samples cross join tot group by song_id) k left join samples s on s.song_id=k.song_id and s.pos=k.g group by k.song_id",
 ec="""select song_id, cast(-1 as bigint) as ord, tr from dr union all
 select song_id, ord, case when pk>=1e-7 then list_transform(range(0,len(tr)), lambda i: case when i>=e+20 and i<least(e+70,total) then list_sum([tr[i+1], t[i-e-19]*(lv*0.2e0/te)]) else tr[i+1] end) else tr end from (
 select *, sqrt(list_sum(list_transform(src, lambda x: x*x))/30)+1e-8 as lv, list_max(list_transform(src, lambda x: abs(x))) as pk,
 sqrt(list_avg(list_transform(list_filter(t, lambda x: x<>0), lambda x: x*x)))+1e-8 as te from (
 select *, list_transform(range(1,51), lambda k: list_sum([case when k<=30 then src[k]*0.3e0 end, case when k>20 then src[k-20]*0.15e0 end])) as t from (
 select c.song_id, p.ord, c.tr, tot.total, p.dest_end as e, list_transform(range(0,30), lambda i: c.tr[p.dest_end-29+i]) as src
 from ec c join pl p on p.song_id=c.song_id and p.ord=c.ord+1 cross join tot) a) b) z"""))
def _(t):
    p = placements(t).select("song_id", "ord", "dest_start", "dest_end")
    # 100 positions per second at 300 beats per minute: echoes every 20 positions, shorter than the 30-position source
    return L.echo_tails(xs(t), p, SONG, "pos", "x", 300.0, reach(t), sr=100).select("song_id", "pos", r6("x").alias("x"))


# ---- ordered placement and searches -------------------------------------------------------------

def song_phrases(t):
    p = X.active_phrases(t.stored("frames"), SONG, "frame", "rms")
    d = X.dense_index(p, SONG, ["start_time"], F.floor(F.col("start_time") / 4096), "phrase_idx")
    return materialize(d.withColumn("duration", F.col("end_time") - F.col("start_time")), "song-phrases")


def beat_bars(t):
    """Analysed bars of the beat song, one second each."""
    return B.analyze_bars(t.stored("samples"), SONG, "pos", "stem", "x", 20).select("song_id", "bar", "label")


def rank_case(column, wanted):
    wanted = [*dict.fromkeys(wanted)]
    return f"case {column} " + " ".join(f"when '{x}' then {i}" for i, x in enumerate(wanted)) + " else 99 end"


PHRASE_RANK = "case type " + " ".join(f"when '{k}' then {rank_case('labels[i+1]', [*v, *K.PHRASE_FALLBACK])}" for k, v in K.PHRASE_PREFERENCES.items()) + " end"
PHRASES_PLACED = dict(upto("ph"), **BARS,
    lb=f"select song_id, bar, case when energy>=p75 then 'drop' when energy>=p40 then 'groove' when energy>=p20 then 'build' else 'breakdown' end as label from nm join (select song_id, quantile_cont(energy,0.75) as p75, quantile_cont(energy,0.4) as p40, quantile_cont(energy,0.2) as p20 from nm group by song_id) q using(song_id)",
    ln2="select song_id, cast(max(bar)+1 as bigint) as n, list(label order by bar) as labels from lb group by song_id",
    lim="select *, least(greatest(8,n//8),16) as lo, n-least(greatest(8,n//10),12) as hi from ln2",
    typed="select p.song_id, row_number() over(partition by p.song_id order by start_time)-1 as phrase_idx, start_time, end_time, energy, case when energy>=p75 then 'hook' when energy>=p50 then 'groove' else 'atmosphere' end as type, cast(greatest(1,ceil((end_time-start_time)/1e0)) as bigint) as size from ph p join (select song_id, quantile_cont(energy,0.75) as p75, quantile_cont(energy,0.5) as p50 from ph group by song_id) q using(song_id)",
    asked="select *, size+greatest(1,least(3,size//2)) as need from typed",
    laid=f"""select song_id, cast(-1 as bigint) as phrase_idx, n, labels, list_transform(range(0,n), lambda i: i>=lo and i<hi and labels[i+1]<>'breakdown') as free, cast(null as bigint) as bar, '' as type from lim where n>=12 union all
 select song_id, phrase_idx, n, labels, case when bar is null then free else list_transform(range(0,n), lambda i: free[i+1] and not (i>=bar and i<bar+need)) end, bar, type from (
 select *, case when len(grid)>0 then list_min(list_transform(grid, lambda i: ({PHRASE_RANK})*1000000+i))%1000000 when len(fits)>0 then fits[1] end as bar from (
 select *, list_filter(fits, lambda i: i%8=0) as grid from (
 select l.song_id, a.phrase_idx, l.n, l.labels, l.free, a.type, a.need, list_filter(range(0,l.n), lambda i: i+a.need<=l.n and list_bool_and(l.free[i+1:i+a.need])) as fits from laid l join asked a on a.song_id=l.song_id and a.phrase_idx=l.phrase_idx+1) x) y) z""",
    pp="""select song_id, phrase_idx, bar, type from laid where bar is not null union all
 select song_id, phrase_idx, 0, type from (select a.*, row_number() over(partition by song_id order by energy desc, phrase_idx) as rn from asked a where song_id not in (select song_id from lim where n>=12)) q where rn=1""")


@query("g03_place_phrases", sql("frames samples", "select song_id, phrase_idx, bar, type from pp", **PHRASES_PLACED))
def _(t):
    return L.place_phrases(song_phrases(t), beat_bars(t), "song_id", 1.0)


def mixes(t):
    return t.stored("frames").groupBy("song_id").agg((F.max("frame") * 0.25).alias("total_s"), F.lit(0.5).alias("bar_s"), F.lit(1.0).alias("region_start"),
                                                     (F.max("frame") * 250).alias("vocal_samples"), F.lit(1.02).alias("stretch"))


def placed_sections(t):
    s = materialize(B.classify_sections(t.stored("sections"), SONG), "classified")
    # two-second grid sections stretched to five seconds so that they pass the minimum length
    s = s.withColumn("start_time", F.col("start_time") * 2.5).withColumn("end_time", F.col("end_time") * 2.5)
    return L.place_sections(s, s, mixes(t).withColumn("total_s", F.col("total_s") * 2.5), "song_id", sr=1000)


def quoted(names):
    return ",".join(f"'{n}'" for n in names)


SECTION_RANK = "case vt " + " ".join(f"when '{k}' then {rank_case('slots[j].bt', [*v, *K.ALL_SECTION_TYPES])}" for k, v in K.SECTION_PREFERENCES.items()) + f" else {rank_case('slots[j].bt', [*K.DEFAULT_PREFERENCE, *K.ALL_SECTION_TYPES])} end"
SECTIONS_PLACED = dict(cl=CLASSIFIED,
    mx="select *, least(4e0,total_s*0.15e0) as mi, total_s-least(4e0,total_s*0.15e0) as mo from (select song_id, max(frame)*0.25e0*2.5e0 as total_s, max(frame)*250 as vocal_samples from frames group by song_id) q",
    vs=f"""select song_id, row_number() over(partition by song_id order by section_idx) as ord, classification as vt, cast(trunc(start_time*2.5e0*1.02e0*1000) as bigint) as vocal_start,
 least(cast(trunc(end_time*2.5e0*1.02e0*1000) as bigint), vocal_samples) as vocal_end from cl join mx using(song_id) where classification not in ({quoted(K.NO_VOCAL_SECTIONS)}) and end_time*2.5e0-start_time*2.5e0>=4""",
    bs=f"""select *, greatest(0e0,round_even(greatest(rs,mi)/0.5e0,0))*0.5e0 as snap from (select song_id, section_idx, classification as bt, start_time*2.5e0-1 as rs, end_time*2.5e0-1 as re, total_s, mi, mo from cl join mx using(song_id)
 where classification not in ({quoted(K.NO_BEAT_SECTIONS)})) q where re>0 and rs<total_s and re>mi and rs<mo and least(re,mo)-greatest(rs,mi)>=4""",
    sl="""select song_id, list({'bt': bt, 'dest': cast(trunc(snap*1000) as bigint), 'total': cast(trunc(total_s*1000) as bigint)} order by section_idx) as slots from bs where snap<mo group by song_id""",
    put=f"""select song_id, slots, cast([] as bigint[]) as used, cast(0 as bigint) as ord, cast(null as bigint) as j, '' as vt, cast(0 as bigint) as vocal_start, cast(0 as bigint) as vocal_end from sl union all
 select song_id, slots, case when j is null or slots[j].dest>=slots[j].total then used else list_append(used, j) end, ord, case when slots[j].dest<slots[j].total then j end, vt, vocal_start, vocal_end from (
 select song_id, slots, used, ord, vt, vocal_start, vocal_end, list_min(list_transform(list_filter(range(1,len(slots)+1), lambda j: not list_contains(used, j)), lambda j: ({SECTION_RANK})*1000000+j))%1000000 as j from (
 select p.song_id, p.slots, p.used, v.ord, v.vt, v.vocal_start, v.vocal_end from put p join vs v on v.song_id=p.song_id and v.ord=p.ord+1) x) y""",
    ps="select song_id, vocal_start, vocal_end, slots[j].dest as dest_start, vt as vox_type, slots[j].bt as beat_type from put where j is not null")


@query("g04_place_sections", sql("frames sections", "select * from ps", **SECTIONS_PLACED))
def _(t):
    return placed_sections(t)


@query("g04_place_vocals", sql("frames sections samples", """select song_id, vocal_start, vocal_end, dest_start from ps where song_id in (select song_id from ps group by song_id having count(*)>=2) union all
 select song_id, cast(trunc(start_time*1000) as bigint), cast(trunc(end_time*1000) as bigint), bar*1000 from pp join asked using(song_id, phrase_idx) where song_id not in (select song_id from ps group by song_id having count(*)>=2)""", **PHRASES_PLACED, **SECTIONS_PLACED))
def _(t):
    ph = song_phrases(t)
    by_bar = L.place_phrases(ph, beat_bars(t), "song_id", 1.0).join(ph, ["song_id", "phrase_idx"])
    by_bar = by_bar.select("song_id", (F.col("start_time") * 1000).cast("bigint").alias("vocal_start"), (F.col("end_time") * 1000).cast("bigint").alias("vocal_end"),
                           (F.col("bar") * 1000).alias("dest_start"))
    return L.place_vocals(placed_sections(t), by_bar, "song_id")


def mix_score(mix, keys):
    return Q.mix_quality(mix, keys, "x").withColumnRenamed("mix_quality", "score")


COMBOS = " union all ".join(f"select {n} as ord, {v}e0 as vox_rms, {i}e0 as inst_rms" for n, (v, i) in enumerate((v, i) for v in K.VOCAL_LEVELS for i in K.BEAT_LEVELS))


@query("g06_level_grid", sql("samples", """select song_id, vox_rms, inst_rms, round(score,6) as score from (select *, row_number() over(partition by song_id order by round(score,12) desc, ord) as rn from (
 select song_id, ord, vox_rms, inst_rms, 0.5e0*greatest(0e0,1-avg(case when abs(m)>0.95 then 1e0 else 0e0 end)*50)+0.5e0*greatest(0e0,least(1e0,1-abs(log10(greatest(max(abs(m))/sqrt(avg(m*m)),0.1e0))-0.78e0)/0.6e0)) as score from (
 select v.song_id, c.ord, c.vox_rms, c.inst_rms, v.x*least(c.vox_rms/rv,8e0)+i.x*least(c.inst_rms/ri,8e0) as m from v join i using(song_id,pos)
 join (select song_id, sqrt(avg(x*x)) as rv from v group by song_id) a on a.song_id=v.song_id join (select song_id, sqrt(avg(x*x)) as ri from i group by song_id) b on b.song_id=v.song_id cross join c) q
 group by song_id, ord, vox_rms, inst_rms) w) z where rn=1""", **VI, c=COMBOS))
def _(t):
    v, i = halves(t)
    return L.level_grid(v, i, SONG, "pos", "x", mix_score).withColumn("score", r6("score"))


@query("g07_region_scan", sql("frames", """select song_id, case when dur<=10 then 5e0 else 5+ord*1e0 end as start_s, case when dur<=10 then greatest(10e0,dur-5) else 15+ord*1e0 end as end_s from d join (
 select song_id, ord from (select *, row_number() over(partition by song_id order by s desc, ord) as rn from (select d.song_id, g.o as ord, round(avg(f.rms),12) as s from d join g on g.song_id=d.song_id join frames f on f.song_id=d.song_id and f.frame*0.25e0>=10+g.o-2 and f.frame*0.25e0<10+g.o+2 where dur>10 group by d.song_id, g.o) a) b where rn=1 union all
 select song_id, 0 from d where dur<=10) c using(song_id)""", d="select song_id, max(frame)*0.25e0 as dur from frames group by song_id",
 g="select song_id, unnest(range(0, cast(ceil(greatest(6e0,dur-15)-5) as bigint))) as o from d"))
def _(t):
    f = t.stored("frames").select("song_id", (F.col("frame") * 0.25).alias("t"), "rms")
    score = lambda rows, keys: rows.groupBy(*keys).agg(F.avg("rms").alias("score"))
    return L.region_scan(f, SONG, "t", 10.0, 4.0, score, step=1.0)


@query("f04_argmax_first", sql("samples", """select song_id, pos, round(x,6) as x from (select *, row_number() over(partition by song_id order by x desc, pos) as rn from samples) q where rn=1"""))
def _(t):
    d = L.argmax_first(xs(t), SONG, F.col("x"), F.col("pos"), {"pos": F.col("pos"), "x": F.col("x")})
    return d.select("song_id", "pos", r6("x").alias("x"))
