"""Song analysis as one record per song, over the frame and beat tables."""

from pyspark.sql import functions as F

from tonegrid.operators import analysis as N
from tonegrid.plans.adapters import sql
from tonegrid.plans.registry import query
from tonegrid.plans.series_queries import ACT, COMBINED, PEAK_ROWS, SONG, r6, vector_frames
from tonegrid.plans.similarity_queries import MAJ, MIN, NAMES
from tonegrid.plans.structure_queries import CLASSIFIED, DOWN

#: Series of the given tables last seconds, so that sections are four seconds apart here.
SECTION_S = 4.0


def analysed(t):
    stem = lambda s: F.when(F.col("stem") == s, F.col("rms")).otherwise(0.0).alias(s)
    profile = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.pmod(F.col("frame") * 7 + i * i + F.col("song_id"), F.lit(12)) * F.col("rms"))
    stems = t.stored("frames").select("song_id", "frame", stem("vocals"), stem("drums"), (1000 + F.col("rms") * 5000).alias("centroid"),
                                      F.when(F.col("stem") == "other", profile).alias("key_chroma"))
    return N.analyse_songs(vector_frames(t).join(stems, ["song_id", "frame"]), t.stored("beats"), SONG, 0.25, SECTION_S)


def curve(name: str, level: str) -> dict[str, str]:
    """Levels between beats over their maximum, half seconds where a song has fewer than two beats."""
    return {f"{name}_raw": f"""select s.song_id, s.i, sqrt(avg(({level})*({level}))) as e from sp s join frames f on f.song_id=s.song_id and f.frame>=s.s and f.frame<s.e group by 1,2
 union all select song_id, frame//2, sqrt(avg(({level})*({level}))) from frames join ln using(song_id) where song_id not in (select song_id from sp) and ((frame//2+1)*2<=len or frame<2) group by 1,2""",
            name: f"select song_id, i, case when max(e) over(partition by song_id)>0 then e/max(e) over(partition by song_id) else e end as e from {name}_raw"}


DRUMS = "case when stem='drums' then rms else 0e0 end"
PARTS = dict(
    ln=f"select song_id, max(frame)+1 as len, (max(frame)+1)*0.25e0 as duration, sqrt(avg(({DRUMS})*({DRUMS})))>0.02 as strong from frames group by 1",
    sp="""select song_id, beat_idx as i, greatest(0, least(cast(trunc(t*4) as bigint), len-1)) as s, greatest(greatest(0, least(cast(trunc(t*4) as bigint), len-1))+1, least(cast(trunc(nt*4) as bigint), len)) as e
 from (select *, lead(t) over(partition by song_id order by beat_idx) as nt from beats) q join ln using(song_id) where nt is not null""",
    **curve("cv", "rms"), **curve("dc", DRUMS),
    vf="select song_id, frame, case when stem='vocals' then rms else 0e0 end as rms from frames", **{k: v.replace("from frames", "from vf") for k, v in ACT.items()},
    **COMBINED, pk=PEAK_ROWS, **DOWN,
    bd="""select song_id, min(frame) as frame from pk group by song_id union all select p.song_id, min(k.frame) from bd p join pk k
 on k.song_id=p.song_id and k.frame-p.frame>=16 group by p.song_id, p.frame""",
    snp="""select song_id, coalesce(g, found) as t from (select p.song_id, p.frame*0.25e0 as found, d.t as g, row_number() over(partition by p.song_id, p.frame order by abs(d.t-p.frame*0.25e0), d.t) as rn
 from bd p left join dn d on d.song_id=p.song_id) q where rn=1""",
    pts="select distinct song_id, t from (select song_id, t from snp union all select song_id, 0e0 from ln union all select song_id, duration from ln) u",
    fin="select song_id, max(t) as fin from pts group by song_id", body="select p.* from pts p join fin f using(song_id) where p.t<f.fin",
    kept="""select song_id, min(t) as t from body group by song_id union all select p.song_id, min(k.t) from kept p join body k
 on k.song_id=p.song_id and k.t-p.t>=3 group by p.song_id, p.t""",
    eg="select song_id, t from (select p.*, f.fin, max(p.t) over(partition by p.song_id) as last from kept p join fin f using(song_id)) q where t<last or fin-last>=3 union all select song_id, fin from fin",
    spn="""select song_id, t as start_time, nt as end_time, cast(row_number() over(partition by song_id order by t)-1 as bigint) as section_idx
 from (select *, lead(t) over(partition by song_id order by t) as nt from eg) q where nt-t>=2""",
    lvl="select s.song_id, s.section_idx, coalesce(sqrt(avg(f.rms*f.rms)),0) as e, coalesce(avg(1000+f.rms*5000),0) as spectral_centroid from spn s left join frames f on f.song_id=s.song_id and f.frame*0.25e0>=s.start_time and f.frame*0.25e0<s.end_time group by 1,2",
    vox="select s.song_id, s.section_idx, coalesce(avg(case when b.activity>0 then 1e0 else 0e0 end) filter (where b.frame is not null),0) as vocal_density from spn s left join br b on b.song_id=s.song_id and b.frame>=cast(trunc(s.start_time/0.25e0) as bigint) and b.frame<cast(trunc(s.end_time/0.25e0) as bigint) group by 1,2",
    drm="""select s.song_id, s.section_idx, coalesce(avg(c.e)>any_value(w.mean)*1.1e0,false) as drum_dominant from spn s join (select song_id, greatest(max(end_time),1e0) as dur from spn group by 1) d using(song_id)
 left join (select song_id, count(*) as n, avg(e) as mean from dc group by 1) w using(song_id) left join dc c on c.song_id=s.song_id and c.i>=greatest(0,cast(trunc(s.start_time/d.dur*w.n) as bigint)) and c.i<least(cast(trunc(s.end_time/d.dur*w.n) as bigint), w.n) group by 1,2""",
    bts="select s.song_id, s.section_idx, count(b.t) as n_beats from spn s left join beats b on b.song_id=s.song_id and b.t>=s.start_time and b.t<=s.end_time group by 1,2",
    sections="""select s.*, case when max(e) over(partition by s.song_id)>0 then e/max(e) over(partition by s.song_id) else e end as energy, spectral_centroid, vocal_density, vocal_density>0.25 as has_vocals, drum_dominant, n_beats
 from spn s join lvl using(song_id, section_idx) join vox using(song_id, section_idx) join drm using(song_id, section_idx) join bts using(song_id, section_idx)""",
    cl=CLASSIFIED)


@query("m04_song_sections", sql("beats", """select song_id, section_idx, start_time, end_time, round(energy,6) as energy, round(spectral_centroid,6) as spectral_centroid, round(vocal_density,6) as vocal_density, has_vocals,
 drum_dominant, n_beats, classification from cl""", **PARTS))
def _(t):
    d = N.nest_songs(analysed(t), SONG).select("song_id", F.explode("sections").alias("s")).select("song_id", "s.*")
    return d.select("song_id", "section_idx", "start_time", "end_time", *[r6(c).alias(c) for c in ("energy", "spectral_centroid", "vocal_density")],
                    "has_vocals", "drum_dominant", "n_beats", "classification")


@query("m05_analyse_songs", sql("beats", f"""select l.song_id, l.duration, round(coalesce(tempo,120e0),6) as tempo, coalesce(n_beats,0) as n_beats, key, round(coalesce(c.e,0),6) as overall_energy, coalesce(n_phrases,0) as n_phrases,
 coalesce(p.strong,false) as has_strong_vocals, l.strong as has_strong_drums, coalesce(n_sections,cast(0 as int)) as n_sections, coalesce(labels,'') as labels from ln l
 left join (select song_id, case when x<70 then x*2 when x>180 then x/2 else x end as tempo from (select song_id, 60e0/nullif(quantile_cont(d,0.5),0) as x from (select *, t-lag(t) over(partition by song_id order by beat_idx) as d from beats) i group by 1) q) a using(song_id)
 left join (select song_id, count(*) as n_beats from beats group by 1) b using(song_id) left join (select song_id, avg(e) as e from cv group by 1) c using(song_id)
 left join (select song_id, count(*) as n_phrases, bool_or(energy>0.03) as strong from ph group by 1) p using(song_id)
 left join (select song_id, list_extract({NAMES}, cast(root+1 as int)) || case when mode=0 then ' major' else ' minor' end as key from (select *, row_number() over(partition by song_id order by root*2+mode) as rn from (select *, max(r) over(partition by song_id) as top from fit) f where coalesce(r>=top-1e-9,true)) q where rn=1) k using(song_id)
 left join (select song_id, cast(count(*) as int) as n_sections, string_agg(classification, '/' order by section_idx) as labels from cl group by 1) s using(song_id)""", **PARTS,
    kc="select song_id, i, avg(((frame*7+i*i+song_id)%12)*rms) as v from frames, (select unnest(range(12)) as i) i where stem='other' group by 1,2",
    fit=f"select c.song_id, t.root, m.mode, corr(c.v, list_extract(case when m.mode=0 then {MAJ} else {MIN} end, cast((c.i-t.root+12)%12+1 as int))) as r from kc c, range(0,12) t(root), range(0,2) m(mode) group by 1,2,3"))
def _(t):
    d = N.nest_songs(analysed(t), SONG)
    labels = F.array_join(F.transform("sections", lambda s: s["classification"]), "/")
    return d.select("song_id", "duration", r6("tempo").alias("tempo"), "n_beats", "key", r6("overall_energy").alias("overall_energy"), "n_phrases", "has_strong_vocals", "has_strong_drums",
                    F.size("sections").alias("n_sections"), labels.alias("labels"))
