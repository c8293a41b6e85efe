"""Similarity search and key queries."""

from pyspark.sql import functions as F

from tonegrid import constants as K
from tonegrid.functions import arrays as A
from tonegrid.operators import similarity as M
from tonegrid.plans.adapters import sql
from tonegrid.plans.registry import query
from tonegrid.plans.scalars_queries import INTERVAL_CASE, REL, TEMPO_CASE

DOTS = """select a.vec_id as a, b.vec_id as b, round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])),9) as sim
 from embeddings a join embeddings b on a.vec_id<>b.vec_id"""


@query("c02_top_pairs", sql("", "select a as song_a, b as song_b, round(sim,6) as similarity from dots where a<b order by sim desc, a, b limit 20", dots=DOTS))
def _(t):
    return M.top_pairs(t.embeddings, 20).withColumn("similarity", F.round("similarity", 6))


@query("f01_top_n", sql("songs", "select song_id, tempo, overall_energy from songs order by overall_energy desc, tempo desc, song_id limit 25"))
def _(t):
    return M.top_n(t.songs.select("song_id", "tempo", "overall_energy"), [F.desc("overall_energy"), F.desc("tempo"), F.col("song_id")], 25)


@query("c03_best_match", sql("", """select a as song_id, b as match_id, round(sim,6) as similarity from (select *, row_number() over(partition by a order by sim desc, b) as rn from dots) q where rn=1""", dots=DOTS))
def _(t):
    return M.best_match(t.embeddings).withColumn("similarity", F.round("similarity", 6))


@query("c04_next_song", sql("songs", f"""select a as song_id, b as next_id, round(score,6) as score from (select *, row_number() over(partition by a order by round(score,9) desc, b) as rn from (
 select a, b, 0.5e0*dot+0.3e0*({INTERVAL_CASE})+0.2e0*({TEMPO_CASE}) as score from cand) q) w where rn=1""",
 cand=f"""select x.song_id as a, y.song_id as b, list_dot_product(cast(ex.embedding as double[]), cast(ey.embedding as double[])) as dot,
 greatest(x.tempo,y.tempo)/greatest(least(x.tempo,y.tempo),1e0) as r, abs({REL('x.key')}-{REL('y.key')}) as iv
 from songs x join songs y on x.song_id<>y.song_id join embeddings ex on ex.vec_id=x.song_id join embeddings ey on ey.vec_id=y.song_id"""))
def _(t):
    return M.next_song(t.songs, t.embeddings).withColumn("score", F.round("score", 6))


@query("c04_next_song_chroma", sql("songs chromas", f"""select a as song_id, b as next_id, round(score,6) as score from (select *, row_number() over(partition by a order by round(score,9) desc, b) as rn from (
 select x.song_id as a, y.song_id as b, 0.5e0*list_dot_product(cast(ex.embedding as double[]), cast(ey.embedding as double[]))+0.3e0*greatest(0e0,least(1e0,(k.best+0.5e0)/1.5e0))+0.2e0*({TEMPO_CASE}) as score
 from ky k join tm x on x.song_id=k.a join tm y on y.song_id=k.b join embeddings ex on ex.vec_id=k.a join embeddings ey on ey.vec_id=k.b join rt on rt.a=k.a and rt.b=k.b) q) w where rn=1""",
 ce="select song_id, list_transform(chroma, lambda x: x-list_avg(chroma)) as c from chromas", un="select song_id, list_transform(c, lambda x: x/sqrt(list_dot_product(c, c))) as u from ce",
 tu="select song_id, list_concat(u[s.s+1:12], u[1:s.s]) as u from un, range(0,12) s(s)",
 ky="select a.song_id as a, b.song_id as b, max(list_dot_product(a.u, b.u)) as best from un a join tu b on a.song_id<>b.song_id group by 1, 2",
 tm="select song_id, tempo from songs", rt="select x.song_id as a, y.song_id as b, greatest(x.tempo,y.tempo)/greatest(least(x.tempo,y.tempo),1e0) as r from songs x join songs y on x.song_id<>y.song_id"))
def _(t):
    songs = t.songs.join(t.chromas.withColumnRenamed("chroma", "key_chroma"), "song_id")
    return M.next_song(songs, t.embeddings).withColumn("score", F.round("score", 6))


ROT = """select p.pair_id, s.s as shift, corr(list_extract(a.chroma, i.i+1), list_extract(b.chroma, (i.i-s.s+12)%12+1)) as r from song_pairs p
 join chromas a on a.song_id=p.song_a join chromas b on b.song_id=p.song_b, range(0,12) s(s), range(0,12) i(i) group by p.pair_id, s.s"""


@query("c08_chroma_compat", sql("song_pairs chromas", "select pair_id, round(greatest(0e0, least(1e0, (max(r)+0.5e0)/1.5e0)),6) as key_score from rot group by pair_id", rot=ROT))
def _(t):
    side = lambda s: t.chromas.select(F.col("song_id").alias(f"song_{s}"), F.col("chroma").alias(f"c{s}"))
    d = t.song_pairs.join(side("a"), "song_a").join(side("b"), "song_b")
    return d.select("pair_id", F.round(A.chroma_compatibility(F.col("ca"), F.col("cb"), F.lit(0.5)), 6).alias("key_score"))


MAJ, MIN = ("[" + ",".join(f"{v}e0" for v in p) + "]" for p in (K.MAJOR_PROFILE, K.MINOR_PROFILE))
NAMES = "[" + ",".join(f"'{n}'" for n in K.NOTE_NAMES) + "]"


@query("c09_detect_key", sql("chromas", f"""select song_id, list_extract({NAMES}, cast(root+1 as int)) || case when mode=0 then ' major' else ' minor' end as key, round(r,6) as corr from (
 select *, row_number() over(partition by song_id order by round(r,12) desc, root*2+mode) as rn from fit) q where rn=1""",
 fit=f"""select c.song_id, t.root, m.mode, corr(list_extract(c.chroma, cast((k.k+t.root)%12+1 as int)), case when m.mode=0 then list_extract({MAJ}, cast(k.k+1 as int)) else list_extract({MIN}, cast(k.k+1 as int)) end) as r
 from chromas c, range(0,12) t(root), range(0,2) m(mode), range(0,12) k(k) group by c.song_id, t.root, m.mode"""))
def _(t):
    k = A.detect_key(F.col("chroma"))
    return t.chromas.select("song_id", k["key"].alias("key"), F.round(k["corr"], 6).alias("corr"))
