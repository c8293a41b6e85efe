"""Rating, suggestion and model queries."""

from pyspark.sql import functions as F

from tonegrid import constants as K
from tonegrid.operators import learning as R
from tonegrid.operators import similarity as M
from tonegrid.plans.adapters import sql
from tonegrid.plans.registry import query
from tonegrid.plans.scalars_queries import INTERVAL_CASE, REL, TEMPO_CASE
from tonegrid.session import materialize


def r6(c):
    return F.round(c, 6)


LATEST = """select mix_id, rating, rated_at, seq from (select *, row_number() over(partition by mix_id order by rated_at desc, seq desc) as rn from ratings_in) q where rn=1"""
RATED = """select m.*, cast(greatest(1,least(5,l.rating)) as int) as rating, list_transform(a.embedding, lambda x: cast(x as double)) as emb_a, list_transform(b.embedding, lambda x: cast(x as double)) as emb_b
 from mix_params m join latest l using(mix_id) join embeddings a on a.vec_id=m.song_a join embeddings b on b.vec_id=m.song_b"""


def rated(t, vectors=True):
    ok, _ = R.apply_ratings(t.ratings_in, t.mix_params, ["rated_at", "seq"])
    if not vectors:
        return ok
    e = t.embeddings
    return (ok.join(e.select(F.col("song_id").alias("song_a"), F.col("embedding").alias("emb_a")), "song_a")
            .join(e.select(F.col("song_id").alias("song_b"), F.col("embedding").alias("emb_b")), "song_b"))


def query_pairs(t):
    e = t.embeddings
    return (t.song_pairs.join(e.select(F.col("song_id").alias("song_a"), F.col("embedding").alias("emb_a")), "song_a")
            .join(e.select(F.col("song_id").alias("song_b"), F.col("embedding").alias("emb_b")), "song_b"))


@query("d30_latest_ratings", sql("ratings_in", "select mix_id, rating, seq from latest", latest=LATEST))
def _(t):
    return R.latest_ratings(t.ratings_in, ["rated_at", "seq"]).select("mix_id", "rating", "seq")


@query("c13_apply_ratings", sql("ratings_in mix_params", "select m.mix_id, cast(greatest(1,least(5,l.rating)) as int) as rating, m.direction, m.key_shift from mix_params m join latest l using(mix_id) where m.mix_id%6<>0", latest=LATEST))
def _(t):
    ok, _ = R.apply_ratings(t.ratings_in, t.mix_params.where(F.col("mix_id") % 6 != 0), ["rated_at", "seq"])
    return ok.select("mix_id", "rating", "direction", "key_shift")


@query("c13_rejected_ratings", sql("ratings_in", "select mix_id, seq, rating from ratings_in where mix_id%6=0"))
def _(t):
    _, bad = R.apply_ratings(t.ratings_in, t.mix_params.where(F.col("mix_id") % 6 != 0), ["rated_at", "seq"])
    return bad.select("mix_id", "seq", "rating")


@query("d28_ratings_count", sql("ratings_in", "select count(*) as n, count(*)>=3 as can_train, count(*)>=5 as can_retrain from latest", latest=LATEST))
def _(t):
    return R.ratings_count(R.latest_ratings(t.ratings_in, ["rated_at", "seq"]))


@query("d29_dominant_width", "select vec_id as song_id, 64::bigint as width from embeddings where vec_id%5<>0")
def _(t):
    e = t.embeddings.select("song_id", F.when(F.col("song_id") % 5 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    return R.dominant_width(e, "embedding", "song_id").select("song_id", F.size("embedding").cast("bigint").alias("width"))


HIST = dict(latest=LATEST, rt="select m.mix_id, m.song_a, m.song_b, m.direction, cast(greatest(1,least(5,l.rating)) as int) as rating from mix_params m join latest l using(mix_id)",
            hist="""select p.pair_id, r.direction, r.rating, r.mix_id from mixpairs p join rt r on r.song_a=p.song_a and r.song_b=p.song_b union all
 select p.pair_id, case when r.direction='a_vocals' then 'b_vocals' else 'a_vocals' end, r.rating, r.mix_id from mixpairs p join rt r on r.song_a=p.song_b and r.song_b=p.song_a and r.song_a<>r.song_b""",
            bdir="""select pair_id, direction, m from (select *, row_number() over(partition by pair_id order by round(m,12) desc, first) as rn from (select pair_id, direction, avg(rating) as m, min(mix_id) as first
 from hist group by pair_id, direction) a) b where rn=1""")
# pairs that were mixed at least once: both orders of every rated mix
MIXPAIRS = "select mix_id as pair_id, case when mix_id%4=0 then song_b else song_a end as song_a, case when mix_id%4=0 then song_a else song_b end as song_b from mix_params"


def mix_pairs(t):
    swap = F.col("mix_id") % 4 == 0
    return t.mix_params.select(F.col("mix_id").alias("pair_id"), F.when(swap, F.col("song_b")).otherwise(F.col("song_a")).alias("song_a"),
                               F.when(swap, F.col("song_a")).otherwise(F.col("song_b")).alias("song_b"))


@query("c14_pair_history", sql("ratings_in mix_params", "select pair_id, direction, rating, mix_id from hist", mixpairs=MIXPAIRS, **{k: HIST[k] for k in ("latest", "rt", "hist")}))
def _(t):
    return R.pair_history(rated(t, False), mix_pairs(t)).select("pair_id", "direction", "rating", "mix_id")


@query("d27_best_direction_by_rating", sql("ratings_in mix_params", "select pair_id, direction, round(m,6) as mean_rating from bdir", mixpairs=MIXPAIRS, **HIST))
def _(t):
    d = R.best_direction_by_rating(rated(t, False), mix_pairs(t))
    return d.select("pair_id", "direction", r6("mean_rating").alias("mean_rating"))


NEAR = dict(latest=LATEST, rated=RATED, qp="""select p.*, list_transform(a.embedding, lambda x: cast(x as double)) as qa, list_transform(b.embedding, lambda x: cast(x as double)) as qb
 from song_pairs p join embeddings a on a.vec_id=p.song_a join embeddings b on b.vec_id=p.song_b""",
    sims="""select p.pair_id, r.mix_id, round((list_dot_product(p.qa,r.emb_a)+list_dot_product(p.qb,r.emb_b))/(sqrt(list_dot_product(p.qa,p.qa)+list_dot_product(p.qb,p.qb))
 *sqrt(list_dot_product(r.emb_a,r.emb_a)+list_dot_product(r.emb_b,r.emb_b))),9) as sim from qp p cross join rated r""",
    nb="select pair_id, mix_id, sim from (select *, row_number() over(partition by pair_id order by sim desc, mix_id) as rn from sims) q where rn<=5")


@query("c15_nearest_rated", sql("song_pairs ratings_in mix_params", "select pair_id, mix_id, round(sim,6) as similarity from nb", **NEAR))
def _(t):
    return R.nearest_rated(t.song_pairs, materialize(rated(t, False), "rated"), t.embeddings).select("pair_id", "mix_id", r6("similarity").alias("similarity"))


SUGG = dict(NEAR, sg="""select pair_id, case when sum(case when direction='b_vocals' then w else 0 end)>sum(case when direction='a_vocals' then w else 0 end) then 'b_vocals' else 'a_vocals' end as direction,
 sum(w*vox_rms)/sum(w) as vox_rms, sum(w*inst_rms)/sum(w) as inst_rms, cast(round_even(sum(w*key_shift)/sum(w),0) as int) as key_shift, sum(w*duck_depth)/sum(w) as duck_depth, sum(w*comp_threshold)/sum(w) as comp_threshold
 from (select nb.pair_id, greatest(sim,0)*(r.rating/5e0) as w, r.* from nb join rated r using(mix_id)) q group by pair_id having sum(w)>1e-6""")
SHOW = "pair_id, direction, round(vox_rms,6) as vox_rms, round(inst_rms,6) as inst_rms, key_shift, round(duck_depth,6) as duck_depth, round(comp_threshold,6) as comp_threshold"


def shown(d):
    return d.select("pair_id", "direction", *[c if c == "key_shift" else r6(c).alias(c) for c in ("vox_rms", "inst_rms", "key_shift", "duck_depth", "comp_threshold")])


@query("d26_weighted_suggestion", sql("song_pairs ratings_in mix_params", f"select {SHOW} from sg", **SUGG))
def _(t):
    r = materialize(rated(t, False), "rated")
    near = R.nearest_rated(t.song_pairs, r, t.embeddings)
    return shown(R.weighted_suggestion(R.rated_neighbors(near, r)))


@query("j04_suggest_params", sql("song_pairs ratings_in mix_params", f"select {SHOW} from sg union all select pair_id, direction, null, null, null, null, null from bdir where pair_id not in (select pair_id from sg)",
                                 **SUGG, rt=HIST["rt"], mixpairs="select * from song_pairs", hist=HIST["hist"], bdir=HIST["bdir"]))
def _(t):
    return shown(R.suggest_params(t.song_pairs, rated(t, False), t.embeddings))


@query("j01_train_quality")
def _(t):
    m = R.train_mixes(rated(t, False), t.embeddings)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return m.select("layer", F.size("W").alias("inputs"), F.size("b").alias("outputs"), r6(total(F.flatten("W"))).alias("weight_sum"), r6(total("b")).alias("bias_sum"))


@query("j02_predict_quality")
def _(t):
    m = R.train_mixes(rated(t, False), t.embeddings)
    p = query_pairs(t).withColumn("direction", F.lit("a_vocals")).withColumn("key_shift", F.lit(0))
    return R.predict_quality(m, p).select("pair_id", r6("quality").alias("quality"))


@query("j03_predict_directional")
def _(t):
    width = 129
    m = R.save_model(t.spark, R.initial_layers(width, (256, 128)))
    p = query_pairs(t).withColumn("direction", F.explode(F.array(F.lit("a_vocals"), F.lit("b_vocals"))))
    return R.predict_directional(m, p).select("pair_id", "direction", r6("compatibility").alias("compatibility"))


CAND = f"""select x.song_id as a, y.song_id as b, list_dot_product(cast(ex.embedding as double[]), cast(ey.embedding as double[])) as dot,
 greatest(x.tempo,y.tempo)/greatest(least(x.tempo,y.tempo),1e0) as r, abs({REL('x.key')}-{REL('y.key')}) as iv
 from songs x join songs y on x.song_id<>y.song_id join embeddings ex on ex.vec_id=x.song_id join embeddings ey on ey.vec_id=y.song_id"""
SCORED_NEXT = f"select a, b, round(0.5e0*dot+0.3e0*({INTERVAL_CASE})+0.2e0*({TEMPO_CASE}),9) as score from cand"


@query("g05_session_chain", sql("songs", "select song_id as start_id, step, s as song_id from chain where step>0", cand=CAND, sc=SCORED_NEXT,
 nxt="select a, b from (select *, row_number() over(partition by a order by score desc, b) as rn from sc) w where rn=1",
 chain="select song_id, song_id as s, 0 as step from songs union all select c.song_id, n.b, c.step+1 from chain c join nxt n on n.a=c.s where c.step<5"))
def _(t):
    nxt = materialize(M.next_song(t.songs, t.embeddings), "next-song")
    return R.session_chain(nxt, t.songs.select("song_id"), 5)


@query("g05_session_chain_no_repeat", sql("songs", "select st as start_id, step, s as song_id from chain where step>0", cand=CAND, sc=SCORED_NEXT,
 chain="""select song_id as st, song_id as s, [song_id] as seen, 0 as step from songs union all select st, b, list_append(seen, b), step+1 from (
 select c.st, c.seen, c.step, first(k.b order by k.score desc, k.b) as b from chain c join sc k on k.a=c.s where c.step<4 and not list_contains(c.seen, k.b) group by c.st, c.seen, c.step) q"""))
def _(t):
    nxt = materialize(M.next_song(t.songs, t.embeddings, k=5), "next-songs")
    return R.session_chain(nxt, t.songs.select("song_id"), 4, no_repeat=True)
