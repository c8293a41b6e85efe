"""Engine tables read or derived from the given parquet tables, and the same as SQL texts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.constants import NOTE_NAMES
from tonegrid.operators.ordered import dense_index
from tonegrid.session import materialize


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._stored: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stored(self, name: str) -> DataFrame:
        """A derived table written once, for queries that read it several times."""
        if name not in self._stored:
            self._stored[name] = materialize(getattr(self, name), name)
        return self._stored[name]

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("song_id"), "embedding", "label")

    @cached_property
    def songs(self) -> DataFrame:
        v = F.col("vec_id")
        names = F.array(*[F.lit(n) for n in NOTE_NAMES])
        return self.raw("embeddings").select(
            v.alias("song_id"), (120 + (v * 13) % 240).cast("double").alias("duration"),
            (70 + ((v * 37) % 1100) / F.lit(10.0)).alias("tempo"),
            F.concat(F.element_at(names, (1 + (v * 5) % 12).cast("int")),
                     F.when(F.col("label") % 2 == 0, " major").otherwise(" minor")).alias("key"),
            (((v * 7) % 100) / F.lit(100.0)).alias("overall_energy"),
            (1 + v % 9).cast("int").alias("n_sections"),
            (1500 + (v * 29) % 2000).cast("double").alias("vocal_centroid"))

    @cached_property
    def n_songs(self) -> int:
        """Song ids run from 0 to this number, less one."""
        return max(self.raw("embeddings").count(), 1)

    @cached_property
    def song_pairs(self) -> DataFrame:
        """One partner per song, picked by arithmetic; the table grows with the songs."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("pair_id"), F.col("vec_id").alias("song_a"),
            ((F.col("vec_id") * 31 + 7) % self.n_songs).alias("song_b"))

    @cached_property
    def frames(self) -> DataFrame:
        e = self.raw("events").select("user_id", "event_id", "ts", "event_type", "value")
        e = dense_index(e, ["user_id"], ["ts", "event_id"], F.to_date("ts"), "frame")
        stem = (F.when(F.col("event_type") == "view", "vocals").when(F.col("event_type") == "click", "drums")
                .when(F.col("event_type") == "purchase", "bass").when(F.col("event_type") == "signup", "other")
                .otherwise("noise"))
        return e.select(F.col("user_id").alias("song_id"), "frame",
                        (F.col("value") / F.lit(500.0)).alias("rms"), stem.alias("stem"), "ts")

    @cached_property
    def beats(self) -> DataFrame:
        f = self.frames.where(F.col("stem").isin("drums", "bass"))
        b = dense_index(f, ["song_id"], ["frame"], F.floor(F.col("frame") / 65536), "beat_idx")
        return b.select("song_id", "beat_idx", (F.col("frame") * 0.25).alias("t"), F.col("rms").alias("strength"))

    @cached_property
    def sections(self) -> DataFrame:
        s = F.floor(F.col("frame") / F.lit(8.0)).cast("bigint")
        return (self.frames.groupBy("song_id", s.alias("section_idx"))
                .agg((F.min("frame") * 0.25).alias("start_time"), ((F.max("frame") + 1) * 0.25).alias("end_time"),
                     F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("energy"),
                     (1000 + F.avg("rms") * 5000).alias("spectral_centroid"),
                     (F.avg(F.when(F.col("stem") == "vocals", 1.0).otherwise(0.0)) > 0.25).alias("has_vocals")))

    @cached_property
    def samples(self) -> DataFrame:
        li = self.raw("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey",
                                         "l_extendedprice", "l_quantity")
        li = dense_index(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
                         F.floor(F.col("l_orderkey") / 65536), "pos")
        line = F.col("l_linenumber") % 4
        stem = (F.when(line == 0, "vocals").when(line == 1, "drums").when(line == 2, "bass").otherwise("other"))
        return li.select(F.col("l_suppkey").alias("song_id"), "pos",
                         ((F.col("l_quantity") - 25.5) / 25.5).alias("x"), stem.alias("stem"))

    @cached_property
    def mix_params(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        return self.raw("orders").select(
            k.alias("mix_id"), (c % self.n_songs).alias("song_a"), ((k * 31) % self.n_songs).alias("song_b"),
            F.when(F.col("o_orderstatus") == "F", "a_vocals").otherwise("b_vocals").alias("direction"),
            (k % 13 - 6).cast("int").alias("key_shift"), (0.07 + (k % 7) * 0.01).alias("vox_rms"),
            (0.10 + (k % 4) * 0.02).alias("inst_rms"), F.lit(0.3).alias("duck_depth"),
            F.lit(-18.0).alias("comp_threshold"))

    @cached_property
    def ratings_in(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            (F.floor(k / F.lit(2.0)).cast("bigint") * 2).alias("mix_id"), (k % 7).cast("int").alias("rating"),
            F.col("o_orderdate").alias("rated_at"), k.alias("seq"))

    @cached_property
    def mix_scores(self) -> DataFrame:
        flag = lambda c, v: F.avg(F.when(F.col(c) == v, 1.0).otherwise(0.0))
        return (self.raw("lineitem").groupBy(F.col("l_suppkey").alias("mix_id"))
                .agg((F.avg("l_discount") * 10).alias("beat_coherence"), (F.avg("l_tax") * 10).alias("spectral_balance"),
                     (F.avg("l_quantity") / 50).alias("harmonic_clarity"), (F.max("l_quantity") / 60).alias("vocal_clarity"),
                     (F.min("l_quantity") / 10).alias("dynamic_range"), flag("l_returnflag", "A").alias("phase_coherence"),
                     flag("l_returnflag", "R").alias("spectral_separation"), flag("l_linestatus", "O").alias("energy_consistency")))

    @cached_property
    def chromas(self) -> DataFrame:
        """First twelve vector values as a pitch-class profile."""
        return self.raw("embeddings").select(F.col("vec_id").alias("song_id"),
                                             F.slice("embedding", 1, 12).cast("array<double>").alias("chroma"))

    @cached_property
    def spectra(self) -> DataFrame:
        """Vectors as 64-bin magnitude frames, one series per label."""
        return self.raw("embeddings").select(
            F.col("label").alias("song_id"), F.col("vec_id").alias("frame"),
            F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("mag"))


# ---- the same tables for the SQL check ----
NOTES_SQL = "list_value('C','C#','D','D#','E','F','F#','G','G#','A','A#','B')"
CTE = {
    "songs": f"""select vec_id as song_id, cast(120 + (vec_id*13)%240 as double) as duration,
 cast(70 + ((vec_id*37)%1100)/10.0e0 as double) as tempo,
 list_extract({NOTES_SQL}, cast(1+(vec_id*5)%12 as int)) || case when label%2=0 then ' major' else ' minor' end as key,
 cast(((vec_id*7)%100)/100.0e0 as double) as overall_energy, cast(1+vec_id%9 as int) as n_sections,
 cast(1500+(vec_id*29)%2000 as double) as vocal_centroid from embeddings""",
    "song_pairs": """select vec_id as pair_id, vec_id as song_a, (vec_id*31+7)%(select count(*) from embeddings) as song_b from embeddings""",
    "frames": """select user_id as song_id,
 cast(row_number() over(partition by user_id order by ts,event_id)-1 as bigint) as frame, value/500e0 as rms,
 case event_type when 'view' then 'vocals' when 'click' then 'drums' when 'purchase' then 'bass'
 when 'signup' then 'other' else 'noise' end as stem, ts from events""",
    "beats": """select song_id, cast(row_number() over(partition by song_id order by frame)-1 as bigint) as beat_idx,
 frame*0.25e0 as t, rms as strength from frames where stem in ('drums','bass')""",
    "sections": """select song_id, cast(floor(frame/8e0) as bigint) as section_idx, min(frame)*0.25e0 as start_time,
 (max(frame)+1)*0.25e0 as end_time, sqrt(avg(rms*rms)) as energy, 1000+avg(rms)*5000 as spectral_centroid,
 avg(case when stem='vocals' then 1e0 else 0e0 end)>0.25e0 as has_vocals
 from frames group by song_id, floor(frame/8e0)""",
    "samples": """select l_suppkey as song_id, cast(row_number() over(partition by l_suppkey
 order by l_orderkey,l_linenumber,l_partkey,l_extendedprice)-1 as bigint) as pos, (l_quantity-25.5e0)/25.5e0 as x,
 case l_linenumber%4 when 0 then 'vocals' when 1 then 'drums' when 2 then 'bass' else 'other' end as stem from lineitem""",
    "mix_params": """select o_orderkey as mix_id, o_custkey%(select count(*) from embeddings) as song_a, (o_orderkey*31)%(select count(*) from embeddings) as song_b,
 case when o_orderstatus='F' then 'a_vocals' else 'b_vocals' end as direction, cast(o_orderkey%13-6 as int) as key_shift,
 0.07e0+(o_orderkey%7)*0.01e0 as vox_rms, 0.10e0+(o_orderkey%4)*0.02e0 as inst_rms, 0.3e0 as duck_depth,
 -18e0 as comp_threshold from orders""",
    "ratings_in": """select cast(floor(o_orderkey/2e0) as bigint)*2 as mix_id, cast(o_orderkey%7 as int) as rating,
 o_orderdate as rated_at, o_orderkey as seq from orders""",
    "mix_scores": """select l_suppkey as mix_id, avg(l_discount)*10 as beat_coherence, avg(l_tax)*10 as spectral_balance,
 avg(l_quantity)/50 as harmonic_clarity, max(l_quantity)/60 as vocal_clarity, min(l_quantity)/10 as dynamic_range,
 avg(case when l_returnflag='A' then 1e0 else 0e0 end) as phase_coherence,
 avg(case when l_returnflag='R' then 1e0 else 0e0 end) as spectral_separation,
 avg(case when l_linestatus='O' then 1e0 else 0e0 end) as energy_consistency from lineitem group by l_suppkey""",
    "chromas": """select vec_id as song_id, list_transform(list_slice(embedding,1,12), lambda v: cast(v as double)) as chroma
 from embeddings""",
    "spectra": """select label as song_id, vec_id as frame, list_transform(embedding, lambda v: abs(cast(v as double))) as mag
 from embeddings""",
}
NEEDS = {"beats": ["frames"], "sections": ["frames"]}


def sql(tables: str, body: str, /, **ctes: str) -> str:
    """A WITH query: the named adapter tables, then extra CTEs in order, then the body."""
    names: list[str] = []
    for t in tables.split():
        for n in [*NEEDS.get(t, []), t]:
            if n not in names:
                names.append(n)
    parts = [f"{n} as ({CTE[n]})" for n in names] + [f"{n} as ({q})" for n, q in ctes.items()]
    return (f"with recursive {', '.join(parts)} " if parts else "") + body
