"""Mixing sources to target weights by entropy balancing; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.llm.common import WORD, unused, whole
from tonegrid.session import materialize

#: Steps of the rounding order; finer only splits its windows further.
STEPS = 1024


def words(text: Column) -> Column:
    """Number of runs of anything but the six ASCII blanks; null: 0."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key, so that the null source joins like any other."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``target`` of every row of (source, source_size): shares of the whole size by weight, each at most ``most`` times its size.

    Sources in code point order, null last, take the weights in turn. What a stopped source leaves is shared among the
    others by weight, until none is above its limit: with the sources ordered by limit per weight, the level at which the
    first unstopped one stands is the level of all that follow. One row per source goes through one window.
    """
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_limit = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_cap").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.sum("source_size").over(everything) - before) / rest)
    stands = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    rows = rows.withColumn("_stands", F.first(stands, ignorenulls=True).over(everything))
    return rows.withColumn("target", F.least("_cap", F.col("_w") * F.coalesce("_stands", F.lit(math.inf)))).drop("_w", "_cap", "_level", "_stands")


def balance(histogram: DataFrame, goals: DataFrame, most: float, tolerance: float = 1e-10, rounds: int = 80) -> DataFrame:
    """Solve the dual of entropy balancing: ``_key, _lambda, _scale`` per source.

    Among all document rates r from 0 to ``most`` with sum(size * r) = target, those of least relative entropy to
    taking every document once are r = min(most, exp(lambda * size / scale)), scale being the source's mean size. Each
    round is one distributed aggregate of the residual and its slope over (source, size, documents), for all sources at
    once; a Newton step that leaves the bracket is replaced by halving it. Rounds that do not suffice are an error. The state is one row per source, written each
    round; the driver reads the largest relative residual only.
    """
    shape = histogram.groupBy("_key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_scale"), F.min("size").alias("_least"))
    ratio = F.col("target") / F.col("source_size")
    least = F.col("_least") / F.col("_scale")
    state = goals.join(shape, "_key").select(
        "_key", "target", "_scale", F.lit(0.0).alias("_lambda"),
        F.when(ratio < 1, F.log(ratio) / least).otherwise(0.0).alias("_low"),
        F.when(ratio > 1, F.lit(math.log(most)) / least).otherwise(0.0).alias("_high"),
        # at the limit every document has the highest rate
        (ratio >= most * (1 - 1e-12)).alias("_full"),
    )
    state = materialize(state.withColumn("_lambda", F.when(F.col("_full"), F.lit(math.inf)).otherwise(F.col("_lambda"))), "balance")
    for _ in range(rounds):
        x = F.col("size") / F.col("_scale")
        tilt = F.exp(F.col("_lambda") * x)
        tokens = F.col("n") * F.col("size")
        now = histogram.join(state, "_key").groupBy("_key").agg(
            F.sum(tokens * F.least(F.lit(most), tilt)).alias("_got"),
            F.sum(F.when(tilt < most, tokens * x * tilt).otherwise(0.0)).alias("_slope"),
        )
        off = F.col("_got") - F.col("target")
        low = F.when(off < 0, F.col("_lambda")).otherwise(F.col("_low"))
        high = F.when(off < 0, F.col("_high")).otherwise(F.col("_lambda"))
        step = F.col("_lambda") - off / F.col("_slope")
        done = F.col("_full") | (F.abs(off) <= F.lit(tolerance) * F.col("target"))
        moved = F.when(done, F.col("_lambda")).when((F.col("_slope") > 0) & (step > low) & (step < high), step).otherwise((low + high) / 2)
        state = state.join(now, "_key").select("_key", "target", "_scale", moved.alias("_lambda"), low.alias("_low"), high.alias("_high"), "_full", (~done).alias("_open"))
        state = materialize(state, "balance")
        if not state.where("_open").limit(1).count():
            break
        state = state.drop("_open")
    else:
        raise RuntimeError(f"entropy balancing: sources still off their target after {rounds} rounds")
    return state.select("_key", "_lambda", "_scale")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, identity: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, source, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``_hash``.

    Rates are tilted exponentially by size until each source's words meet its target, and rounded into copies: the whole
    part, and one more for the first documents in an order that makes one more about as likely as the rate's fraction.
    That order is fixed by a hash of the id, the text and the columns named in ``identity``, so reruns agree; it is cut
    where the words come nearest the target, so a source is off by at most half a document. Equal rows are counted as one
    unit and dealt out again, so they neither gather in one place nor move together. Empty and null texts have size 0
    and are taken once. Null sources are one source; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col, *identity).alias("_hash"))
    units = rows.groupBy("_id", "_source", "size", "_hash").agg(F.count("*").alias("_c")).withColumn("_key", source_key(F.col("_source")))
    units = materialize(units, "units")
    sources = units.groupBy("_key", F.col("_source").alias("source")).agg(F.sum(F.col("size") * F.col("_c")).alias("source_size"))
    goals = materialize(targets(sources, weights, most), "goals")
    histogram = materialize(units.where("size > 0").groupBy("_key", "size").agg(F.sum("_c").alias("n")), "histogram")
    rates = balance(histogram, goals.where("source_size > 0"), most)

    rate = F.when(F.col("size") > 0, F.least(F.lit(most), F.exp(F.col("_lambda") * F.col("size") / F.col("_scale")))).otherwise(1.0)
    units = units.join(goals.drop("source"), "_key").join(rates, "_key", "left").withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    part = F.col("rate") - F.floor("rate")
    # uniform from the hash, over the chance of one more: small values come first
    chance = (F.shiftrightunsigned(F.xxhash64("_hash", F.lit(1)), 11) + 0.5) / F.lit(float(1 << 53))
    units = units.withColumn("_turn", F.when((part > 0) & (F.col("size") > 0), chance / (chance + part)))
    units = units.withColumn("_step", F.floor(F.coalesce("_turn", F.lit(1.0)) * STEPS)).withColumn("_tokens", F.col("size") * F.col("_c"))

    steps = units.groupBy("_key", "_step").agg(F.sum(F.when(F.col("_turn").isNotNull(), F.col("_tokens")).otherwise(0)).alias("_in"), F.sum(F.col("_tokens") * F.floor("rate")).alias("_sure"))
    in_order = Window.partitionBy("_key").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("_key", "_step", F.coalesce(F.sum("_in").over(in_order), F.lit(0)).alias("_before"), F.sum("_sure").over(Window.partitionBy("_key")).alias("_surely"))
    # rows without a fraction take no part in the cut: each is a partition of its own, so that they never gather
    units = units.withColumn("_apart", F.when(F.col("_turn").isNull(), F.col("_hash")).otherwise(0))
    within = Window.partitionBy("_key", "_step", "_apart").orderBy("_turn", "_hash", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("_run", F.coalesce(F.sum("_tokens").over(within), F.lit(0))).join(steps, ["_key", "_step"])
    room = (F.col("target") - F.col("_surely") - F.col("_before") - F.col("_run")) / F.col("size")
    more = F.when(F.col("_turn").isNotNull(), F.greatest(F.lit(0), F.least(F.col("_c"), F.floor(room + 0.5)))).otherwise(0)
    each = units.withColumn("_more", more).withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))
    copies = F.floor("rate") + F.when(F.col("_j") <= F.col("_more"), 1).otherwise(0)
    return each.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target", "rate", copies.cast("int").alias("copies"), "_hash")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it has copies, with all their columns."""
    mixed = mix(docs, id_col, text_col, source_col, identity=tuple(docs.columns), **options)
    key, place, copies, turn = (unused(docs, f"_mix_{x}") for x in ("key", "hash", "copies", "turn"))
    # equal rows are one row here, which has the copies of all of them; structs of null ids are equal
    taken = mixed.groupBy(F.struct(F.col(id_col).alias("id")).alias(key), F.col("_hash").alias(place)).agg(F.sum("copies").cast("int").alias(copies))
    single = docs.select("*", F.struct(F.col(id_col).alias("id")).alias(key), F.xxhash64(id_col, text_col, *docs.columns).alias(place)).dropDuplicates([key, place])
    joined = single.join(taken, [key, place]).where(F.col(copies) > 0)
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
