"""Exact top-k search by inner product over integer vectors: MaxScore per shard, then a merge."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query block and of a shard of candidates.
QUERY_BLOCK, SHARD = 2048, 8192
#: Candidates of a shard that are scored in full to get a first threshold; terms probed together.
SEED, PROBE = 256, 4


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def quantise(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("bigint"))


def packed(rows: DataFrame, size: int, side: str) -> DataFrame:
    """Rows of ``_id, _v`` as blocks: width, number of the block, ids and the values by column as bytes."""
    count = rows.count()
    dealt = rows.repartition(max(1, math.ceil(count / size)))

    def run(batches):
        held: dict[int, list] = {}

        def block(width):
            ids, values = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
            return pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), f"{side}_ids": [ids.tobytes()], f"{side}_values": [np.ascontiguousarray(values.reshape(len(ids), width).T).tobytes()]})

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            widths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(widths)
            for width in np.unique(widths):
                rows_of = np.flatnonzero(widths == width)
                for at in range(0, len(rows_of), size):
                    some = rows_of[at : at + size]
                    if int(width) in held and sum(len(i) for i, _ in held[int(width)]) + len(some) > size:
                        yield block(int(width))
                    places = (ends[some] - width)[:, None] + np.arange(width)
                    held.setdefault(int(width), []).append((ids[some], flat[places].ravel()))
        for width in list(held):
            yield block(width)

    return dealt.mapInArrow(run, f"width int, {side}_ids binary, {side}_values binary")


class Best:
    """The k best (score, id) of one query so far, ties to smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    @property
    def floor(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -math.inf


def search_shard(query: np.ndarray, own: int, columns: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """MaxScore of one query on one shard.

    A term is a component, its postings the shard's column, its bounds the least and the most it can add. The terms with
    the smallest spreads whose joint upper bound leaves every candidate below the k-th score are non-essential.
    Postings of the others are traversed; a candidate is probed in the non-essential terms, widest first, only while its
    partial score and the remaining bounds reach the k-th score. Nothing is lost: a dropped candidate is below it.
    """
    best = Best(k)

    def add(rows, scores):
        keep = ids[rows] != own
        best.add(scores[keep], ids[rows][keep])

    exact = columns.dtype.type
    q = query.astype(exact)
    head = np.arange(min(SEED, len(ids)))
    add(head, (q @ columns[:, head]).astype(np.int64))
    rest = np.arange(len(head), len(ids))
    if not len(rest):
        return best
    upper, lower = np.maximum(q * low, q * high), np.minimum(q * low, q * high)
    order = np.argsort(upper - lower, kind="stable")
    # of all candidates, if the smallest-spread terms alone were at their best
    reach = lower.sum() + np.cumsum((upper - lower)[order])
    split = int(np.searchsorted(reach, best.floor, side="left"))
    essential, others = order[split:][::-1], order[:split][::-1]
    partial = np.zeros(len(rest), exact)
    for term in essential:
        if q[term]:
            partial += q[term] * columns[term, rest[0] :]
    bound = upper[others].sum()
    for at in range(0, len(others), PROBE):
        alive = partial + bound >= best.floor
        rest, partial = rest[alive], partial[alive]
        terms = others[at : at + PROBE]
        if len(rest):
            partial = partial + q[terms] @ columns[np.ix_(terms, rest)]
        bound -= upper[terms].sum()
    alive = partial >= best.floor
    add(rest[alive], partial[alive].astype(np.int64))
    return best


def top_k(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """Every query's k candidates of the highest inner product: query_id, rank (from 1), the id column, score.

    Vectors are arrays of bigint; only vectors of one width meet. Rows with a null id or vector take no part. Ties go to
    the smaller id. Candidates with the query's own id are its own; repeated queries of one id share one list and repeated
    candidates one place. A query without candidates has no row. Both sides travel as packed blocks: each shard of
    candidates meets each block of queries once, and hands on k rows per query. Products must fit in a bigint.
    """
    sides = [df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).alias("_v")).where(F.col("_id").isNotNull() & F.col("_v").isNotNull()) for df in (queries, candidates)]
    blocks, shards = packed(sides[0], QUERY_BLOCK, "q"), packed(sides[1], SHARD, "c")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                q_ids, ids = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "c_ids"))
                queries_of = np.frombuffer(row["q_values"], np.int64).reshape(width, len(q_ids)).T
                columns = np.frombuffer(row["c_values"], np.int64).reshape(width, len(ids))
                largest = float(np.abs(queries_of).max(initial=0)) * float(np.abs(columns).max(initial=0)) * max(width, 1)
                if largest < 2**52:  # doubles are exact, and fast
                    columns = columns.astype(np.float64)
                low, high = columns.min(1), columns.max(1)
                out = [(int(i), search_shard(v, int(i), columns, ids, low, high, k)) for i, v in zip(q_ids, queries_of, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat([i for i, _ in out], [len(b.ids) for _, b in out]), pa.int64()),
                    "_id": pa.array(np.concatenate([b.ids for _, b in out]), pa.int64()),
                    "score": pa.array(np.concatenate([b.scores for _, b in out]), pa.int64()),
                })

    found = blocks.join(shards, "width").select("width", "q_ids", "q_values", "c_ids", "c_values").mapInArrow(run, "query_id bigint, _id bigint, score bigint")
    best = found.groupBy("query_id", "_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score")
