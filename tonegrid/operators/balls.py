"""Packed vector blocks under balls, and the search over pairs of them.

Vectors of one width that lie near each other are packed into blocks; up to ``FAN`` neighbouring blocks are a node.
Both have a ball (unit centre, angle, largest norm), from which follows the highest score any pair of two balls can
have. A search joins nodes of queries with nodes of the base by id, best first, in rounds: what a round finds raises the
score that the following ones have to reach. Inside such a pair every two blocks are one matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrid.session import fresh, materialize

#: Vectors of a block at most, its bytes, blocks of a node.
BLOCK_ROWS, BLOCK_BYTES, FAN = 4096, 1 << 20, 8
#: Directions whose signs order the vectors.
SIGNS = 16
#: Nodes of a round after the first, as a multiple of the round before.
GROWTH = 16
#: Query nodes that meet one copy of the base nodes' balls.
COPY = 1024
# an angle bound is loosened by this much so rounding can never hide a match
SLACK = 1e-6
#: Products that are held at once, pairs that are scored at once, pairs that give a query its first floor.
CELLS, SCORED, SEEDS = 1 << 19, 1 << 16, 64

STATE = "node long, block long, idx array<int>, rep array<long>, match array<long>, score array<double>, floors array<double>, floor double"


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(vectors), width)


def _joined(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def ball(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Unit centre, the widest angle to it and the largest norm; rows without a direction have no angle, as all their products are zero."""
    size = np.linalg.norm(x, axis=1)
    unit = x[size > 0] / size[size > 0][:, None]
    centre = np.zeros(x.shape[1])
    if len(unit):
        centre = unit.mean(axis=0)
        centre = unit[0] if np.linalg.norm(centre) < 1e-9 else centre / np.linalg.norm(centre)
    elif len(centre):
        centre[0] = 1.0
    angle = np.arccos(np.clip(unit @ centre, -1.0, 1.0)).max() if len(unit) else 0.0
    return centre, float(angle), float(np.nan_to_num(size).max(initial=0.0))


def highest(angle, radii, sizes, bound: Callable):
    """Highest score between two balls whose centres are so far apart."""
    gap = np.clip(angle - radii - SLACK, 0.0, np.pi / 2)
    return bound(sizes * np.cos(gap) + SLACK)


def pack(rows: DataFrame, payload: Sequence[str], name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ``rows`` (vec and the payload columns), written as a table: the upper and lower balls, ``vecs`` and the payload as arrays.

    Rows are ordered by the signs of fixed directions, ranges of that order are tasks, and a task cuts its rows as they
    come; it holds one node at a time.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def code(batches):
        for batch in batches:
            vecs = batch.column("vec")
            widths = np.diff(vecs.offsets.to_numpy())
            keys = np.zeros(len(vecs), np.int64)
            for w in np.unique(widths):
                at = np.flatnonzero(widths == w)
                directions = np.random.default_rng(int(w)).normal(size=(w, SIGNS))
                keys[at] = (_matrix(vecs.take(pa.array(at)), int(w)) @ directions > 0) @ (1 << np.arange(SIGNS)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(widths.astype(np.int32)), pa.array(keys)], [*batch.schema.names, "w", "_key"])

    columns = ["vec", *payload]
    spread = rows.select(*columns, F.xxhash64(*payload).alias("_h"))
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in columns], "_h long, w int, _key long"])
    coded = materialize(spread.mapInArrow(code, schema), f"{name}-coded")

    def cut(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def node(table: pa.Table, w: int):
            nonlocal made
            x, rows_per = _matrix(_joined(table.column("vec")), w), max(1, min(block_rows, BLOCK_BYTES // (8 * max(w, 1))))
            centre, radius, size = ball(x)
            out: dict[str, list] = {c: [] for c in ("block", "n", "centre", "radius", "size", "vecs")}
            starts = range(0, len(x), rows_per)
            for j, start in enumerate(starts):
                part = x[start : start + rows_per]
                c, r, s = ball(part)
                for k, v in zip(out, (((base + made) * FAN) + j, len(part), c, r, s, part.ravel()), strict=True):
                    out[k].append(v)
            offsets = pa.array([*starts, len(x)], pa.int32())
            k = len(starts)
            doubles = pa.list_(pa.float64())
            arrays = [pa.array([base + made] * k, pa.int64()), pa.array([w] * k, pa.int32()), pa.array([centre] * k, doubles), pa.array([radius] * k), pa.array([size] * k),
                      pa.array(out["block"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["centre"], doubles), pa.array(out["radius"]), pa.array(out["size"]), pa.array(out["vecs"], doubles),
                      *[pa.ListArray.from_arrays(offsets, _joined(table.column(c))) for c in payload]]
            made += 1
            return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in fields])

        def nodes(w: int, rest: bool):
            nonlocal held
            full = FAN * max(1, min(block_rows, BLOCK_BYTES // (8 * max(w, 1))))
            table = pa.Table.from_batches(held)
            start = 0
            while len(table) - start >= full or (rest and start < len(table)):
                yield node(table.slice(start, full), w)
                start += full
            held = table.slice(start).to_batches() if start < len(table) else []

        width = None
        for batch in batches:
            w = batch.column("w").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1, [len(w)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and w[a] != width:
                    yield from nodes(width, True)
                width = int(w[a])
                held.append(batch.slice(a, b - a))
                if sum(map(len, held)) * 8 * max(width, 1) >= FAN * BLOCK_BYTES or sum(map(len, held)) >= FAN * block_rows:
                    yield from nodes(width, False)
        if held:
            yield from nodes(width, True)

    fields = ["node long", "w int", "node_centre array<double>", "node_radius double", "node_size double", "block long", "n int", "centre array<double>", "radius double", "size double",
              "vecs array<double>", *[f"{c} array<{kinds[c]}>" for c in payload]]
    dealt = coded.repartitionByRange("w", "_key", "_h").sortWithinPartitions("w", "_key", "_h")
    return materialize(dealt.mapInArrow(cut, ", ".join(fields)), f"{name}-blocks")


def node_pairs(asking: DataFrame, base: DataFrame, bound: Callable) -> DataFrame:
    """Every query node with every base node of its width, its highest score, and its rank for the query node.

    A row stands for a product of ``FAN`` by ``FAN`` blocks. Base balls are copied once per ``COPY`` query nodes.
    """

    @F.arrow_udf(T.DoubleType())
    def reach(a: pa.Array, b: pa.Array, radii: pa.Array, sizes: pa.Array) -> pa.Array:
        out, widths = np.empty(len(a)), np.diff(a.offsets.to_numpy())
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            x, y = (_matrix(v.take(pa.array(at)), int(w)) for v in (a, b))
            angle = np.arccos(np.clip((x * y).sum(axis=1), -1.0, 1.0)) if w else np.zeros(len(at))
            out[at] = highest(angle, radii.to_numpy()[at], sizes.to_numpy()[at], bound)
        return pa.array(out)

    top = lambda d, s: d.where(F.col("block") % FAN == 0).select("w", *[F.col(c).alias(f"{s}{c}") for c in ("node", "node_centre", "node_radius", "node_size")])
    q = top(asking, "q_")
    copies = max(1, -(-q.count() // COPY))
    q = q.withColumn("_s", F.pmod(F.xxhash64("q_node"), F.lit(copies)).cast("int"))
    b = top(base, "b_").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    best = reach("q_node_centre", "b_node_centre", F.col("q_node_radius") + F.col("b_node_radius"), F.col("q_node_size") * F.col("b_node_size"))
    order = Window.partitionBy("q_node").orderBy(F.desc("ub"), "b_node")
    return q.join(b, ["w", "_s"]).select("q_node", "b_node", best.alias("ub")).withColumn("rank", F.row_number().over(order))


def _trim(idx, rep, match, score, want):
    """Of every query the ``want`` best by score, then by lower match."""
    order = np.lexsort((match, -score, idx))
    idx = idx[order]
    first = np.concatenate([[True], idx[1:] != idx[:-1]]) if len(idx) else np.zeros(0, bool)
    rank = np.arange(len(idx)) - np.maximum.accumulate(np.where(first, np.arange(len(idx)), 0))
    kept = rank < want
    order = order[kept]
    return idx[kept], rep[order], match[order], score[order]


def _floors(idx, score, n, want):
    counts = np.bincount(idx, minlength=n)
    low = np.full(n, np.inf)
    np.minimum.at(low, idx, score)
    return np.where(counts >= want, low, -np.inf)


def _below(edge: np.ndarray, bound: Callable, reach: float) -> np.ndarray:
    """Products at most ``reach`` in size whose highest score is just too low for each edge."""
    low, high = np.full(len(edge), -reach), np.full(len(edge), reach)
    for _ in range(40):
        mid = (low + high) / 2
        enough = bound(mid) >= edge
        low, high = np.where(enough, low, mid), np.where(enough, mid, high)
    return np.where(bound(np.full(len(edge), -reach)) >= edge, -np.inf, low)


def _hits(qx: pd.DataFrame, by: pd.DataFrame, x: np.ndarray, y: np.ndarray, floors: np.ndarray, want: int, score: Callable, bound: Callable):
    """Pairs of two blocks that may be among the best: row, col, score, for a few rows at a time.

    Only pairs whose product alone lets them reach the floor are scored. A row without a floor gets one from its pairs
    of highest product.
    """
    def scored(row, col, dots, least):
        cuts = [slice(c, c + SCORED) for c in range(0, len(row), SCORED)]
        return np.concatenate([np.zeros(0), *[score(qx, by, row[c], col[c], dots[c], least[c]) for c in cuts]])

    step = max(1, CELLS // max(1, len(y)))
    longest = lambda v: np.nan_to_num(np.linalg.norm(v, axis=1)).max(initial=0.0)
    reach = longest(x) * longest(y) * (1 + 1e-9) + 1e-9
    for top in range(0, len(x) if len(y) else 0, step):
        dots = x[top:top + step] @ y.T
        edge = floors[top:top + step].copy()
        if len(bare := np.flatnonzero(edge == -np.inf)):
            few, keep = min(max(SEEDS, want), len(y)), min(want, len(y))
            col = np.argpartition(-dots[bare], few - 1, axis=1)[:, :few].ravel()
            row = np.repeat(bare, few)
            seeds = np.nan_to_num(scored(row + top, col, dots[row, col], np.full(len(row), -np.inf)), nan=-np.inf).reshape(-1, few)
            edge[bare] = -np.partition(-seeds, keep - 1, axis=1)[:, keep - 1]
        edge = np.maximum(edge - 1e-9, np.finfo(float).min)
        row, col = np.divmod(np.flatnonzero(dots >= _below(edge - 1e-9, bound, reach)[:, None]), len(y))
        value = scored(row + top, col, dots[row, col], edge[row])
        good = value >= edge[row]
        yield row[good] + top, col[good], value[good]


def _named(ids: pa.Array, reps: np.ndarray, row, col, value, want):
    """Hits as query index, query, match and score, the ``want`` best of every query; a base row stands for a few equal ones."""
    sizes = np.diff(ids.offsets.to_numpy())[col]
    starts = ids.offsets.to_numpy()[:-1][col] - ids.offsets[0].as_py()
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    idx = np.repeat(row, sizes).astype(np.int32)
    return _trim(idx, reps[idx], ids.flatten().to_numpy()[at], np.repeat(np.round(value, 9), sizes), want)


def _state(node, block, found, floors) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64())
    lists = [pa.array([x], pa.list_(k)) for x, k in zip(found, kinds, strict=True)]
    return pa.table([pa.array([node], pa.int64()), pa.array([block], pa.int64()), *lists, pa.array([floors], pa.list_(pa.float64())), pa.array([float(floors.min(initial=np.inf))])],
                    [f.strip().split()[0] for f in STATE.split(",")])


def _list(table: pa.Table, column: str, i: int) -> pa.Array:
    return _joined(table.column(column))[i].values


def search(asking: DataFrame, base: DataFrame, want: int, extra: Sequence[str], score: Callable, bound: Callable, lowest: Callable | None = None, trace: list | None = None) -> DataFrame:
    """Best ``want`` matches of every query vector: ``rep``, ``match``, ``score`` (equal scores by lower match).

    ``asking`` has the payload ``rep``, ``base`` the payload ``ids`` (equal vectors' ids, lowest first), both the ``extra``
    columns. ``score(q, b, row, col, dots, least)`` scores pairs of rows of two frames of
    these; a pair that cannot reach its ``least`` may get any lower score. ``lowest(found)``, if given, is a score that no other pair has to be below to be of use. The driver holds
    the number of nodes and that score. ``trace`` gathers the node pairs of every round.
    """

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        frames = lambda t, i: pd.DataFrame({c: _list(t, c, i).to_pandas() for c in extra}, index=range(t.column("n")[i].as_py()))
        w = right.column("w")[0].as_py() if len(right) else 0
        there = [(np.array(_list(right, "centre", j)), right.column("radius")[j].as_py(), right.column("size")[j].as_py()) for j in range(len(right))]
        for i in range(len(left) if len(right) else 0):
            n = left.column("n")[i].as_py()
            x, qx, reps = _list(left, "vecs", i).to_numpy().reshape(n, w), frames(left, i), _list(left, "rep", i).to_numpy()
            known = left.column("floors")[i].as_py()
            before = np.full(n, -np.inf) if known is None else np.array(known)
            centre, radius, size = np.array(_list(left, "centre", i)), left.column("radius")[i].as_py(), left.column("size")[i].as_py()
            angles = [np.arccos(np.clip(centre @ c, -1.0, 1.0)) if w else 0.0 for c, _, _ in there]
            ub = np.array([highest(a, radius + r, size * s, bound) for a, (_, r, s) in zip(angles, there, strict=True)])
            found = tuple(np.zeros(0, k) for k in (np.int32, np.int64, np.int64, np.float64))
            floors = before
            for j in np.argsort(-ub, kind="stable"):
                if ub[j] < floors.min() - 1e-9:
                    break
                y, by, ids = _list(right, "vecs", j).to_numpy().reshape(-1, w), frames(right, j), _list(right, "ids", j)
                new = [_named(ids, reps, *hit, want) for hit in _hits(qx, by, x, y, floors, want, score, bound)]
                found = _trim(*(np.concatenate(p) for p in zip(found, *new, strict=True)), want)
                floors = np.maximum(before, _floors(found[0], found[3], n, want))
            if len(found[0]):
                out.append(_state(left.column("node")[i].as_py(), left.column("block")[i].as_py(), found, floors))
        return pa.concat_tables(out) if out else _state(0, 0, tuple(np.zeros(0) for _ in range(4)), np.zeros(0)).slice(0, 0)

    def merge(rows: pa.Table) -> pa.Table:
        parts = [[_list(rows, c, i).to_numpy() for i in range(len(rows))] for c in ("idx", "rep", "match", "score")]
        found = _trim(*map(np.concatenate, parts), want)
        floors = _floors(found[0], found[3], len(_list(rows, "floors", 0)), want)
        return _state(rows.column("node")[0].as_py(), rows.column("block")[0].as_py(), found, floors)

    pairs = materialize(node_pairs(asking, base, bound), "node-pairs")
    last = pairs.agg(F.max("rank").alias("r")).head()["r"] or 0
    state, low, lo, hi = asking.sparkSession.createDataFrame([], STATE), float("-inf"), 1, 1
    while lo <= last:
        ends = state.groupBy(F.col("node").alias("q_node")).agg(F.min("floor").alias("floor"), F.count(F.lit(1)).alias("k"))
        blocks = asking.groupBy(F.col("node").alias("q_node")).agg(F.count(F.lit(1)).alias("all"))
        # a node's floor holds once all its blocks have one
        active = pairs.where(F.col("rank").between(lo, hi) & (F.col("ub") >= low - 1e-9))
        if lo > 1:
            known = blocks.join(ends, "q_node").where(F.col("k") == F.col("all")).select("q_node", "floor")
            active = active.join(known, "q_node", "left").where(F.col("floor").isNull() | (F.col("ub") >= F.col("floor") - 1e-9))
        active = materialize(active.select("q_node", "b_node"), "round") if lo > 1 else active.select("q_node", "b_node")
        if trace is not None:
            trace.append(active)
        left = active.join(asking.withColumnRenamed("node", "q_node").join(state.select("block", "floors"), "block", "left"), "q_node")
        right = active.join(base.withColumnRenamed("node", "b_node"), "b_node")
        on = ["q_node", "b_node"]
        need = ["w", "n", "centre", "radius", "size", "vecs", *extra]
        left = left.select(*on, F.col("q_node").alias("node"), "block", "rep", "floors", *need)
        right = right.select(*on, "ids", *need)
        hits = fresh(left).groupBy(*on).cogroup(fresh(right).groupBy(*on)).applyInArrow(tile, STATE)
        state = materialize(state.unionByName(hits).groupBy("block").applyInArrow(merge, STATE), "found")
        lo, hi = hi + 1, hi + GROWTH * (hi - lo + 1)
        if lowest and lo <= last:
            low = max(low, lowest(_exploded(state)))
    return _exploded(state)


def _exploded(state: DataFrame) -> DataFrame:
    return state.select(F.explode(F.arrays_zip("rep", "match", "score")).alias("h")).select("h.*")
