"""Language-model scores: a weighted backoff automaton over n-grams of the whole training corpus."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.common import slices, whole
from tonegrid.session import materialize

#: Characters of a block; n-grams of a shard; tokens that one run of the traversal takes before the next text's or stretch's run.
BLOCK, SHARD, STRETCH = 6 << 20, 1_500_000, 512
#: States that every block has: the empty history, and the beginning of a text.
EMPTY, BEGUN = 0, 1
#: Odd multipliers that mix 64 bits, and the hashes of the text's end and beginning.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
END, BEGIN = np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)
#: What is kept of the hash of two tokens or more: 56 bits, so that every n-gram moves as one byte less.
LONGER = np.uint64(0xFFFFFFFFFFFFFF00)
#: Weights that a state's own arcs may have against its failure arc.
GRID = np.array([0, 0.001, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99])
#: Classes of states, by the logarithm of their count.
CLASSES = 48


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of integers, one plane per byte place, compressed."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def expand(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, np.uint64), dtype=np.uint64)


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = before * MIX[0] + word
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    return x ^ (x >> np.uint64(27))


def tokenise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, token numbers and the end of each text: words between ASCII blanks, A-Z lower-cased, and an end each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    used = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[numbers]
    cuts = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    cuts = np.concatenate([[0], np.cumsum(used)])[cuts]  # words up to the end of each text
    tokens = np.insert(numbers[used], cuts, len(words)).astype(np.int32)
    return np.append(hashes, END), tokens, cuts + np.arange(1, len(cuts) + 1)


def write_blocks(docs: DataFrame, id_col: str, text_col: str, learns_col: str) -> DataFrame:
    """The texts as blocks of tokens, written once: all later steps read the same blocks."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(learns_col), F.lit(False)).alias("_learns"), whole(F.col(text_col)).alias("_text"))
    kind = dict(rows.dtypes)["_id"]

    def packed(number: int, ids: pa.Array, learns: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        hashes, tokens, ends = tokenise(texts)
        one = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([len(tokens)]), pa.ListArray.from_arrays(one, ids), pa.array([learns.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()]), pa.array([squeeze(ends.astype(np.int64))]), pa.array([squeeze(tokens)]), pa.array([hashes.tobytes()])],
            ["block", "n", "ids", "learns", "ends", "tokens", "hashes"],
        )

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lengths = pc.utf8_length(batch.column(2)).to_pylist()
            for a, b in slices(lengths, BLOCK):
                if held and size + sum(lengths[a:b]) > BLOCK:
                    yield packed(number, *(pa.concat_arrays(x) for x in zip(*held, strict=True)))
                    number, held, size = number + 1, [], 0
                held.append([batch.column(i).slice(a, b - a) for i in range(3)])
                size += sum(lengths[a:b])
        if held:
            yield packed(number, *(pa.concat_arrays(x) for x in zip(*held, strict=True)))

    return materialize(rows.mapInArrow(run, f"block long, n long, ids array<{kind}>, learns binary, ends binary, tokens binary, hashes binary"), "lm_blocks")


class Block:
    """One block's tokens and the n-grams that end at each."""

    def __init__(self, row: dict, order: int):
        self.ids, self.learns = row["ids"], np.frombuffer(row["learns"], np.uint8).astype(bool)
        self.ends = expand(row["ends"], np.int64)
        words = np.frombuffer(row["hashes"], np.uint64)[expand(row["tokens"], np.int32)]
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.learnt = np.repeat(self.learns, self.ends - self.starts)
        place = np.arange(len(words)) - np.repeat(self.starts, self.ends - self.starts)
        #: Per order: the places that have such an n-gram, its different keys in order, and the place of each among them.
        self.grams = []
        history = None
        for k in range(1, order + 1):
            if k == 1:
                at, keys = np.arange(len(words)), words
            else:  # a text's first word follows its beginning, and nothing goes back further
                at = np.flatnonzero(place >= k - 2)
                before = np.where(place[at] > 0, history[at - 1], BEGIN) if k == 2 else history[at - 1]
                keys = chained(before, words[at])
            history = np.zeros(len(words), np.uint64)
            history[at] = keys
            self.grams.append((at, *np.unique(keys if k == 1 else keys & LONGER, return_inverse=True)))

    def counted(self, order: int) -> np.ndarray:
        """Occurrences in this block's training texts of each different n-gram."""
        at, keys, place = self.grams[order - 1]
        return np.bincount(place, self.learnt[at], len(keys)).astype(np.uint32)


def exchange(blocks: DataFrame, order: int, shards: int) -> DataFrame:
    """Corpus counts of every block's n-grams: ``block, order, shard, counts`` in the order of the block's keys.

    A block sends each shard of the hash space its different n-grams once, with their counts in its training texts; the
    shard adds up and answers. A frequent n-gram is so one entry per block, however often it occurs. The answers of block
    -1 hold each order's sum and number of different n-grams.
    """

    def ask(batches):
        edges = np.array([(i << 64) // shards for i in range(1, shards)], dtype=object).astype(np.uint64) if shards > 1 else np.zeros(0, np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order)
                for k in range(1, order + 1):
                    keys, counts = block.grams[k - 1][1], block.counted(k)
                    cuts = [0, *np.searchsorted(keys, edges), len(keys)]
                    parts = [(s, a, b) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["block"]] * len(parts), pa.int64()), pa.array([k] * len(parts), pa.int32()), pa.array([s for s, _, _ in parts], pa.int32()), pa.array([squeeze_sorted(keys[a:b]) for _, a, b in parts], pa.binary()), pa.array([squeeze(counts[a:b]) for _, a, b in parts], pa.binary())],
                        ["block", "order", "shard", "keys", "counts"],
                    )

    def answer(key, asked):
        keys = [expand_sorted(x) for x in asked.column("keys").to_pylist()]
        counts = [expand(x, np.uint32) for x in asked.column("counts").to_pylist()]
        different, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, np.concatenate(counts), len(different)).astype(np.int64)
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        answers = [squeeze(totals[p]) for p in np.split(place, cuts)]
        whole_shard = squeeze(np.array([totals.sum(), (totals > 0).sum()], np.int64))
        n = len(keys) + 1
        return pa.table({"block": pa.array([*asked.column("block").to_pylist(), -1], pa.int64()), "order": pa.array([key[0].as_py()] * n, pa.int32()), "shard": pa.array([key[1].as_py()] * n, pa.int32()), "counts": pa.array([*answers, whole_shard], pa.binary())})

    asked = blocks.mapInArrow(ask, "block long, order int, shard int, keys binary, counts binary")
    return materialize(asked.groupBy("order", "shard").applyInArrow(answer, "block long, order int, shard int, counts binary"), "lm_counts")


def class_of(counts: np.ndarray) -> np.ndarray:
    """A state's class: the binary logarithm of its count, whole part."""
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), CLASSES - 1)


class Automaton:
    """The states, arcs and failure arcs that one block's texts can visit.

    A state is a history of up to order - 1 tokens that occurs in training, with its count c; the beginning of a text is
    a token of histories. Its own arc for a token holds the smoothed chance weight * count / c of the next longer n-gram +
    (1 - weight) * chance of the shorter n-gram, and leads to the longest history that is a state; its failure arc leads to
    the history without its first token and holds 1 - weight. Every state has a chain of failure arcs down to the empty
    history, whose arcs hold the smoothed token frequencies and one for all unknown tokens, so the chances of a state's
    next tokens sum to one.
    """

    def __init__(self, block: Block, answers: list[dict], totals: dict):
        self.block, self.order, self.totals = block, len(block.grams), totals
        self.n = int(block.ends[-1]) if len(block.ends) else 0
        #: Per order: training count of each different n-gram of the block.
        self.known = [np.zeros(0, np.int64)]
        for k, (_, keys, _) in enumerate(block.grams, 1):
            parts = sorted((a["shard"], a["counts"]) for a in answers if a["order"] == k)
            self.known.append(np.concatenate([expand(c, np.int64) for _, c in parts]) if len(keys) else np.zeros(0, np.int64))

    def build(self, weights: np.ndarray) -> None:
        """Number the states of the block, and write their arcs and failure arcs with log10 chances.

        ``failure`` and ``back`` are the failure arc's end and weight per state; ``arc`` holds (state, token) of all other arcs
        in order, ``arc_chance`` and ``arc_end`` what they weigh and where they lead. Arcs of the empty history are one per
        token of the block: ``first_chance``, ``first_end``.
        """
        texts = self.totals["texts"]
        vocabulary = len(self.block.grams[0][1])
        #: Per place, its token, and per order the state of the history that ends there (-1: none).
        self.token = np.zeros(self.n, np.int64)
        self.token[self.block.grams[0][0]] = self.block.grams[0][2]
        begins = np.zeros(self.n, bool)
        begins[self.block.starts] = True
        failure, back, counts, ends_at = [np.array([EMPTY, EMPTY])], [], [np.array([0, texts])], []
        number = 2
        for k in range(1, self.order):
            at, keys, place = self.block.grams[k - 1]
            states = np.full(len(keys), -1)
            trained = self.known[k] > 0
            states[trained] = np.arange(number, number + trained.sum())
            number += int(trained.sum())
            there = np.full(self.n, -1)
            there[at] = states[place]
            shown = np.zeros(len(keys), np.int64)  # a place that ends each history
            shown[place] = at
            failure.append(ends_at[-1][shown[trained]] if k > 1 else np.full(trained.sum(), EMPTY))
            counts.append(self.known[k][trained])
            ends_at.append(there)
        self.failure, counts = np.concatenate(failure), np.concatenate(counts)
        lengths = np.concatenate([[0, 1], *[np.full(len(x), k) for k, x in enumerate(failure[1:], 1)]]).astype(np.int64)
        weight = np.where((lengths > 0) & (counts > 0), weights[np.minimum(lengths + 1, self.order), class_of(counts)], 0.0)
        self.back = np.log10(1 - weight)

        longest = lambda k, places: ends_at[min(k, self.order - 1) - 1][places] if self.order > 1 else np.full(len(places), EMPTY)
        chance = (self.known[1] + 1) / (self.totals["tokens"] + self.totals["different"] + 1)
        self.first_chance, self.first_end = np.log10(chance), np.full(vocabulary, EMPTY)
        if vocabulary:
            shown = np.zeros(vocabulary, np.int64)
            shown[self.token] = np.arange(self.n)
            self.first_end = np.maximum(longest(1, shown), EMPTY)
        arcs, chances, ends = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        of_place = chance[self.token]
        for k in range(2, self.order + 1):
            at, keys, place = self.block.grams[k - 1]
            shown = np.zeros(len(keys), np.int64)
            shown[place] = at
            trained = np.flatnonzero(self.known[k] > 0)
            places = shown[trained]
            source = np.where(begins[places], BEGUN, ends_at[k - 2][places - 1])
            own = weight[source]
            smoothed = own * self.known[k][trained] / counts[source] + (1 - own) * of_place[places]
            arcs.append((source << 32) | self.token[places])
            chances.append(smoothed)
            ends.append(np.maximum(longest(k, places), EMPTY))
            of_gram = np.zeros(len(keys))
            of_gram[trained] = smoothed
            of_place = np.zeros(self.n)
            of_place[at] = of_gram[place]
        arcs = np.concatenate(arcs)
        order = np.argsort(arcs)
        self.arc, self.arc_chance, self.arc_end = arcs[order], np.log10(np.concatenate(chances)[order]), np.concatenate(ends)[order]

    def walk(self) -> np.ndarray:
        """Log10 probability of every text: all texts of the block are traversed from left to right at once.

        Each carries its state: it takes the state's arc for the next token if there is one, else the failure arcs down to
        a state that has one. A long text runs as stretches side by side. The state depends on the last order - 1 tokens
        only, so a stretch first walks those before it, without counting them, and is then in the state it would be handed.
        """
        starts, ends = self.block.starts, self.block.ends
        pieces = -(-(ends - starts) // STRETCH)
        of = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = starts[of] + nth * STRETCH
        last = np.minimum(first + STRETCH, ends[of])
        start = np.maximum(first - (self.order - 1), starts[of])
        by_length = np.argsort(start - last, kind="stable")  # longest first: those still running are always the first ones
        of, first, last, at = of[by_length], first[by_length], last[by_length], start[by_length]
        state = np.where(at == starts[of], BEGUN, EMPTY)
        total = np.zeros(len(of))
        lengths = last - at
        for step in range(int(lengths.max(initial=0))):
            running = int(np.searchsorted(-lengths, -step, side="left"))
            here = at[:running] + step
            token, now = self.token[here], state[:running].copy()
            gained, reached = np.zeros(running), np.zeros(running, np.int64)
            open_ = np.arange(running)
            while len(open_):
                wanted = (now[open_] << 32) | token[open_]
                arc = np.minimum(np.searchsorted(self.arc, wanted), max(len(self.arc) - 1, 0))
                base = now[open_] == EMPTY
                found = ~base & (self.arc[arc] == wanted) if len(self.arc) else np.zeros(len(open_), bool)
                taken = open_[found]
                gained[taken] += self.arc_chance[arc[found]]
                reached[taken] = self.arc_end[arc[found]]
                taken = open_[base]
                gained[taken] += self.first_chance[token[taken]]
                reached[taken] = self.first_end[token[taken]]
                open_ = open_[~found & ~base]
                gained[open_] += self.back[now[open_]]
                now[open_] = self.failure[now[open_]]
            state[:running] = reached
            total[:running] += np.where(here >= first[:running], gained, 0.0)
        return np.bincount(of, total, len(starts))

    def left_out(self, weights: np.ndarray, upto: int) -> np.ndarray:
        """Per place the chance of its token by n-grams of at most ``upto`` tokens, each occurrence taken out of the counts it meets."""
        chance = self.counts[1] / max(self.totals["tokens"] + self.totals["different"], 1)
        for k in range(2, upto + 1):
            states, seen = self.states[k] - 1, self.counts[k] - 1
            here = states > 0  # elsewhere the state is shorter and has no arc of this order
            weight = weights[k, class_of(states)]
            chance = np.where(here, weight * np.maximum(seen, 0) / np.maximum(states, 1) + (1 - weight) * chance, chance)
        return chance

    def per_place(self) -> None:
        """Counts of the n-gram that ends at each place, and of the history before it, per order."""
        self.counts, self.states = (np.zeros((self.order + 1, self.n), np.int64) for _ in range(2))
        for k, (at, _, place) in enumerate(self.block.grams, 1):
            self.counts[k, at] = self.known[k][place]
        for k in range(2, self.order + 1):
            self.states[k, 1:] = self.counts[k - 1, :-1]
            self.states[k, self.block.starts] = self.totals["texts"] if k == 2 else 0

    def trials(self) -> list[tuple[int, int, np.ndarray]]:
        """(order, class, log-likelihood of the left-out training tokens per weight of the grid)."""
        self.per_place()
        out = []
        weights = np.zeros((self.order + 1, CLASSES))
        for k in range(2, self.order + 1):
            lower = self.left_out(weights, k - 1)
            use = self.block.learnt & (self.states[k] > 1)
            states, seen, lower = self.states[k][use] - 1, self.counts[k][use] - 1, lower[use]
            kinds = class_of(states)
            order = np.argsort(kinds, kind="stable")
            own, lower = (seen / states)[order], lower[order]
            found, starts = np.unique(kinds[order], return_index=True)
            for c, a, b in zip(found, starts, [*starts[1:], len(kinds)], strict=True):
                fit = np.array([np.log(w * own[a:b] + (1 - w) * lower[a:b]).sum() for w in GRID])
                out.append((k, int(c), fit))
                weights[k, c] = GRID[fit.argmax()]  # good enough to weigh the next order's trials
        return out

    def scores(self, weights: np.ndarray) -> dict:
        """Per text: tokens, known tokens, base score, score."""
        lengths = self.block.ends - self.block.starts
        self.build(weights)
        sums = lambda x: np.add.reduceat(x, self.block.starts) if len(x) else np.zeros(0)
        return {"n_tokens": lengths, "n_known": sums((self.known[1] > 0)[self.token].astype(np.int64)), "base_score": sums(self.first_chance[self.token]), "score": self.walk()}


def best_weights(fits: list[dict], order: int) -> np.ndarray:
    """Per order and class the likeliest weight; classes without training tokens are like the nearest smaller one, else larger."""
    weights = np.full((order + 1, CLASSES), np.nan)
    for row in fits:
        weights[row["order"], row["class"]] = GRID[int(np.argmax(row["fit"]))]
    return pd.DataFrame(weights).ffill(axis=1).bfill(axis=1).fillna(0.0).to_numpy()


def score(docs: DataFrame, learns_col: str, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of all whole texts under an automaton learnt from those with ``learns_col``.

    Columns: id, n_tokens, n_known, train_tokens, base_score (add-one token frequencies), score. Tokens are words between
    ASCII blanks with A-Z in lower case, and one end per text, so an empty or null text has one token. All n-grams of all
    training texts are counted; nothing is pruned. The weights of the arcs are chosen per order and class of states, as
    the likeliest for training tokens left out of the counts. Each block builds the automaton its texts can visit from the
    counts and walks it. Texts travel once as packed blocks; counts come back by
    ``exchange``. Repeated rows are scored one by one; a null in ``learns_col`` means no. Words are known by
    64-bit hashes, longer n-grams by 56 bits: among a billion different ones about one in 70 million meets another's count.
    The driver holds three totals.
    """
    spark = docs.sparkSession
    blocks = write_blocks(docs, id_col, text_col, learns_col)
    kind = dict(blocks.dtypes)["ids"][6:-1]
    tokens = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD))
    counts = exchange(blocks, order, shards)

    def texts(batches):
        for batch in batches:
            n = sum(sum(x) for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    def totals_of(batches):
        for batch in batches:
            values = [expand(x, np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(v[0]) for v in values], pa.int64()), pa.array([int(v[1]) for v in values], pa.int64())], ["tokens", "different"])

    learnt = blocks.select("learns").mapInArrow(texts, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    sums = counts.where("block = -1 and order = 1").select("counts").mapInArrow(totals_of, "tokens long, different long").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("different"), F.lit(0)).alias("different")).head()
    totals = {"texts": learnt, "tokens": sums["tokens"], "different": sums["different"]}

    answers = counts.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("order", "shard", "counts")).alias("answers"))
    met = blocks.drop("n").join(answers, "block")

    def automata(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield row, Automaton(Block(row, order), row["answers"], totals)

    def trial(batches):
        for _, automaton in automata(batches):
            found = automaton.trials()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in found], pa.int32()), pa.array([c for _, c, _ in found], pa.int32()), pa.array([f.tolist() for _, _, f in found], pa.list_(pa.float64()))], ["order", "class", "fit"])

    def run(batches):
        for row, automaton in automata(batches):
            out = automaton.scores(best_weights(row["fits"], order))
            yield pa.RecordBatch.from_arrays([pa.array(automaton.block.ids), *(pa.array(out[c]) for c in ("n_tokens", "n_known", "base_score", "score"))], ["_id", "n_tokens", "n_known", "base_score", "score"])

    fits = met.mapInArrow(trial, "order int, class int, fit array<double>").groupBy("order", "class").agg(F.array(*[F.sum(F.col("fit")[i]) for i in range(len(GRID))]).alias("fit"))
    # one row of at most orders x classes trials, joined in one plan, so that the blocks are dealt to their answers once
    fits = fits.agg(F.collect_list(F.struct("order", "class", "fit")).alias("fits")).withColumn("_all", F.lit(1))
    met = met.withColumn("_all", F.lit(1)).join(F.broadcast(fits), "_all").drop("_all")
    scored = met.mapInArrow(run, f"_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("_id").alias(id_col), "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
