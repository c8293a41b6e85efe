"""Toxicity, language-model scores, mixing, search, near duplicates and licences against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonegrid.llm import license_scan, max_score, mixing, near_join, ngram_scores, toxicity

DOCS = "doc_id long, text string, lang string, source string, _id long, _text string, _key string, size string, learns boolean"


def frame(spark, rows):
    """(doc_id, text, source) with further columns of clashing names."""
    return spark.createDataFrame([(i, t, None, s, 7, "clash", "clash", "clash", None) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (None, "no id at all", "b"), (5, "twice the same words here now", "b"), (5, "twice the same words here now", "b"), (6, "lang " * 40_000, None)]


def test_term_features_are_whole():
    of_text, feature, count = toxicity.text_features(pa.array(["Abcdef abcdef, x", "", "x X ÄB"]))
    got = defaultdict(dict)
    for t, f, c in zip(of_text, feature, count, strict=True):
        got[t][f] = c
    assert sorted(got[0].values()) == [1, 2, 2, 2, 2] and sorted(got[2].values()) == [1, 2] and 1 not in got


def test_machine_learns_pairs(spark):
    """Toxic where two words meet; either word alone is clean, so linear weights cannot tell."""
    rng = random.Random(2)
    filler = [f"w{i:c}{j:c}" for i in range(97, 110) for j in range(97, 110)]
    rows, labels = [], []
    for i in range(1600):
        kind = i % 4
        words = [rng.choice(filler) for _ in range(20)] + ["nasty"] * (kind in (1, 3)) + ["them"] * (kind in (2, 3))
        rng.shuffle(words)
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(kind == 3)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, marks.where("doc_id < 1200"))
    scored = docs.where("doc_id >= 1200").select("doc_id", toxicity.score(docs["text"], machine).alias("s")).collect()
    right = sum((r["s"] >= 0.5) == (r["doc_id"] % 4 == 3) for r in scored)
    assert right >= 0.97 * len(scored)


def test_toxicity_of_odd_rows(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    marks = spark.createDataFrame([(1, 0), (2, None), (None, 1), (5, 1), (5, 0)], "doc_id long, toxic int")
    for labels in (none, marks):
        machine = toxicity.train(docs, labels)
        scores = [r[0] for r in docs.select(toxicity.score(docs["text"], machine)).collect()]
        assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert docs.limit(0).select(toxicity.score(docs["text"], toxicity.train(docs.limit(0), none))).count() == 0


def words_of(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w] + ["</s>"]


def learnt(rows):
    count, grams = Counter(), Counter()
    for text in rows:
        words = words_of(text)
        count.update(words)
        grams.update(zip(["<s>", *words], words, strict=False))
    return count, grams


def test_ngram_scores(spark):
    rng = random.Random(4)
    vocabulary = ["Aa", "b", "c", "d", "ÄÖ", "e"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12))), None) for i in range(120)] + ODD
    docs = frame(spark, rows).withColumn("learns", F.col("doc_id") % 3 != 0)
    count, _ = learnt([t for i, t, _ in rows if i is not None and i % 3 != 0])
    total, different = sum(count.values()), len(count)
    got = ngram_scores.score(docs, "learns").collect()
    want = Counter()
    for i, t, _ in rows:
        words = words_of(t)
        base = sum(math.log10((count[w] + 1) / (total + different + 1)) for w in words)
        want[i, len(words), sum(count[w] > 0 for w in words), total, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert ngram_scores.score(docs.limit(0), "learns").count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_automaton_is_a_distribution(order):
    """Over all next tokens the arcs of any state, failure arcs included, sum to one."""
    train = ["a b a", "b a", "", "a a b c"]
    for history in ([], ["a"], ["a", "b"], ["zz", "a"], ["zz"], ["b", "zz"]):
        chance = 0.0
        for nxt in ("a", "b", "c", None, "unknown"):
            words = [*history, *([nxt] if nxt else [])]
            texts = [*train, " ".join(words)]
            hashes, tokens, ends = ngram_scores.tokenise(pa.array(texts))
            row = {"ids": None, "learns": bytes([1] * 4 + [0]), "ends": ngram_scores.squeeze(ends.astype(np.int64)), "tokens": ngram_scores.squeeze(tokens), "hashes": hashes.tobytes()}
            block = ngram_scores.Block(row, order)
            answers = [{"order": k, "shard": 0, "counts": ngram_scores.squeeze(block.counted(k).astype(np.int64))} for k in range(1, order + 1)]
            single = block.counted(1)
            machine = ngram_scores.Automaton(block, answers, {"texts": 4, "tokens": int(single.sum()), "different": int((single > 0).sum())})
            weights = np.tile(np.linspace(0.2, 0.7, ngram_scores.CLASSES), (order + 1, 1))
            machine.build(weights)
            state = ngram_scores.BEGUN
            for place in range(block.starts[-1], block.starts[-1] + len(history) + 1):
                state, gained = step(machine, state, int(machine.token[place]))
            chance += 10**gained
        assert chance == pytest.approx(1)


def step(machine, state, token):
    """One token from one state, read off the arcs one by one."""
    arcs = {int(a): (int(e), float(c)) for a, e, c in zip(machine.arc, machine.arc_end, machine.arc_chance, strict=True)}
    gained = 0.0
    while state != ngram_scores.EMPTY:
        if (state << 32) | token in arcs:
            end, chance = arcs[(state << 32) | token]
            return end, gained + chance
        gained += float(machine.back[state])
        state = int(machine.failure[state])
    return int(machine.first_end[token]), gained + float(machine.first_chance[token])


def plain_scores(texts, learns, order):
    """Log10 probabilities by interpolated n-grams counted in dictionaries, weights as the likeliest per class of histories."""
    runs = [["<", *words_of(t)] for t in texts]
    counts, grid = Counter(), [float(w) for w in ngram_scores.GRID]
    for run, learn in zip(runs, learns, strict=True):
        for i in range(1, len(run) if learn else 0):
            counts[run[i],] += 1
            for k in range(2, min(order, i + 1) + 1):
                counts[tuple(run[i - k + 1 : i + 1])] += 1
    total, different = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    # a history's count is that of its occurrences, also where a text ends after it
    seen = lambda history: sum(map(bool, learns)) if history == ("<",) else counts[history]
    kind = lambda n: int(math.log2(n))
    weights: dict = {}

    def chance(run, i, upto, less):
        p = (counts[run[i],] - less + 1) / (total - less + different + 1)
        for k in range(2, min(upto, i + 1) + 1):
            gram = tuple(run[i - k + 1 : i + 1])
            n = seen(gram[:-1]) - less
            if n > 0:
                w = weights.get((k, kind(n)), 0.0)
                p = w * max(counts[gram] - less, 0) / n + (1 - w) * p
        return p

    for k in range(2, order + 1):
        met = defaultdict(list)
        for run, learn in zip(runs, learns, strict=True):
            for i in range(k - 1, len(run) if learn else 0):
                gram = tuple(run[i - k + 1 : i + 1])
                if seen(gram[:-1]) > 1:
                    n = seen(gram[:-1]) - 1
                    met[kind(n)].append(((counts[gram] - 1) / n, chance(run, i, k - 1, 1)))
        for c, values in met.items():
            own, lower = np.array(values).T
            weights[k, c] = grid[int(np.argmax([np.log(w * own + (1 - w) * lower).sum() for w in grid]))]
    for k in range(2, order + 1):  # classes that training never meets are like the nearest smaller one, else larger
        known = sorted(c for q, c in weights if q == k)
        for c in range(ngram_scores.CLASSES if known else 0):
            weights[k, c] = weights[k, max([x for x in known if x <= c], default=known[0])]
    return [sum(math.log10(chance(run, i, order, 0)) for i in range(1, len(run))) for run in runs]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_plain_counts(spark, order):
    """Also over a text of many stretches, repeated texts, texts without words, and held-out texts with unknown words."""
    rng = random.Random(order)
    texts = [" ".join(rng.choice("a b c d e ff".split()) for _ in range(rng.randrange(12))) for _ in range(90)]
    texts += [" ".join(rng.choice("a b c d e ff gg".split()) for _ in range(2500)), "", "a b a b a b", "a b a b a b", "zz a b yy zz", "lang " * 1500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("learns", F.col("doc_id") % 3 != 1).coalesce(1)
    want = plain_scores(texts, [i % 3 != 1 for i in range(len(texts))], order)
    got = {r["doc_id"]: r["score"] for r in ngram_scores.score(docs, "learns", order).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want)


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (ngram_scores.expand_sorted(ngram_scores.squeeze_sorted(keys)) == keys).all()
    assert len(ngram_scores.expand(ngram_scores.squeeze(np.zeros(0, np.int64)), np.int64)) == 0


def goals(sizes, weights=(1, 2, 3), most=3.0):
    """Reshare the excess until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped: dict = {}
    while True:
        rest = sum(sizes.values()) - sum(stopped.values())
        free = [s for s in order if s not in stopped]
        shares = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if shares[s] > most * sizes[s]}
        if not over:
            return stopped | shares
        stopped |= over


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([1, 2, 5, 30, 100, 400]), rng.choice(["hot"] * 8 + ["b", "é", "z", None, "tiny"])) for i in range(3000)]
    rows += [(9000, "same " * 17, "hot")] * 500 + [(9001, "q", "speck"), *ODD]
    docs = frame(spark, rows).repartition(7)
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = goals(sizes), Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
    assert len(got) == len(rows)
    longest = defaultdict(int)
    for r in got:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in sizes)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    # tilted by size within a source that takes less than it has
    kept = {r["size"]: r["rate"] for r in got if r["source"] == "hot" and r["size"]}
    assert kept[1] > kept[400] or kept[1] == kept[400] == 3
    mixed = Counter(r["doc_id"] for r in mixing.take(docs).collect())
    assert mixed[9000] == sum(r["copies"] for r in got if r["doc_id"] == 9000) and mixing.take(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_stop_and_share(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, None: 3, "d": 0}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = goals(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == want


def test_top_k(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 6)]) for i in range(700)] + [(700, [0] * 6), (701, None), (None, [1] * 6), (750, [5, 5]), (751, [1, 1]), (752, [2**40, 2**20]), (800, [])]
    frame_of = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, vector array<bigint>, _id string").repartition(5)
    old = max_score.QUERY_BLOCK, max_score.SHARD, max_score.SEED
    max_score.QUERY_BLOCK, max_score.SHARD, max_score.SEED = 4, 90, 10
    try:
        got = max_score.top_k(frame_of.where("vec_id % 50 = 0"), frame_of, 5).collect()
    finally:
        max_score.QUERY_BLOCK, max_score.SHARD, max_score.SEED = old
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    for q, v in rows:
        if q is not None and q % 50 == 0 and v is not None:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i is not None and i != q and w is not None and len(w) == len(v)]
            assert found[q] == [(i, -s) for s, i in sorted(scores)[:5]]
    assert max_score.top_k(frame_of.limit(0), frame_of.limit(0), 5).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_near_join(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 16)  # so that the large group spans many blocks
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(1000 + i, " ".join(word() for _ in range(40)), "a") for i in range(60)]
    base = [word() for _ in range(120)]
    for i in range(90):  # near copies of one text, all different
        words = list(base)
        words[rng.randrange(120)] = word()
        rows.append((i, " ".join(words), "a"))
    rows += [(2000 + i, rows[0][1].upper(), "a") for i in range(30)] + [(3000, "three short words", "a"), (3001, "Three short words", "a"), *ODD]
    got = near_join.join(frame(spark, rows).repartition(3)).collect()
    sets = [shingles(t) for _, t, _ in rows]
    links = Counter()
    owner = list(range(len(rows)))

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                owner[find(a)] = find(b)
    groups = defaultdict(list)
    for a, (i, _, _) in enumerate(rows):
        groups[find(a)].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want = Counter((i, least(groups[find(a)]), links[a]) for a, (i, _, _) in enumerate(rows))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    assert near_join.join(frame(spark, [])).count() == 0


def test_banding_reaches_the_recall():
    bands, rows = near_join.banding(0.8, 0.995)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.995


def test_components_of_a_long_path(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"x", b"y")]
    got = {bytes(r["_key"]): bytes(r["_root"]) for r in near_join.components(spark.createDataFrame(edges, "_a binary, _b binary")).collect()}
    assert got == {bytes([i]): b"\x00" for i in range(41)} | {b"x": b"x", b"y": b"x"}


def dice_rows(docs):
    import re

    pairs = lambda t: (lambda w: {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})(re.sub(r"[^a-z0-9]+", " ", t.lower()).split())
    found = {}
    for i, text in docs:
        units = [("line", k, x) for k, x in enumerate((text or "").split("\n"), 1)]
        units += [("paragraph", k, x) for k, x in enumerate(re.split(r"\n[ \t\r]*\n", text or ""), 1) if "\n" in x]
        for unit, k, x in units:
            for name, template in license_scan.TEMPLATES:
                a, b = pairs(x), pairs(template)
                if a and 2 * len(a & b) / (len(a) + len(b)) >= 0.8:
                    key = (i, unit, k, name)
                    found[key] = max(found.get(key, 0), 2 * len(a & b) / (len(a) + len(b)))
    return Counter((*k, round(v, 9)) for k, v in found.items())


def test_license_scan(spark):
    rng = random.Random(12)
    rows = list(ODD)
    for i, (_, template) in enumerate(license_scan.TEMPLATES):
        words = template.split(" ")
        rows.append((100 + i, f"before\n{template}\nafter " + "prose " * 300, "a"))
        some = [w for w in words if rng.random() > 0.06] + ["extra"] * rng.randrange(2)
        rows.append((200 + i, f"intro words\n\n{' '.join(some[: len(some) // 2])}\n{' '.join(some[len(some) // 2 :]).upper()}\n\nend", "a"))
    got = license_scan.scan(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["unit"], r["place"], r["licence"], round(r["dice"], 9)) for r in got) == dice_rows([(i, t) for i, t, _ in rows])
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_licences_inside_longer_texts(spark):
    """Comment headers, sentences that share a line, wrapped notices."""
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and t.startswith("Permission"))
    words = mit.split(" ")
    wrapped = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    header = "/*\n * Copyright 2020 Some Body\n *\n" + "".join(f" * {x}\n" for x in wrapped) + " *\n */\n" + "".join(f"int helper{i}(void) {{ return value{i} + argument{i}; }}\n" for i in range(12))
    rows = [(1, header, None), (2, "See the manual for details. Released under the MIT License. Contact us for more.", None), (3, "some words go here first and Licensed under\nthe Apache License, Version\n2.0. and " + "more words " * 40, None),
            (4, "Released under the MIT License.", None), (5, "Released under the trees, a license to walk. " * 5, None), *ODD]
    plain = license_scan.scan(frame(spark, rows)).collect()
    got = license_scan.scan(frame(spark, rows), windows=True).collect()
    assert {(r["doc_id"], r["unit"]) for r in plain} == {(4, "line")}
    found = sorted((r["doc_id"], r["unit"], r["place"], r["licence"], round(r["dice"], 6)) for r in got)
    assert found == [(1, "window", 5, "MIT", 1.0), (2, "window", 6, "MIT", 1.0), (3, "window", 7, "Apache-2.0", 1.0), (4, "line", 1, "MIT", 1.0)]
    assert license_scan.scan(frame(spark, []), windows=True).count() == 0
    # all texts are searched for needles once, before the two kinds of units part
    searched = [license_scan.scan(frame(spark, rows), windows=w)._jdf.queryExecution().optimizedPlan().toString().count(" OR Contains(") > 0 for w in (False, True)]
    assert searched == [True, False]
