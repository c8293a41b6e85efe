import math

import numpy as np
import pandas as pd

from tonegrid import constants as K
from tonegrid.operators import timeline as L


def test_place_phrases_rules(spark):
    """64 bars with breakdowns, 20 phrases: no overlap, free intro, outro and breakdowns."""
    rng = np.random.default_rng(0)
    labels = ["breakdown" if 24 <= b < 28 else ["drop", "groove", "build"][(b // 8) % 3] for b in range(64)]
    bars = spark.createDataFrame([("m", b, lab) for b, lab in enumerate(labels)], "pair string, bar long, label string")
    ph = [("m", i, i * 6.0, float(rng.choice([1.0, 3.5, 9.0])), float(rng.random())) for i in range(20)]
    phrases = spark.createDataFrame(ph, "pair string, phrase_idx long, start_time double, duration double, energy double")
    got = L.place_phrases(phrases, bars, "pair", 2.0).toPandas()
    assert len(got)
    taken, duration = set(), {p[1]: p[3] for p in ph}
    for r in got.itertuples():
        size = max(1, math.ceil(duration[r.phrase_idx] / 2.0))
        need = range(r.bar, r.bar + size + max(1, min(3, size // 2)))
        assert not taken & set(need)
        taken |= set(need)
        assert all(8 <= b < 64 - 8 and labels[b] != "breakdown" for b in need)
    first = got[got.phrase_idx == got.phrase_idx.min()].bar.iloc[0]
    assert first % 8 == 0


def test_short_mix_takes_the_loudest(spark):
    bars = spark.createDataFrame([("m", b, "drop") for b in range(6)], "pair string, bar long, label string")
    phrases = spark.createDataFrame([("m", 0, 0.0, 1.0, 0.2), ("m", 1, 4.0, 1.0, 0.9)],
                                    "pair string, phrase_idx long, start_time double, duration double, energy double")
    assert [tuple(r) for r in L.place_phrases(phrases, bars, "pair", 2.0).collect()] == [("m", 1, 0, "hook")]


def test_place_sections_prefers_matching_types(spark):
    sec = "pair string, section_idx long, start_time double, end_time double, classification string"
    vox = spark.createDataFrame([("m", 0, 0.0, 20.0, "intro"), ("m", 1, 20.0, 40.0, "verse"), ("m", 2, 40.0, 60.0, "chorus"), ("m", 3, 60.0, 62.0, "chorus")], sec)
    beat = spark.createDataFrame([("m", 0, 30.0, 60.0, "drop"), ("m", 1, 60.0, 90.0, "instrumental"), ("m", 2, 90.0, 119.0, "buildup")], sec)
    mixes = spark.createDataFrame([("m", 2.0, 0.0, 120.0, 10**9, 1.0)],
                                  "pair string, bar_s double, region_start double, total_s double, vocal_samples long, stretch double")
    got = {(r.vox_type, r.beat_type, r.dest_start) for r in L.place_sections(vox, beat, mixes, "pair", sr=10).collect()}
    assert got == {("verse", "instrumental", 600), ("chorus", "drop", 300)}


def plain_phrases(phrases, labels, bar_s):
    """Bar by bar and phrase by phrase, as a listener would."""
    n = len(labels)
    energy = sorted(p[3] for p in phrases)
    cut = lambda q: float(np.quantile(energy, q))
    kind = lambda e: "hook" if e >= cut(0.75) else "groove" if e >= cut(0.5) else "atmosphere"
    first, last = min(max(8, n // 8), 16), n - min(max(8, n // 10), 12)
    free = [first <= i < last and labels[i] != "breakdown" for i in range(n)]
    out = []
    for idx, _, duration, e in sorted(phrases, key=lambda p: (p[1], p[0])):
        size = max(1, math.ceil(duration / bar_s))
        need = size + max(1, min(3, size // 2))
        fits = [i for i in range(n) if i + need <= n and all(free[i:i + need])]
        grid = [i for i in fits if i % 8 == 0]
        wanted = [*K.PHRASE_PREFERENCES[kind(e)], *K.PHRASE_FALLBACK]
        if fits:
            bar = min(grid, key=lambda i: (wanted.index(labels[i]) if labels[i] in wanted else 99, i)) if grid else fits[0]
            free[bar:bar + need] = [False] * need
            out.append((idx, bar, kind(e)))
    return out


def test_phrases_like_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    phrases, bars, want = [], [], []
    for mix, n in enumerate((12, 40, 64, 200, 333)):
        labels = rng.choice(["drop", "groove", "build", "breakdown"], size=n, p=[0.3, 0.3, 0.3, 0.1]).tolist()
        ph = [(i, float(rng.integers(0, 300)), float(rng.choice([0.5, 2.0, 5.0, 11.0])), float(rng.random())) for i in range(n // 4)]
        bars += [(mix, i, x) for i, x in enumerate(labels)]
        phrases += [(mix, *p) for p in ph]
        want += [(mix, *r) for r in plain_phrases(ph, labels, 2.0)]
    got = L.place_phrases(spark.createDataFrame(phrases, "pair long, phrase_idx long, start_time double, duration double, energy double"),
                          spark.createDataFrame(bars, "pair long, bar long, label string"), "pair", 2.0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_sections_like_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    kinds = [*K.ALL_SECTION_TYPES, "intro", "outro", "unknown", "solo"]
    vox, beat, mixes, want = [], [], [], []
    for mix in range(12):
        count = int(rng.integers(1, 30))
        make = lambda: [(mix, i, i * 10.0, i * 10.0 + float(rng.choice([3.0, 6.0, 10.0])), str(rng.choice(kinds))) for i in range(count)]
        v, b = make(), make()
        vox, beat = vox + v, beat + b
        total = count * 10.0
        mixes.append((mix, 2.0, 4.0, total, 10**6, 1.1))
        margin = min(16.0, total * 0.15)
        slots = []
        for _, i, s, e, k in b:
            s, e = s - 4.0, e - 4.0
            if k not in K.NO_BEAT_SECTIONS and e > 0 and s < total and e > margin and s < total - margin:
                s, e = max(s, margin), min(e, total - margin)
                snap = max(0, round(s / 2.0)) * 2.0
                if e - s >= 4 and snap < total - margin:
                    slots.append((k, int(snap * 10)))
        for _, i, s, e, k in v:
            if k in K.NO_VOCAL_SECTIONS or e - s < 4 or not slots:
                continue
            liked = [*K.SECTION_PREFERENCES.get(k, K.DEFAULT_PREFERENCE), *K.ALL_SECTION_TYPES]
            j = min(range(len(slots)), key=lambda j: (liked.index(slots[j][0]) if slots[j][0] in liked else 99, j))
            if slots[j][1] < int(total * 10):
                kind, dest = slots.pop(j)
                want.append((mix, int(s * 1.1 * 10), min(int(e * 1.1 * 10), 10**6), dest, k, kind))
    sec = "pair long, section_idx long, start_time double, end_time double, classification string"
    got = L.place_sections(spark.createDataFrame(vox, sec), spark.createDataFrame(beat, sec),
                           spark.createDataFrame(mixes, "pair long, bar_s double, region_start double, total_s double, vocal_samples long, stretch double"), "pair", sr=10)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_mixes_share_python_calls(spark):
    bars = spark.createDataFrame([(m, b, "drop") for m in range(3) for b in range(40 if m else 5)], "pair long, bar long, label string")
    phrases = spark.createDataFrame([(m, i, i * 4.0, 2.0, 0.1 * i) for m in range(4) for i in range(5)], "pair long, phrase_idx long, start_time double, duration double, energy double")
    got = L.place_phrases(phrases, bars, "pair", 2.0)
    assert "CoGroup" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(tuple(r)[:3] for r in got.collect())
    # a mix of five bars and one without any take the loudest phrase
    assert [r for r in rows if r[0] in (0, 3)] == [(0, 4, 0), (3, 4, 0)] and [r for r in rows if r[0] == 1] == [(1, 0, 8), (1, 1, 16), (1, 2, 24), (1, 3, 10), (1, 4, 12)]
