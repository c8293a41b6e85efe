"""Values on a limit: the query and its SQL say the same, whatever the order of summation."""

import os
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare  # noqa: E402
from tonegrid import plans  # noqa: E402


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = plans.queries()[name](spark, str(folder))
    rows, cur = [tuple(r) for r in df.collect()], con.execute(plans.oracle_sql()[name])
    assert rows and compare(rows, df.columns, cur.fetchall(), [c[0] for c in cur.description]) is None
    return {r[0]: r[1:] for r in rows}


def events(values, kinds="view", user=1, step=1):
    from datetime import datetime, timedelta

    n, kinds = len(values), [kinds] * len(values) if isinstance(kinds, str) else kinds
    return {"event_id": list(range(n)), "user_id": [user] * n, "ts": [datetime(2024, 1, 1) + timedelta(seconds=step * i) for i in range(n)], "event_type": kinds, "value": [float(v) for v in values]}


def test_pitch_ignores_unvoiced_frames(spark, tmp_path):
    got = same(spark, tmp_path, "b03_voice_type_pitch", events=events([0, 0, 60, 70]))
    assert got[1] == (130.0, "baritone")


def test_stream_reads_a_folder_of_parts(spark, tmp_path):
    for table, ids in (("documents", [[1, 2], [3, 4, 5]]), ("labels", [[2], [4]])):
        (tmp_path / f"{table}.parquet").mkdir()
        for i, part in enumerate(ids):
            pq.write_table(pa.table({"doc_id": part}), tmp_path / f"{table}.parquet" / f"part-{i}.parquet")
    assert sorted(r[0] for r in plans.queries()["k01_new_entries"](spark, str(tmp_path)).collect()) == [1, 3, 5]


def lines(rows):
    """lineitem: song, line, quantity per position."""
    n = len(rows)
    return {"l_suppkey": [r[0] for r in rows], "l_orderkey": list(range(n)), "l_linenumber": [1 + i % 4 for i in range(n)], "l_partkey": [1] * n, "l_extendedprice": [1.0] * n,
            "l_quantity": [float(r[1]) for r in rows], "l_discount": [r[2] if len(r) > 2 else 0.05 for r in rows], "l_tax": [0.02] * n, "l_returnflag": ["A"] * n, "l_linestatus": ["O"] * n}


def test_phase_on_a_step(spark, tmp_path):
    # half of its stems: .6 just below the step, .5 from it on; the last song is silent
    rows = [(song, 1 + (song * 31 + i * i * 17 + i * 7) % 50) for song in range(1, 400, 4) for i in range(92)]
    rows += [(1001, 25.5)] * 8
    got = same(spark, tmp_path, "d16_phase_coherence_stems", lineitem=lines(rows))
    assert {v[0] for s, v in got.items() if s < 1001} == {0.5} and got[1001] == (0.5,)


def test_tempo_spread_at_its_limit(spark, tmp_path):
    # intervals of 4 and 1 steps in equal number and any order: mean 2.5, deviation 1.5, their ratio just .6
    import random

    songs, kinds = [], []
    for song in range(60):
        gaps = [1, 4] * (20 + song)
        random.Random(song).shuffle(gaps)
        for gap in [1, *gaps]:
            songs += [song] * gap
            kinds += ["view"] * (gap - 1) + ["click"]
    e = events([50] * len(songs), kinds)
    e["user_id"] = songs
    got = same(spark, tmp_path, "d22_tempo_stable", events=e)
    assert {v[0] for v in got.values()} == {False}


def test_vibrato_at_four_beats_a_second(spark, tmp_path):
    # a peak every fifth frame of 50 ms, each song with its own start and length
    values, kinds, songs = [], [], []
    for song in range(40):
        n, quiet = 60 + 5 * song, 3 * song + 1
        values += [50.0] * quiet + [50.0 + 400 * (i % 5 == 2) for i in range(n)]
        kinds += ["noise"] * quiet + ["view"] * n
        songs += [song] * (quiet + n)
    e = events(values, kinds)
    e["user_id"] = songs
    got = same(spark, tmp_path, "d35_vibrato", events=e)
    assert {v[0] for v in got.values()} == {True}


def tied_bars(n=60):
    """Nine bars a song, three each of one mean, whose four frames come in any order."""
    import random

    values, songs = [], []
    for song in range(n):
        for bar in range(9):
            four = [0.1 + 3 * (bar % 3), 0.2, 0.3, 0.7 + bar % 3]
            random.Random(song * 100 + bar).shuffle(four)
            values, songs = values + four, songs + [song] * 4
    return events(values) | {"user_id": songs}


def test_label_counts_of_equal_bars(spark, tmp_path):
    same(spark, tmp_path, "d36_label_counts", events=tied_bars())
    got = {(r.song_id, r.label): r.n for r in plans.queries()["d36_label_counts"](spark, str(tmp_path)).collect()}
    assert set(got.values()) == {3}


def test_sweeps_before_equal_bars(spark, tmp_path):
    same(spark, tmp_path, "h07_sweep_schedule", events=tied_bars())
    got = plans.queries()["h07_sweep_schedule"](spark, str(tmp_path))
    assert {r[0] for r in got.select("drop_bar").distinct().collect()} == {2, 5, 8}


def test_drops_of_equal_bars(spark, tmp_path):
    same(spark, tmp_path, "e18_drop_starts", events=tied_bars())
    assert plans.queries()["e18_drop_starts"](spark, str(tmp_path)).count() == 60 * 3


def test_recommendation_on_its_threshold(spark, tmp_path):
    # a mean discount of .05 makes a score of just .5
    import random

    from tonegrid import constants as K

    below = next(b for d, b, *_ in K.RECOMMENDATIONS if d == "beat_coherence")
    rows = []
    for song in range(60):
        part = [round(below / 10 + s * d / 100, 2) for d in (0, 1, 2, 3) for s in (1, -1)] * (3 + song)
        random.Random(song).shuffle(part)
        rows += [(song, 10, v) for v in part]
    same(spark, tmp_path, "b18_recommend", lineitem=lines(rows))
    got = plans.queries()["b18_recommend"](spark, str(tmp_path))
    assert got.where("dimension = 'beat_coherence'").count() == 0


def bars_on_the_limit(n=60):
    """Nine bars a song, every second one of the same four frames in any order: the upper quartile lies among the equal ones."""
    import random

    values, songs = [], []
    for song in range(n):
        for bar in range(9):
            four = [3.1, 0.2, 0.3, 0.7] if bar % 2 else [0.01 * bar, 0.02, 0.03, 0.04]
            random.Random(song * 100 + bar).shuffle(four)
            values, songs = values + four, songs + [song] * 4
    return events(values) | {"user_id": songs}


def test_sweeps_before_bars_on_the_limit(spark, tmp_path):
    same(spark, tmp_path, "h07_sweep_schedule", events=bars_on_the_limit())
    got = plans.queries()["h07_sweep_schedule"](spark, str(tmp_path)).select("song_id", "drop_bar").distinct()
    assert sorted(map(tuple, got.collect())) == [(song, bar) for song in range(60) for bar in (1, 3, 5, 7)]


def test_drops_of_bars_on_the_limit(spark, tmp_path):
    same(spark, tmp_path, "e18_drop_starts", events=bars_on_the_limit())
    assert plans.queries()["e18_drop_starts"](spark, str(tmp_path)).count() == 60 * 4
