import math

from pyspark.sql import functions as F

from tonegrid.constants import NOTE_NAMES
from tonegrid.functions.arrays import detect_key
from tonegrid.operators.analysis import analyse_songs, nest_songs

FRAMES = "song_id string, frame long, rms double, mfcc array<double>, chroma array<double>, centroid double, vocals double, drums double, key_chroma array<double>"
BEATS = "song_id string, beat_idx long, t double, strength double"


def frame(song, i, rms, key=None, vocals=0.0, drums=0.0):
    return song, i, rms, [rms, rms * rms], [1.0 - rms, rms], 1000.0, vocals, drums, key


def test_song_records(spark):
    # two minutes in two halves: quiet and sung, then loud with drums; C major throughout
    major = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
    rows = [frame("full", i, 0.2 + 0.01 * math.sin(i), major, 0.5, 0.0) for i in range(240)]
    rows += [frame("full", i, 0.8 + 0.01 * math.sin(i), major, 0.0, 0.6) for i in range(240, 480)]
    rows += [frame("bare", i, 0.3) for i in range(40)] + [frame("blip", i, 0.0) for i in range(3)]
    beats = [("full", i, i * 0.5, 1.0 if i % 4 == 0 else 0.2) for i in range(240)]
    parts = analyse_songs(spark.createDataFrame(rows, FRAMES), spark.createDataFrame(beats, BEATS), ["song_id"])
    got = {r.song_id: r for r in nest_songs(parts, ["song_id"]).collect()}
    full, bare, blip = got["full"], got["bare"], got["blip"]
    assert (full.duration, full.tempo, full.n_beats, full.key, full.has_strong_drums) == (120.0, 120.0, 240, "C major", True)
    assert len(full.sections) == 2 and abs(full.sections[1].start_time - 60) <= 4
    assert full.sections[1].start_time % 2 == 0  # on a downbeat
    assert [s.has_vocals for s in full.sections] == [True, False] and [s.drum_dominant for s in full.sections] == [False, True]
    assert full.sections[1].energy == 1 and full.sections[0].energy < 0.3
    assert full.n_phrases == len(full.phrases) == 1 and full.has_strong_vocals
    assert (bare.duration, bare.tempo, bare.n_beats, bare.key, bare.n_phrases, bare.phrases) == (10.0, 120.0, 0, None, 0, [])
    assert bare.sections == []  # shorter than the least span
    assert (blip.duration, blip.sections, blip.overall_energy, blip.has_strong_drums) == (0.75, [], 0.0, False)
    assert parts.curve.where("song_id = 'full'").agg(F.max("energy")).first()[0] == 1


def test_no_songs(spark):
    parts = analyse_songs(spark.createDataFrame([], FRAMES), spark.createDataFrame([], BEATS), ["song_id"])
    assert nest_songs(parts, ["song_id"]).count() == 0


def test_keys_six_semitones_apart_tie(spark):
    # equal halves fit a root and the one six above it alike; these lay on either side of a twelfth decimal
    halves = [[0.68351, 0.8284000000000001, 1.26307, 0.8497600000000002, 1.26307, 0.8284000000000001], [0.9656133333333333, 1.1757199999999999, 1.38312, 1.5130933333333332, 1.38312, 1.1757199999999999],
              [1.0519433333333332, 1.2011466666666666, 0.6966766666666667, 0.7522933333333333, 0.6966766666666667, 1.2011466666666666], [1.23962, 1.4231333333333334, 0.9639933333333334, 0.68908, 0.9639933333333334, 1.4231333333333334]]
    d = spark.createDataFrame([(h + h,) for h in halves], "c array<double>")
    roots = [r.key.split()[0] for r in d.select(detect_key(F.col("c"))["key"].alias("key")).collect()]
    assert set(roots) <= set(NOTE_NAMES[:6])
