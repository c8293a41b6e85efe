"""Files on disk: WAV decoding, folder scan and stream, JSON tables."""

import json
import wave

import numpy as np
from pyspark.sql import functions as F

from tonegrid.functions.arrays import detect_key
from tonegrid.operators import spectral as Z
from tonegrid.sources import audio, tables
from tonegrid.streaming import jobs as J


def write_wav(path, x, sr=22050, width=2, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(sr)
        scaled = np.round(np.repeat(x, channels) * (2 ** (8 * width - 1) - 1)).astype("<i4")
        w.writeframes(scaled.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())


def sine(hz, seconds=1.0, sr=22050):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * sr)) / sr)


def test_scan_decode_and_features(spark, tmp_path):
    x = sine(440)
    write_wav(tmp_path / "b.WAV", x)
    write_wav(tmp_path / "a.wav", x, width=3, channels=2)
    (tmp_path / "broken.wav").write_bytes((tmp_path / "b.WAV").read_bytes()[:2000])
    (tmp_path / "notes.txt").write_text("no audio")
    files = audio.scan_audio(spark, str(tmp_path), content=True)
    assert [r.song_id for r in files.select("song_id").collect()] == ["a", "b", "broken"]
    samples, errors = audio.decode_wav(files, sr=22050, chunk=4096)
    assert errors.count() == 1
    for song in "ab":
        got = audio.explode_samples(samples.where(F.col("song_id") == song), 4096).orderBy("pos").toPandas().x.to_numpy()
        assert len(got) == len(x) and np.abs(got - x).max() <= 1 / 32767
    frames = Z.frame_samples(samples.where("song_id = 'b'"), ["song_id", "stem"], 4096, 2048, 512)
    feats = Z.mfcc_chroma(Z.spectrum(frames), 13, 22050).orderBy("frame").toPandas()
    assert len(feats) == 1 + (len(x) - 2048) // 512
    assert all(abs(np.argmax(m) * 22050 / 2048 - 440) <= 22050 / 2048 for m in feats.mag)
    assert all(np.argmax(c) == 9 for c in feats.chroma)  # A


def test_key_of_an_ideal_profile(spark):
    from tonegrid.constants import MINOR_PROFILE

    d = spark.createDataFrame([(np.roll(MINOR_PROFILE, 9).tolist(),), ([1.0] * 12,)], "c array<double>")
    assert [r.k.key for r in d.select(detect_key(F.col("c")).alias("k")).collect()] == ["A minor", "C major"]


def test_json_tables(spark, tmp_path):
    (tmp_path / "analysis" / "one").mkdir(parents=True)
    (tmp_path / "analysis" / "two").mkdir(parents=True)
    (tmp_path / "analysis" / "one" / "analysis.json").write_text(json.dumps({"song_id": "one", "tempo": 120.0, "vocals": {"voice_type": "alto"}}, indent=2))
    (tmp_path / "analysis" / "two" / "analysis.json").write_text("{ broken")
    rows = {r.song_id: r for r in tables.read_songs(spark, str(tmp_path / "analysis")).collect()}
    assert rows["one"].tempo == 120.0 and rows["two"]._corrupt_record is not None
    (tmp_path / "ratings.json").write_text(json.dumps([{"mix_id": "m", "rating": 4}], indent=2))
    (tmp_path / "params.json").write_text(json.dumps({"m": {"song_a": "x", "key_shift": 2}, "n": {"song_a": "y"}}, indent=2))
    assert [r.rating for r in tables.read_ratings(spark, str(tmp_path / "ratings.json")).collect()] == [4]
    assert {r.mix_id: r.key_shift for r in tables.read_mix_params(spark, str(tmp_path / "params.json")).collect()} == {"m": 2, "n": None}
    for read in (tables.read_ratings, tables.read_mix_params, tables.read_embeddings):
        assert read(spark, str(tmp_path / "absent")).count() == 0


def test_new_files_are_handled_once(spark, tmp_path):
    folder, done = tmp_path / "in", str(tmp_path / "done")
    folder.mkdir()
    spark.createDataFrame([("old", 0)], "song_id string, n int").write.parquet(done)
    work = lambda d: d.select("song_id", F.lit(1).alias("n"))

    def drain():
        J.stream_new(audio.stream_audio(spark, str(folder)), done, "song_id", work, str(tmp_path / "cp"), once=True).awaitTermination()
        return sorted(r.song_id for r in spark.read.parquet(done).collect())

    for n in ("old", "a"):
        write_wav(folder / f"{n}.wav", sine(220, 0.1))
    (folder / "x.txt").write_text("no")
    assert drain() == ["a", "old"]
    write_wav(folder / "b.wav", sine(220, 0.1))
    assert drain() == ["a", "b", "old"]
