"""Audio file sources: directory scan and PCM WAV decoding."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonegrid.constants import AUDIO_EXTENSIONS, SAMPLE_RATE
from tonegrid.schemas import BINARY_FILE
from tonegrid.session import plain

CHUNK_SAMPLES = 65536


def _name(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(F.replace(path, F.lit("+"), F.lit("%2B")), r"([^/]+)$", 1))


def with_identity(files: DataFrame) -> DataFrame:
    """Adds name and song_id (the file stem) and keeps audio files only."""
    name = _name(F.col("path"))
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return (files.withColumn("name", name).withColumn("song_id", F.regexp_replace(name, r"\.[^.]+$", ""))
            .where(ext.isin(AUDIO_EXTENSIONS)))


def scan_audio(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Audio files of a folder (not below it) by name: path, name, song_id[, content]."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    cols = ["path", "name", "song_id", "modificationTime", "length", *(["content"] if content else [])]
    return with_identity(files).select(*cols).orderBy("name")


def stream_audio(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same folder as a stream; every file arrives once."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return with_identity(reader.load(path))


def _mono(data: bytes, sr: int) -> np.ndarray:
    """Mean of all channels of a PCM WAV in -1..1; anything else raises."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate, n = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.getnframes()
        raw = w.readframes(n)
    if rate != sr:
        raise ValueError(f"sample rate {rate}, expected {sr}")
    if len(raw) < n * width * channels:
        raise ValueError("file ends early")
    if width == 1:
        v = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000).astype(np.float64)
        v = (v - 0x800000) / 0x800000
    else:
        v = np.frombuffer(raw, {2: np.int16, 4: np.int32}[width]).astype(np.float64) / 2.0 ** (8 * width - 1)
    return v.reshape(-1, channels).mean(axis=1)


def decode_wav(files: DataFrame, stem: Column | None = None, sr: int = SAMPLE_RATE, chunk: int = CHUNK_SAMPLES) -> tuple[DataFrame, DataFrame]:
    """(samples, errors): chunked mono arrays per song and stem; an unreadable file becomes an error row.

    ``files``: song_id, path, content.
    """
    named = files.select("song_id", (stem if stem is not None else F.lit("mix")).alias("stem"), "path", "content")
    schema = T.StructType([T.StructField("song_id", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("chunk", T.LongType()),
                           T.StructField("pcm", T.ArrayType(T.FloatType())), T.StructField("path", T.StringType()), T.StructField("error", T.StringType())])

    def decode(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                try:
                    v = _mono(r.content, sr).astype(np.float32)
                except Exception as e:  # a bad file is data, not a job failure
                    yield plain(pd.DataFrame({"song_id": [r.song_id], "stem": [r.stem], "chunk": [None], "pcm": [None], "path": [r.path], "error": [str(e)]}))
                    continue
                for i in range(0, len(v), chunk):
                    yield plain(pd.DataFrame({"song_id": [r.song_id], "stem": [r.stem], "chunk": [i // chunk], "pcm": [v[i:i + chunk]],
                                              "path": [r.path], "error": [None]}))

    decoded = named.mapInPandas(decode, schema)
    return (decoded.where(F.col("error").isNull()).select("song_id", "stem", "chunk", "pcm"),
            decoded.where(F.col("error").isNotNull()).select("path", "error"))


def explode_samples(samples: DataFrame, chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """Chunked arrays as rows: song_id, stem, pos, x."""
    return samples.select("song_id", "stem", "chunk", F.posexplode("pcm").alias("_i", "_x")).select(
        "song_id", "stem", (F.col("chunk") * chunk + F.col("_i")).alias("pos"), F.col("_x").cast("double").alias("x"))
