"""Catalogue tables: listings, deletion, incremental work lists, serialisation."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_songs(songs: DataFrame) -> DataFrame:
    """song_id, duration, key, tempo, voice_type with defaults; an unreadable record shows '?'. Ordered by id."""
    broken = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in songs.columns else F.lit(False)
    show = lambda c, default: F.when(broken, F.lit(default)).otherwise(F.coalesce(c, F.lit(default))) 
    voice = F.when(broken, "?").otherwise(F.coalesce("vocals.voice_type", F.lit("none")))
    return songs.select("song_id", show(F.col("duration"), 0.0).alias("duration"), show(F.col("key"), "?").alias("key"),
                        show(F.col("tempo"), 0.0).alias("tempo"), voice.alias("voice_type")).orderBy("song_id")


def list_mixes(mixes: DataFrame) -> DataFrame:
    """Mixes by directory name, last name first; a missing score counts as 0."""
    return mixes.select("mix_id", F.col("song_a_id").alias("song_a"), F.col("song_b_id").alias("song_b"),
                        F.coalesce("quality_scores.overall", F.lit(0.0)).alias("overall"), "created_at", "directory").orderBy(F.desc("directory"))


def delete_songs(tables: dict[str, DataFrame], ids: DataFrame, key: str = "song_id") -> dict[str, DataFrame]:
    """Tables without the given songs; tables that keep history (mixes, ratings) pass through."""
    keep = {"mixes", "ratings"}
    return {n: d if n in keep else d.join(ids.select(key).distinct(), key, "left_anti") for n, d in tables.items()}


def pending(files: DataFrame, done: DataFrame, key: str = "song_id") -> DataFrame:
    """Entries without a finished counterpart."""
    return files.join(done.select(key), key, "left_anti")


def ensure_embeddings(songs: DataFrame, emb: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Known embeddings plus computed ones for songs that have none."""
    missing = songs.join(emb.select("song_id"), "song_id", "left_anti")
    known = emb.join(songs.select("song_id"), "song_id", "left_semi")
    return known.unionByName(compute(missing).select(*known.columns))


def to_json_col(columns: Iterable[str | Column]) -> Column:
    """JSON text of the given columns, nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
