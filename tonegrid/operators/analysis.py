"""A song's analysis as one operator: tempo, energy curve, phrases, key and classified sections from framed stems and beats."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.functions.arrays import detect_key
from tonegrid.operators import structure as B
from tonegrid.operators.quality import chroma_profile
from tonegrid.operators.signal import active_phrases, activity_rms, beat_energy, bridge_gaps
from tonegrid.session import materialize


class SongTables(NamedTuple):
    """Parts of an analysis: one row per song, per beat of the energy curve, per vocal phrase and per section."""

    songs: DataFrame
    curve: DataFrame
    phrases: DataFrame
    sections: DataFrame


def analyse_songs(frames: DataFrame, beats: DataFrame, keys: Sequence[str], hop_s: float = 0.25, min_section_s: float = 16.0, smooth: int = 16) -> SongTables:
    """Analyse every song of a catalogue.

    ``frames``: keys, frame (dense from 0), rms, mfcc, chroma and centroid of the mix, vocals and drums (levels of these stems, 0 where silent) and
    key_chroma (12 values of the melodic stems, null where they have none). ``beats``: keys, beat_idx (dense from 0), t, strength.

    Sections start where timbre, harmony and level change most, at least ``min_section_s`` apart, moved to the nearest downbeat; spans under three
    quarters of that go, so a song shorter than such a span has no section. A song without beats has tempo 120, its curve in half seconds and boundaries where they were found; one without
    key_chroma has no key. Every step works on stretches of a song, none gathers one.
    """
    keys = list(keys)
    d = materialize(frames.select(*keys, "frame", "rms", "mfcc", "chroma", "centroid", "vocals", "drums", "key_chroma"), "song-frames")
    beats = materialize(beats.select(*keys, "beat_idx", "t", "strength"), "song-beats")
    length = d.groupBy(*keys).agg(((F.max("frame") + 1) * hop_s).alias("duration"), F.sqrt(F.avg(F.col("drums") * F.col("drums"))).alias("_drums"))

    curve = materialize(beat_energy(d, beats, keys, "frame", "rms", "t", "beat_idx", sr=1 / hop_s), "curve")
    drums = beat_energy(d, beats, keys, "frame", "drums", "t", "beat_idx", sr=1 / hop_s)
    phrases = active_phrases(d, keys, "frame", "vocals", hop_s)
    key = chroma_profile(d.where(F.col("key_chroma").isNotNull()), keys, "key_chroma").select(*keys, detect_key(F.col("chroma"))["key"].alias("key"))

    inner = B.boundary_peaks(d, keys, "frame", "mfcc", "chroma", "rms", int(min_section_s / hop_s), smooth).select(*keys, (F.col("frame") * hop_s).alias("t"))
    grid = B.downbeats(beats, keys, "beat_idx", "strength")
    snapped = B.snap_nearest(materialize(inner, "boundaries"), grid, beats, keys, "t", "t", "t", "t").select(*keys, "t").distinct()
    edges = B.clean_boundaries(snapped, length, keys, "t", "duration", min_section_s * 0.75)
    s = materialize(B.sections_from_edges(materialize(edges, "edges"), keys, "t", min_s=2.0), "spans")
    s = B.section_energy(s, d.withColumn("t", F.col("frame") * hop_s), keys, "t", "rms", "centroid")
    s = B.vocal_density(materialize(s, "spans-energy"), bridge_gaps(activity_rms(d, keys, "frame", "vocals"), keys, "frame", "active"), keys, "frame", "activity", hop_s)
    s = B.drum_dominance(s, materialize(drums, "drum-curve"), keys, "beat_idx", "energy")
    s = B.beats_in_range(materialize(s, "spans-stems"), beats, keys, "section_idx", "start_time", "end_time", "t")
    s = materialize(B.classify_sections(s, keys), "song-sections")

    per_curve = curve.groupBy(*keys).agg(F.avg("energy").alias("overall_energy"))
    per_phrase = phrases.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_phrases"), F.bool_or("is_strong").alias("_strong"))
    out = length
    for part in (B.tempo_from_beats(beats, keys, "beat_idx", "t"), beats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_beats")), per_curve, key, per_phrase):
        out = out.join(part, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    songs = out.select(*keys, "duration", F.coalesce("tempo", F.lit(120.0)).alias("tempo"), zero("n_beats"), "key", F.coalesce("overall_energy", F.lit(0.0)).alias("overall_energy"),
                       zero("n_phrases"), F.coalesce("_strong", F.lit(False)).alias("has_strong_vocals"), F.coalesce(F.col("_drums") > 0.02, F.lit(False)).alias("has_strong_drums"))
    return SongTables(materialize(songs, "songs"), curve, phrases, s)


def nest_songs(parts: SongTables, keys: Sequence[str]) -> DataFrame:
    """The song record: one row per song with its sections and phrases as arrays in order; the curve stays a table of its own."""
    keys = list(keys)

    def listed(d: DataFrame, name: str, first: str) -> DataFrame:
        rest = [c for c in d.columns if c not in (*keys, first)]
        return d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(first, *rest))).alias(name))

    d = parts.songs.join(listed(parts.sections, "sections", "section_idx"), keys, "left").join(listed(parts.phrases, "phrases", "start_time"), keys, "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(d.schema[c].dataType)).alias(c)
    return d.select(*parts.songs.columns, none("sections"), none("phrases"))
