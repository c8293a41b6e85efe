"""Explicit schemas of the engine tables."""

from pyspark.sql import types as T

_D, _S, _I, _L, _B = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SECTION = _struct(start_time=_D, end_time=_D, duration=_D, classification=_S, energy=_D, has_vocals=_B)
SONG = _struct(song_id=_S, duration=_D, key=_S, tempo=_D, bars=_I, has_strong_vocals=_B, has_strong_drums=_B, overall_energy=_D,
               vocals=_struct(voice_type=_S), sections=T.ArrayType(SECTION), key_chroma=T.ArrayType(_D), processed_at=_S)
PARAMS = _struct(song_a=_S, song_b=_S, direction=_S, key_shift=_I, vox_rms=_D, inst_rms=_D, duck_depth=_D, comp_threshold=_D,
                 emb_a=T.ArrayType(T.FloatType()), emb_b=T.ArrayType(T.FloatType()), timestamp=_S)
MIX_PARAMS = T.StructType([T.StructField("mix_id", _S), *PARAMS.fields])
RATING = T.StructType([*MIX_PARAMS.fields, T.StructField("rating", _I), T.StructField("rated_at", _S)])
SCORES = _struct(beat_coherence=_D, spectral_balance=_D, harmonic_clarity=_D, vocal_clarity=_D, dynamic_range=_D, phase_coherence=_D,
                 spectral_separation=_D, energy_consistency=_D, overall=_D)
MIX = _struct(mix_id=_S, song_a_id=_S, song_b_id=_S, params_used=_struct(direction=_S, vox_rms=_D, inst_rms=_D), quality_scores=SCORES, created_at=_S)
SAMPLES = _struct(song_id=_S, stem=_S, chunk=_L, pcm=T.ArrayType(T.FloatType()))
DECODE_ERRORS = _struct(path=_S, error=_S)
EMBEDDING = _struct(song_id=_S, embedding=T.ArrayType(T.FloatType()))
BINARY_FILE = _struct(path=_S, modificationTime=T.TimestampType(), length=_L, content=T.BinaryType())
