"""Fixed values of the domain. Results depend on them being exactly these."""

from __future__ import annotations

# --- fixed values: signal layout ---
SAMPLE_RATE = 44100
BEATS_PER_BAR = 4
STEMS = ["vocals", "drums", "bass", "other"]
AUDIO_EXTENSIONS = ["mp3", "wav", "flac", "m4a", "aac", "ogg"]

# --- fixed values: pitch classes ---
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLAT_NAMES = {"Db": 1, "Eb": 3, "Gb": 6, "Ab": 8, "Bb": 10}

# --- fixed values: Krumhansl-Kessler key profiles (published tables) ---
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]

# --- fixed values: key interval scores and notes ---
INTERVAL_SCORES = {
    0: 1.0, 1: 0.2, 2: 0.6, 3: 0.5, 4: 0.5, 5: 0.9,
    6: 0.1, 7: 0.9, 8: 0.5, 9: 0.5, 10: 0.6, 11: 0.2,
}
INTERVAL_NOTES = {
    0: "Same key — perfect match",
    1: "Minor 2nd — strong clash",
    2: "Major 2nd — workable with adjustment",
    3: "Minor 3rd — might clash",
    4: "Major 3rd — might clash",
    5: "Perfect 4th — very compatible",
    6: "Tritone — maximum dissonance",
    7: "Perfect 5th — very compatible",
    8: "Minor 6th — might clash",
    9: "Major 6th — might clash",
    10: "Minor 7th — workable with adjustment",
    11: "Major 7th — strong clash",
}

# --- fixed values: tempo score steps (ratio below, score, note) ---
TEMPO_STEPS = [
    (1.05, 1.0, "Perfect tempo match"),
    (1.10, 0.9, "Very close tempos, minor stretch needed"),
    (1.20, 0.7, "Moderate tempo difference, stretching may be audible"),
    (1.50, 0.4, "Large tempo gap — recommend vocals-over-instrumental mode"),
]
TEMPO_DOUBLE = (1.95, 2.05, 0.6, "Double-time relationship — could work as half-time mashup")
TEMPO_FAR = (0.2, "Very different tempos — will require heavy time-stretching")

# --- fixed values: fusion modes ---
MODE_REASONS = {
    "tempo": "Large tempo difference — layering everything will sound messy",
    "key": "Clashing keys — single vocal source avoids harmonic conflict",
    "blend": "Compatible tempo and key — full blend should work",
}

# --- fixed values: section pairing bonuses (vocal section, beat section) ---
SECTION_BONUS = [
    ("chorus", "drop", 0.15),
    ("chorus", "instrumental", 0.12),
    ("chorus", "chorus", 0.10),
    ("verse", "instrumental", 0.10),
    ("verse", "verse", 0.08),
    ("chorus", "buildup", 0.05),
]

# --- fixed values: structure placement preferences ---
SECTION_PREFERENCES = {
    "chorus": ["drop", "instrumental", "buildup"],
    "drop": ["drop", "instrumental"],
    "verse": ["instrumental", "buildup", "drop"],
    "buildup": ["buildup", "instrumental"],
    "instrumental": ["drop", "instrumental"],
}
DEFAULT_PREFERENCE = ["drop", "instrumental"]
ALL_SECTION_TYPES = ["drop", "instrumental", "buildup", "breakdown", "verse", "chorus"]
NO_VOCAL_SECTIONS = ["intro", "outro", "breakdown", "unknown"]
NO_BEAT_SECTIONS = ["intro", "outro", "unknown"]

# --- fixed values: phrase placement preferences ---
PHRASE_PREFERENCES = {
    "hook": ["drop", "groove"],
    "groove": ["groove", "drop", "build"],
    "atmosphere": ["build", "groove"],
}
PHRASE_FALLBACK = ["groove", "drop", "build"]

# --- fixed values: vocal gain by bar label ---
LABEL_GAIN = {"drop": 1.25, "groove": 1.00, "build": 0.80, "breakdown": 0.00}

# --- fixed values: mix score dimensions and weights, in order ---
SCORE_WEIGHTS = {
    "beat_coherence": 0.20,
    "spectral_balance": 0.10,
    "harmonic_clarity": 0.15,
    "vocal_clarity": 0.20,
    "dynamic_range": 0.05,
    "phase_coherence": 0.10,
    "spectral_separation": 0.10,
    "energy_consistency": 0.10,
}

# --- fixed values: spectral bands (name, low Hz, high Hz, ideal share) ---
BANDS = [
    ("sub", 20.0, 80.0, 0.08),
    ("bass", 80.0, 250.0, 0.25),
    ("low_mid", 250.0, 500.0, 0.20),
    ("mid", 500.0, 2000.0, 0.22),
    ("upper_mid", 2000.0, 4000.0, 0.12),
    ("presence", 4000.0, 8000.0, 0.08),
    ("air", 8000.0, 16000.0, 0.05),
]

# --- fixed values: recommendations ---
# (dimension, below, action, parameter, current, suggested, reason, priority)
RECOMMENDATIONS = [
    ("beat_coherence", 0.5, "realign_beats", "beat_alignment_window_ms", "50", "100",
     "Beats are not tight — try wider alignment window or use single drum source", 1),
    ("spectral_balance", 0.5, "apply_eq_correction", "eq_curve", "0", "1",
     "Frequency spectrum is unbalanced — needs EQ correction", 2),
    ("harmonic_clarity", 0.5, "adjust_transposition", "transposition_semitones", "0", "0",
     "Songs may be in clashing keys — try different transposition or use single-source mode", 1),
    ("vocal_clarity", 0.5, "boost_vocal_presence", "vocal_gain_db", "0", "3",
     "Vocals are buried — increase vocal level or add presence EQ", 1),
    ("vocal_clarity", 0.5, "increase_sidechain", "sidechain_amount", "0.3", "0.5",
     "Duck instruments more when vocals are active", 2),
    ("dynamic_range", 0.4, "reduce_compression", "compression_ratio", "3.0", "2.0",
     "Mix is over-compressed — reduce compression ratio", 3),
    ("phase_coherence", 0.5, "switch_to_single_source", "fusion_mode", "blend", "a_vocals_b_inst",
     "Phase cancellation detected — use vocals from one song only", 1),
    ("spectral_separation", 0.4, "increase_eq_carving", "eq_carve_depth_db", "-2", "-4",
     "Elements are masking each other — deeper EQ carving needed", 2),
    ("energy_consistency", 0.5, "improve_crossfades", "crossfade_ms", "500", "1500",
     "Energy jumps at transitions — use longer crossfades", 2),
]

# --- fixed values: mixing parameter defaults ---
PARAM_DEFAULTS = {
    "vox_rms": 0.09, "inst_rms": 0.12, "key_shift": 0.0, "duck_depth": 0.3, "comp_threshold": -18.0,
}
VOCAL_LEVELS = [0.07, 0.09, 0.11, 0.13]
BEAT_LEVELS = [0.10, 0.12, 0.14, 0.16]
MIN_RATINGS_TO_TRAIN = 3
MIN_RATINGS_TO_RETRAIN = 5
