"""Vector column functions on array columns (higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once; inside another lambda it would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _dbl(a: Column) -> Column:
    return F.transform(a, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Null when the widths differ."""
    total = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def l2_normalize(a: Column) -> Column:
    scale = lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 1e-10, x / n).otherwise(x)))
    return let(_dbl(a), scale)


def pad(a: Column, n: int) -> Column:
    """Zero-pad or cut to width n."""
    return F.slice(F.concat(_dbl(a), F.array_repeat(F.lit(0.0), n)), 1, n)


def clip_array(a: Column, lo: float, hi: float) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x.cast("double"))))


def feature_vector(emb_a: Column, emb_b: Column, direction: Column, key_shift: Column) -> Column:
    """Both embeddings, direction flag, key shift over 6."""
    flag = F.when(direction == "a_vocals", 1.0).otherwise(0.0)
    return F.concat(_dbl(emb_a), _dbl(emb_b), F.array(flag, key_shift / F.lit(6.0)))


def mean_of(a: Column) -> Column:
    return _sum(a) / F.size(a)


def _centred(a: Column) -> Column:
    return let(mean_of(_dbl(a)), lambda m: F.transform(a, lambda x: x.cast("double") - m))


def chroma_compatibility(a: Column, b: Column, otherwise: Column) -> Column:
    """Best correlation over 12 rotations, (r+.5)/1.5 clipped to 0..1; other widths give ``otherwise``."""
    def fit(ca, cb):
        turned = lambda s: F.concat(F.slice(cb, 13 - s, s), F.slice(cb, 1, 12 - s))
        sums = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda s: _sum(F.zip_with(ca, turned(s), lambda x, y: x * y)))
        scale = norm(ca) * norm(cb)
        return F.when(scale > 0, F.array_max(sums) / scale)

    best = let(_centred(a), lambda ca: let(_centred(b), lambda cb: fit(ca, cb)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (best + 0.5) / 1.5))
    return F.when((F.size(a) == 12) & (F.size(b) == 12), F.coalesce(score, F.lit(0.0))).otherwise(otherwise)


def detect_key(chroma: Column) -> Column:
    """struct(key, corr): best of 24 rotated key profiles; root-major before root-minor, the first wins among those within 1e-9 of the best."""
    from tonegrid.constants import MAJOR_PROFILE, MINOR_PROFILE, NOTE_NAMES

    def unit(p):
        m = sum(p) / 12
        size = sum((v - m) ** 2 for v in p) ** 0.5
        return [(v - m) / size for v in p]

    modes = [("major", unit(MAJOR_PROFILE)), ("minor", unit(MINOR_PROFILE))]
    table = F.array(*[F.struct(F.lit(f"{NOTE_NAMES[r]} {mode}").alias("key"), F.array(*[F.lit(z[(p - r) % 12]) for p in range(12)]).alias("z"))
                      for r in range(12) for mode, z in modes])

    def fit(c, size):
        fits = F.transform(table, lambda t: F.struct((_sum(F.zip_with(c, t["z"], lambda x, y: x * y)) / size).alias("corr"), t["key"].alias("key")))
        first = lambda f: let(F.array_max(F.transform(f, lambda x: x["corr"])), lambda top: F.get(F.filter(f, lambda x: x["corr"] >= top - 1e-9), F.lit(0)))
        return F.when(size > 0, let(fits, first))

    best = let(_centred(chroma), lambda c: let(norm(c), lambda size: fit(c, size)))
    return F.struct(F.coalesce(best["key"], F.lit("C major")).alias("key"), F.round(best["corr"], 12).alias("corr"))


def simple_key(chroma: Column) -> Column:
    """Name of the strongest pitch class; the first one on ties."""
    from tonegrid.constants import NOTE_NAMES

    idx = F.array_position(chroma, F.array_max(chroma)).cast("int")
    return F.element_at(F.array(*[F.lit(n) for n in NOTE_NAMES]), idx)
