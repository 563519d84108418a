"""Style-vector geometry as column expressions (survey V1-V14).

Vectors are ``array<float>`` or ``array<double>`` columns; all arithmetic is in double. A null vector gives null,
vectors of different lengths are compared over the longer one with nulls, which also gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: str | Column) -> Column:
    """The vector as ``array<double>``."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(u, v) -> Column:
    """Inner product, added up from the first element."""
    return F.aggregate(F.zip_with(as_double(u), as_double(v), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def scaled(v, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(as_double(v), lambda x: x * f))


def normalised(v) -> Column:
    """Scaled to length 1; a zero vector gives null."""
    return let(norm(v), lambda n: F.transform(as_double(v), lambda x: F.try_divide(x, n)))


def cosine(u, v) -> Column:
    """Cosine; null when either vector is zero."""
    return F.try_divide(dot(u, v), norm(u) * norm(v))


def sim_measure(u, v) -> Column:
    """Angular similarity in [0.5, 1]; the cosine is clipped before its arc."""
    def arc(c):
        return F.when(c.isNotNull(), (2.0 - F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))) / F.lit(3.141592653589793)) / 2.0)

    return let(cosine(u, v), arc)


def distance(u, v) -> Column:
    """1 - sim_measure."""
    return 1.0 - sim_measure(u, v)


def away_of(cs: Column, st: Column) -> Column:
    """away from the similarities of current and source, and of source and target."""
    whole = 1.0 - st
    return F.when(cs.isNotNull(), F.try_divide(F.least(1.0 - cs, whole), whole))


def towards_of(ct: Column, st: Column) -> Column:
    """towards from the similarities of current and target, and of source and target."""
    return F.when(ct.isNotNull() & st.isNotNull(), F.try_divide(F.greatest(ct - st, F.lit(0.0)), 1.0 - st))


def away(source, current, target) -> Column:
    """How far the current text left its source, relative to the target's distance; at most 1, null for target = source."""
    return let(F.struct(sim_measure(current, source).alias("cs"), sim_measure(target, source).alias("st")), lambda s: away_of(s["cs"], s["st"]))


def towards(source, current, target) -> Column:
    """How much nearer to the target the current text is than its source; at least 0, null for target = source."""
    return let(F.struct(sim_measure(current, target).alias("ct"), sim_measure(source, target).alias("st")), lambda s: towards_of(s["ct"], s["st"]))


def rescaled(target, source=None, target_norm: float | None = None) -> Column:
    """The target at the source's norm (1 for a zero source) or at ``target_norm``; a zero target stays zero."""
    wanted = F.lit(float(target_norm)) if target_norm is not None else F.when(norm(source) == 0, 1.0).otherwise(norm(source))
    have = F.when(norm(target) == 0, 1.0).otherwise(norm(target))
    return scaled(target, wanted / have)


def norm_ok(v, kind: str | None) -> Column:
    """Whether a vector suits an encoder's convention: 'normalized' (0.9 to 1.1), 'unnormalized' (above 10) or any."""
    if kind is None:
        return F.lit(True)
    if kind == "normalized":
        return norm(v).between(0.9, 1.1)
    if kind == "unnormalized":
        return norm(v) > 10
    raise ValueError(f"unknown norm convention {kind!r}")


def guarded(v, kind: str | None, auto_normalise: bool = False) -> Column:
    """The vector, normalised on request; the query fails on a vector that breaks the convention."""
    if auto_normalise and kind == "unnormalized":
        raise ValueError("automatic normalisation contradicts unnormalized vectors")
    value = normalised(v) if auto_normalise else as_double(v)
    return F.when(norm_ok(value, kind), value).otherwise(F.raise_error(F.lit(f"style vector is not {kind}")))


def uniform(seed: int, *parts) -> Column:
    """A uniform number in (0, 1) from a hash of the row, the same for any partitioning."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def negated(v, share: float, seed: int, *key) -> Column:
    """Each coordinate negated with probability ``share``; the norm is kept."""
    return F.transform(as_double(v), lambda x, i: F.when(uniform(seed, *key, i) <= share, -x).otherwise(x))


def noisy(v, scale: float, seed: int, *key) -> Column:
    """Gaussian noise of ``scale`` on the unit vector, brought back to the old norm; a zero vector gives null."""
    def gauss(i):
        return F.sqrt(-2.0 * F.log(uniform(seed, *key, i))) * F.cos(F.lit(6.283185307179586) * uniform(seed + 1, *key, i))

    moved = F.transform(normalised(v), lambda x, i: x + scale * gauss(i))
    return rescaled(moved, v)


def mixed(vectors: Column, weights: Column) -> Column:
    """Weighted sum of an array of vectors; weights are scaled to add up to 1."""
    def add(whole):
        parts = F.zip_with(vectors, weights, lambda v, w: let(w / whole, lambda q: F.transform(v.cast("array<double>"), lambda x: x * q)))
        return F.reduce(parts, F.lit(None).cast("array<double>"), lambda s, v: F.when(s.isNull(), v).otherwise(F.zip_with(s, v, lambda a, b: a + b)))

    return let(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x), add)
