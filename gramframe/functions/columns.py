"""Scalar column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the studied method.
ANGLE_CLIP = 3.0          # features are clipped to [-3, 3] before encoding
ALLCLOSE_RTOL = 1e-5      # tolerance of the symmetry / unit-diagonal checks
ALLCLOSE_ATOL = 1e-8
EIGEN_FLOOR = 1e-12       # eigenvalues at or below this are not counted by the effective rank


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_hash(seed: int | Column, purpose: str, key: str | Column) -> Column:
    """Deterministic pseudo-random order key: md5 of 'seed~purpose~key'.

    Replaces a random generator: the same value is produced by Spark and DuckDB, so every
    sample built on it can be checked against SQL.
    """
    seed_c = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("~", seed_c, F.lit(purpose), col(key).cast("string")))


def r6(c: str | Column) -> Column:
    """Round to 6 decimals and normalise -0.0 (used on both sides of an oracle comparison).

    Spark rounds a double by way of its decimal digits, a microsecond a value. Where the millionths are clear of one half
    and small enough to be exact, the nearest integer over 10^6 is the same double; only the others take Spark's way."""
    x = col(c)
    millionths = x * F.lit(1e6)
    nearest = F.rint(millionths)
    clear = (F.abs(x) < 1e6) & (F.abs(millionths - nearest) < 0.499)
    return F.when(clear, nearest / F.lit(1e6)).otherwise(F.round(x, 6)) + F.lit(0.0)


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den with 0.0 for a zero (or null) denominator, as double."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def clip_angle(c: str | Column) -> Column:
    """Angle encoding: clip to [-3, 3], then scale to [-pi, pi]."""
    return F.least(F.greatest(col(c), F.lit(-ANGLE_CLIP)), F.lit(ANGLE_CLIP)) / F.lit(ANGLE_CLIP) * F.lit(math.pi)


def nan_to_null(c: str | Column) -> Column:
    """Missing values: NaN and NULL both become NULL (done once at the scan)."""
    x = col(c).cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def allclose(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.lit(ALLCLOSE_ATOL) + F.lit(ALLCLOSE_RTOL) * F.abs(b)
