"""Numeric Column helpers that keep IEEE comparisons and rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sure(condition: Column) -> Column:
    """False where the condition is null, so that its complement keeps those rows."""
    return F.coalesce(condition, F.lit(False))


def above(x: Column, limit: float, inclusive: bool = False) -> Column:
    """x > limit (>= if inclusive), false for NaN and null. Spark itself holds NaN to be above every number."""
    return sure((x >= limit if inclusive else x > limit) & ~F.isnan(x))


def below(x: Column, limit: float, inclusive: bool = False) -> Column:
    return sure((x <= limit if inclusive else x < limit) & ~F.isnan(x))


def half_even(x: Column, digits: int = 3) -> Column:
    """Rounded half to even after scaling."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def log1p_or_nan(x: Column) -> Column:
    """log1p where it exists, NaN elsewhere. Spark's own gives NULL there, which sums leave out silently."""
    return F.when(x > -1.0, F.log1p(x)).otherwise(F.lit(float("nan")))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def dot(weights: list[float], values: list[Column]) -> Column:
    """Sum of products; zero weights are left out of the expression."""
    used = [F.lit(float(w)) * v for w, v in zip(weights, values, strict=True) if w != 0]
    return reduce(lambda a, b: a + b, used) if used else F.lit(0.0)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def bin_of(x: Column, bins: int, low: float, high: float) -> Column:
    """Bin number from 0; bins are half-open but for the last, which is closed. Null outside the range and for NaN."""
    at = F.floor((x - low) / ((high - low) / bins)).cast("int")
    inside = above(x, low, True) & below(x, high, True)
    return F.when(inside, F.least(at, F.lit(bins - 1)))


def keyed_uniform(key: Column, seed: int, k: int = 0) -> Column:
    """Draw number k of a key, in [0, 1): the same wherever and however often it is drawn. 52 bits of SHA-256, four draws a digest."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(f":{k // 4}")).cast("binary"), 256), 13 * (k % 4) + 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))
