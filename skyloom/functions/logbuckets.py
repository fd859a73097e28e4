"""Signed logarithmic buckets of fixed relative width, as Column expressions.

A value x > 0 falls into bucket i = ceil(ln x / ln g), g = (1 + a) / (1 - a), that
is (g^(i-1), g^i]; its representative 2 g^i / (1 + g) is within relative error a
of every value of the bucket. Zero has its own bucket and negative values mirror
the positive ones, so bucket keys order like the values themselves. Counts per
bucket of different partitions, days or loads add up to those of the union.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAX = 1.7976931348623157e308


def _gamma(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    # A hair narrower than asked, so that rounding in ln() can't break the bound.
    a = alpha * (1 - 1e-9)
    return (1 + a) / (1 - a)


def offset(alpha: float) -> int:
    """Shift that makes bucket numbers of the smallest subnormal positive."""
    return math.ceil(745 / math.log(_gamma(alpha))) + 2


def is_finite(x: Column) -> Column:
    """True for values that count: neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(_MAX))


def bucket(x: Column, alpha: float) -> Column:
    """Integer bucket key of a finite double."""
    i = F.ceil(F.log(F.abs(x)) / F.lit(math.log(_gamma(alpha)))) + F.lit(offset(alpha))
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * i).cast("int")


def representative(key: Column, alpha: float) -> Column:
    """The value that stands for a bucket."""
    g = _gamma(alpha)
    i = F.abs(key) - F.lit(offset(alpha))
    v = F.least(F.exp(i * F.lit(math.log(g)) - F.lit(math.log((1 + g) / 2))), F.lit(_MAX))
    return F.when(key == 0, F.lit(0.0)).otherwise(F.signum(key) * v)
