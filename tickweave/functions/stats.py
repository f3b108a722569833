"""Aggregates that stay representable where plain sums of squares would not.

Root mean squares use the accumulators of Blue's norm algorithm (1978): the squares are
summed three times, plain, scaled down and scaled up by powers of two, and the largest
magnitude says which sum is exact. One pass, mergeable, nothing is joined back."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.functions.scalars import col

_BIG, _SMALL = 2.0**400, 2.0**-400
_DOWN, _UP = 2.0**-550, 2.0**500


def _sums(x: Column):
    largest = F.max(F.abs(x))
    n = F.count(x)
    return largest, n, F.sum(x * x), F.sum((x * _DOWN) * (x * _DOWN)), F.sum((x * _UP) * (x * _UP))


def mean_square(c: Column | str) -> Column:
    """Aggregate mean(x^2); infinite only when the result itself exceeds the largest double."""
    largest, n, plain, down, up = _sums(col(c))
    return (
        F.when(largest == 0.0, F.lit(0.0))
        .when(largest > _BIG, (down / n) / F.lit(_DOWN) / F.lit(_DOWN))
        .when(largest < _SMALL, (up / n) / F.lit(_UP) / F.lit(_UP))
        .otherwise(plain / n)
    )


def root_mean_square(c: Column | str) -> Column:
    """Aggregate sqrt(mean(x^2)); never beyond the largest magnitude."""
    largest, n, plain, down, up = _sums(col(c))
    return (
        F.when(largest == 0.0, F.lit(0.0))
        .when(largest > _BIG, F.sqrt(down / n) / F.lit(_DOWN))
        .when(largest < _SMALL, F.sqrt(up / n) / F.lit(_UP))
        .otherwise(F.sqrt(plain / n))
    )


def safe_mean(values: Column) -> Column:
    """Mean of an array whose sum cannot overflow: readings near the largest double are averaged
    after scaling by a power of two; ordinary readings keep the plain mean. The readings are added
    from the first to the last, as the last bits of a sum of doubles depend on the order; nulls are left out."""
    read = F.filter(values, lambda v: v.isNotNull())

    def mean(scale: float) -> Column:
        return F.try_divide(F.aggregate(read, F.lit(0.0), lambda total, v: total + v * scale), F.size(read).cast("double"))

    return F.when(F.array_max(F.transform(read, F.abs)) > _BIG, mean(_DOWN) / F.lit(_DOWN)).otherwise(mean(1.0))


def midpoint(low: Column, high: Column) -> Column:
    """Middle of two finite numbers without overflow."""
    return F.when(low == high, low).when(
        (low < 0.0) != (high < 0.0), (low + high) / 2.0
    ).otherwise(low + (high - low) / 2.0)


@lru_cache(maxsize=65536)
def sign_test_p(successes: int, trials: int) -> float:
    """P(X >= successes), X binomial(trials, 1/2), in exact integers and one division."""
    if trials == 0:
        return 1.0
    return sum(math.comb(trials, i) for i in range(successes, trials + 1)) / 2**trials


@F.pandas_udf(T.DoubleType())
def sign_test(successes: pd.Series, trials: pd.Series) -> pd.Series:
    """Arrow-batched; it runs on one row per comparison and budget, after aggregation."""
    return pd.Series(
        [sign_test_p(int(k), int(n)) for k, n in zip(successes, trials, strict=True)], dtype="float64"
    )


# 2 (1 - Phi(k)) for k = 1, 2.
TAIL_BEYOND = {1: 0.31731050786291415, 2: 0.04550026389635839}
