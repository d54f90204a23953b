"""Statistics without a built-in: binomial tails, Student's t, ranks with ties, divergences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The highest surprise, the least chance told from none, and how near to 0 or 1 a rate may be.
CAP, LEAST_TAIL, RATE_FLOOR = 300.0, 1e-300, 1e-9


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: up to fourteen steps up, then Stirling's series."""
    x = np.asarray(x, float)
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(14):
        small = y < 14
        shift += np.where(small, np.log(np.where(small, y, 1.0)), 0.0)
        y = y + small
    z = 1.0 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    z = np.clip(z, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z))
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.abs(step - 1).max(initial=0) < 1e-15:
            break
    part = np.where(z <= 0, 0.0, np.nan_to_num(front) * h / p)
    return np.where(swap, 1 - part, part)


@F.pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) for X binomial over n at rate p, 0 < k <= n. Its sum has no built-in; batches go through Arrow."""
    return pd.Series(incomplete_beta(k.to_numpy(float), (n - k + 1).to_numpy(float), p.to_numpy(float)))


def surprise(k: Column, n: Column, total_k: Column, total_n: Column) -> Column:
    """How many powers of ten lie between 1 and the chance of k or more of n at the rate of all others; 0 where k or n is 0.

    The others' rate is smoothed by half a count in one trial.
    """
    others = (F.greatest(total_k - k, F.lit(0)) + F.lit(0.5)) / (F.greatest(total_n - n, F.lit(0)) + F.lit(1.0))
    possible = (k > 0) & (n > 0)
    tail = binomial_tail(F.when(possible, k).otherwise(1).cast("double"), F.when(possible, F.greatest(n, k)).otherwise(1).cast("double"), F.greatest(F.least(others, F.lit(1 - RATE_FLOOR)), F.lit(RATE_FLOOR)))
    return F.when(possible, F.least(F.lit(CAP), F.greatest(-F.log10(F.greatest(tail, F.lit(LEAST_TAIL))), F.lit(0.0)))).otherwise(0.0)


def t_test_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation r over n points."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return float(incomplete_beta(np.array((n - 2) / 2), np.array(0.5), np.array((n - 2) / (n - 2 + t2))))


def with_average_ranks(df: DataFrame, value: str, rank: str, cuts: int = 256) -> DataFrame:
    """df with the rank of `value` among all rows, ties sharing their mean rank.

    No global sort: rows are counted per distinct value, values are bucketed at approximate
    quantiles, and a running count within buckets starts from the buckets' own running count.
    """
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    points = df.agg(F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 10_000).alias("__cuts"))
    placed = counted.crossJoin(F.broadcast(points))  # one row of `cuts` numbers
    placed = placed.withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    per = placed.groupBy("__b").agg(F.sum("__n").alias("__m"))
    before = per.withColumn("__before", F.coalesce(F.sum("__m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__m")
    inside = Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = placed.withColumn("__c", F.sum("__n").over(inside)).join(F.broadcast(before), "__b")
    ranks = ranks.select(value, (F.col("__before") + F.col("__c") - (F.col("__n") - 1) / 2).alias(rank))
    return df.join(ranks, value)


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null for fewer than two rows or a constant side."""
    moving = (F.count(F.lit(1)) >= 2) & (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(moving, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def js_term(p: Column, q: Column) -> Column:
    """One bin's share of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(F.try_divide(x, m))).otherwise(0.0)
    return (part(p) + part(q)) / 2
