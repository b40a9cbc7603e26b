"""Statistics as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Genomic base frequencies.
GENOMIC = {"A": 0.3, "T": 0.3, "C": 0.2, "G": 0.2}


def stdev(x: Column) -> Column:
    """Sample standard deviation, 0 for two values or fewer (aggregate)."""
    return F.when(F.count(x) > 2, F.stddev_samp(x)).otherwise(F.lit(0.0))


def weighted_stdev(value: Column, n: Column) -> Column:
    """The same over values with counts (aggregate)."""
    total, mean = F.sum(n), F.sum(value * n) / F.sum(n)
    return F.when(total > 2, F.sqrt((F.sum(value * value * n) - total * mean * mean) / (total - 1))).otherwise(F.lit(0.0))


def entropy(a: Column, c: Column, g: Column, t: Column) -> Column:
    """Sum of p log2 p over bases, p being the share with pseudo-counts over the genomic one; 0 without bases."""
    n = a + c + g + t
    root = F.sqrt(n.cast("double"))
    counts = {"A": a, "T": t, "C": c, "G": g}
    whole = n + root
    out = F.lit(0.0)
    for b, f in GENOMIC.items():
        p = (counts[b] + f * root) / whole / f
        out = out + p * F.log2(p)
    return F.when(n == 0, 0.0).otherwise(out)


def log_likelihood(a: Column, c: Column, g: Column, t: Column, background: tuple[float, ...] = (0.3, 0.2, 0.2, 0.3), pseudo: str | float = "auto") -> Column:
    """struct of ln(share / background) for A, C, G and T; pseudo-counts are background times the root of the sum."""
    n = a + c + g + t
    weight = F.sqrt(n.cast("double")) if pseudo == "auto" else F.lit(float(pseudo))
    cols = [F.log((x + bg * weight) / (n + weight) / bg).alias(b) for b, x, bg in zip("ACGT", (a, c, g, t), background)]
    return F.struct(*cols)


def calls(a: Column, c: Column, g: Column, t: Column) -> Column:
    """(count, base), largest first; ties by base backwards."""
    each = F.array(*[F.struct(x.cast("long").alias("n"), F.lit(b).alias("b")) for b, x in zip("ACGT", (a, c, g, t))])
    return F.reverse(F.array_sort(each))


def consensus(a: Column, c: Column, g: Column, t: Column, minor_share: float = 0.01) -> Column:
    """struct<major,minor>: bases with the largest count and, if that is one base, those with the next
    count if it is at least minor_share of all. N and nothing without bases."""
    known = dict(zip("TGCA", (t, g, c, a)))  # ties by base backwards
    best = F.greatest(*known.values())
    second = F.greatest(*[F.when(x < best, x).otherwise(0) for x in known.values()])
    alone = sum((F.when(x == best, 1).otherwise(0) for x in known.values()), F.lit(0)) == 1
    listed = lambda n: F.concat_ws("/", *[F.when(x == n, b) for b, x in known.items()])
    good = alone & (second > 0) & (second / (a + c + g + t) >= minor_share)
    return F.struct(F.when(best == 0, "N").otherwise(listed(best)).alias("major"), F.when(good, listed(second)).otherwise("").alias("minor"))


def heterozygosity(a: Column, c: Column, g: Column, t: Column) -> Column:
    """Share of the second base, the third as background taken off both; 0 if nothing is left of it."""
    n = F.sort_array(F.array(a, c, g, t))
    major, minor, back = (F.element_at(n, -i).cast("double") for i in (1, 2, 3))
    return F.when(minor <= back, 0.0).otherwise((minor - back) / (major - back + minor - back))


def poisson(mu: Column, lam: Column) -> Column:
    """lam^mu e^-lam / mu!, for mu up to 20."""
    return F.pow(lam, mu) * F.exp(-lam) / F.factorial(mu.cast("int"))


def poisson_cumulative(x: Column, mean: Column) -> Column:
    """Sum over 1 to x; 0 is not counted."""
    steps = F.sequence(F.lit(1), F.greatest(x.cast("int"), F.lit(1)))
    return F.when(x < 1, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.pow(mean, i) * F.exp(-mean) / F.factorial(i)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def binomial_interval(n: int, x: int, alleles: int, level: float = 0.95) -> tuple[float, float]:
    """Interval of a share from beta quantiles at (x + 1, n - x + 1); a low end below the least that can
    be told, max(1/n, 0.5/alleles), is 0 and a high end within that of 1 is 1."""
    if n <= 0:
        return float("nan"), float("nan")
    low, high = (beta_quantile(p, x + 1, n - x + 1) for p in ((1 - level) / 2, (1 + level) / 2))
    least = max(1 / n, 0.5 / alleles)
    return (0.0 if low < least else low), (1.0 if high > 1 - least else high)


def confidence(n: Column, x: Column, alleles: int) -> Column:
    """struct<low,high> of binomial_interval; pairs of counts that repeat in a batch are computed once."""

    @F.pandas_udf("low double, high double")
    def interval(n: pd.Series, x: pd.Series) -> pd.DataFrame:
        keys = list(zip(n.fillna(0).astype(int), x.fillna(0).astype(int)))
        known = {k: binomial_interval(*k, alleles) for k in set(keys)}
        out = np.array([known[k] for k in keys]).reshape(-1, 2)
        return pd.DataFrame({"low": out[:, 0], "high": out[:, 1]})

    return interval(n, x)


def median_of_counts(counts, keys: list[str], value: str = "value", n: str = "n"):
    """keys with median of whole numbers that have counts: where two share the middle, half their sum,
    rounded down; 0 without any."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    df = counts.withColumns({"__c": F.sum(n).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__t": F.sum(n).over(w)})
    low = F.min(F.when(F.col("__c") * 2 >= F.col("__t"), F.when(F.col(n) > 0, F.col(value))))
    high = F.min(F.when(F.col("__c") * 2 > F.col("__t"), F.when(F.col(n) > 0, F.col(value))))
    return df.groupBy(*keys).agg(F.coalesce(F.floor((low + high) / 2), F.lit(0)).cast("long").alias("median"))
