"""Statistics: closed forms as columns, distribution tails as small Python functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def jsd_term(p: Column, q: Column) -> Column:
    """One outcome's part of the Jensen-Shannon divergence in bits; 0 log 0 counts as 0."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays of shares."""
    return F.aggregate(F.zip_with(p, q, jsd_term), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, tiny: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(tiny))


def unit(a: Column, tiny: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(tiny))
    return F.transform(a, lambda x: x.cast("double") / n)


def npmi(joint: Column, a: Column, b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information of document counts; -1 if never together."""
    p12 = joint / n
    return F.when(joint == 0, F.lit(-1.0)).otherwise(F.ln(p12 / ((a / n) * (b / n))) / -F.ln(p12))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution, by the incomplete gamma function's series or continued fraction."""
    if not x > 0:
        return 1.0
    a, x = dof / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b)
        c = b + n / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def normal_tail(z: float) -> float:
    """Both tails of the standard normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(T.DoubleType())
def chi2_tail_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else chi2_tail(a, int(d)) for a, d in zip(x, dof)])


@F.pandas_udf(T.DoubleType())
def normal_tail_udf(z: pd.Series) -> pd.Series:
    return z.map(normal_tail)
