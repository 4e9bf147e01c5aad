"""Scores and test statistics as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(ratio(tp, tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(ratio(tp, tp + fn), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing is true or predicted."""
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def exact_p(b: int, c: int) -> float:
    """Two-sided exact binomial p of b against c at one half."""
    n, k = b + c, min(b, c)
    if not n:
        return 1.0
    # sums of binomials over 2 ** n by logarithms, so n may be large
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


@F.pandas_udf(T.DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([exact_p(int(x), int(y)) for x, y in zip(b, c)])


@F.pandas_udf(T.DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def chi2_1_p(q: pd.Series) -> pd.Series:
    """Upper tail of chi-squared with one degree of freedom."""
    return q.map(lambda x: math.erfc(math.sqrt(max(x, 0) / 2)), na_action="ignore")
