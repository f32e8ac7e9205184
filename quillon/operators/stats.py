"""Descriptive statistics: means, medians, variances and their weighted and pooled forms. All variances are population variances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def weighted_median(value: str, weight: str) -> Column:
    """Exact median of values that count `weight` times."""
    return F.percentile(F.col(value), F.lit(0.5), F.col(weight).cast("long"))


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, sum, mean, median, variance and standard deviation."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("std"),
    )


def deviation(df: DataFrame, distance: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared distance to a centre: the variance under another metric."""
    return df.groupBy(*by).agg(F.avg(distance * distance).alias("variance"))


def pooled_variance(df: DataFrame, value: str, group: str) -> DataFrame:
    """sum((n_i - 1) var_i) / (sum(n_i) - k) over groups, and its root."""
    each = df.groupBy(group).agg(F.count(value).alias("n"), F.var_pop(value).alias("v")).filter("n > 0")
    out = each.agg((F.sum((F.col("n") - 1) * F.col("v")) / (F.sum("n") - F.count("*"))).alias("avg_variance"))
    return out.withColumn("avg_std", F.sqrt("avg_variance"))


def association(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Population covariance and Pearson correlation; null where a deviation is zero."""
    flat = (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
    return df.groupBy(*by).agg(F.covar_pop(x, y).alias("covariance"), F.when(~flat, F.corr(x, y)).alias("correlation"))


def product(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.product(value).alias("product"))


def cross_reduce(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Sum over all pairs of a * b, which factorises into two sums: no pair is made."""
    return left.agg(F.sum(a).alias("_a")).join(F.broadcast(right.agg(F.sum(b).alias("_b")))).select((F.col("_a") * F.col("_b")).alias("cross_sum"))
