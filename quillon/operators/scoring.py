"""Classifier scoring: rates, correlation, threshold sweeps, areas under curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ColumnLike, col

#: E-value cut points by default: powers of ten with their halves.
E_VALUES = tuple(float(f"{m}e{k}") for k in range(-12, 1) for m in (1, 5))[:25]


def _rate(a: ColumnLike, b: ColumnLike, empty: float) -> Column:
    total = col(a) + col(b)
    return F.when(total == 0, empty).otherwise(col(a) / total)


def true_positive_rate(tp: ColumnLike, fn: ColumnLike) -> Column:
    return _rate(tp, fn, 1.0)


def true_negative_rate(tn: ColumnLike, fp: ColumnLike) -> Column:
    return _rate(tn, fp, 1.0)


def false_positive_rate(fp: ColumnLike, tn: ColumnLike) -> Column:
    return _rate(fp, tn, 0.0)


def false_negative_rate(fn: ColumnLike, tp: ColumnLike) -> Column:
    return _rate(fn, tp, 0.0)


def accuracy(tp: ColumnLike, tn: ColumnLike, positives: ColumnLike, negatives: ColumnLike) -> Column:
    return (col(tp) + col(tn)) / (col(positives) + col(negatives))


def precision(tp: ColumnLike, fp: ColumnLike) -> Column:
    return _rate(tp, fp, 1.0)


def matthews(tp: ColumnLike, tn: ColumnLike, fp: ColumnLike, fn: ColumnLike) -> Column:
    """Matthews correlation; a zero denominator counts as 1."""
    a, b, c, d = (col(x).cast("double") for x in (tp, tn, fp, fn))
    under = F.sqrt((a + c) * (a + d) * (b + c) * (b + d))
    return (a * b - c * d) / F.when(under == 0, 1.0).otherwise(under)


def confusion(df: DataFrame, score: str, label: str, cuts: Sequence[float], below: bool = False) -> DataFrame:
    """(cut, tp, tn, fp, fn) at each threshold: positive where score >= cut (or <= cut). The cuts are few literals, so each row expands by their number."""
    rows = df.select(F.col(label).cast("int").alias("y"), F.col(score).alias("s"), F.explode(F.array(*map(F.lit, map(float, cuts)))).alias("cut"))
    yes = F.col("s") <= F.col("cut") if below else F.col("s") >= F.col("cut")
    count = lambda c: F.count_if(c)
    return rows.groupBy("cut").agg(
        count(yes & (F.col("y") == 1)).alias("tp"), count(~yes & (F.col("y") == 0)).alias("tn"), count(yes & (F.col("y") == 0)).alias("fp"), count(~yes & (F.col("y") == 1)).alias("fn"),
    )


def roc(df: DataFrame, score: str, label: str, cuts: Sequence[float], below: bool = False) -> DataFrame:
    """confusion() with tpr, fpr, mcc, acc and ppv."""
    c = confusion(df, score, label, cuts, below)
    return c.select(
        "*", true_positive_rate("tp", "fn").alias("tpr"), false_positive_rate("fp", "tn").alias("fpr"), matthews("tp", "tn", "fp", "fn").alias("mcc"),
        accuracy("tp", "tn", F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")).alias("acc"), precision("tp", "fp").alias("ppv"),
    )


def area(points: DataFrame, x: str = "fpr", y: str = "tpr") -> DataFrame:
    """Trapezoid area under points in order of x; points are one for each cut."""
    w = Window.orderBy(x, y)
    steps = points.select(F.col(x).alias("x"), F.col(y).alias("y"), F.lead(x).over(w).alias("x2"), F.lead(y).over(w).alias("y2"))
    return steps.agg(F.coalesce(F.sum((F.col("x2") - F.col("x")) * (F.col("y") + F.col("y2")) / 2), F.lit(0.0)).alias("area"))


def roc_area(points: DataFrame) -> DataFrame:
    """One best tpr for each fpr (the least at fpr 1), with (0, 0) and (1, 1), as an area and scaled so that chance is 0."""
    best = points.groupBy("fpr").agg(F.when(F.col("fpr") == 1, F.min("tpr")).otherwise(F.max("tpr")).alias("tpr"))
    spark = points.sparkSession
    ends = spark.sql("select 0d fpr, 0d tpr union all select 1d, 1d")
    out = area(best.unionByName(ends).distinct())
    return out.withColumn("scaled", (F.col("area") - 0.5) / 0.5)


def best_point(points: DataFrame) -> DataFrame:
    """The point of least 1 - (tpr - fpr), the first cut on ties."""
    return points.agg(F.min_by(F.struct("cut", "tpr", "fpr"), F.struct(1 - (F.col("tpr") - F.col("fpr")), F.col("cut"))).alias("b")).select("b.*")


def score_cuts(n: int = 25, spread: float = 6.0) -> list[float]:
    """Logistic-spaced thresholds between 0 and 1."""
    import math

    return [1 / (1 + math.exp(-(-spread + 2 * spread * i / (n - 1)))) for i in range(n)]


def positive_negative_sets(df: DataFrame, evalue: str, low: float, high: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Positives below the cutoff; negatives at or above it, or above `high` if a range is given."""
    negative = F.col(evalue) >= low if high is None else F.col(evalue) > high
    return df.filter(F.col(evalue) < low), df.filter(negative)
