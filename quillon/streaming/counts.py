"""Streaming n-gram counts and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ngrams


def ngram_counts(stream: DataFrame, text: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Running counts of n-grams over a stream of texts; state is one row for each (group, n-gram). Write in `complete` or `update` mode."""
    return stream.select(*by, F.explode(ngrams(text, n)).alias("item")).groupBy(*by, "item").agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; state older than the watermark goes."""
    rows = stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")
