"""Order-dependent operators: running sums, suffixes, empirical distributions, cuts, nearest and best rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.mathfn import half_away


def running_sum(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Sums up to and with each row; `order` has to be total."""
    return df.withColumn("running", F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def suffix_duplicates(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """name, name/2, name/3, ... for repeated names."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_name", F.when(nth == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("/"), nth.cast("string"))))


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, order: Sequence[str] = (), largest: bool = False) -> DataFrame:
    """The row of least (or largest) score of each key, the first in `order` on ties: an aggregate, which combines before the shuffle."""
    signed = -F.col(score) if largest else F.col(score)
    rank = F.struct(signed, *order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), rank).alias("_best")).select(*keys, "_best.*")


def first_k(df: DataFrame, keys: Sequence[str], k: int, order: Sequence[Column | str]) -> DataFrame:
    """At most k rows of each key in order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def score_histogram(df: DataFrame, score: str, places: int = 3) -> DataFrame:
    """(bin, n, p): scores rounded after a nudge of a tenth of a bin. Bins number at most 10^places for each unit of score."""
    counts = df.groupBy(half_away(F.col(score) + 0.1 / 10**places, places).alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select("bin", "n", (F.col("n") / F.col("_t")).alias("p"))  # one row


def empirical_cdf(df: DataFrame, score: str, places: int = 3) -> DataFrame:
    """(bin, n, p, cdf) over the binned scores."""
    rows = score_histogram(df, score, places)
    below = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # bins only
    return rows.withColumn("cdf", below / F.sum("n").over(Window.partitionBy()))  # whole counts, so that no rounding adds up


def cdf_cut(df: DataFrame, score: str, dy: float, most: float, places: int = 3) -> DataFrame:
    """One row (cutoff, n): the largest bin with score <= most and cdf <= dy + 0.5, else the first bin if it is <= most; n counts scores up to it."""
    cdf = empirical_cdf(df, score, places)
    pick = cdf.agg(F.max(F.when((F.col("bin") <= most) & (F.col("cdf") <= dy + 0.5), F.col("bin"))).alias("a"), F.min("bin").alias("b"))
    cut = pick.select(F.coalesce("a", F.when(F.col("b") <= most, F.col("b"))).alias("cutoff"))
    return df.select(F.col(score).alias("_s")).join(F.broadcast(cut)).groupBy("cutoff").agg(F.count_if(F.col("_s") <= F.col("cutoff")).alias("n"))  # one row


def split_ranked(df: DataFrame, order: Sequence[str], cut: int, ends: str = "low") -> DataFrame:
    """positive = the rank lies within the cut from the low end, the high end or both."""
    total = df.agg(F.count("*").alias("_total"))
    w = Window.orderBy(*order)
    rows = df.withColumn("rank", F.row_number().over(w)).join(F.broadcast(total))  # one row
    low, high = F.col("rank") <= cut, F.col("rank") > F.col("_total") - cut
    return rows.withColumn("positive", {"low": low, "high": high, "both": low | high}[ends]).drop("_total")


def greedy_dedupe(df: DataFrame, keys: Sequence[str], spread: int, order: Sequence[str]) -> DataFrame:
    """Hits in order; one whose start and end both lie within spread of a kept hit of the same keys is dropped.

    Sequential by nature, so each key's hits are streamed in order through one task; only kept hits near the current start are remembered when order begins with start.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), kind="stable")
        kept: list[tuple[int, int]] = []
        take = []
        for s, e in zip(rows["start"], rows["end"], strict=True):
            fresh = not any(abs(s - a) <= spread and abs(e - b) <= spread for a, b in reversed(kept))
            take.append(fresh)
            if fresh:
                kept.append((s, e))
        return rows[take]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap: float) -> DataFrame:
    """The declarative companion of greedy_dedupe: runs of rows no further than gap apart get one session number."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    return df.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(w.rangeBetween(Window.unboundedPreceding, 0)))


def ranked_power(df: DataFrame, score: str, length: str, k: int = 10) -> DataFrame:
    """The k rows of least score ^ ln(length)."""
    return df.withColumn("value", F.pow(F.col(score), F.log(F.col(length)))).orderBy("value", length).limit(k)


def greedy_keepers(df: DataFrame, block: Sequence[str], seq: str, order: Sequence[str], shorter: float = 0.7, identity: float = 0.9) -> DataFrame:
    """A non-redundant set by longest first: a sequence goes if a kept one of its block repeats it (same test as similarity.redundant)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_n=rows[seq].str.len()).sort_values(["_n", *order], ascending=[False, *[True] * len(order)], kind="stable")
        kept: list[str] = []
        take = []
        for s in rows[seq]:
            fresh = not any(len(s) > shorter * len(q) and abs(_edits(q, s) - len(q)) / len(q) >= identity for q in kept)
            take.append(fresh)
            if fresh:
                kept.append(s)
        return rows[take].drop(columns="_n")

    return df.groupBy(*block).applyInPandas(run, df.schema)


def _edits(a: str, b: str) -> int:
    import numpy as np

    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, c in enumerate(x, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != c))
        new = np.concatenate([[i], new]) - steps
        row = np.minimum.accumulate(new) + steps
    return int(row[-1])


def edit_distances(df: DataFrame, a: str, b: str) -> DataFrame:
    """Edit distance of two ARRAY columns, by a vectorised table in batches (strings have a built-in one)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            codes: dict = {}
            text = lambda v: "".join(chr(256 + codes.setdefault(x, len(codes))) for x in v)
            yield rows.assign(distance=[_edits(text(x), text(y)) for x, y in zip(rows[a], rows[b], strict=True)])

    return df.mapInPandas(run, df.select("*", F.lit(0).cast("long").alias("distance")).schema)
