"""Frequencies and distributions in long form: (group columns, item, n, p).

Everything is one explode and one grouped count, so counting combines before the shuffle; probabilities divide by window totals over
the already counted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.arrays import reversible
from ..functions.similarity import ngrams


def items_of(df: DataFrame, items: Column, by: Sequence[str] = ()) -> DataFrame:
    """One row for each item of an array column."""
    return df.select(*by, F.explode(items).alias("item"))


def frequencies(df: DataFrame, items: Column, by: Sequence[str] = ()) -> DataFrame:
    return items_of(df, items, by).groupBy(*by, "item").agg(F.count("*").alias("n"))


def with_probabilities(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """counts (by, item, n) with p: within each group, or over everything from one total row."""
    if by:
        return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).select(*counts.columns, (F.col("n") / F.col("_total")).alias("p"))  # one row


def ngram_frequencies(df: DataFrame, text: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Sliding n-gram counts of a text column; texts shorter than n give none."""
    return frequencies(df, ngrams(text, n), by)


def ngram_probabilities(df: DataFrame, text: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    return with_probabilities(ngram_frequencies(df, text, n, by), by)


def alphabet(df: DataFrame, text: str, n: int = 1) -> DataFrame:
    """Distinct n-grams."""
    return items_of(df, ngrams(text, n)).distinct()


def grouped_with_totals(df: DataFrame, items: Column, group: str) -> DataFrame:
    """Counts for each group and over all of them (group null, level 'all'), in one pass of grouping sets, with probabilities in each level."""
    rows = items_of(df, items, [group])
    out = rows.groupingSets([[F.col(group), F.col("item")], [F.col("item")]], F.col(group), F.col("item")).agg(F.count("*").alias("n"), F.grouping(group).alias("_all"))
    out = out.withColumn("level", F.when(F.col("_all") == 1, "all").otherwise("group")).drop("_all")
    return out.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("level", group)))


def combination_frequencies(df: DataFrame, text: str, key: str, by: Sequence[str], symmetric: bool = True) -> DataFrame:
    """Counts of all pairs of positions i < j of each text, by their characters; with `symmetric`, xy and yx are one item. key names the rows.

    Closed forms over a text's symbols instead of pairs, c(x) c(y) or C(c(x), 2), or in order the sum over the places of y of how many x
    came before: time L * alphabet and no row for each character. Each batch sends one row for each group and item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            found: dict[tuple, int] = {}
            for group, s in zip(groups, batch.column(len(by)).to_pylist(), strict=True):
                for item, n in _pairs_of(s or "", symmetric):
                    found[*group, item] = found.get((*group, item), 0) + n
            rows = list(zip(*found, strict=True)) or [[]] * (len(by) + 1)
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(rows, [*(batch.schema.field(c).type for c in by), pa.string()], strict=True)), pa.array(list(found.values()), pa.int64())], [*by, "item", "n"])

    schema = StructType([*(df.schema[c] for c in by), StructField("item", StringType()), StructField("n", LongType())])
    return df.select(*by, text).mapInArrow(run, schema).groupBy(*by, "item").agg(F.sum("n").alias("n"))


def _pairs_of(s: str, symmetric: bool) -> Iterator[tuple[str, int]]:
    symbols, codes = np.unique(np.frombuffer(s.encode("utf-32-le"), np.uint32), return_inverse=True)
    names, counts = [chr(c) for c in symbols], np.bincount(codes, minlength=len(symbols))
    if symmetric:
        each = ((x, y, int(counts[x]) * int(counts[y]) if x < y else int(counts[x]) * (int(counts[x]) - 1) // 2) for x in range(len(names)) for y in range(x, len(names)))
        yield from ((names[x] + names[y], n) for x, y, n in each if n)
        return
    for x in range(len(names)):
        at = codes == x
        before = np.cumsum(at) - at
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, codes, before)
        yield from ((names[x] + names[y], int(n)) for y, n in enumerate(sums) if n)


def merge_reversible(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of a key and its reverse, summed under the lesser of the two."""
    return counts.withColumn("item", reversible("item")).groupBy(*by, "item").agg(F.sum("n").alias("n"))


def without_gaps(dist: DataFrame, by: Sequence[str] = (), gaps: str = ".-") -> DataFrame:
    """Items without gap characters, renormalised."""
    kept = dist.filter(F.col("item") == F.translate("item", gaps, "")).drop("p")
    return with_probabilities(kept, by)


def expand_weights(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Each value as often as its weight says."""
    return df.select(F.explode(F.expr(f"array_repeat(`{value}`, cast(`{weight}` as int))")).alias(value))


def pivot_counts(df: DataFrame, row: str, column: str, condition: Column, values: list | None = None) -> DataFrame:
    """Counts of rows that meet a condition, names by columns."""
    return df.filter(condition).groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))


def base_pair_stats(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AU, UA, GC and CG counts of a pair distribution and their share of it."""
    total = F.sum("n")
    pair = lambda k: F.coalesce(F.sum(F.when(F.col("item") == k, F.col("n"))), F.lit(0)).cast("long")
    cols = [pair(k).alias(k.lower()) for k in ("AU", "UA", "GC", "CG")]
    share = (F.sum(F.when(F.col("item").isin("AU", "UA", "GC", "CG"), F.col("n")).otherwise(0)) / total).alias("paired")
    return counts.groupBy(*by).agg(*cols, share)


def background(df: DataFrame, text: str, n: int, file: str | None = None, symmetric: bool = False, gapless: bool = True, items: Callable[[str, int], Column] = ngrams) -> DataFrame:
    """The distribution over all files: one count with partial sums, optionally gapless and with reversible keys merged."""
    counts = frequencies(df, items(text, n))
    if symmetric:
        counts = merge_reversible(counts)
    return without_gaps(counts) if gapless else with_probabilities(counts)


def token_counts(df: DataFrame, text: str, separator: str = ",") -> DataFrame:
    return df.select(F.explode(F.split(text, separator)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def line_word_counts(df: DataFrame, text: str) -> DataFrame:
    """One row: words, numbers and lines of a table of lines."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    number = lambda w: w.rlike(r"^[0-9]+$")
    return df.select(
        F.size(F.filter(words, lambda w: ~number(w))).alias("w"), F.size(F.filter(words, lambda w: number(w))).alias("m"),
    ).agg(F.sum("w").alias("words"), F.sum("m").alias("numbers"), F.count("*").alias("lines"))
