"""Alignments as rows (name, seq) of equal length: columns, gap filters, entropies and information between columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import gap_fraction
from .counting import without_gaps, with_probabilities
from .info import clamp


def cells(aln: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """(name, col, ch), col from 0."""
    return aln.select(F.col(name).alias("name"), F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("col", "ch"))


def columns_of(aln: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """The transposed alignment: one string for each column, in row order; columns beyond the shortest row are left out."""
    shortest = aln.agg(F.min(F.length(seq)).alias("_w"))
    rows = cells(aln, name, seq).join(F.broadcast(shortest)).filter("col < _w")  # one row
    return rows.groupBy("col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "ch"))), lambda s: s["ch"]), "").alias("seq"))


def few_gaps(seqs: DataFrame, most: float, seq: str = "seq") -> DataFrame:
    """Sequences whose gap share is strictly below `most`."""
    return seqs.filter(gap_fraction(seq) < most)


def column_entropy(aln: DataFrame, gapless: bool = True, name: str = "name", seq: str = "seq") -> DataFrame:
    """(col, entropy, n): Shannon entropy of each column's symbols in bits."""
    counts = cells(aln, name, seq).groupBy("col", F.col("ch").alias("item")).agg(F.count("*").alias("n"))
    dist = without_gaps(counts, ["col"]) if gapless else with_probabilities(counts, ["col"])
    return dist.groupBy("col").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.sum("n").alias("n"))


def pair_counts(aln: DataFrame, gapless: bool = True, name: str = "name", seq: str = "seq") -> DataFrame:
    """(i, j, item, n): symbol pairs of each two columns i < j, rows with a gap in either left out. An alignment's width bounds the pairs of a row."""
    c = cells(aln, name, seq)
    if gapless:
        c = c.filter(~F.col("ch").isin(".", "-"))
    left = c.select("name", F.col("col").alias("i"), F.col("ch").alias("a"))
    right = c.select("name", F.col("col").alias("j"), F.col("ch").alias("b"))
    return left.join(right, "name").filter("i < j").groupBy("i", "j", "a", "b").agg(F.count("*").alias("n"))


def column_information(aln: DataFrame, gapless: bool = True, name: str = "name", seq: str = "seq") -> DataFrame:
    """(i, j, mutual_information, joint_entropy, variation) of each column pair, in nats, over the rows that have both symbols.

    From the pair counts alone: each column's counts within a pair are sums over the other's symbols.
    """
    pairs = pair_counts(aln, gapless, name, seq)
    h = lambda n: F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)
    n = F.col("n").cast("double")
    joint = pairs.groupBy("i", "j").agg(h(n).alias("hxy"))
    hx = pairs.groupBy("i", "j", "a").agg(F.sum(n).alias("m")).groupBy("i", "j").agg(h(F.col("m")).alias("hx"))
    hy = pairs.groupBy("i", "j", "b").agg(F.sum(n).alias("m")).groupBy("i", "j").agg(h(F.col("m")).alias("hy"))
    rows = joint.join(hx, ["i", "j"]).join(hy, ["i", "j"])
    mi = clamp(F.col("hx") + F.col("hy") - F.col("hxy"))
    return rows.select("i", "j", mi.alias("mutual_information"), F.col("hxy").alias("joint_entropy"), F.when(F.abs("hxy") > 1e-12, 1 - mi / F.col("hxy")).otherwise(0.0).alias("variation"))


def degapped_pair(a: str, b: str, gaps: str = ".-") -> list:
    """Two Columns: strings without every place at which either has a gap."""
    zipped = F.filter(F.arrays_zip(F.split(F.col(a), "").alias("x"), F.split(F.col(b), "").alias("y")), lambda p: ~p["x"].isin(*gaps) & ~p["y"].isin(*gaps))
    return [F.array_join(F.transform(zipped, lambda p: p[k]), "") for k in ("x", "y")]
