"""Set operations on entry tables (name, start, end, strand): exact, by name, fuzzy, with sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals
from ..functions.coords import slice_of


def entry_set(df: DataFrame, full: bool = True, columns: tuple[str, ...] = ("name", "start", "end", "strand")) -> DataFrame:
    """Distinct entries, or distinct names."""
    return df.select(*columns).distinct() if full else df.select(columns[0]).distinct()


def union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def intersect(*sets: DataFrame) -> DataFrame:
    """In all of the sets: one grouped count of the sets that hold a row, whatever their number."""
    columns = sets[0].columns
    tagged = reduce(DataFrame.unionByName, [s.select(*columns).distinct().withColumn("_set", F.lit(i)) for i, s in enumerate(sets)])
    return tagged.groupBy(*columns).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(sets)).drop("_n")


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    """In the first set and in none of the others."""
    return reduce(DataFrame.subtract, [o.select(*first.columns) for o in others], first.distinct())


def with_sequences(entries: DataFrame, genomes: DataFrame, rna: bool = False) -> DataFrame:
    """Entries with their sequences, by genome name; entries of unknown genomes drop out."""
    g = genomes.select(F.col("name"), F.col("seq").alias("_genome"))
    return entries.join(g, "name").withColumn("seq", slice_of("_genome", "start", "end", "strand", rna)).drop("_genome")


def set_operation(op: str, *sets: DataFrame, mode: str = "exact", full: bool = True, delta: int = 10, genomes: DataFrame | None = None) -> DataFrame:
    """op: union, intersect or difference; mode: exact, fuzzy or seqs (exact, then sequences from genomes)."""
    if mode == "fuzzy":
        fuzzy = {"union": intervals.fuzzy_union, "intersect": intervals.fuzzy_intersect, "difference": intervals.fuzzy_difference}[op]
        return reduce(lambda a, b: fuzzy(a, b, ["name", "strand"], delta), sets)
    exact = {"union": union, "intersect": intersect, "difference": difference}[op]
    out = exact(*(entry_set(s, full) for s in sets))
    if mode == "seqs":
        if genomes is None:
            raise ValueError("sequences need a genome table")
        return with_sequences(out, genomes)
    return out
