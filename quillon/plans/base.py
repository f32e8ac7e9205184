"""Registration of queries with their SQL, and the derived tables that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(oracle: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return add

    return queries, sql, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# How both engines turn prose into RNA-like letters.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGUACGUACGUACGUACGUACGUAC"
RNA_SQL = f"regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGU]', '', 'g')"
ALIGNED_SQL = f"regexp_replace(translate(lower({{}}), '{LETTERS}', '{BASES}'), '[^ACGU]', '.', 'g')"


def rna(text: str = "text") -> Column:
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, BASES), "[^ACGU]", "")


def aligned(text: str) -> Column:
    """A text as a row of an alignment: RNA-like letters, gaps for all else."""
    return F.regexp_replace(F.translate(F.lower(text), LETTERS, BASES), "[^ACGU]", ".")


def r6(c: Column, name: str) -> Column:
    """A double rounded so that both engines' summation orders agree; -0.0 becomes 0.0."""
    return (F.round(c, 6) + 0.0).alias(name)


#: Added before rounding where values are ratios of small counts, so that a value halfway between two steps goes up in both engines.
HALFWAY = "1e-9"
