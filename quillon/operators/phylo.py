"""Grouping by lineage and thinning of redundant members."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import greedy_keepers


def at_level(df: DataFrame, level: int, lineage: str = "ancestors") -> DataFrame:
    """df with `taxon`: the ancestor `level` steps above the last, the first where the lineage is shorter."""
    parts = F.split(lineage, ", ")
    return df.withColumn("taxon", F.when(F.size(parts) > level, F.element_at(parts, F.lit(-(level + 1)))).otherwise(F.element_at(parts, 1)))


def large_groups(df: DataFrame, most: int, by: str = "taxon") -> DataFrame:
    """Groups with more than `most` rows and their sizes."""
    return df.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > most)


def group_by_taxon(df: DataFrame, name: str, cutoff: int = 100, lineage: str = "ancestors", levels: int = 20, least: int = 3) -> DataFrame:
    """(name, taxon, level): each row is grouped at the lowest level where its group is larger than the cutoff; the cutoff halves over what is left until below `least`, and the rest form their top groups."""
    left, out = df, None
    while cutoff >= least:
        for level in range(1, levels + 1):
            rows = at_level(left, level, lineage)
            big = rows.join(large_groups(rows, cutoff).select("taxon"), "taxon", "left_semi").select(name, "taxon", F.lit(level).alias("level"))
            out = big if out is None else out.union(big)
            left = left.join(big.select(name), name, "left_anti")
            if level % 5 == 0:
                from .graph import settled

                left, out = settled(left), settled(out)
            if not left.limit(1).count():
                return out
        cutoff //= 2
    return out.union(at_level(left, levels, lineage).select(name, "taxon", F.lit(levels).alias("level")))


def merge_small(df: DataFrame, by: str, order: str, size: str, enough: int = 200, floor: int = 50) -> DataFrame:
    """Sub-clusters of a taxon merged in order while the sum stays below `enough` or the next is smaller than `floor`: adds `merged`, the merged cluster's number."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        merged, total, out = 0, 0, []
        for n in rows[size]:
            if total and total + n >= enough and n >= floor:
                merged, total = merged + 1, 0
            total += n
            out.append(merged)
        return rows.assign(merged=out)

    return df.groupBy(by).applyInPandas(run, df.select("*", F.lit(0).cast("long").alias("merged")).schema)


def non_redundant(df: DataFrame, cluster: str, seq: str, name: str, identity: float = 0.9) -> DataFrame:
    """Per cluster, the greedy non-redundant members, longest first."""
    return greedy_keepers(df, [cluster], seq, [name], identity=identity)


def shuffles(df: DataFrame, seq: str, limit: int, seed: int) -> DataFrame:
    """(row columns, nth, shuffled): up to `limit` distinct shuffles of each sequence with the same dinucleotide counts.

    Each is an Euler walk over the sequence's letters as a multigraph: the last edges out of each letter form a random tree into the end, the others are shuffled.
    """
    import random

    def shuffle(s: str, draw: random.Random) -> str | None:
        out: dict[str, list[str]] = {}
        for a, b in zip(s, s[1:], strict=False):
            out.setdefault(a, []).append(b)
        for _ in range(200):
            last = {a: draw.choice(bs) for a, bs in out.items() if a != s[-1]}
            ok = True
            for a in last:
                seen, at = set(), a
                while at != s[-1] and at in last and at not in seen:
                    seen.add(at)
                    at = last[at]
                ok &= at == s[-1]
            if not ok:
                continue
            queues = {}
            for a, bs in out.items():
                rest = list(bs)
                if a in last:
                    rest.remove(last[a])
                draw.shuffle(rest)
                queues[a] = rest + ([last[a]] if a in last else [])
            walk = [s[0]]
            while queues.get(walk[-1]):
                walk.append(queues[walk[-1]].pop(0))
            if len(walk) == len(s):
                return "".join(walk)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = []
            for row in rows.itertuples(index=False):
                s = getattr(row, seq)
                draw = random.Random(f"{seed}:{s}")
                found = list(dict.fromkeys(x for x in (shuffle(s, draw) for _ in range(3 * limit)) if x)) if s else []
                made.extend((*row, k, x) for k, x in enumerate(found[:limit]))
            yield pd.DataFrame(made, columns=[*rows.columns, "nth", "shuffled"])

    return df.mapInPandas(run, df.select("*", F.lit(0).cast("long").alias("nth"), F.lit("").alias("shuffled")).schema)


def monte_carlo_hits(spark, samples: int, size: int, target: str, seed: int, parts: int = 8, alphabet: str = "ATGC") -> DataFrame:
    """One row (hits, total, frequency): how often an n-mer occurs in `samples` random sequences of `size` letters.

    Each batch of sample numbers draws its letters with numpy from a generator seeded by the number, so a lost task is redrawn alike.
    """
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = np.array([alphabet.index(c) for c in target], np.uint8)
        for rows in batches:
            hits = []
            for i in rows["id"]:
                s = np.random.default_rng([seed, int(i)]).integers(0, len(alphabet), size, dtype=np.uint8)
                found = np.ones(max(size - len(codes) + 1, 0), bool)
                for k, c in enumerate(codes):
                    found &= s[k : k + len(found)] == c
                hits.append(int(found.sum()))
            yield pd.DataFrame({"id": rows["id"], "hits": hits})

    each = spark.range(0, samples, 1, parts).mapInPandas(run, "id long, hits long")
    total = float(samples * max(size - len(target) + 1, 0))
    return each.agg(F.sum("hits").alias("hits")).select("hits", F.lit(int(total)).alias("total"), (F.col("hits") / F.lit(total)).alias("frequency"))
