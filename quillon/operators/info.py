"""Entropies and divergences over rows (columns are the variables) and over long-form distributions (group, item, p).

Several entropies of one table come from one pass of grouping sets over counts: the counts of all variables together are made first,
so the sets expand counted rows, not input rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-10


def _log(x: Column, base: float) -> Column:
    return F.log2(x) if base == 2 else F.log(float(base), x)


def clamp(x: Column) -> Column:
    """Tiny negatives from rounding become 0."""
    return F.when((x < 0) & (x > -TINY), 0.0).otherwise(x)


def entropy(p: str = "p", base: float = 2.0) -> Column:
    """Aggregate: -sum p log p with 0 log 0 = 0."""
    return F.sum(F.when(F.col(p) > 0, -F.col(p) * _log(F.col(p), base)).otherwise(0.0))


def entropies(df: DataFrame, variables: Sequence[str], sets: Sequence[Sequence[str]], by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """One row for each group with a column h_<set> for each set of variables: H = log N - sum(n log n) / N."""
    counts = df.groupBy(*by, *variables).agg(F.count("*").alias("_n"))
    names = ["_".join(s) for s in sets]
    grouped = counts.groupingSets([[*map(F.col, by), *map(F.col, s)] for s in sets], *map(F.col, [*by, *variables])).agg(F.sum("_n").alias("_c"), F.grouping_id(*[F.col(c) for c in [*by, *variables]]).alias("_g"))
    columns = [*by, *variables]
    code = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in by and c not in s) for name, s in zip(names, sets, strict=True)}
    out = []
    for name in names:
        c = F.when(F.col("_g") == code[name], F.col("_c"))
        out.append((_log(F.sum(c), base) - F.sum(c * _log(c, base)) / F.sum(c)).alias(f"h_{name}"))
    return grouped.groupBy(*by).agg(*out)


def shannon_entropy(df: DataFrame, variable: str, by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    return entropies(df, [variable], [[variable]], by, base).withColumnRenamed(f"h_{variable}", "entropy")


def joint_entropy(df: DataFrame, variables: Sequence[str], by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    return entropies(df, variables, [list(variables)], by, base).withColumnRenamed("h_" + "_".join(variables), "joint_entropy")


def conditional_entropy(df: DataFrame, x: str, y: str, by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """H(X | Y) = H(X, Y) - H(Y)."""
    h = entropies(df, [x, y], [[x, y], [y]], by, base)
    return h.select(*by, (F.col(f"h_{x}_{y}") - F.col(f"h_{y}")).alias("conditional_entropy"))


def mutual_information(df: DataFrame, x: str, y: str, by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """I(X; Y), and the variation 1 - I / H(X, Y), null where the joint entropy is 0."""
    h = entropies(df, [x, y], [[x, y], [x], [y]], by, base)
    mi = clamp(F.col(f"h_{x}") + F.col(f"h_{y}") - F.col(f"h_{x}_{y}"))
    joint = F.col(f"h_{x}_{y}")
    return h.select(*by, mi.alias("mutual_information"), joint.alias("joint_entropy"), F.when(joint != 0, 1 - mi / joint).alias("variation_information"))


def conditional_mutual_information(df: DataFrame, x: str, y: str, z: str, by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """I(X; Y | Z) = H(X, Z) + H(Y, Z) - H(X, Y, Z) - H(Z)."""
    h = entropies(df, [x, y, z], [[x, z], [y, z], [x, y, z], [z]], by, base)
    value = clamp(F.col(f"h_{x}_{z}") + F.col(f"h_{y}_{z}") - F.col(f"h_{x}_{y}_{z}") - F.col(f"h_{z}"))
    return h.select(*by, value.alias("conditional_mutual_information"))


def total_correlation(df: DataFrame, variables: Sequence[str], by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """Sum of the single entropies less the joint one."""
    h = entropies(df, variables, [*([v] for v in variables), list(variables)], by, base)
    single = sum((F.col(f"h_{v}") for v in variables[1:]), F.col(f"h_{variables[0]}"))
    return h.select(*by, clamp(single - F.col("h_" + "_".join(variables))).alias("total_correlation"))


def interaction_information(df: DataFrame, variables: Sequence[str], by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """-sum over non-empty subsets of (-1)^(n - size) H(subset): the cube of the variables."""
    n = len(variables)
    sets = [list(s) for k in range(1, n + 1) for s in combinations(variables, k)]
    h = entropies(df, variables, sets, by, base)
    value = sum((F.col("h_" + "_".join(s)) * float(-((-1) ** (n - len(s)))) for s in sets), F.lit(0.0))
    return h.select(*by, value.alias("interaction_information"))


def conditional_probability(df: DataFrame, x: str, y: str) -> DataFrame:
    """P(x | y) of each pair that occurs."""
    counts = df.groupBy(x, y).agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(y)))


def joint_probability(df: DataFrame, x: str, y: str, symmetric: bool = False) -> DataFrame:
    """P(x, y); with `symmetric`, pairs without order."""
    rows = df.select(F.least(x, y).alias(x), F.greatest(x, y).alias(y)) if symmetric else df
    counts = rows.groupBy(x, y).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).select(x, y, "n", (F.col("n") / F.col("_t")).alias("p"))  # one row


def relative_entropy(p: DataFrame, q: DataFrame, key: str = "item", by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """KLD over the union of keys, where terms with either side 0 count 0, as the reference defines it; tiny negatives become 0. A group of either side has a row.

    A clearly negative result (possible since terms drop out) comes with negative = true instead of an exception.
    """
    both = p.select(*by, key, F.col("p").alias("_p")).join(q.select(*by, key, F.col("p").alias("_q")), [*by, key], "full_outer")
    term = F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_p") * _log(F.col("_p") / F.col("_q"), base)).otherwise(0.0)
    value = F.coalesce(F.sum(term), F.lit(0.0))
    return both.groupBy(*by).agg(clamp(value).alias("kld"), (value <= -TINY).alias("negative"))


def lambda_divergence(p: DataFrame, q: DataFrame, lam: float = 0.5, key: str = "item", by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """lam D(P | M) + (1 - lam) D(Q | M), M = lam P + (1 - lam) Q; Jensen-Shannon at 0.5 and base 2."""
    both = p.select(*by, key, F.col("p").alias("_p")).join(q.select(*by, key, F.col("p").alias("_q")), [*by, key], "full_outer")
    a, b = F.coalesce("_p", F.lit(0.0)), F.coalesce("_q", F.lit(0.0))
    m = lam * a + (1 - lam) * b
    term = lam * F.when(a > 0, a * _log(a / m, base)).otherwise(0.0) + (1 - lam) * F.when(b > 0, b * _log(b / m, base)).otherwise(0.0)
    return both.groupBy(*by).agg(clamp(F.sum(term)).alias("divergence"))


def jensen_shannon_pairs(dist: DataFrame, group: str, key: str = "item") -> DataFrame:
    """Jensen-Shannon divergence of every pair of groups of one distribution table.

    Only shared keys are joined; a key on one side adds p / 2 bits, so JS = 1 + sum over shared of [p log p + q log q - (p + q) log (p + q)] / 2.
    Groups are few against keys; every key holds at most one row for each group. Pairs without a shared key come out as 1.
    """
    left = dist.select(F.col(group).alias("a"), key, F.col("p").alias("_p"))
    right = dist.select(F.col(group).alias("b"), key, F.col("p").alias("_q"))
    f = lambda x: x * F.log2(x)
    shared = left.join(right, key).filter("a < b").groupBy("a", "b").agg((F.sum(f(F.col("_p")) + f(F.col("_q")) - f(F.col("_p") + F.col("_q"))) / 2 + 1).alias("_js"))
    names = dist.select(group).distinct()
    pairs = names.select(F.col(group).alias("a")).join(names.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", clamp(F.coalesce("_js", F.lit(1.0))).alias("divergence"))


def lod_scores(df: DataFrame, x: str, y: str) -> DataFrame:
    """log2 of the joint over the product of the single probabilities, for each pair that occurs."""
    counts = df.groupBy(x, y).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    px = F.sum("n").over(Window.partitionBy(x))
    py = F.sum("n").over(Window.partitionBy(y))
    rows = counts.withColumn("_x", px).withColumn("_y", py).join(F.broadcast(total))  # one row
    return rows.select(x, y, F.log2(F.col("n") * F.col("_t") / (F.col("_x") * F.col("_y"))).alias("lod"))
