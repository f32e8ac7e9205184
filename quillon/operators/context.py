"""Sequence-conservation context engine: Markov reconstruction of n-gram dictionaries, relative entropies, profiles and candidate filters.

Dictionaries are long tables (group, item, n, p); one profile row for each gram, one candidate's distance by one join on grams.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import ngrams
from .counting import ngram_probabilities
from .info import clamp

# By run number, how far the score distribution is followed and the largest score accepted.
CUT_SHARE = {1: 0.3, 2: 0.25, 3: 0.2, 4: 0.1, 5: 0.0}
CUT_SHARE_LATER = -0.1
CUT_SCORE = {1: 0.953, 2: 0.94, 3: 0.935, 4: 0.93}
CUT_SCORE_LATER = 0.927
HIT_ONLY = (0.4, 0.7)


def dictionary(df: DataFrame, text: str, n: int, by: Sequence[str]) -> DataFrame:
    return ngram_probabilities(df, text, n, by)


def sentinel_dictionary(df: DataFrame, text: str, n: int, by: Sequence[str], mark: str = "X") -> DataFrame:
    """Counts with a sentinel after each text, and those without the grams that hold it under `plain`."""
    rows = df.select(*by, F.explode(ngrams(F.concat(F.col(text), F.lit(mark)), n)).alias("item")).groupBy(*by, "item").agg(F.count("*").alias("n"))
    return rows.withColumn("plain", ~F.col("item").endswith(mark))


def marginal(counts: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Counts of (n-1)-grams from those of n-grams with sentinels: the last symbol summed out."""
    return counts.groupBy(*by, F.substring("item", 1, n - 1).alias("item")).agg(F.sum("n").alias("n"))


def expected(shorter: DataFrame, shortest: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """Reconstructed n-grams: p(x1..xn-1) p(x2..xn) / p(x2..xn-1), where all three occur; renormalised."""
    middle = F.substring("item", 2, n - 2)
    left = shorter.select(*by, F.col("item").alias("_l"), F.col("p").alias("_pl"), middle.alias("_m"))
    right = shorter.select(*by, F.col("item").alias("_r"), F.col("p").alias("_pr"), F.substring("item", 1, n - 2).alias("_m"))
    mid = shortest.select(*by, F.col("item").alias("_m"), F.col("p").alias("_pm"))
    rows = left.join(right, [*by, "_m"]).join(mid, [*by, "_m"])
    out = rows.select(*by, F.concat("_l", F.substring("_r", n - 1, 1)).alias("item"), (F.col("_pl") * F.col("_pr") / F.col("_pm")).alias("w"))
    return out.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(*by))).drop("w") if by else out.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).drop("w")


def reconstruct(df: DataFrame, text: str, n: int, by: Sequence[str]) -> DataFrame:
    return expected(dictionary(df, text, n - 1, by), dictionary(df, text, n - 2, by), n, by)


def relative_entropies(df: DataFrame, text: str, lengths: Sequence[int], by: Sequence[str]) -> DataFrame:
    """(by, k, kld): observed against reconstructed k-grams, each k. Terms without both sides count 0; small negatives become 0."""
    out = None
    for k in lengths:
        seen = dictionary(df, text, k, by).select(*by, "item", F.col("p").alias("_p"))
        both = seen.join(reconstruct(df, text, k, by).select(*by, "item", F.col("p").alias("_q")), [*by, "item"])
        part = both.groupBy(*by).agg(clamp(F.sum(F.col("_p") * F.log2(F.col("_p") / F.col("_q")))).alias("kld")).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def cumulative_relative_entropy(df: DataFrame, text: str, lengths: Sequence[int], by: Sequence[str]) -> DataFrame:
    """(by, l, cre): the sum over k >= l of relative_entropies, as far as the lengths go."""
    w = Window.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return relative_entropies(df, text, lengths, by).withColumn("cre", F.sum(F.greatest("kld", F.lit(0.0))).over(w)).select(*by, F.col("k").alias("l"), "cre")


def limit_entropy(df: DataFrame, text: str, n: int, by: Sequence[str], letters: int = 4) -> DataFrame:
    """(H(n) - H(n-1)) / log2(letters), -1 where there are no n-grams; and informativity, n log2(letters) - H(n)."""
    h = lambda k: dictionary(df, text, k, by).groupBy(*by).agg(F.sum(-F.col("p") * F.log2("p")).alias(f"h{k}"))
    both = h(n - 1).join(h(n), list(by), "left")
    return both.select(*by, F.coalesce((F.col(f"h{n}") - F.col(f"h{n - 1}")) / math.log2(letters), F.lit(-1.0)).alias("limit_entropy"), (n * math.log2(letters) - F.col(f"h{n}")).alias("informativity"))


def information_capacity(df: DataFrame, text: str, n: int, by: Sequence[str]) -> DataFrame:
    """Jensen-Shannon divergence of observed and reconstructed n-grams."""
    from .info import lambda_divergence

    return lambda_divergence(dictionary(df, text, n, by), reconstruct(df, text, n, by), 0.5, by=by).withColumnRenamed("divergence", "capacity")


def hybrid_profile(df: DataFrame, text: str, n: int, key: str) -> DataFrame:
    """(item, p): the mean over sequences of their n-gram distributions."""
    dist = dictionary(df, text, n, [key])
    many = df.filter(F.length(text) >= n).agg(F.count("*").alias("_m"))
    return dist.groupBy("item").agg(F.sum("p").alias("_s")).join(F.broadcast(many)).select("item", (F.col("_s") / F.col("_m")).alias("p"))  # one row


def profile_distances(df: DataFrame, text: str, n: int, key: str, profile: DataFrame) -> DataFrame:
    """(key, re): Jensen-Shannon divergence of each sequence and the profile.

    Joined on shared grams only: JS = 1 + sum over shared of [p log p + q log q - (p + q) log (p + q)] / 2; sequences that share none get 1.
    """
    dist = dictionary(df, text, n, [key])
    f = lambda x: x * F.log2(x)
    q = profile.select("item", F.col("p").alias("_q"))
    near = dist.join(q, "item").groupBy(key).agg((1 + F.sum(f(F.col("p")) + f(F.col("_q")) - f(F.col("p") + F.col("_q"))) / 2).alias("_re"))
    return df.filter(F.length(text) >= n).select(key).distinct().join(near, key, "left").select(key, clamp(F.coalesce("_re", F.lit(1.0))).alias("re"))


def cut_parameters(run: int, delta: int) -> tuple[float, float]:
    """(share, score) of a run; a delta of 0 is the hit-only phase."""
    if delta == 0:
        return HIT_ONLY
    return CUT_SHARE.get(run, CUT_SHARE_LATER), CUT_SCORE.get(run, CUT_SCORE_LATER)


def candidate_filter(seeds: DataFrame, candidates: DataFrame, text: str, n: int, key: str, run: int, delta: int) -> DataFrame:
    """candidates with re and good: at or below the cut of their score distribution."""
    from .windows import cdf_cut

    scored = profile_distances(candidates, text, n, key, hybrid_profile(seeds, text, n, key))
    share, most = cut_parameters(run, delta)
    cut = cdf_cut(scored, "re", share, most).select("cutoff")
    return scored.join(F.broadcast(cut)).select(key, "re", F.coalesce(F.col("re") <= F.col("cutoff"), F.lit(False)).alias("good"))  # one row


def word_size(df: DataFrame, text: str, lengths: Sequence[int], key: str, cut: float = 0.10) -> int:
    """The word size at which cumulative relative entropy falls under the cut, folded over sequences as (so far + first) / 2 from 0, rounded up."""
    cre = cumulative_relative_entropy(df, text, lengths, [key])
    firsts = cre.filter(F.col("cre") < cut).groupBy(key).agg(F.min("l").alias("l")).agg(F.array_sort(F.collect_list(F.struct(key, "l"))).alias("all"))
    fold = F.aggregate("all", F.lit(0.0), lambda a, x: (a + x["l"]) / 2)
    return int(firsts.select(F.ceil(fold)).first()[0] or 0)


def context_sizes(low: int = 0, count: int = 81, step: int = 20) -> list[int]:
    return [low + step * i for i in range(count)]


def best_context(sequences: DataFrame, sizes: Sequence[int], n: int, k: int = 10) -> DataFrame:
    """(size, re, score) of the best context sizes: texts (key, context) are cut to each size, and the mean distance to their own profile is ranked by re ^ ln(size)."""
    rows = sequences.select("key", F.explode(F.array(*map(F.lit, sizes))).alias("size"), "context").select("size", "key", F.expr("substring(context, 1, size)").alias("t"))
    dist = dictionary(rows.filter(F.length("t") >= n), "t", n, ["size", "key"])
    many = rows.filter(F.length("t") >= n).groupBy("size").agg(F.count("*").alias("_m"))
    q = dist.groupBy("size", "item").agg(F.sum("p").alias("_s")).join(F.broadcast(many), "size").select("size", "item", (F.col("_s") / F.col("_m")).alias("_q"))  # one row for each size
    f = lambda x: x * F.log2(x)
    re = dist.join(q, ["size", "item"]).groupBy("size", "key").agg((1 + F.sum(f(F.col("p")) + f(F.col("_q")) - f(F.col("p") + F.col("_q"))) / 2).alias("re"))
    return re.groupBy("size").agg(F.avg("re").alias("re")).withColumn("score", F.pow("re", F.log(F.col("size") + 1))).orderBy("score", "size").limit(k)


def neighbour_counts(n: int) -> list[int]:
    """The k values to try for n sequences in neighbour clustering."""
    return list(range(2, 2 + max(1, min(8, n // 5))))


def merge_by_size(clusters: DataFrame) -> DataFrame:
    """Clusters (cluster, size, members) of equal context size, together."""
    return clusters.groupBy("size").agg(F.sort_array(F.collect_set("cluster")).alias("clusters"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))


def saved_sizes(annotations: DataFrame) -> DataFrame:
    """(file, size) from the CTXSZ header of alignments."""
    rows = annotations.filter((F.col("tag") == "GF") & (F.upper("key") == "CTXSZ"))
    return rows.groupBy("file").agg(F.max(F.regexp_extract("value", r"([0-9]+)", 1).try_cast("int")).alias("size"))


def annotation_size(hits: DataFrame, features: DataFrame, margin: int = 0) -> DataFrame:
    """(name, size): the distance from each hit to the nearest feature end past it, plus a margin, rounded up to a hundred."""
    from .intervals import nearest_before

    mirrored = hits.select("name", (-F.col("end")).alias("at"))
    ends = features.select("name", (-F.col("end")).alias("mark"))
    near = nearest_before(mirrored, ends, ["name"], "at", "mark")
    return near.filter("nearest is not null").select("name", (F.ceil((F.col("at") - F.col("nearest") + margin) / 100) * 100).alias("size"))


def write_clusters(sequences: DataFrame, clusters: DataFrame, path: str) -> None:
    """Sequences (key, seq) in one folder for each cluster."""
    rows = sequences.join(clusters, "key").select("cluster", F.concat(F.lit(">"), F.col("key").cast("string"), F.lit("\n"), "seq").alias("value"))
    rows.write.mode("overwrite").partitionBy("cluster").text(path)


def aggregate(all_entries: DataFrame, *accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that any cluster accepted, and the others."""
    from .setops import difference, union

    good = union(*(a.select(*all_entries.columns) for a in accepted))
    return good, difference(all_entries, good)


def compare_rankings(scored: DataFrame, key: str, score: str, evalue: str, cut: int) -> DataFrame:
    """(both, score_only, evalue_only): how the first `cut` by score and by e-value overlap."""
    best = lambda c, name: scored.orderBy(c, key).limit(cut).select(key, F.lit(True).alias(name))
    rows = best(score, "_s").join(best(evalue, "_e"), key, "full_outer")
    return rows.agg(F.count_if(F.col("_s") & F.col("_e")).alias("both"), F.count_if(F.col("_s") & F.col("_e").isNull()).alias("score_only"), F.count_if(F.col("_e") & F.col("_s").isNull()).alias("evalue_only"))
