"""Clustering: distances, nearest centres, k-means, neighbour graphs, validity indices.

Points are (id, v ARRAY<DOUBLE>); centres (cluster, center). The centres are few, k by parameter, and are broadcast by that bound.
All-pairs operators work on a table of points of a stated block key, so work is quadratic in a block only. Neighbours are found tile by tile
with matrix products; no pair is a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import euclid, mean_vector

Metric = Callable[[str, str], Column]


def pair_distances(points: DataFrame, metric: Metric = euclid, block: str | None = None) -> DataFrame:
    """(i, j, d) for i < j, within blocks if given; symmetric, so computed once."""
    a = points.select(F.col("id").alias("i"), F.col("v").alias("_a"), *([block] if block else []))
    b = points.select(F.col("id").alias("j"), F.col("v").alias("_b"), *([block] if block else []))
    pairs = a.join(b, block).filter("i < j") if block else a.join(b, F.col("i") < F.col("j"))
    return pairs.select("i", "j", metric("_a", "_b").alias("d"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def centers_table(spark: SparkSession, centers: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster int, center array<double>")


def assign(points: DataFrame, centers: DataFrame, metric: Metric = euclid) -> DataFrame:
    """points with their nearest centre and distance; the first centre wins ties. The centres come as one array in one broadcast row."""
    all_centers = centers.agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("_cs"))
    rows = points.join(F.broadcast(all_centers))  # one row of k centres
    ranked = F.array_min(F.transform("_cs", lambda c: F.struct(metric(F.col("v"), c["center"]).alias("d"), c["cluster"].alias("cluster"), c["center"].alias("center"))))
    return rows.withColumn("_n", ranked).select(*points.columns, F.col("_n.cluster").alias("cluster"), F.col("_n.center").alias("center"), F.col("_n.d").alias("d"))


def extreme(points: DataFrame, x: list[float], metric: Metric = euclid, farthest: bool = False) -> DataFrame:
    """The nearest (or farthest) point to x and its distance; the least id wins ties."""
    d = metric(F.col("v"), F.array(*map(F.lit, map(float, x))))
    rank = F.struct(-d if farthest else d, F.col("id"))
    return points.agg(F.min_by(F.struct("id", "v", d.alias("d")), rank).alias("b")).select("b.*")


def recenter(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(mean_vector("v").alias("center"))


def sum_squared_error(assigned: DataFrame) -> DataFrame:
    """(cluster, n, sse)."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("sse"))


def split_worst(assigned: DataFrame, metric: Metric = euclid, share: float = 0.8) -> DataFrame:
    """Two centres for the cluster of most error that has several points: the means of its points within and beyond `share` of its radius."""
    worst = sum_squared_error(assigned).filter("n > 1").orderBy(F.desc("sse"), "cluster").limit(1).select("cluster")
    rows = assigned.join(F.broadcast(worst), "cluster")
    radius = rows.agg(F.max("d").alias("_r"))
    rows = rows.join(F.broadcast(radius)).withColumn("_far", (F.col("d") > share * F.col("_r")).cast("int"))  # one row
    return rows.groupBy("_far").agg(F.first("cluster").alias("cluster"), mean_vector("v").alias("center"))


def kmeans(points: DataFrame, centers: list[list[float]], metric: Metric = euclid, rounds: int = 50) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd's iteration from given centres to a fixed point; a lost cluster is made up for by splitting the worst one.

    The driver holds the k centres only. Returns the assignment and the centres.
    """
    k, spark = len(centers), points.sparkSession
    for _ in range(rounds):
        assigned = assign(points, centers_table(spark, centers), metric)
        new = [list(r["center"]) for r in recenter(assigned).orderBy("cluster").collect()]
        while len(new) < k:
            again = assign(points, centers_table(spark, new), metric)
            worst = split_worst(again, metric).orderBy("_far").collect()
            if len(worst) < 2:
                break
            new[worst[0]["cluster"]] = list(worst[0]["center"])
            new.append(list(worst[1]["center"]))
        done = all(abs(a - b) < 1e-12 for x, y in zip(centers, new, strict=False) for a, b in zip(x, y, strict=True)) and len(new) == len(centers)
        centers = new
        if done:
            break
    return assign(points, centers_table(spark, centers), metric), centers


def seed_centers(points: DataFrame, k: int, seed: int, metric: Metric = euclid) -> list[list[float]]:
    """k-means++: each next centre by a seeded draw with weights of squared distance to the nearest so far (Gumbel keys, one pass each)."""
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit((1 << 30) - 1)) + 1) / float(1 << 30)
    first = points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(1).collect()
    centers = [list(map(float, r["v"])) for r in first]
    while first and len(centers) < k:
        rows = assign(points, centers_table(points.sparkSession, centers), metric).filter("d > 0")
        drawn = rows.orderBy(F.log(uniform(len(centers))) / (F.col("d") * F.col("d")), "id", ascending=[False, True]).limit(1).collect()
        if not drawn:
            break
        centers.append(list(map(float, drawn[0]["v"])))
    return centers


def kmeans_plus(points: DataFrame, k: int, seed: int = 1, metric: Metric = euclid) -> tuple[DataFrame, list[list[float]]]:
    return kmeans(points, seed_centers(points, k, seed, metric), metric)


def knn_graph(pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, d, rank): the k nearest of each point by (d, id), from one-way pair distances."""
    w = Window.partitionBy("i").orderBy("d", "j")
    return both_ways(pairs).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("i").alias("src"), F.col("j").alias("dst"), "d", "rank")


#: Points of a tile of queries and of a tile of their candidates, and tiles of queries of a block at most: each copies the block's candidates once.
QUERIES, CANDIDATES, COPIES = 2048, 32_768, 24


def _tiles(points: DataFrame, block: str | None) -> tuple[DataFrame, DataFrame]:
    """Points as queries and as candidates: (block, q, c, id, v), each query in every tile of its block's candidates and the other way round."""
    rows = points.select((F.col(block) if block else F.lit(0)).alias("block"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).dropna(subset=["block", "id"])
    sizes = rows.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > QUERIES)
    parts = lambda most: F.ceil(F.col("n") / most).cast("int")
    sizes = sizes.select("block", F.least(parts(QUERIES), F.greatest(F.lit(COPIES), parts(CANDIDATES))).alias("_q"), parts(CANDIDATES).alias("_c"))  # large blocks only, fewer than points / QUERIES
    sized = rows.join(F.broadcast(sizes), "block", "left").withColumns({"_q": F.coalesce("_q", F.lit(1)), "_c": F.coalesce("_c", F.lit(1))})
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = sized.select("block", own("_q").alias("q"), every("_c").alias("c"), "id", "v")
    candidates = sized.select("block", every("_q").alias("q"), own("_c").alias("c"), "id", "v")
    return queries.toDF(*queries.columns), candidates.toDF(*candidates.columns)  # columns of their own, as both come from one table


def _matrix(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix with 0 for missing places, and which places are there."""
    sizes, values = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten()
    there = np.arange(width) < sizes[:, None]
    out = np.zeros(there.shape)
    out[there] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    if values.null_count:
        there[there] = values.is_valid().to_numpy(zero_copy_only=False)
    return out, there


def _sequential_distances(a: np.ndarray, b: np.ndarray, both: np.ndarray | None) -> np.ndarray:
    """Euclidean distances of rows, summed from the first place to the last as the Column `euclid` does, so that equal distances are equal here too."""
    square = (a - b) ** 2 if both is None else np.where(both, (a - b) ** 2, 0.0)
    return np.sqrt(np.cumsum(square, axis=1)[:, -1]) if square.shape[1] else np.zeros(len(square))


def _nearest(query_ids: np.ndarray, a: np.ndarray, a_there: np.ndarray, ids: np.ndarray, b: np.ndarray, b_there: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, d, none): the k candidates of another id that are nearest to each query by (d, id), fewer where there are fewer. NaN comes late, pairs without a common place (none) last.

    A matrix product gives distances up to a rounding error; whatever lies within that error of the k-th is measured again, place by place. Copies of a vector are one
    column of the product: of each only the least ids can be among the nearest.
    """
    order = np.lexsort([ids])
    ids, b, b_there = ids[order], b[order], b_there[order]
    most = int(np.unique(ids, return_counts=True)[1].max(initial=1))  # rows of one id
    take = k + most  # enough once a query's own id is left out
    rows_of = lambda x, there: np.ascontiguousarray(np.hstack([x + 0.0, there])).view(np.dtype((np.void, 16 * x.shape[1]))).ravel()
    _, first, of = np.unique(rows_of(b, b_there), return_index=True, return_inverse=True)
    members = np.argsort(of, kind="stable")  # by vector, then by id
    sizes = np.bincount(of, minlength=len(first))
    begin = np.cumsum(sizes) - sizes
    x, x_there = b[first], b_there[first]
    whole = bool(a_there.all() and x_there.all())
    with np.errstate(all="ignore"):
        a2, x2 = a * a, x * x
        left, right = (a2.sum(axis=1), x2.sum(axis=1))
        slack = 1e-10 * (left[:, None].max(initial=0.0) + right.max(initial=0.0))
        out = [(query_ids[:0], ids[:0], np.zeros(0), np.zeros(0, bool))]
        step = max(1, (4 << 20) // max(1, len(x)))
        for at in range(0, len(a), step):
            part = slice(at, at + step)
            near = -2.0 * (a[part] @ x.T)
            near += left[part, None] + right if whole else a2[part] @ x_there.T.astype(float) + a_there[part].astype(float) @ x2.T
            unsure = ~np.isfinite(near)
            near[unsure] = np.inf
            if not whole:
                near[a_there[part].astype(np.float32) @ x_there.T.astype(np.float32) == 0] = np.inf
            limit = np.partition(near, take - 1, axis=1)[:, take - 1] + slack if near.shape[1] > take else np.full(len(near), np.inf)
            i, j = np.nonzero((near <= limit[:, None]) | unsure)
            both = None if whole else a_there[part][i] & x_there[j]
            exact = _sequential_distances(a[part][i], x[j], both)
            none = np.zeros(len(i), bool) if whole else ~both.any(axis=1)
            count = np.minimum(sizes[j], take)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found = ids[members[np.repeat(begin[j], count) + place]]
            i, exact, none = (np.repeat(each, count) for each in (i, exact, none))
            other = np.flatnonzero(found != query_ids[part][i])
            by = other[np.lexsort([found[other], exact[other], none[other], i[other]])]
            rank = np.arange(len(by)) - np.searchsorted(i[by], i[by])
            best = by[rank < k]
            out.append((query_ids[part][i[best]], found[best], exact[best], none[best]))
    return tuple(np.concatenate(each) for each in zip(*out, strict=True))


def _unmeasured(query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst): the k least ids besides each query's own, for pairs without a distance."""
    least = np.unique(ids)[: k + 1]
    src, dst = np.repeat(query_ids, len(least)), np.tile(least, len(query_ids))
    return src[src != dst], dst[src != dst]


def nearest_neighbours(points: DataFrame, k: int, block: str | None = None) -> DataFrame:
    """(block, src, dst, d, rank): what knn_graph gives for Euclidean pair distances, without a row for each pair. Block is the one that the row was found in.

    Exact, over all points of a block. Vectors without a common place (nulls, empty ones) have no distance (null), which comes last. A point with a null id or block has no neighbours and is none.
    """
    queries, candidates = _tiles(points, block)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = [t.column("v").combine_chunks() for t in (left, right)]
        width = max([1, *(int(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max(initial=0)) for v in lists)])
        (a, a_there), (b, b_there) = (_matrix(v, width) for v in lists)
        a_ids, b_ids = (t.column("id").to_numpy() for t in (left, right))
        known, measured = a_there.any(axis=1), b_there.any(axis=1)
        near = (a_ids[:0], b_ids[:0], np.zeros(0), np.zeros(0, bool))
        if known.any() and measured.any():
            near = _nearest(a_ids[known], a[known], a_there[known], b_ids[measured], b[measured], b_there[measured], k)
        rest = [(*_unmeasured(*pair, k),) for pair in ((a_ids[~known], b_ids), (a_ids[known], b_ids[~measured]))]
        src, dst = (np.concatenate(each) for each in zip(near[:2], *rest, strict=True))
        more = len(src) - len(near[0])
        name = (left if left.num_rows else right).column("block").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(src), np.int64)))
        return pa.table({"block": name, "src": src, "dst": dst, "d": pa.array(np.append(near[2], np.zeros(more)), mask=np.append(near[3], np.ones(more, bool)))})

    keys = ["block", "q", "c"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, f"block {queries.schema['block'].dataType.simpleString()}, src long, dst long, d double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.col("d").asc_nulls_last(), "dst")))  # few rows from each tile
    return ranked.filter(F.col("rank") <= k)


def reverse_knn(knn: DataFrame) -> DataFrame:
    """(id, n, sources): who has each point among its nearest."""
    return knn.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("src")).alias("sources"))


def split_by_degree(knn: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst) among points of in-degree >= k, and among the others; edges between the two are left out. In-degree 0 counts as other."""
    ids = knn.select(F.col("src").alias("id")).union(knn.select("dst")).distinct()
    degree = ids.join(knn.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", (F.coalesce("n", F.lit(0)) >= k).alias("core"))
    marked = knn.select("src", "dst").join(degree.select(F.col("id").alias("src"), F.col("core").alias("_s")), "src").join(degree.select(F.col("id").alias("dst"), F.col("core").alias("_d")), "dst")
    return marked.filter("_s and _d").select("src", "dst"), marked.filter("not _s and not _d").select("src", "dst")


def fold_outliers(knn: DataFrame, membership: DataFrame) -> DataFrame:
    """(id, cluster) for points outside any cluster: the cluster with most of their neighbours either way, the least on ties, else one of their own (their id negated, less 1)."""
    ids = knn.select(F.col("src").alias("id")).union(knn.select("dst")).distinct()
    out = ids.join(membership, "id", "left_anti")
    near = knn.select(F.col("src").alias("id"), F.col("dst").alias("near")).union(knn.select("dst", "src")).join(out, "id", "left_semi")
    votes = near.join(membership.withColumnRenamed("id", "near"), "near").groupBy("id", "cluster").agg(F.count("*").alias("n"))
    best = votes.groupBy("id").agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("cluster"))
    return membership.unionByName(out.join(best, "id", "left").select("id", F.coalesce("cluster", -F.col("id") - 1).alias("cluster")))


def krnn_clusters(points: DataFrame, k: int, metric: Metric = euclid, block: str | None = None) -> DataFrame:
    """(id, cluster): reverse-neighbour clustering: strong components of the core graph, then outliers folded in."""
    from .graph import settled, strong_components, strong_components_by_block

    if metric is not euclid:
        knn = settled(knn_graph(pair_distances(points, metric, block), k))
    else:
        knn = settled(nearest_neighbours(points, k, block))  # read by each of the steps below
    core, _ = split_by_degree(knn, k)
    several = knn.select("src", "block").distinct().groupBy("src").count().filter("count > 1") if metric is euclid else None
    if several is not None and several.limit(1).count() == 0:  # no id is in two blocks, so no edge joins blocks
        comps = strong_components_by_block(core.join(knn.select("src", "dst", "block"), ["src", "dst"]), "block")
    else:
        comps = strong_components(core)
    return fold_outliers(knn, comps.select("id", F.col("component").alias("cluster")))


def center_distances(centers: DataFrame, metric: Metric = euclid) -> DataFrame:
    """(a, b, d) of each two centres."""
    x = centers.select(F.col("cluster").alias("a"), F.col("center").alias("_a"))
    y = centers.select(F.col("cluster").alias("b"), F.col("center").alias("_b"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", metric("_a", "_b").alias("d"))  # k^2 rows


def intra_distances(assigned: DataFrame, metric: Metric = euclid) -> DataFrame:
    """(cluster, i, j, d) within each cluster."""
    a = assigned.select("cluster", F.col("id").alias("i"), F.col("v").alias("_a"))
    b = assigned.select("cluster", F.col("id").alias("j"), F.col("v").alias("_b"))
    return a.join(b, "cluster").filter("i < j").select("cluster", "i", "j", metric("_a", "_b").alias("d"))


def davies_bouldin(assigned: DataFrame, centers: DataFrame, metric: Metric = euclid, single: float = 10.0) -> DataFrame:
    """One row: the mean over clusters of the largest (S_i + S_j) / d(c_i, c_j); a singleton's S is `single`."""
    s = assigned.groupBy("cluster").agg(F.when(F.count("*") < 2, single).otherwise(F.avg("d")).alias("s"))
    pairs = center_distances(centers, metric)
    r = pairs.join(s.select(F.col("cluster").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("cluster").alias("b"), F.col("s").alias("sb")), "b")
    r = r.select("a", "b", ((F.col("sa") + F.col("sb")) / F.col("d")).alias("r"))
    worst = r.select(F.col("a").alias("cluster"), "r").union(r.select("b", "r")).groupBy("cluster").agg(F.max("r").alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def spread(assigned: DataFrame) -> DataFrame:
    """(stdev, scatt): sqrt(sum((n_i - 1) var_i) / (sum n_i - k)) over mean squared distances, and the mean of cluster variance over total variance."""
    each = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.col("d") * F.col("d")).alias("var"))
    mean = assigned.agg(mean_vector("v").alias("_m"))
    total = assigned.join(F.broadcast(mean)).agg(F.avg(F.pow(euclid("v", "_m"), 2.0)).alias("tv"))  # one row
    return each.join(F.broadcast(total)).agg(F.sqrt(F.sum((F.col("n") - 1) * F.col("var")) / (F.sum("n") - F.count("*"))).alias("stdev"), F.avg(F.col("var") / F.col("tv")).alias("scatt"))


def s_dbw(assigned: DataFrame, centers: DataFrame, metric: Metric = euclid) -> DataFrame:
    """One row (scatt, density, s_dbw): scatter within clusters plus density between them, the latter over the midpoints of each two centres."""
    from ..functions.vectors import midpoint

    s = spread(assigned)
    pts = assigned.select("id", "v", "cluster", "d").join(F.broadcast(s.select("stdev")))  # one row
    own = pts.groupBy("cluster").agg(F.count_if(F.col("d") <= F.col("stdev")).alias("own"))
    x = centers.select(F.col("cluster").alias("a"), F.col("center").alias("_a"))
    y = centers.select(F.col("cluster").alias("b"), F.col("center").alias("_b"))
    mids = x.join(y, F.col("a") < F.col("b")).select("a", "b", midpoint("_a", "_b").alias("mid"))  # k^2 rows
    ends = mids.select("a", "b", "mid", F.explode(F.array("a", "b")).alias("cluster"))
    at = ends.join(pts, "cluster").groupBy("a", "b").agg(F.count_if(metric("v", "mid") <= F.col("stdev")).alias("mid"))
    both = at.join(own.select(F.col("cluster").alias("a"), F.col("own").alias("oa")), "a").join(own.select(F.col("cluster").alias("b"), F.col("own").alias("ob")), "b")
    k = centers.agg(F.count("*").alias("k"))
    dens = both.join(F.broadcast(k)).agg((2 * F.sum(F.col("mid") / F.greatest("oa", "ob", F.lit(1))) / (F.first("k") * (F.first("k") - 1))).alias("density"))
    return s.join(F.broadcast(dens)).select("scatt", F.coalesce("density", F.lit(0.0)).alias("density"), (F.col("scatt") + F.coalesce("density", F.lit(0.0))).alias("s_dbw"))


def cluster_distances(assigned: DataFrame, centers: DataFrame, metric: Metric = euclid) -> DataFrame:
    """(kind, cluster, value): mean pairwise distance within each cluster and over all clusters, and mean distance of centres."""
    each = intra_distances(assigned, metric).groupBy("cluster").agg(F.avg("d").alias("value")).select(F.lit("each").alias("kind"), "cluster", "value")
    over = each.agg(F.avg("value").alias("value")).select(F.lit("intra").alias("kind"), F.lit(None).cast("int").alias("cluster"), "value")
    inter = center_distances(centers, metric).agg(F.avg("d").alias("value")).select(F.lit("inter").alias("kind"), F.lit(None).cast("int").alias("cluster"), "value")
    return each.union(over).union(inter)


def find_clusters(points: DataFrame, index: Callable[[DataFrame, DataFrame], float], seed: int = 1, most: int | None = None) -> tuple[int, float, list[list[float]]]:
    """k from 2 up until the index worsens: (k, index, centres); with `most`, the best k of the whole range up to it instead."""
    best: tuple[int, float, list[list[float]]] | None = None
    k = 2
    while most is None or k <= most:
        assigned, centers = kmeans_plus(points, k, seed)
        value = index(assigned, centers_table(points.sparkSession, centers))
        if best is None or value < best[1]:
            best = (k, value, centers)
        elif most is None:
            break
        if len(centers) < k:
            break
        k += 1
    return best


def ml_kmeans(points: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Spark's own k-means (k-means||) for Euclidean data at scale: (id, cluster)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows).select("id", "cluster")
