"""Queries: clustering, classifier scoring, context engine, lineage groups, simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster, context, phylo, scoring, windows
from .base import HALFWAY, RNA_SQL, r6, registry, rna, table

QUERIES, ORACLE_SQL, query = registry()


def _all_points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


_P = "with p as (select vec_id as id, embedding::double[] as v, label from embeddings), "
_D = _P + "d as (select a.id as i, b.id as j, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d from p a join p b on a.label = b.label and a.id < b.id), "


@query(_D + "x as (select 1) select i, j, round(d, 5) as d from d")
def dist_matrix(spark, sf):
    return cluster.pair_distances(_all_points(spark, sf), block="label").select("i", "j", F.round("d", 5).alias("d"))


@query(_D + "e as (select i, j, d from d union all select j, i, d from d) select i as src, j as dst, (row_number() over (partition by i order by d, j))::int as rank from e qualify rank <= 5")
def knn_graph(spark, sf):
    return cluster.nearest_neighbours(_all_points(spark, sf), 5, block="label").select("src", "dst", "rank")


@query(_D + "e as (select i, j, d from d union all select j, i, d from d), k as (select i, j from e qualify row_number() over (partition by i order by d, j) <= 5) select j as id, count(*) as n, string_agg(i::varchar, ',' order by i) as sources from k group by 1")
def krnn_graph(spark, sf):
    knn = cluster.nearest_neighbours(_all_points(spark, sf), 5, block="label")
    return cluster.reverse_knn(knn).select("id", "n", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


_CENTERS = [10, 20, 30, 40]
_ASSIGNED = _P + "c as (select id as cluster, v as center from p where id in (10, 20, 30, 40)), a as (select p.id, c.cluster, sqrt(list_sum(list_transform(list_zip(p.v, c.center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d from p, c qualify row_number() over (partition by p.id order by d, cluster) = 1) "


def _assigned(spark, sf):
    points = _all_points(spark, sf)
    centers = points.filter(F.col("id").isin(*_CENTERS)).select(F.col("id").cast("int").alias("cluster"), F.col("v").alias("center"))
    return cluster.assign(points, centers)


@query(_ASSIGNED + "select id, cluster::int as cluster, round(d, 5) as d from a")
def nearest_center(spark, sf):
    return _assigned(spark, sf).select("id", "cluster", F.round("d", 5).alias("d"))


@query(_ASSIGNED + "select cluster::int as cluster, count(*) as n, round(sum(d * d), 4) as sse from a group by 1")
def sse(spark, sf):
    return cluster.sum_squared_error(_assigned(spark, sf)).select("cluster", "n", F.round("sse", 4).alias("sse"))


_LABELS = _P + "m as (select label, k, avg(x) as x from (select label, unnest(v) as x, unnest(range(len(v))) as k from p) group by 1, 2), c as (select label, list(x order by k) as center from m group by 1), dd as (select id, p.label, sqrt(list_sum(list_transform(list_zip(v, center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d from p join c using (label)), cd as (select a.label as a, b.label as b, sqrt(list_sum(list_transform(list_zip(a.center, b.center), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d from c a join c b on a.label < b.label) "


def _labelled(spark, sf):
    from ..functions.vectors import euclid

    points = _all_points(spark, sf).withColumnRenamed("label", "cluster")
    centers = cluster.recenter(points)
    return points.join(centers, "cluster").withColumn("d", euclid("v", "center")), centers


@query(_LABELS + "select a, b, round(d, 5) as d from cd")
def cluster_distances(spark, sf):
    return cluster.center_distances(_labelled(spark, sf)[1]).select("a", "b", F.round("d", 5).alias("d"))


@query(_LABELS + ", s as (select label, case when count(*) < 2 then 10.0 else avg(d) end as s from dd group by 1), r as (select a, b, (x.s + y.s) / d as r from cd join s x on a = x.label join s y on b = y.label), w as (select label, max(r) as r from (select a as label, r from r union all select b, r from r) group by 1) select round(avg(r), 5) as davies_bouldin from w")
def davies_bouldin(spark, sf):
    return cluster.davies_bouldin(*_labelled(spark, sf)).select(F.round("davies_bouldin", 5).alias("davies_bouldin"))


@query(_LABELS + """, e as (select label, count(*) as n, avg(d * d) as var from dd group by 1), g as (select list(x order by k) as m from (select k, avg(x) as x from (select unnest(v) as x, unnest(range(len(v))) as k from p) group by 1)),
t as (select avg(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as tv from p, g) select round(sqrt(sum((n - 1) * var) / (sum(n) - count(*))), 5) as stdev, round(avg(var / tv), 5) as scatt from e, t""")
def cluster_spread(spark, sf):
    return cluster.spread(_labelled(spark, sf)[0]).select(F.round("stdev", 5).alias("stdev"), F.round("scatt", 5).alias("scatt"))


@query()
def s_dbw(spark, sf):
    return cluster.s_dbw(*_labelled(spark, sf)).select(*(F.round(c, 5).alias(c) for c in ("scatt", "density", "s_dbw")))


@query()
def kmeans_fixed(spark, sf):
    points = _all_points(spark, sf)
    start = [list(r["v"]) for r in points.filter(F.col("id").isin(*_CENTERS)).orderBy("id").collect()]
    return cluster.kmeans(points, start, rounds=8)[0].select("id", "cluster", F.round("d", 5).alias("d"))


@query()
def krnn_clusters(spark, sf):
    return cluster.krnn_clusters(_all_points(spark, sf), 4, block="label")


_CUTS = [100.0 * k for k in range(1, 26)]
_CONF = "with c as (select unnest(range(100, 2501, 100))::double as cut), r as (select n_chars, quality as y from documents join labels using (doc_id)), k as (select cut, count(*) filter (n_chars >= cut and y = 1) as tp, count(*) filter (n_chars < cut and y = 0) as tn, count(*) filter (n_chars >= cut and y = 0) as fp, count(*) filter (n_chars < cut and y = 1) as fn from c, r group by 1), "
_RATES = _CONF + "q as (select *, case when tp + fn = 0 then 1 else tp / (tp + fn)::double end as tpr, case when fp + tn = 0 then 0 else fp / (fp + tn)::double end as fpr from k) "


def _scores(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("n_chars", "quality")


@query(_RATES + ", m as (select *, sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)) as u from q) select cut, tp, tn, fp, fn, round(tpr, 6) as tpr, round(fpr, 6) as fpr, round((tp::double * tn - fp::double * fn) / case when u = 0 then 1 else u end, 6) as mcc, round((tp + tn) / (tp + tn + fp + fn)::double, 6) as acc, round(case when tp + fp = 0 then 1 else tp / (tp + fp)::double end, 6) as ppv from m")
def roc_sweep(spark, sf):
    rows = scoring.roc(_scores(spark, sf), "n_chars", "quality", _CUTS)
    return rows.select("cut", "tp", "tn", "fp", "fn", *(r6(F.col(c), c) for c in ("tpr", "fpr", "mcc", "acc", "ppv")))


@query(_RATES + ", b as (select fpr, case when fpr = 1 then min(tpr) else max(tpr) end as tpr from q group by 1 union select 0, 0 union select 1, 1), s as (select fpr, tpr, lead(fpr) over (order by fpr, tpr) as f2, lead(tpr) over (order by fpr, tpr) as t2 from b) select round(sum((f2 - fpr) * (tpr + t2) / 2), 6) as area, round((sum((f2 - fpr) * (tpr + t2) / 2) - 0.5) / 0.5, 6) as scaled from s")
def auc(spark, sf):
    return scoring.roc_area(scoring.roc(_scores(spark, sf), "n_chars", "quality", _CUTS)).select(r6(F.col("area"), "area"), r6(F.col("scaled"), "scaled"))


@query(_RATES + "select cut, round(tpr, 6) as tpr, round(fpr, 6) as fpr from q order by 1 - (tpr - fpr), cut limit 1")
def youden_point(spark, sf):
    return scoring.best_point(scoring.roc(_scores(spark, sf), "n_chars", "quality", _CUTS)).select("cut", r6(F.col("tpr"), "tpr"), r6(F.col("fpr"), "fpr"))


def _seqs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rna().alias("q"))


_G = f"s as (select doc_id, {RNA_SQL} as q from documents), "


def _dict(n: int) -> str:
    return f"c{n} as (select doc_id, unnest(list_transform(range(1, length(q) - {n} + 2), lambda i: substring(q, i, {n}))) as item from s where length(q) >= {n}), d{n} as (select doc_id, item, count(*) as n, count(*) / (sum(count(*)) over (partition by doc_id))::double as p from c{n} group by 1, 2)"


@query(f"with {_G} {_dict(3)} select item, round(sum(p) / (select count(*) from s where length(q) >= 3), 6) as p from d3 group by 1")
def hybrid_profile(spark, sf):
    return context.hybrid_profile(_seqs(spark, sf), "q", 3, "doc_id").select("item", r6(F.col("p"), "p"))


_Q3 = f"with {_G} {_dict(1)}, {_dict(2)}, {_dict(3)}, w as (select l.doc_id, l.item || substring(r.item, 2, 1) as item, l.p * r.p / m.p as w from d2 l join d2 r on l.doc_id = r.doc_id and substring(l.item, 2, 1) = substring(r.item, 1, 1) join d1 m on m.doc_id = l.doc_id and m.item = substring(l.item, 2, 1)), q3 as (select doc_id, item, w / sum(w) over (partition by doc_id) as p from w) "


@query(_Q3 + f"select doc_id, item, round(p + {HALFWAY}, 6) as p from q3")
def expected_qdict(spark, sf):
    return context.reconstruct(_seqs(spark, sf), "q", 3, ["doc_id"]).select("doc_id", "item", r6(F.col("p") + float(HALFWAY), "p"))


@query(_Q3 + "select d3.doc_id, round(case when sum(d3.p * log2(d3.p / q3.p)) between -1e-10 and 0 then 0 else sum(d3.p * log2(d3.p / q3.p)) end, 6) as kld from d3 join q3 using (doc_id, item) group by 1")
def cre_curve(spark, sf):
    return context.relative_entropies(_seqs(spark, sf), "q", [3], ["doc_id"]).select("doc_id", r6(F.col("kld"), "kld"))


@query(f"with {_G} {_dict(2)}, {_dict(3)}, h2 as (select doc_id, -sum(p * log2(p)) as h from d2 group by 1), h3 as (select doc_id, -sum(p * log2(p)) as h from d3 group by 1) select h2.doc_id, round(coalesce((h3.h - h2.h) / 2, -1), 6) as limit_entropy, round(6 - h3.h, 6) as informativity from h2 left join h3 using (doc_id)")
def limit_entropy(spark, sf):
    return context.limit_entropy(_seqs(spark, sf), "q", 3, ["doc_id"]).select("doc_id", r6(F.col("limit_entropy"), "limit_entropy"), r6(F.col("informativity"), "informativity"))


_HYBRID = f"with {_G} {_dict(3)}, h as (select item, sum(p) / (select count(*) from s where length(q) >= 3) as p from d3 group by 1), k as (select x.doc_id, h.item, h.p as q, coalesce(d.p, 0) as p from (select distinct doc_id from d3) x cross join h left join d3 d on d.doc_id = x.doc_id and d.item = h.item), js as (select doc_id, sum(case when p > 0 then 0.5 * p * log2(p / (0.5 * p + 0.5 * q)) else 0 end + 0.5 * q * log2(q / (0.5 * p + 0.5 * q))) as re from k group by 1) "


@query(_HYBRID + "select doc_id, round(re, 6) as re from js")
def profile_distances(spark, sf):
    s = _seqs(spark, sf)
    return context.profile_distances(s, "q", 3, "doc_id", context.hybrid_profile(s, "q", 3, "doc_id")).select("doc_id", r6(F.col("re"), "re"))


@query()
def candidate_filter(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", rna().alias("q"))
    return context.candidate_filter(s.filter("doc_id % 2 = 0"), s.filter("doc_id % 2 = 1"), "q", 3, "doc_id", 1, 100).select("doc_id", r6(F.col("re"), "re"), "good")


@query()
def greedy_nonredundant(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return windows.greedy_keepers(rows, ["p_brand"], "p_name", ["p_partkey"], identity=0.5)


@query()
def dinuc_shuffle(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", rna().alias("q"))
    return phylo.shuffles(rows, "q", 2, 3)


@query()
def monte_carlo(spark, sf):
    """The reference's timed workload: a 6-mer in 1,000 random sequences of 28,800 bases."""
    return phylo.monte_carlo_hits(spark, 1000, 28_800, "TATAAT", 11)


@query()
def taxon_groups(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select("c_custkey", F.concat_ws(", ", "r_name", "n_name", "c_mktsegment", "c_name").alias("ancestors"))
    return phylo.group_by_taxon(rows, "c_custkey", 40, levels=3, least=10)
