"""Queries: relational, interval, nearest and nested-set joins; fuzzy set operations; trees and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, intervals, relational, setops
from .base import r6, registry, table

QUERIES, ORACLE_SQL, query = registry()

_EV = "with ev as (select event_id, user_id, event_type, epoch(ts)::bigint as s, epoch(ts)::bigint + value::bigint as e from events where value is not null) "


def _events(spark, sf, *types):
    ev = table(spark, sf, "events").filter("value is not null")
    ev = ev.filter(F.col("event_type").isin(*types)) if types else ev
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return ev.select("event_id", "user_id", "event_type", s.alias("start"), (s + F.round("value").cast("long")).alias("end"))


_EVR = _EV.replace("value::bigint", "round(value)::bigint").replace("epoch(ts)::bigint", "epoch(date_trunc('second', ts))::bigint")


@query(_EVR + "select a.event_id as inner_id, b.event_id as outer_id from ev a join ev b on a.user_id = b.user_id and a.s >= b.s - 5000 and a.e <= b.e + 5000 where a.event_type = 'click' and b.event_type = 'view'")
def containment_join(spark, sf):
    a = _events(spark, sf, "click").select(F.col("event_id").alias("inner_id"), "user_id", "start", "end")
    b = _events(spark, sf, "view").select(F.col("event_id").alias("outer_id"), "user_id", (F.col("start") - 5000).alias("from"), (F.col("end") + 5000).alias("to"))
    return intervals.containment_join(a, b, ["user_id"], 10_000).select("inner_id", "outer_id")


@query(_EVR + "select a.event_id as a, b.event_id as b, least(a.e, b.e) - greatest(a.s, b.s) + 1 as overlap from ev a join ev b on a.event_type = b.event_type and a.event_id < b.event_id and least(a.e, b.e) - greatest(a.s, b.s) + 1 > 0")
def overlap_dup(spark, sf):
    ev = _events(spark, sf)
    b = ev.select(F.col("event_id").alias("b"), "event_type", F.col("start").alias("from"), F.col("end").alias("to"))
    return intervals.overlap_join(ev.withColumnRenamed("event_id", "a"), b, ["event_type"], 600).filter("a < b").select("a", "b", "overlap")


@query(_EVR + "select a.event_id, a.user_id, (select max(b.s) from ev b where b.user_id = a.user_id and b.event_type = 'view' and b.s <= a.s) as nearest from ev a where a.event_type = 'click'")
def nearest_upstream(spark, sf):
    clicks = _events(spark, sf, "click").select("event_id", "user_id", "start")
    views = _events(spark, sf, "view").select("user_id", F.col("start").alias("mark"))
    return intervals.nearest_before(clicks, views, ["user_id"], "start", "mark").select("event_id", "user_id", "nearest")


@query(_EVR + ", n as (select a.event_id, a.s, (select max(b.e) from ev b where b.user_id = a.user_id and b.event_type = 'view' and b.e <= a.s) as g from ev a where a.event_type = 'purchase') select event_id, greatest(1, s - 250, coalesce(g + 1, 1)) as region_start, s + 25 as region_end from n")
def upstream_region(spark, sf):
    hits = _events(spark, sf, "purchase").select("event_id", "user_id", F.col("start").alias("at"))
    genes = _events(spark, sf, "view").select("user_id", F.col("end").alias("gene_end"))
    return intervals.upstream_region(hits, genes, ["user_id"]).select("event_id", "region_start", "region_end")


_FUZZY = _EVR + ", a as (select distinct user_id, s, e from ev where event_type = 'click'), b as (select user_id, s, e from ev where event_type = 'error') "


def _fuzzy(spark, sf):
    return [_events(spark, sf, t).select("user_id", "start", "end") for t in ("click", "error")]


@query(_FUZZY + 'select user_id, s as start, e as "end" from a where exists (select 1 from b where b.user_id = a.user_id and abs(a.s - b.s) < 9000 and abs(a.e - b.e) < 9000)')
def fuzzy_intersect(spark, sf):
    return intervals.fuzzy_intersect(*_fuzzy(spark, sf), ["user_id"], 9000)


@query(_FUZZY + 'select user_id, s as start, e as "end" from a where not exists (select 1 from b where b.user_id = a.user_id and abs(a.s - b.s) < 9000 and abs(a.e - b.e) < 9000)')
def fuzzy_difference(spark, sf):
    return intervals.fuzzy_difference(*_fuzzy(spark, sf), ["user_id"], 9000)


@query(_EVR + "select a.event_id, not exists (select 1 from ev b where b.event_type = 'view' and b.user_id = a.user_id and (abs(a.s - b.s) < 900 or abs(a.e - b.e) < 900)) as good from ev a where a.event_type = 'click'")
def group_hit_parts(spark, sf):
    known = _events(spark, sf, "view").select("user_id", "start", "end")
    return intervals.split_by_known(_events(spark, sf, "click"), known, ["user_id"], 900).select("event_id", "good")


# A nested set: region r holds nations, a nation its customers; boundaries numbered over the walk.
_NESTED = """with c as (select c_custkey, c_nationkey, n_regionkey, row_number() over (order by n_regionkey, c_nationkey, c_custkey) as k from customer join nation on c_nationkey = n_nationkey),
n as (select c_nationkey, n_regionkey, min(k) as lo, max(k) as hi, dense_rank() over (order by n_regionkey, c_nationkey) as d from c group by 1, 2) """


@query(_NESTED + "select n.n_regionkey as root, count(distinct c_nationkey) + sum(hi - lo + 1)::bigint + 1 as nodes, sum(hi - lo + 1)::bigint as leaves from n group by 1")
def nested_set_subtree(spark, sf):
    nodes = relational.nested_set(table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "customer"))
    roots = nodes.filter("kind = 'region'").select("node")
    below = intervals.descendants(nodes, roots).join(nodes.select("node", F.col("kind"), "key"), "node")
    keys = nodes.select(F.col("node").alias("root"), F.col("key").alias("_root"))
    return below.join(keys, "root").groupBy(F.col("_root").cast("int").alias("root")).agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "customer").alias("leaves"))


@query("select n_regionkey, n_nationkey, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (partition by n_regionkey), 6) as pct from customer join nation on c_nationkey = n_nationkey group by 1, 2")
def taxon_counts_pct(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return relational.counts_with_share(rows, ["n_regionkey"], ["n_nationkey"]).select("n_regionkey", "n_nationkey", "n", r6(F.col("pct"), "pct"))


@query("select o_orderkey, count(*) as n_locs, string_agg(l_partkey::varchar, ',' order by l_partkey, l_suppkey, l_linenumber, l_quantity) as parts, max(l_quantity) as longest from orders join lineitem on l_orderkey = o_orderkey where o_orderpriority = '1-URGENT' group by 1")
def feature_struct(spark, sf):
    rows = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    f = relational.nested_records(rows, ["o_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])
    return f.select("o_orderkey", F.size("records").cast("long").alias("n_locs"), F.array_join(F.transform("records", lambda r: r["l_partkey"].cast("string")), ",").alias("parts"), F.array_max(F.transform("records", lambda r: r["l_quantity"])).alias("longest"))


@query("select r_name, n_name, c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join orders on o_custkey = c_custkey where o_orderdate between timestamp '1995-01-01' and timestamp '2030-01-01' and c_mktsegment not in ('BUILDING') group by 1, 2, 3")
def relational_join(spark, sf):
    c, n, r, o = (table(spark, sf, t) for t in ("customer", "nation", "region", "orders"))
    rows = o.filter("o_orderdate between timestamp_ntz '1995-01-01' and timestamp_ntz '2030-01-01'").join(c.filter("c_mktsegment <> 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def semi_join(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("select p_brand, p_type, string_agg(p_partkey::varchar, ', ' order by p_partkey) as keys from part group by 1, 2")
def combine_values(spark, sf):
    return relational.joined_values(table(spark, sf, "part"), ["p_brand", "p_type"], "p_partkey", "keys")


@query("with m as (select distinct l_orderkey as o, l_partkey as p from lineitem where l_quantity > 45) select a.o, count(distinct b.o) as n from m a join m b using (p) group by 1")
def equivalence_matches(spark, sf):
    rows = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    return relational.matched_names(rows, "o", "p").select("o", F.size("matches").cast("long").alias("n"))


@query("select k, name from (select c_nationkey as k, c_name as name from customer qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 2)")
def stratified_top(spark, sf):
    from ..operators.windows import first_k

    rows = first_k(table(spark, sf, "customer"), ["c_nationkey"], 2, [F.desc("c_acctbal"), "c_custkey"])
    return rows.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))


@query()
def stratified_sample(spark, sf):
    """A seeded sample of two customers of each nation."""
    return relational.stratified_sample(table(spark, sf, "customer"), ["c_nationkey"], 2, 5, "c_custkey").select("c_nationkey", "c_custkey")


@query()
def scc(spark, sf):
    """Suppliers (negative numbers) lead to the parts they shipped, parts that came back lead to their suppliers."""
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), (-1 - F.col("l_suppkey")).alias("supplier"), "l_returnflag")  # noqa: E741
    back = l.filter("l_returnflag = 'R'").select("part", "supplier")
    return graph.strong_components(l.filter("l_returnflag <> 'R'").select(F.col("supplier").alias("src"), F.col("part").alias("dst")).union(back))


_TREE = "with recursive t as (select p_partkey as id, case when p_partkey = 0 then null else (p_partkey - 1) // 3 end as parent_id, p_brand as name from part), "


def _tree(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor((F.col("p_partkey") - 1) / 3)).alias("parent_id"), F.col("p_brand").alias("name"))


@query(_TREE + "a as (select id, id::varchar as path, 0 as depth from t where parent_id is null union all select t.id, a.path || '/' || t.id, a.depth + 1 from t join a on t.parent_id = a.id) select id, path, depth::int as depth from a")
def ancestors_path(spark, sf):
    p = graph.ancestor_paths(_tree(spark, sf), skip_root=False)
    return p.select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "depth")


@query(_TREE + "a as (select id, name as ancestors from t where parent_id is null union all select t.id, a.ancestors || ', ' || t.name from t join a on t.parent_id = a.id) select id, ancestors from a")
def ancestors_as_names(spark, sf):
    t = _tree(spark, sf)
    return graph.ancestor_names(t, t)


@query(_TREE + "a as (select id, 0 as depth from t where parent_id is null union all select t.id, a.depth + 1 from t join a on t.parent_id = a.id), k as (select parent_id, count(*) as n from t where parent_id is not null group by 1) select (select count(*) from t) as nodes, (select max(depth) from a)::int as max_depth, (select count(*) from k) as internal, (select round(avg(n), 6) from k) as avg_children")
def tree_depth(spark, sf):
    return graph.tree_stats(_tree(spark, sf)).select("nodes", "max_depth", "internal", r6(F.col("avg_children"), "avg_children"))


@query(_TREE + "s as (select id from t where id = 2 union all select t.id from t join s on t.parent_id = s.id) select id from t where id not in (select id from s)")
def tree_remove(spark, sf):
    t = _tree(spark, sf)
    return graph.without_subtrees(t, t.filter("id = 2").select("id")).select("id")


@query()
def setops_with_seqs(spark, sf):
    """Entries of urgent orders with the stretch of a document that they name."""
    from .queries_scalars import _entries
    from ..functions.coords import entry_parts

    e = _entries(spark, sf).select(entry_parts("entry").alias("p")).select("p.*")
    g = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("seq"))
    return setops.set_operation("union", e, mode="seqs", genomes=g)
