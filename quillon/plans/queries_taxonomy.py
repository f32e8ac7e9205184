"""Queries: lineages, nested sets, genomes and their counts, with regions, nations and customers as the taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational
from .base import r6, registry, table

QUERIES, ORACLE_SQL, query = registry()


def _names(spark, sf):
    """name, taxon_id and description of each customer as an entry."""
    return table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("taxon_id"), F.col("c_mktsegment").alias("description"), "c_custkey")


def _taxon(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("taxon_id"), (F.col("n_nationkey") + 1000).alias("ncbi_taxon_id"))


def _ancestors(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select((F.col("n_nationkey") + 1000).alias("ncbi_taxon_id"), F.concat_ws(", ", F.lit("root"), "r_name", "n_name").alias("ancestors"))


def _tree(spark, sf):
    nodes = relational.nested_set(table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "customer"))
    return nodes.select(F.col("node").alias("taxon_id"), F.col("kind").alias("node_rank"), "left_value", "right_value")


@query("select distinct c_name as name, 'root, ' || r_name || ', ' || n_name as ancestors from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def lineages(spark, sf):
    return relational.names_to_lineage(_names(spark, sf), _names(spark, sf), _taxon(spark, sf), _ancestors(spark, sf)).distinct()


@query("select distinct o.c_name as name, n_name as taxon, 'root, ' || r_name || ', ' || n_name as ancestors from (select c_name, c_nationkey from customer) o join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def entry_info(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("taxon_id"), F.col("n_name").alias("name"), F.lit("scientific name").alias("name_class"))
    info = relational.base_info(_names(spark, sf), _names(spark, sf), _taxon(spark, sf), names, _ancestors(spark, sf))
    return info.select("name", "taxon", "ancestors").distinct()


@query("select min(n_nationkey) as taxon_id from nation where regexp_matches(n_name, '^[nN]')")
def root_taxon(spark, sf):
    return relational.taxon_root(table(spark, sf, "nation").select(F.col("n_nationkey").alias("taxon_id"), F.col("n_name").alias("name")), "N")


@query("select 'c' || c_custkey as taxon_id from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1")
def taxon_leaves(spark, sf):
    tree = _tree(spark, sf)
    return relational.taxon_subtree(tree, tree.filter("taxon_id = 'r1'").select("taxon_id"), leaves=True).select("taxon_id")


@query("select 'n' || c_nationkey as rank_taxon, string_agg(c_name, ',' order by c_name) as names from (select distinct c_nationkey, c_name from customer) group by 1")
def entries_by_rank(spark, sf):
    entries = _names(spark, sf).select(F.concat(F.lit("c"), "c_custkey").alias("taxon_id"), "name")
    rows = relational.genomes_by_rank(_tree(spark, sf), entries, "nation")
    return rows.select("rank_taxon", F.array_join("names", ",").alias("names"))


@query("select count(distinct c_nationkey) as genomes from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where regexp_matches('root, ' || r_name || ', ' || n_name, ', ' || (select min(r_name) from region)) and not regexp_matches(lower(c_mktsegment), 'plasmid')")
def genome_counts(spark, sf):
    lineage = table(spark, sf, "region").agg(F.min("r_name")).first()[0]
    entries = _names(spark, sf).withColumn("name", F.concat(F.lit("NC_"), "name"))
    return relational.count_genomes(entries, _taxon(spark, sf), _ancestors(spark, sf), lineage)


@query("""with g as (select distinct c_name as name, c_nationkey as taxon from customer), t as (select taxon, count(*) as total from g group by 1), h as (select distinct c_mktsegment as rna, c_name as name from customer), f as (select rna, taxon, count(distinct name) as n from h join g using (name) group by 1, 2)
select rna, t.taxon, coalesce(n, 0)::bigint as n, total, round(100.0 * coalesce(n, 0) / total, 6) as pct from t cross join (select distinct rna from h) r left join f using (rna, taxon)""")
def rna_counts(spark, sf):
    c = table(spark, sf, "customer")
    hits = c.select(F.col("c_mktsegment").alias("rna"), F.col("c_name").alias("name"))
    genomes = c.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("taxon"))
    rows = relational.rna_by_taxon(hits, genomes, hits.select("rna").distinct(), genomes)
    return rows.select("rna", "taxon", "n", "total", r6(F.col("pct"), "pct"))


@query("select l_orderkey, l_returnflag as name, case when l_returnflag = 'N' then string_agg(l_quantity::int::varchar, ',' order by l_quantity) else string_agg(distinct l_quantity::int::varchar, ',' order by l_quantity::int::varchar) end as quantities from lineitem group by 1, 2")
def merged_features(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("int").alias("q"))
    merged = relational.merged_values(rows, ["l_orderkey"], "name", "q", repeated=("N",))
    text = F.transform("values", lambda v: v.cast("string"))
    return merged.select("l_orderkey", "name", F.array_join(F.when(F.col("name") == "N", text).otherwise(F.array_sort(text)), ",").alias("quantities"))


_LOCS = "with ev as (select event_id, user_id, event_type, epoch(date_trunc('second', ts))::bigint as s, epoch(date_trunc('second', ts))::bigint + round(value)::bigint as e from events where value is not null) "


@query(_LOCS + "select f.event_id as feature, h.event_id as hit from ev f join ev h on f.user_id = h.user_id and f.s >= greatest(1, h.s - 3000) and f.e <= h.e + 3000 where f.event_type = 'view' and h.event_type = 'purchase'")
def features_of_hits(spark, sf):
    from .queries_joins import _events

    hits = _events(spark, sf, "purchase").select(F.col("event_id").alias("hit"), F.col("user_id").alias("name"), "start", "end")
    known = _events(spark, sf, "view").select(F.col("event_id").alias("feature"), F.col("user_id").alias("name"), "start", "end")
    return relational.hit_features(hits, known, 3000).select("feature", "hit")
