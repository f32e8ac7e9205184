"""Queries: files written to the shared folder and read back, and operons with their genes and hits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import coords
from ..operators import operons
from ..operators.graph import shared_folder
from ..sources import sequences
from .base import ALIGNED_SQL, aligned, registry, table
from .queries_scalars import _ENTRY, _entries

QUERIES, ORACLE_SQL, query = registry()
_WIDTH = 48  # columns of the alignment, more than any name and type have


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/quillon/{name}-{uuid.uuid4().hex}"


# Every part is a sequence: its name and type as letters and gaps; even keys are named by an entry.
_SEQS = f"with s as (select p_partkey as k, case when p_partkey % 2 = 0 then 'P' || p_partkey || '/1-{_WIDTH}/1' else 'P' || p_partkey end as name, rpad({ALIGNED_SQL.format("p_name || '-' || p_type")}, {_WIDTH}, '.') as seq from part) "


def _seqs(spark, sf):
    key = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("P"), key, F.lit(f"/1-{_WIDTH}/1"))).otherwise(F.concat(F.lit("P"), key))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row"), name.alias("name"), F.rpad(aligned(F.concat("p_name", F.lit("-"), "p_type")), _WIDTH, ".").alias("seq"))


@query(_SEQS + "select name, seq from s")
def fasta_round_trip(spark, sf):
    path = _path(spark, "fasta")
    sequences.write_fasta(_seqs(spark, sf), path)
    return sequences.read_sequences(spark, path, "fna").select("name", "seq")


@query(_SEQS + "select name, replace(seq, '.', '') as seq from s")
def degapped_fasta(spark, sf):
    path = _path(spark, "degapped")
    sequences.stockholm_to_fasta(_seqs(spark, sf), path)
    return sequences.read_sequences(spark, path, "fasta").select("name", "seq")


@query(_SEQS + "select name, seq from s")
def stockholm_round_trip(spark, sf):
    path = _path(spark, "sto")
    sequences.write_stockholm(_seqs(spark, sf), path, ss_cons="." * _WIDTH)
    return sequences.read_sequences(spark, path, "sto").select("name", "seq")


@query(_SEQS + "select 'invalid entry' as problem, count(*) as n from s where k % 2 = 1")
def stockholm_faults(spark, sf):
    path = _path(spark, "sto")
    sequences.write_stockholm(_seqs(spark, sf), path, ss_cons="." * _WIDTH)
    return sequences.check_stockholm(spark, path).select("problem", F.size("names").cast("long").alias("n"))


@query(f"select 'GF' as tag, 'AU' as key, 'quillon' as value union all select 'GF', 'CC', 'parts as rows' union all select 'GC', 'SS_cons', repeat('<', {_WIDTH})")
def stockholm_marks(spark, sf):
    path = _path(spark, "sto")
    sequences.write_stockholm(_seqs(spark, sf), path, ss_cons="<" * _WIDTH, origin="quillon", comments=("parts as rows",))
    return sequences.stockholm_annotations(spark, path).select("tag", "key", F.trim("value").alias("value"))


@query(f"select repeat('<', {_WIDTH}) as seq")
def consensus_line(spark, sf):
    path = _path(spark, "sto")
    sequences.write_stockholm(_seqs(spark, sf), path, ss_cons="<" * _WIDTH)
    return sequences.consensus(spark, path).select("seq")


@query(_SEQS + "select name, replace(seq, '.', '-') as seq from s")
def clustal_round_trip(spark, sf):
    path = _path(spark, "aln")
    sequences.write_clustal(_seqs(spark, sf), path, block=20)
    return sequences.read_sequences(spark, path, "aln").select("name", "seq")


@query(f"select split_part(e, '/', 1) as name, split_part(split_part(e, '/', 2), '-', 1)::bigint as start, split_part(split_part(e, '/', 2), '-', 2)::bigint as \"end\", split_part(e, '/', 3) as strand, score from (select {_ENTRY} as e, (o_orderkey % 10)::double as score from orders)")
def entries_round_trip(spark, sf):
    path = _path(spark, "ent")
    e = _entries(spark, sf).select("o_orderkey", coords.entry_parts("entry").alias("p")).select("p.*", (F.col("o_orderkey") % 10).alias("score"))
    sequences.write_entries(e, path, ["score"])
    return sequences.read_sequences(spark, path, "ent").select("name", "start", "end", "strand", "score")


_OPERONS = "with o as (select o_custkey::varchar as name, l_orderkey as operon_id, (l_linenumber * 100 + l_partkey % 60)::bigint as start_pos, (l_linenumber * 100 + l_partkey % 60 + round(l_quantity))::bigint as end_pos, case when l_orderkey % 2 = 0 then 1 else -1 end as strand from lineitem join orders on l_orderkey = o_orderkey) "


def _operons(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = (F.col("l_linenumber") * 100 + F.col("l_partkey") % 60).cast("long")
    strand = F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1)
    return rows.select(F.col("o_custkey").cast("string").alias("name"), F.col("l_orderkey").alias("operon_id"), start.alias("start_pos"), (start + F.round("l_quantity").cast("long")).alias("end_pos"), strand.alias("strand"))


@query(_OPERONS + "select name, strand, case when strand < 0 then -operon_id else operon_id end as id, case when strand < 0 then string_agg(start_pos || '-' || end_pos, ',' order by start_pos desc, end_pos desc) else string_agg(start_pos || '-' || end_pos, ',' order by start_pos, end_pos) end as genes from o group by name, strand, operon_id")
def operon_genes(spark, sf):
    rows = operons.gene_lists(_operons(spark, sf))
    return rows.select("name", "strand", "id", F.array_join(F.transform("genes", lambda g: F.concat_ws("-", g[0].cast("string"), g[1].cast("string"))), ",").alias("genes"))


@query(_OPERONS + "select name, strand, min(start_pos) as minimum, max(end_pos) as maximum from o group by 1, 2")
def operon_bounds(spark, sf):
    return operons.strand_bounds(_operons(spark, sf))


@query(_OPERONS + """, h as (select o_custkey::varchar as name, case when o_orderkey % 2 = 0 then 1 else -1 end as strand, (o_orderkey % 700 + 1)::bigint as at0 from orders), m as (select *, at0 * strand as p from h),
g as (select name, strand, case when strand < 0 then -start_pos else end_pos end as e from o), n as (select m.*, (select max(e) from g where g.name = m.name and g.strand = m.strand and g.e <= m.p) as nearest from m),
r as (select *, greatest(p - 250, coalesce(nearest + 1, p - 250)) as low, p + 25 as high from n) select name, strand, at0 as "at", greatest(1, case when strand < 0 then -high else low end) as region_start, greatest(1, case when strand < 0 then -low else high end) as region_end from r""")
def operon_hits(spark, sf):
    hits = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("strand"), (F.col("o_orderkey") % 700 + 1).alias("at"))
    return operons.hit_regions(hits, _operons(spark, sf))
