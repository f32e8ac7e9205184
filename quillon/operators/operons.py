"""Operon tables (name, operon_id, start_pos, end_pos, strand): grouping, bounds, and the region before a hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals


def gene_lists(operons: DataFrame) -> DataFrame:
    """(name, strand, id, genes): sorted [start, end] lists of each operon; on strand -1 ids are negated and genes listed backwards."""
    rows = operons.groupBy("name", "strand", "operon_id").agg(F.sort_array(F.collect_list(F.array("start_pos", "end_pos"))).alias("genes"))
    back = F.col("strand") < 0
    return rows.select("name", "strand", F.when(back, -F.col("operon_id")).otherwise(F.col("operon_id")).alias("id"), F.when(back, F.reverse("genes")).otherwise(F.col("genes")).alias("genes"))


def strand_bounds(operons: DataFrame) -> DataFrame:
    """(name, strand, minimum, maximum) positions of the operons of each strand."""
    return operons.groupBy("name", "strand").agg(F.min("start_pos").alias("minimum"), F.max("end_pos").alias("maximum"))


def hit_regions(hits: DataFrame, operons: DataFrame, up: int = 250, down: int = 25) -> DataFrame:
    """hits (name, strand, at) with (region_start, region_end): the stretch before each hit, cut at the nearest gene end behind it.

    On strand -1 positions are mirrored, so that `behind` is one direction for both; the mirrored region is turned back.
    """
    mirrored = hits.withColumn("_hit", F.monotonically_increasing_id()).withColumn("at", F.when(F.col("strand") < 0, -F.col("at")).otherwise(F.col("at")))
    ends = operons.select("name", "strand", F.when(F.col("strand") < 0, -F.col("start_pos")).otherwise(F.col("end_pos")).alias("gene_end"))
    near = intervals.nearest_before(mirrored, ends, ["name", "strand"], "at", "gene_end")
    low = F.greatest(F.col("at") - up, F.coalesce(F.col("nearest") + 1, F.col("at") - up))
    high = F.col("at") + down
    back = F.col("strand") < 0
    return near.select(
        "name", "strand", F.abs("at").alias("at"), F.greatest(F.lit(1), F.when(back, -high).otherwise(low)).alias("region_start"), F.greatest(F.lit(1), F.when(back, -low).otherwise(high)).alias("region_end"),
    )


def downstream_genes(hits: DataFrame, operons: DataFrame, k: int = 30) -> DataFrame:
    """The k next genes past each hit on its strand, nearest first, the very first left out: ranks by one window over the union of hits and genes.

    Genes are numbered along each strand; a hit's next genes are those numbered after its last one, an equi join on the number.
    """
    from pyspark.sql.window import Window

    numbered = operons.withColumn("number", F.row_number().over(Window.partitionBy("name", "strand").orderBy("start_pos", "end_pos")))
    marked = intervals.nearest_before(hits, numbered.select("name", "strand", F.col("start_pos").alias("mark")), ["name", "strand"], "at", "mark")
    last = marked.join(numbered.select("name", "strand", F.col("start_pos").alias("nearest"), "number"), ["name", "strand", "nearest"], "left")
    wanted = last.select(*hits.columns, F.explode(F.sequence(F.coalesce("number", F.lit(0)) + 2, F.coalesce("number", F.lit(0)) + k)).alias("number"))
    return wanted.join(numbered, ["name", "strand", "number"])
