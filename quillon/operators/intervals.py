"""Interval joins: containment, fuzzy equality, overlap, nearest boundary, nested sets.

A join on ranges alone would compare everything with everything. Here each interval is put into the bins that it touches and joined
on (key, bin), with the exact test after it, so work follows the pairs that are near each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bins(df: DataFrame, start: Column, end: Column, width: int, name: str = "_bin") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def containment_join(inner: DataFrame, outer: DataFrame, keys: Sequence[str], width: int, inner_at: tuple[str, str] = ("start", "end"), outer_at: tuple[str, str] = ("from", "to")) -> DataFrame:
    """Pairs whose inner interval lies within the outer one. An inner interval is in the bin of its start only; the outer one in all that it touches."""
    a = inner.withColumn("_bin", F.floor(F.col(inner_at[0]) / width))
    b = _bins(outer, F.col(outer_at[0]), F.col(outer_at[1]), width)
    return a.join(b, [*keys, "_bin"]).filter((F.col(inner_at[0]) >= F.col(outer_at[0])) & (F.col(inner_at[1]) <= F.col(outer_at[1]))).drop("_bin")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of left (start, end) and right (from, to) that share a position, with the number shared. Each pair is kept in the first bin that both touch."""
    a = _bins(left, F.col("start"), F.col("end"), width)
    b = _bins(right, F.col("from"), F.col("to"), width)
    shared = F.least("end", "to") - F.greatest("start", "from") + 1
    first = F.floor(F.greatest("start", "from") / width) == F.col("_bin")
    return a.join(b, [*keys, "_bin"]).filter((shared > 0) & first).withColumn("overlap", shared).drop("_bin")


def fuzzy_matches(left: DataFrame, right: DataFrame, keys: Sequence[str], delta: int) -> DataFrame:
    """Pairs with equal keys whose starts and ends differ by less than delta: left looks into its own bin and both neighbours."""
    a = left.withColumn("_bin", F.explode(F.array(*(F.floor(F.col("start") / delta) + k for k in (-1, 0, 1)))))
    b = right.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.floor(F.col("start") / delta).alias("_bin"))
    return a.join(b, [*keys, "_bin"]).filter((F.abs(F.col("start") - F.col("_s")) < delta) & (F.abs(F.col("end") - F.col("_e")) < delta)).drop("_bin")


def fuzzy_intersect(left: DataFrame, right: DataFrame, keys: Sequence[str], delta: int) -> DataFrame:
    """Left rows (once each) with a fuzzy match."""
    return fuzzy_matches(left, right, keys, delta).select(*left.columns).distinct()


def fuzzy_difference(left: DataFrame, right: DataFrame, keys: Sequence[str], delta: int) -> DataFrame:
    """Distinct left rows without one."""
    return left.distinct().join(fuzzy_intersect(left, right, keys, delta), left.columns, "left_anti")


def fuzzy_union(left: DataFrame, right: DataFrame, keys: Sequence[str], delta: int) -> DataFrame:
    """Left, and the right rows that match nothing in it."""
    return left.distinct().unionByName(fuzzy_difference(right, left, keys, delta))


def split_by_known(hits: DataFrame, known: DataFrame, keys: Sequence[str], near: int = 10) -> DataFrame:
    """hits with good = true where no known place of the same keys has a start or an end within (-near, near) of theirs."""
    marked = hits.withColumn("_row", F.monotonically_increasing_id())
    found = []
    for side in ("start", "end"):
        a = marked.select("_row", *keys, F.col(side).alias("_at"), F.explode(F.array(*(F.floor(F.col(side) / near) + k for k in (-1, 0, 1)))).alias("_bin"))
        b = known.select(*keys, F.col(side).alias("_known"), F.floor(F.col(side) / near).alias("_bin"))
        found.append(a.join(b, [*keys, "_bin"]).filter(F.abs(F.col("_at") - F.col("_known")) < near).select("_row"))
    bad = found[0].union(found[1]).distinct().withColumn("_bad", F.lit(True))
    return marked.join(bad, "_row", "left").withColumn("good", F.col("_bad").isNull()).drop("_row", "_bad")


def nearest_before(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark: str) -> DataFrame:
    """points with the greatest mark of the same keys at or below them, null without one: one sort of the union, no range join."""
    rows = points.withColumn("_mark", F.lit(None).cast(marks.schema[mark].dataType)).withColumn("_point", F.lit(1)).withColumn("_at", F.col(at).cast("double"))
    other = marks.select(*keys, F.col(mark).alias("_mark"), F.lit(0).alias("_point"), F.col(mark).cast("double").alias("_at"))
    both = rows.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("nearest", F.last("_mark", ignorenulls=True).over(w)).filter("_point = 1").drop("_mark", "_point", "_at")


def upstream_region(hits: DataFrame, genes: DataFrame, keys: Sequence[str], up: int = 250, down: int = 25) -> DataFrame:
    """(region_start, region_end) before each hit `at`: up to `up` back, clipped after the last gene end, and `down` past it."""
    near = nearest_before(hits, genes, keys, "at", "gene_end")
    begin = F.greatest(F.lit(1), F.col("at") - up, F.coalesce(F.col("nearest") + 1, F.lit(1)))
    return near.select(*hits.columns, begin.cast("long").alias("region_start"), (F.col("at") + down).cast("long").alias("region_end"))


def descendants(nodes: DataFrame, roots: DataFrame, node: str = "node", left: str = "left_value", right: str = "right_value", width: int = 1024) -> DataFrame:
    """(root, node) for every node of each root's subtree in a nested-set table, the root itself included.

    A node is below a root if its left boundary lies within the root's. Roots are put into all bins of `width` numbers that they span, nodes into
    their own bin, and the two are joined on the bin.
    """
    spans = nodes.join(roots.select(node), node, "left_semi").select(F.col(node).alias("root"), F.col(left).alias("from"), F.col(right).alias("to"))
    at = nodes.select(node, F.col(left).alias("start"), F.col(left).alias("end"))
    return containment_join(at, spans, [], width).select("root", node)


def nested_parents(nodes: DataFrame, node: str = "node", left: str = "left_value", right: str = "right_value") -> DataFrame:
    """(node, parent) of a nested-set table: depths from a running count of open intervals, then the last node opened one level up.

    The running count sorts the whole tree, whose size is that of a taxonomy.
    """
    n = nodes.select(F.col(node).alias("node"), F.col(left).alias("lo"), F.col(right).alias("hi"))
    ends = n.select("node", F.col("lo").alias("at"), F.lit(1).alias("step")).union(n.select("node", "hi", F.lit(-1)))
    depth = ends.withColumn("depth", F.sum("step").over(Window.orderBy("at"))).filter("step = 1").select("node", "at", "depth")
    above = depth.select(F.col("depth").alias("level"), "at", F.col("node").alias("parent"), F.lit(None).cast(n.schema["node"].dataType).alias("node"))
    below = depth.select((F.col("depth") - 1).alias("level"), "at", F.lit(None).cast(n.schema["node"].dataType).alias("parent"), "node")
    w = Window.partitionBy("level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    found = above.union(below).withColumn("parent", F.last("parent", ignorenulls=True).over(w))
    return found.filter("node is not null and parent is not null").select(F.col("node").alias(node), "parent")


def subtree(nodes: DataFrame, low: int, high: int, left: str = "left_value", right: str = "right_value", leaves: bool = False) -> DataFrame:
    """The nodes within one root's boundaries, a filter that reaches the scan; with `leaves`, those without children."""
    inside = nodes.filter(F.col(left).between(low, high))
    return inside.filter(F.col(left) + 1 == F.col(right)) if leaves else inside
