"""Graphs as edges (src, dst) and trees as (id, parent_id): strong components, paths, depths, codes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is named, a local session takes a temporary one; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share and read back, so lineage ends."""
    path = f"{shared_folder(df.sparkSession)}/quillon/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label): the largest id that reaches each node along edges, itself included."""
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        sent = edges.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("label").alias("seen"))
        new = settled(labels.join(sent, "id", "left").select("id", F.greatest("label", F.coalesce("seen", "label")).alias("label"), F.col("label").alias("before")))
        changed = new.filter("label <> before").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components named by their least id, by colouring.

    Each round gives every node the largest id that reaches it. A node whose label is its own is a root; its component is what its colour
    can walk back to it. Found components are removed, and what is left is coloured again; acyclic ends vanish in the first rounds.
    """
    edges = settled(edges.select("src", "dst").distinct())
    left = settled(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    found = None
    while left.limit(1).count():
        labels = reach_labels(edges, left)
        colour = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("_a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("_b")), "dst").filter("_a = _b")
        inner = settled(colour.select("src", "dst"))
        member = labels.filter("id = label").select("id", F.col("label"))
        frontier = member
        while True:  # backwards from the roots within their colour
            step = inner.join(frontier.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label").distinct().join(member, "id", "left_anti")
            step = settled(step)
            if not step.limit(1).count():
                break
            member, frontier = settled(member.union(step)), step
        names = member.groupBy("label").agg(F.min("id").alias("component"))
        part = settled(member.join(names, "label").select("id", "component"))
        found = part if found is None else found.union(part)
        left = settled(left.join(part, "id", "left_anti"))
        edges = settled(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return found if found is not None else left.select("id", F.col("id").alias("component"))


def _strong(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, component of each): Tarjan's algorithm with a stack of its own, linear in the edges."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    order = np.argsort(a, kind="stable")
    to, begin = b[order].tolist(), np.searchsorted(a[order], np.arange(len(ids) + 1)).tolist()
    place, low, open_, component = [-1] * len(ids), [0] * len(ids), [False] * len(ids), [0] * len(ids)
    following, stack, seen = begin[:-1], [], 0
    for root in range(len(ids)):
        path = [root] if place[root] < 0 else []
        while path:
            v = path[-1]
            if place[v] < 0:
                place[v] = low[v] = seen
                seen += 1
                stack.append(v)
                open_[v] = True
            if following[v] < begin[v + 1]:
                w = to[following[v]]
                following[v] += 1
                if place[w] < 0:
                    path.append(w)
                elif open_[w]:
                    low[v] = min(low[v], place[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == place[v]:
                members = [stack.pop()]
                while members[-1] != v:
                    members.append(stack.pop())
                least = min(members)  # ids are sorted
                for w in members:
                    open_[w], component[w] = False, least
    return ids, ids[component] if len(ids) else ids


def strong_components_by_block(edges: DataFrame, block: str) -> DataFrame:
    """strong_components of edges (block, src, dst) that never leave their block, in one pass: each block's edges are held by one task, about 200 bytes an edge."""

    def run(rows: pa.Table) -> pa.Table:
        ids, component = _strong(rows.column("src").to_numpy(), rows.column("dst").to_numpy())
        return pa.table({"id": ids, "component": component})

    return edges.select(block, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).groupBy(block).applyInArrow(run, "id long, component long")


def ancestor_paths(tree: DataFrame, skip_root: bool = True) -> DataFrame:
    """(id, path, depth): ids from the root to each node; the root itself left out of paths if asked. Rows whose parent is null or themselves are roots."""
    rows = tree.select("id", "parent_id")
    roots = rows.filter("parent_id is null or parent_id = id").select("id", F.array("id").alias("path"))
    out, level = roots, roots
    children = rows.filter("parent_id is not null and parent_id <> id")
    while True:
        level = settled(children.join(level.withColumnRenamed("id", "parent_id"), "parent_id").select("id", F.array_append("path", F.col("id")).alias("path")))
        if not level.limit(1).count():
            break
        out = out.union(level)
    path = F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(1))) if skip_root else F.col("path")
    return out.select("id", F.when(F.size("path") > 1, path).otherwise(F.array().cast("array<long>") if skip_root else F.col("path")).alias("path"), (F.size("path") - 1).alias("depth"))


def ancestor_names(tree: DataFrame, names: DataFrame) -> DataFrame:
    """(id, ancestors): names along the path, comma-separated, root first."""
    steps = ancestor_paths(tree, skip_root=False).select("id", F.posexplode("path").alias("pos", "node"))
    named = steps.join(names.select(F.col("id").alias("node"), "name"), "node")
    return named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]), ", ").alias("ancestors"))


def subtree_ids(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids of the roots (id) and all below them."""
    out, step = roots.select("id"), roots.select("id")
    children = tree.filter("parent_id is not null and parent_id <> id").select("id", "parent_id")
    while True:
        step = settled(children.join(step.withColumnRenamed("id", "parent_id"), "parent_id").select("id"))
        if not step.limit(1).count():
            return out.distinct()
        out = out.union(step)


def without_subtrees(tree: DataFrame, roots: DataFrame) -> DataFrame:
    return tree.join(subtree_ids(tree, roots), "id", "left_anti")


def tree_stats(tree: DataFrame) -> DataFrame:
    """One row: nodes, depth, internal nodes, mean children of internal nodes."""
    depth = ancestor_paths(tree).agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"))
    kids = child_counts(tree).agg(F.count("*").alias("internal"), F.avg("n").alias("avg_children"))
    return depth.join(F.broadcast(kids))  # one row


def child_counts(tree: DataFrame) -> DataFrame:
    return tree.filter("parent_id is not null and parent_id <> id").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n"))


def edit_nodes(tree: DataFrame, condition, column: str, value) -> DataFrame:
    """A tree whose matching nodes have a column replaced."""
    return tree.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def prufer_code(edges: list[tuple[int, int]]) -> list[int]:
    """A labelled tree's code: the neighbour of the least leaf, leaf after leaf. Trees are small by nature here, so it runs on the driver."""
    import heapq

    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    leaves = [n for n, s in near.items() if len(s) == 1]
    heapq.heapify(leaves)
    out = []
    while len(out) < len(near) - 2:
        leaf = heapq.heappop(leaves)
        other = next(iter(near[leaf]))
        out.append(other)
        near[other].discard(leaf)
        near[leaf].clear()
        if len(near[other]) == 1:
            heapq.heappush(leaves, other)
    return out


def prufer_tree(code: list[int]) -> list[tuple[int, int]]:
    """The edges of the tree with labels 1 to len + 2 that has this code."""
    import heapq

    n = len(code) + 2
    degree = dict.fromkeys(range(1, n + 1), 1)
    for x in code:
        degree[x] += 1
    leaves = [k for k, d in degree.items() if d == 1]
    heapq.heapify(leaves)
    out = []
    for x in code:
        leaf = heapq.heappop(leaves)
        out.append((leaf, x))
        degree[x] -= 1
        if degree[x] == 1:
            heapq.heappush(leaves, x)
    out.append((heapq.heappop(leaves), heapq.heappop(leaves)))
    return out


def threshold_search(items: DataFrame, item: str, query: str, most: int, limit: int = 10) -> DataFrame:
    """Items within an edit distance of a query, nearest first: a length filter, then the bounded distance; a full scan, but no index to build or keep."""
    near = items.select(F.col(item).alias("item")).distinct().filter(F.abs(F.length("item") - len(query)) <= most)
    d = F.levenshtein(F.col("item"), F.lit(query), most)
    return near.withColumn("d", d).filter("d >= 0").orderBy("d", "item").limit(limit)


def edges_of(spark: SparkSession, graph: dict) -> DataFrame:
    """A small adjacency map as an edge table."""
    return spark.createDataFrame([(a, b) for a, bs in graph.items() for b in bs], "src long, dst long")
