"""Substring deduplication over a compacted de Bruijn graph (operator 10).

Nodes are token k-mers (8 words) sampled by winnowing: the least k-mer of every 35-word window, so that equal windows share
theirs. Edges are the exact word strings from one sampled k-mer to the next, with their multiplicity. Where a
node has one way in and one way out (its count equals both edges' counts) the path compacts; a compacted path that
occurs twice certifies the windows around its inner nodes. The remaining windows of repeated nodes (ends of paths,
branches) are verified one by one, by hashes of whole windows taken at their source coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, Rolling, WordHashes, mixed, over_arrow, raw, written

#: Words of a window whose repetition removes it, and of a k-mer.
SPAN = 35
KMER = 8

_HASHES: WordHashes | None = None


def _words() -> WordHashes:
    global _HASHES
    if _HASHES is None:
        _HASHES = WordHashes()
    return _HASHES


def anchors(kmers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the least k-mer (leftmost of equals) of each run of `width` k-mers, and which of them is each run's own: equal runs pick equal places."""
    n = len(kmers)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at = kmers.copy(), np.arange(n)
    size = 1
    while size < width:  # doubling: the minimum over `size` entries becomes that over up to twice as many
        step = min(size, width - size)
        right, right_at = least[step:], at[step:]
        left, left_at = least[:-step], at[:-step]
        worse = right < left
        least, at = np.where(worse, right, left), np.where(worse, right_at, left_at)
        size += step
    return np.unique(at, return_inverse=True)


class Spans:
    """The hashes of one text's words: its sampled k-mers, the edges between them and its windows."""

    def __init__(self, words: list[bytes], span: int = SPAN, kmer: int = KMER) -> None:
        self.n, self.span, self.kmer = len(words), span, kmer
        self.values = _words().array(words)
        self.rolling = Rolling(self.values)
        kmers = self.rolling.windows(kmer) if self.n >= span else np.zeros(0, np.uint64)
        self.at, self.own = anchors(kmers, span - kmer + 1)
        self.nodes = kmers[self.at]

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the windows at these starts."""
        second = Rolling(mixed(self.values ^ np.uint64(GOLDEN)))
        return self.rolling.windows(self.span)[starts], second.windows(self.span)[starts]

    def edges(self) -> np.ndarray:
        """The hash of the words from each sampled k-mer to the end of the next."""
        return self.rolling.stretch(self.at[:-1], self.at[1:] + self.kmer)


def occurrences(docs: DataFrame) -> DataFrame:
    """(node, key, doc, pos, edge): each sampled k-mer with the edge that leaves it, null at the last."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, row, doc, pos, edge, last = [], [], [], [], [], []
        for key, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
            words = text.split() if text else []
            if len(words) < SPAN:
                continue
            found = Spans(words)
            node.append(found.nodes)
            pos.append(found.at)
            edge.append(np.append(found.edges(), np.uint64(0)))
            last.append(np.append(np.zeros(len(found.at) - 1, bool), True))
            row.append(np.full(len(found.at), key, np.int64))
            doc.append(np.full(len(found.at), own, np.int64))
        if not node:
            return None
        return pa.record_batch(
            [pa.array(np.concatenate(node).view(np.int64)), pa.array(np.concatenate(row)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.concatenate(edge).view(np.int64), mask=np.concatenate(last))],
            ["node", "key", "doc", "pos", "edge"],
        )

    return over_arrow(docs, ["key", "doc", "text"], "node long, key long, doc long, pos int, edge long", run)


def paths(found: Spans, pos: np.ndarray, node_count: np.ndarray, edge_count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inner, low, high) of each sampled k-mer: whether it is an inner node of a compacted path, and the path's first word and end.

    pos: the places of the repeated nodes; edge_count: the multiplicity of the edge to the next sampled k-mer, 0 where it occurs once.
    """
    size = len(found.at)
    nodes, edges = np.zeros(size, np.int64), np.zeros(size, np.int64)
    place = np.searchsorted(found.at, pos)
    nodes[place], edges[place] = node_count, edge_count
    inner = np.zeros(size, bool)
    inner[1:-1] = (nodes[1:-1] > 1) & (edges[:-2] == nodes[1:-1]) & (edges[1:-1] == nodes[1:-1])
    index = np.arange(size)
    low = found.at[np.maximum.accumulate(np.where(inner, 0, index))]
    high = found.at[np.minimum.accumulate(np.where(inner, size - 1, index)[::-1])[::-1]] + found.kmer
    return inner, low, high


def plan_windows(found: Spans, pos: np.ndarray, node_count: np.ndarray, edge_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(certified window starts, window starts to verify) of a text with repeated k-mers at pos.

    A window's least k-mer is sampled wherever the window occurs, so it must be a repeated node. If it is an inner node
    of a path that covers the window, all its occurrences run along that path: the window repeats as often, and each copy
    is certified in its own text likewise. Any other window is left to verification in all its copies.
    """
    starts = np.arange(found.n - found.span + 1)
    repeated = np.zeros(len(found.at), bool)
    repeated[np.searchsorted(found.at, pos)] = True
    starts = starts[repeated[found.own]]
    own = found.own[starts]
    inner, low, high = paths(found, pos, node_count, edge_count)
    sure = inner[own] & (starts >= low[own]) & (starts + found.span <= high[own])
    return starts[sure], starts[~sure]


def runs(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Window starts to the stretches [from, to) of words that they cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > span) + 1
    return [(int(g[0]), int(g[-1]) + span) for g in np.split(starts, cut)]


def substring_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_text (the words left, joined by one space).

    Every word in a 35-word window that starts anywhere else too is removed, in all its places. Null and empty texts
    have no words and keep the empty text. Rows are told apart even where doc_id is null or repeated, and repeated rows are
    copies of each other. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")) if _from_files(docs) else None
    if rows is None:
        keyed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "substring-docs")
        rows = keyed.select("doc_id", "text", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    rows = rows.select(F.xxhash64("path", "row").alias("key"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "doc_id", "text")
    found = occurrences(rows)
    nodes = found.groupBy("node").agg(F.count("*").alias("node_count")).filter("node_count > 1")
    known = written(found.join(nodes, "node"), "substring-nodes")
    edges = known.filter("edge is not null").groupBy("edge").agg(F.count("*").alias("edge_count")).filter("edge_count > 1")
    spots = known.join(edges, "edge", "left").groupBy("key", "doc").agg(F.sort_array(F.collect_list(F.struct("pos", "node_count", F.coalesce("edge_count", F.lit(0)).alias("edge_count")))).alias("spots"))
    spots = written(spots, "substring-spots")
    texts = rows.join(spots, ["key", "doc"])

    def emit(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        window, check, row, doc, at = [], [], [], [], []
        spots = Spots(batch.column(3))
        for i, (key, own, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True)):
            spans = Spans(text.split())
            _, unsure = plan_windows(spans, *spots[i])
            if len(unsure):
                for to, value in zip((window, check), spans.windows(unsure), strict=True):
                    to.append(value)
                row.append(np.full(len(unsure), key, np.int64))
                doc.append(np.full(len(unsure), own, np.int64))
                at.append(unsure)
        if not window:
            return None
        hashes = [pa.array(np.concatenate(x).view(np.int64)) for x in (window, check)]
        return pa.record_batch([*hashes, pa.array(np.concatenate(row)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(at).astype(np.int32))], ["window", "check", "key", "doc", "at"])

    windows = written(over_arrow(texts, ["key", "doc", "text", "spots"], "window long, check long, key long, doc long, at int", emit), "substring-windows")
    twice = windows.groupBy("window", "check").agg(F.count("*").alias("n")).filter("n > 1").select("window", "check")
    verified = windows.join(twice, ["window", "check"], "left_semi").groupBy("key", "doc").agg(F.sort_array(F.collect_list("at")).alias("verified"))
    full = rows.join(spots.join(verified, ["key", "doc"], "left"), ["key", "doc"], "left")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, removed, kept = [], [], []
        spots, sure = Spots(batch.column(2)), batch.column(3)
        at_of, verified_at = sure.offsets.to_numpy(), sure.values.to_numpy(zero_copy_only=False)
        for i, text in enumerate(raw(batch.column(1))):
            words = text.split() if text else []
            total.append(len(words))
            if spots.valid[i]:
                fixed, _ = plan_windows(Spans(words), *spots[i])
                starts = np.unique(np.concatenate([fixed, verified_at[at_of[i] : at_of[i + 1]].astype(np.int64)]))
                out, at = [], 0
                for a, b in runs(starts, SPAN):
                    out.extend(words[at:a])
                    at = b
                words = out + words[at:]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return over_arrow(full, ["doc_id", "text", "spots", "verified"], "doc_id long, n_words long, n_removed long, kept_text string", finish)


class Spots:
    """A column of repeated nodes by row, without a Python object for each."""

    def __init__(self, column: pa.ListArray) -> None:
        self.offsets = column.offsets.to_numpy()
        values = column.values
        self.columns = [values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.offsets[i], self.offsets[i + 1]
        return tuple(c[a:b] for c in self.columns)


def _from_files(docs: DataFrame) -> bool:
    """Whether docs is a plain read of Parquet files, whose rows have a place that every scan finds again."""
    plan = docs._jdf.queryExecution().analyzed().toString()
    return plan.startswith("Relation ") and plan.count("\n") <= 1 and " parquet" in plan
