"""Benchmark decontamination by q-gram lemma filtering (operator 8).

Texts are compared in lower case (A-Z) with runs of white space as one space. If a stretch of a document matches an item of m
characters within k edits, the two share at least m + 1 - q - k q of their q-grams on diagonals that differ by at most k. Shared
q-grams are counted in overlapping bands of diagonals, two edit budgets wide; bands that reach the bound are regions, and each
region is verified by a banded alignment of the whole item.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_arrow, raw, rows_where

#: Bytes of a q-gram and edits allowed for each byte of an item; items shorter than SHORTEST bytes must match without edits.
Q = 10
BUDGET = 0.06
SHORTEST = 32
_BITS = 20
_SPLIT = 1 << 21
#: Bytes of benchmark text that one pass broadcasts; a larger benchmark takes several passes over blocks of it.
BLOCK_BYTES = 8 << 20


def normal(text: bytes | None) -> bytes:
    return b" ".join(text.lower().split()) if text else b""


def budget(length: int) -> int:
    """The edits allowed for an item: as the rate says, but never so many that the lemma's bound on shared q-grams falls below one."""
    return 0 if length < SHORTEST else max(0, min(int(BUDGET * length), (length - Q) // Q))


def qgrams(buffer: bytes) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    count = len(buffer) - Q + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    return words[:count] * np.uint64(0x9E3779B97F4A7C15) + words[Q - 8 : Q - 8 + count] * np.uint64(0xC2B2AE3D27D4EB4F)


class Index:
    """The q-grams of a block of items: a bitmap to pass over text quickly, then a sorted table with the places."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.items = [(i, t) for i, t in items if t]
        self.size = np.array([len(t) for _, t in self.items], np.int64)
        self.edits = np.array([budget(len(t)) for _, t in self.items], np.int64)
        grams = [qgrams(t) for _, t in self.items]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = (np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64))[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.needed = np.maximum(1, self.size + 1 - Q - self.edits * Q)
        self.tiny = [(n, t) for n, (_, t) in enumerate(self.items) if len(t) < Q]

    def regions(self, buffer: bytes) -> list[tuple[int, int]]:
        """(item, diagonal where its band starts) of the bands with enough shared q-grams."""
        grams = qgrams(buffer)
        at = np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        found = grams[at]
        low, high = np.searchsorted(self.hashes, found, "left"), np.searchsorted(self.hashes, found, "right")
        n = high - low
        if not n.sum():
            return []
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item = self.item[entry]
        diagonal = np.repeat(at, n) - self.place[entry] + self.size[item]  # never negative
        width = self.edits[item] + 1
        band = diagonal // width
        span = np.int64(len(buffer) + int(self.size.max()) + 2)
        keys = np.concatenate([item * span + band, item * span + np.maximum(band - 1, 0)])  # band b holds diagonals [b, b + 2) * width
        keys, counts = np.unique(keys, return_counts=True)
        which = keys // span
        keep = counts >= self.needed[which]
        return [(int(i), int(b * (self.edits[i] + 1) - self.size[i])) for i, b in zip(which[keep], (keys % span)[keep], strict=True)]


def align(item: bytes, text: bytes, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the whole item within text, in a band of diagonals; None above the budget.

    Costs run over text offsets 0 to len(text) - len(item) + edits of the start diagonal; each row is a vector, and insertions along it
    are a running minimum.
    """
    found = text.find(item)
    if found >= 0:
        return 0, found, found + len(item)
    if not edits:
        return None
    a, b = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    n = len(b)
    steps = np.arange(n + 1)
    cost = np.zeros(n + 1, np.int32)
    begin = steps.copy()
    for i, c in enumerate(a):
        replaced = cost[:-1] + (b != c)
        dropped = cost[1:] + 1
        take = replaced <= dropped
        new = np.concatenate([[i + 1], np.where(take, replaced, dropped)])
        start = np.concatenate([[begin[0]], np.where(take, begin[:-1], begin[1:])])
        level = new - steps
        least = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == least, steps, 0))
        cost, begin = least + steps, start[source]
        if cost.min() > edits:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


def matches(index: Index, text: bytes) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, edits) of each item found in a normalised text: its best place."""
    best: dict[int, tuple[int, int, int]] = {}
    overlap = int(index.size.max() + index.edits.max()) if len(index.size) else 0
    for at in range(0, max(1, len(text)), _SPLIT):  # a very long text in overlapping parts
        part = text[at : at + _SPLIT + 2 * overlap]
        for n, t in index.tiny:
            place = part.find(t)
            if place >= 0:
                best[n] = min(best.get(n, (1 << 30, 0, 0)), (0, at + place, at + place + len(t)))
        for n, diagonal in index.regions(part):
            if n in best and not best[n][0]:
                continue
            k = int(index.edits[n])
            low = max(0, diagonal - k)
            got = align(index.items[n][1], part[low : diagonal + 2 * k + 2 + int(index.size[n]) + k], k)
            if got:
                best[n] = min(best.get(n, (1 << 30, 0, 0)), (got[0], at + low + got[1], at + low + got[2]))
    return [(index.items[n][0], start, end, edits) for n, (edits, start, end) in sorted(best.items())]


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and benchmark item found in it: doc_id, item_id, match_start, match_end, edits.

    Offsets are bytes of the normalised text. Null and empty texts and items match nothing; repeated rows give repeated matches. The
    benchmark is read in blocks of BLOCK_BYTES, one pass over the documents for each block. Other columns are ignored.
    """
    out = None
    for items in item_blocks(benchmark):
        part = _pass(docs, items)
        out = part if out is None else out.union(part)
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's normalised items in blocks of about BLOCK_BYTES; one block at least."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        yield sorted((r["item_id"], normal(r["text"].encode())) for r in own.collect())


def clean_rows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark item is found."""
    for items in item_blocks(benchmark):
        docs = rows_where(docs, "text", _finder(items))
    return docs


def _finder(items: list[tuple[int, bytes]]) -> Callable[[list[bytes | None]], list[bool]]:
    kept: list[Index] = []

    def clean(texts: list[bytes | None]) -> list[bool]:
        if not kept:
            kept.append(Index(items))
        return [not t or not matches(kept[0], normal(t)) for t in texts]

    return clean


def _pass(docs: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
    kept: list[Index] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not kept:
            kept.append(Index(items))
        out = []
        texts = [normal(t) for t in raw(batch.column(1))]
        for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            if text:
                out.extend((doc, *m) for m in matches(kept[0], text))
        if not out:
            return None
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "item_id", "match_start", "match_end", "edits"])

    return over_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, item_id long, match_start long, match_end long, edits long", run)
