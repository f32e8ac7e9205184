"""Best-fit packing by bin completion (operator 5).

A document's tokens, cut at the sequence length, are pieces of 1 to 2048 tokens. How pieces share sequences depends
only on how many there are of each length, so the driver packs a histogram of at most 2048 entries: around the largest
piece left, branch and bound enumerates undominated fillings, starting from the best-fit filling as incumbent, the best one is used as often as the
counts allow, and where that takes more sequences than the tokens need, a search over plans goes back to other fillings. Every piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import at_rest, written
from .common import pieces as slices
from .tokens import BATCH, Encoded, default_vocabulary, word_ids

CAPACITY = 2048
#: Nodes that the branch and bound visits for one filling, places that the search over plans looks at beyond its first one, and fillings it tries
#: at each. None lifts a limit; the plan is optimal without all three.
NODES, TRIES, WIDE = 400, 2000, 4
#: Pieces of one length that a task numbers before it starts a new block.
BLOCK = 8192


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, block, nth, and ids if asked for): each document's ids and a closing 0, cut every `capacity` tokens.

    A task numbers its pieces of one length as it cuts them: `part` is the task, `nth` the number within a block of BLOCK pieces. A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, BATCH):
                yield cut(some, part, seen)
            pa.default_memory_pool().release_unused()
        batch = some = None
        at_rest()

    def cut(batch: pa.RecordBatch, part: int, seen: np.ndarray) -> pa.RecordBatch:
        flat, bounds = Encoded(batch.column(1), word_ids(path)).ids(0)
        sizes = np.diff(bounds)
        n = -(-sizes // capacity)
        doc = np.repeat(np.arange(len(sizes)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        cuts = np.append(bounds[doc] + start, bounds[-1])
        packed = memoryview(flat.view(np.uint8))
        crc = [zlib.crc32(packed[a:b]) for a, b in zip((4 * cuts[:-1]).tolist(), (4 * cuts[1:]).tolist(), strict=True)]
        length = np.diff(cuts)
        own = seen[length] + among_equal(length)
        seen += np.bincount(length, minlength=len(seen))
        columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        columns += [pa.array(np.full(len(doc), part, np.int32)), pa.array((own // BLOCK).astype(np.int32)), pa.array((own % BLOCK).astype(np.int32))]
        if ids:
            columns.append(pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(flat)]))
        return pa.record_batch(columns, names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "block", "nth", *(["ids"] if ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, block int, nth int" + (", ids binary" if ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def among_equal(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each one."""
    order = np.argsort(values, kind="stable")
    first = np.flatnonzero(np.diff(values[order], prepend=-1))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    return out


def fillings(room: int, counts: np.ndarray, most: int | None = NODES, wanted: int | None = 1) -> list[list[tuple[int, int]]]:
    """The undominated fillings of `room` with the least waste, best first: `wanted` of them at most (None: all), as lists of (length, how often).

    Branch and bound over lengths in falling order; each length is tried in every number that fits, most first, so the first descent is best
    fit and the incumbent. A branch is cut when even all that is left of smaller lengths can't beat the worst of the fillings held, and a filling is
    dominated, and dropped, if one of its pieces could be a longer one that is left over or another piece would still fit. The search visits
    `most` nodes; None is no limit.
    """
    sizes = np.flatnonzero(counts[: room + 1])[::-1]
    if not len(sizes):
        return [[]]
    left_over, falling = [int(s) for s in sizes], (-sizes).tolist()
    volume = np.cumsum((sizes * counts[sizes])[::-1])[::-1].tolist()
    best: list[tuple[int, list[tuple[int, int]]]] = []
    stack: list[tuple[int, int, list[tuple[int, int]]]] = [(0, room, [])]
    visited = 0
    while stack and (most is None or visited < most):
        at, left, chosen = stack.pop()
        visited += 1
        at = max(at, bisect_left(falling, -left))  # the largest that fits
        worst = best[-1][0] if wanted and len(best) == wanted else room + 1
        if not left or at >= len(left_over):
            if left < worst and not _dominated(chosen, left, left_over, counts):
                best = sorted([*best, (left, chosen)], key=lambda x: x[0])[:wanted]
                if wanted and len(best) == wanted and not best[-1][0]:
                    break
            continue
        if left - volume[at] >= worst:
            continue
        size = left_over[at]
        fits = int(min(left // size, counts[size]))
        exact = left - fits * size
        stack.append((at + 1, left, chosen))
        stack.extend((at + 1, left - k * size, [*chosen, (size, k)]) for k in range(1, fits + 1))
        if 0 < exact < size and counts[exact] > 0:  # one more piece closes the sequence
            stack.append((len(left_over), 0, [*chosen, (size, fits), (exact, 1)]))
    return [chosen for _, chosen in best] or [_best_fit(room, left_over, counts)]


def _best_fit(room: int, sizes: list[int], counts: np.ndarray) -> list[tuple[int, int]]:
    out = []
    for size in sizes:
        k = int(min(room // size, counts[size]))
        if k:
            out.append((size, k))
            room -= k * size
    return out


def _dominated(chosen: list[tuple[int, int]], waste: int, sizes: list[int], counts: np.ndarray) -> bool:
    """Whether a piece that is left over fits beside the chosen ones, or in the place of a shorter one."""
    if not waste:
        return False
    used = dict(chosen)
    free = [s for s in sizes if counts[s] > used.get(s, 0)]
    return any(s <= waste for s in free) or any(size < s <= size + waste for size in used for s in free)


def _after(counts: np.ndarray, largest: int, rest: list[tuple[int, int]]) -> tuple[dict[int, int], int]:
    """What a sequence of the largest piece and a filling uses, and how many such sequences the counts allow."""
    use = dict(rest)
    use[largest] = use.get(largest, 0) + 1
    return use, int(min(counts[size] // k for size, k in use.items()))


def _taken(counts: np.ndarray, use: dict[int, int], times: int) -> np.ndarray:
    counts = counts.copy()
    for size, k in use.items():
        counts[size] -= times * k
    return counts


def plan(histogram: dict[int, int], capacity: int = CAPACITY, most: int | None = NODES, tries: int | None = TRIES) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(how many sequences, [(length, how often in each), ...]), ...].

    Bin completion: the largest piece left gets an undominated filling, as often as the counts allow. The best filling at every place makes the
    first incumbent. Where its sequences are more than tokens / capacity, the search goes back to take other fillings, or the same less often,
    pruned by that bound over what is left. It looks at `tries` places of at most WIDE fillings each; with most and tries None it looks at all, and the plan is optimal.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    lengths = np.arange(capacity + 1)
    lowest = -(-int(counts @ lengths) // capacity)

    def choices(counts: np.ndarray, wanted: int | None) -> list[tuple[dict[int, int], int]]:
        largest = int(np.flatnonzero(counts)[-1])
        counts = counts.copy()
        counts[largest] -= 1
        found = fillings(capacity - largest, counts, most, wanted)
        counts[largest] += 1
        return [_after(counts, largest, rest) for rest in found]

    best, left = [], counts
    while left.any():
        use, times = choices(left, 1)[0]
        best.append((times, use))
        left = _taken(left, use, times)
    fewest = sum(n for n, _ in best)
    heap: list[tuple] = [(0, 0, 0, counts, {}, 0, 0, None)]  # places that differ least from the first choices come first, of these the deepest
    pushed = 0
    while heap and fewest > lowest and (tries is None or tries > 0):
        strayed, depth, _, left, use, times, used, steps = heappop(heap)
        left, used = _taken(left, use, times), used + times
        if times:
            steps = (steps, (times, use))
        if not left.any():
            if used < fewest:
                best, fewest = [], used
                while steps:
                    steps, step = steps
                    best.append(step)
                best.reverse()
            continue
        if used - (-int(left @ lengths) // capacity) >= fewest:
            continue
        tries = None if tries is None else tries - 1
        for n, (use, times) in enumerate(choices(left, None if tries is None else WIDE)):
            for k, less in enumerate(sorted({1, times}, reverse=True)):
                pushed += 1
                heappush(heap, (strayed + n + k, depth - 1, pushed, left, use, less, used, steps))
    return [(times, sorted(use.items(), reverse=True)) for times, use in best]


def places(steps: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, how often in each, offset): where the pieces of a length go, by rank among them."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, fillings in steps:
        offset = 0
        for length, k in fillings:
            first = used.get(length, 0)
            out.append((length, first, times * k, sequence, k, offset))
            used[length] = first + times * k
            offset += k * length
        sequence += times
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """The written pieces with `rank`, 0, 1, ... within each length: the number in a block plus the pieces in the blocks before it.

    Only counts of blocks are sorted; a piece moves at most once, to the count of its block, and a block has BLOCK pieces at most.
    """
    blocks = rows.groupBy("length", "part", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(blocks.select("length", "part", "block", before.alias("before")), ["length", "part", "block"]).withColumn("rank", F.col("nth") + F.col("before"))


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null and empty texts are one piece, the closing 0. Repeated rows and null ids are packed like any other. An empty table gives no rows. Other columns are ignored.
    """
    rows = written(pieces(docs, path or default_vocabulary(), capacity, ids), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    steps = places(plan(histogram, capacity)) or [(1, 0, 0, 0, 1, 0)]
    table = spark.createDataFrame(steps, "length long, first long, ranks long, sequence long, k long, place long")
    by_length = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "ranks", "sequence", "k", "place"))).alias("places"))
    spot = F.filter("places", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["first"] + p["ranks"]))[0]
    nth = F.col("rank") - F.col("spot.first")
    out = ranked(rows).join(F.broadcast(by_length), "length").withColumn("spot", spot)
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("spot.sequence") + F.floor(nth / F.col("spot.k"))).cast("long").alias("sequence_id"),
        (F.col("spot.place") + (nth % F.col("spot.k")) * F.col("length")).cast("long").alias("offset"), *(["ids"] if ids else []),
    )
