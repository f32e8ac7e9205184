import random
import zlib

import numpy as np

from quillon.llm import packing
from quillon.llm.tokens import default_vocabulary


def test_ids_and_layout(spark, table, odd_texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_vocabulary())
    texts = [*odd_texts, "It's <|endoftext|> odd spaces here ́mark İstanbul ΣΑΣ don't 12 345", "é Å"]
    rows = packing.pack(spark, table(texts), ids=True).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        expected = whole.encode(text or "", add_special_tokens=False).ids + [0]
        got = [int(x) for r in parts for x in np.frombuffer(r["ids"], "<u4")]
        assert got == expected
        assert [r["piece"] for r in parts] == list(range(len(parts))) and [r["start"] for r in parts] == [2048 * k for k in range(len(parts))]
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in parts) and all(r["length"] == 2048 for r in parts[:-1])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(r["length"] for r in rows) // 2048)


def first_fit_decreasing(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        for i, room in enumerate(bins):
            if room >= x:
                bins[i] -= x
                break
        else:
            bins.append(capacity - x)
    return len(bins)


def test_plan_uses_every_piece_and_beats_first_fit():
    draw = random.Random(2)
    for capacity in (10, 60, 300):
        for _ in range(20):
            lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 200))]
            counts = {x: lengths.count(x) for x in set(lengths)}
            steps = packing.plan(counts, capacity)
            used = {}
            for times, fillings in steps:
                assert sum(size * k for size, k in fillings) <= capacity
                for size, k in fillings:
                    used[size] = used.get(size, 0) + times * k
            assert used == counts
            assert sum(t for t, _ in steps) <= first_fit_decreasing(lengths, capacity) + 1
            assert len(steps) <= 2 * capacity


def test_empty_and_null(spark, table):
    assert packing.pack(spark, table([])).count() == 0
    rows = packing.pack(spark, spark.createDataFrame([(None, None, 1), (3, "hi there", 2), (3, "hi there", 2)], "doc_id long, text string, length int")).collect()
    assert sorted((r["length"], r["sequence_id"]) for r in rows) == [(1, 0), (3, 0), (3, 0)] and sorted(r["offset"] for r in rows) == [0, 3, 6]


def fewest(lengths, capacity):
    """The least number of bins, by trying every bin for every piece."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= lengths[i]}):
            k = rooms.index(room)
            put(i + 1, [*rooms[:k], room - lengths[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


def test_plan_without_limits_is_optimal():
    draw = random.Random(7)
    for _ in range(60):
        capacity = draw.choice([10, 20, 50])
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 9))]
        steps = packing.plan({x: lengths.count(x) for x in set(lengths)}, capacity, None, None)
        assert sum(n for n, _ in steps) == fewest(lengths, capacity), (capacity, lengths)
        assert sorted(s for n, f in steps for _ in range(n) for s, k in f for _ in range(k)) == sorted(lengths)


def test_plan_goes_back_on_a_filling():
    steps = packing.plan({x: 1000 for x in (70, 60, 58, 29, 23, 17, 16, 14, 13)}, 100)
    assert sum(n for n, _ in steps) == 3000


def test_fillings_are_undominated():
    counts = np.zeros(21, np.int64)
    counts[[3, 5, 7, 11]] = [2, 1, 4, 1]
    found = packing.fillings(20, counts, None, None)
    loads = [sum(s * k for s, k in f) for f in found]
    assert loads == sorted(loads, reverse=True) and loads[0] == 20 - min(20 - x for x in {3 * a + 5 * b + 7 * c + 11 * d for a in range(3) for b in range(2) for c in range(5) for d in range(2)} if x <= 20)
    assert len({tuple(sorted(f)) for f in found}) == len(found)


def test_pieces_equal_in_all_columns_have_places_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 7)  # several blocks in each task
    draw = random.Random(8)
    rows = [(None, "the same words in many rows", 1)] * 90 + [(5, "the same words in many rows", 2)] * 40 + [(i, "word " * draw.randrange(3000), 3) for i in range(60)] + [(6, None, 4)] * 30
    got = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string, nth int").repartition(5), capacity=512).collect()
    taken = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    ends = {}
    for sequence, offset, length in taken:
        assert ends.get(sequence, 0) == offset
        ends[sequence] = offset + length
    assert max(ends.values()) <= 512 and len(ends) <= 1 + -(-sum(r["length"] for r in got) // 512)
    assert packing.among_equal(np.array([4, 2, 4, 4, 2, 9])).tolist() == [0, 0, 1, 2, 1, 0] and not len(packing.among_equal(np.zeros(0, np.int64)))
