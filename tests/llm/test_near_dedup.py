import random

import numpy as np

from quillon.llm import near_dedup
from quillon.llm.components import connected_components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(sets[i]), root(i)) for i in range(len(texts))]


def check(rows, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == dict(enumerate(brute(texts)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_matches_brute_force(spark, table, odd_texts):
    check(near_dedup.near_duplicates(spark, table(odd_texts)).collect(), odd_texts)


def test_large_groups_branch_and_join(spark, table):
    draw = random.Random(9)
    base = [f"w{draw.randrange(999)}" for _ in range(90)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(90)] = f"x{draw.randrange(99)}"
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 30 + [" ".join(f"y{draw.randrange(999)}" for _ in range(60)) for _ in range(20)]
    for small, large in ((16, 4096), (16, 40)):
        check(near_dedup.near_duplicates(spark, table(texts), small, large).collect(), texts)


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(1)
    a = np.unique(draw.integers(0, 1 << 62, 400).astype(np.uint64))
    b = np.concatenate([a[:350], np.unique(draw.integers(0, 1 << 62, 50).astype(np.uint64))])
    agree = (near_dedup.sketch(a) == near_dedup.sketch(b)).sum()
    assert near_dedup.AGREE <= agree <= near_dedup.SKETCH


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 8), (8, 9)], "a long, b long")
    assert {r["id"]: r["component"] for r in connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert connected_components(edges.limit(0)).count() == 0


def test_nulls_repeats_and_empty(spark, table):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (None, "a b c d e f", 2), (4, "a b c d e f", 3), (4, "a b c d e f", 3), (7, None, 4)], "doc_id long, text string, kept int")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark, docs).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (4, 4, True), (4, 4, True), (7, 7, True)], key=str)
    assert near_dedup.without_near_duplicates(spark, docs).count() == 4
    assert near_dedup.near_duplicates(spark, table([])).count() == 0


def test_unlucky_pairs_at_the_threshold_are_candidates(spark):
    draw = np.random.default_rng(3)
    a = draw.integers(0, 1 << 32, near_dedup.SKETCH).astype(np.uint32)
    b = np.where(np.arange(near_dedup.SKETCH) < 28, a, a + np.uint32(1))  # 28 of 64 agree
    members = spark.createDataFrame([(5, 1, a.tobytes()), (5, 2, b.tobytes())], "node long, id long, sketch binary")
    assert [(r["a"], r["b"]) for r in near_dedup.compare_nodes(members).collect()] == [(1, 2)]


def test_repeated_ids_and_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "a", 7), (2, words + " more", "b", 8), (2, "another text of one repeated id here", "c", 9), (2, "another text of one repeated id here", "c", 9), (None, words, "d", 1), (None, None, "e", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _nth string, _kept long")
    kept = near_dedup.without_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["_nth"], r["_kept"]) for r in kept.collect()} in ({(1, "a", 7), (None, "d", 1), (None, "e", 2)}, {(1, "a", 7), (2, "c", 9), (None, "d", 1), (None, "e", 2)})
    first = sorted(map(str, kept.collect()))
    assert all(sorted(map(str, near_dedup.without_near_duplicates(spark, docs.repartition(k)).collect())) == first for k in (1, 3))
