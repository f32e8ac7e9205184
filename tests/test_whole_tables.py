import math
import random
from collections import Counter

from quillon.plans import queries_counting as counting
from quillon.plans import queries_joins as joins
from quillon.plans import queries_models as models
from quillon.plans.base import BASES, LETTERS


def rna(text):
    return "".join(c for c in text.lower().translate(str.maketrans(LETTERS, BASES)) if c in "ACGU")


def prose(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice("abcdefgh tuvw.") for _ in range(n))


def write_texts(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")


def test_dinuc_shuffle_covers_whole_texts(spark, tmp_path):
    texts = [prose(i, 400) for i in range(6)]
    write_texts(spark, tmp_path, texts)
    rows = models.dinuc_shuffle(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(range(6))
    pairs = lambda s: Counter(zip(s, s[1:]))
    assert all(pairs(r["shuffled"]) == pairs(rna(texts[r["doc_id"]])) for r in rows)


def test_candidate_filter_scores_whole_texts(spark, tmp_path):
    head = prose(1, 120)  # equal heads: only the rest tells the texts apart
    write_texts(spark, tmp_path, [head + prose(10 + i, 300) for i in range(8)])
    scores = [r["re"] for r in models.candidate_filter(spark, str(tmp_path)).collect()]
    assert len(scores) == 4 and len(set(scores)) == 4 and all(math.isfinite(s) for s in scores)


def test_krnn_clusters_takes_every_vector(spark, tmp_path):
    draw = random.Random(4)
    vectors = [(190 + i, [draw.gauss(9.0 * (i % 3), 1.0) for _ in range(3)], 0) for i in range(30)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    clusters = {r["id"]: r["cluster"] for r in models.krnn_clusters(spark, str(tmp_path)).collect()}
    assert max(clusters) >= 200 and all(a == b or (i - j) % 3 for i, a in clusters.items() for j, b in clusters.items() if a != b)


def test_setops_with_seqs_takes_every_order(spark, tmp_path):
    orders = [(k, 1, f"1990-01-{10 + k % 9}") for k in (2, 499, 500, 1200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    text = prose(2, 300)
    write_texts(spark, tmp_path, ["", text])
    rows = joins.setops_with_seqs(spark, str(tmp_path)).collect()
    day = lambda k: 9 + k % 9
    assert {(r["start"], r["end"]) for r in rows} == {(day(k), day(k) + k % 50) for k, _, _ in orders}
    assert all(r["seq"] == text[r["start"] - 1 : r["end"]] for r in rows if r["strand"] == "1")


def test_scc_takes_every_line(spark, tmp_path):
    draw = random.Random(8)
    lines = [(draw.randrange(30), draw.randrange(12), draw.choice("RAN")) for _ in range(60)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    reach = {}
    for p, s, flag in lines:
        a, b = (p, -1 - s) if flag == "R" else (-1 - s, p)
        reach.setdefault(a, {a}).add(b)
        reach.setdefault(b, {b})
    for _ in reach:
        for a in reach:
            reach[a] = set().union(*(reach[b] for b in reach[a]))
    expected = {a: min(b for b in reach[a] if a in reach[b]) for a in reach}
    got = {r["id"]: r["component"] for r in joins.scc(spark, str(tmp_path)).collect()}
    assert got == expected and len(set(expected.values())) < len(expected)


def test_ordered_pairs_over_whole_texts(spark, tmp_path):
    texts = [prose(i, 300) for i in range(4)] + ["", None]
    spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    expected, ordered = Counter(), Counter()
    for i, t in enumerate(texts):
        q, lang = rna(t or ""), "en" if i % 2 else None
        for j, y in enumerate(q):
            for x in q[:j]:
                ordered[lang, x + y] += 1
                expected[lang, min(x, y) + max(x, y)] += 1
    rows = lambda df: {(r["lang"], r["item"]): r["n"] for r in df.collect()}
    assert rows(counting.combins_freq_sym(spark, str(tmp_path))) == expected and rows(counting.combins_freq_nonsym(spark, str(tmp_path))) == ordered
