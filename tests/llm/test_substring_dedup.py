import random
from collections import Counter

from quillon.llm import substring_dedup


def brute(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def check(spark, table, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(spark, table(texts)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_matches_brute_force(spark, table, odd_texts):
    check(spark, table, odd_texts)


def test_branching_passages(spark, table):
    draw = random.Random(2)
    words = lambda n: [f"w{draw.randrange(60)}" for _ in range(n)]
    shared = [words(n) for n in (34, 35, 36, 50, 70, 120)]
    texts = []
    for _ in range(60):
        text = words(draw.randint(0, 40))
        for _ in range(draw.randint(0, 3)):
            piece = draw.choice(shared)
            at = draw.randrange(len(piece))
            text += draw.choice([piece, piece[at:], piece[:at]]) + words(draw.randint(0, 30))
        texts.append(" ".join(text))
    texts += ["a b " * 60, "c " * 35, "c " * 34, "d " * 36]
    check(spark, table, texts)


def test_nulls_repeats_and_empty(spark, table):
    line = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, line, 1), (3, line, 2), (3, None, 3)], "doc_id long, text string, key int")
    assert sorted(r["n_removed"] for r in substring_dedup.substring_dedup(spark, docs).collect()) == [0, 40, 40]
    assert substring_dedup.substring_dedup(spark, table([])).count() == 0
