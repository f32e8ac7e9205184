import random

from quillon.llm import decontamination as d


def edit_distance_within(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def sentences(draw, n):
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(n))


def test_matches_brute_force(spark):
    draw = random.Random(6)
    items = [(i, sentences(draw, draw.randint(6, 30))) for i in range(12)]
    texts = []
    for k in range(50):
        text = sentences(draw, draw.randint(5, 60))
        if k % 2:
            item = list(draw.choice(items)[1])
            for _ in range(draw.randint(0, 12)):
                at = draw.randrange(len(item))
                item[at : at + draw.randint(0, 1)] = draw.choice(["", "z", "q"])
            text = f"{text}\n {''.join(item).upper()}  {sentences(draw, 10)}"
        texts.append(text)
    texts += [None, "", items[0][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in d.contaminated(spark, docs, spark.createDataFrame([*items, (99, None)], "item_id long, text string")).collect()}
    expected = {}
    for i, t in enumerate(texts):
        text = d.normal((t or "").encode())
        for j, item in items:
            one = d.normal(item.encode())
            if text:
                e = edit_distance_within(one, text)
                if e <= d.budget(len(one)):
                    expected[i, j] = e
    assert got == expected and len(expected) > 10


def test_blocks_and_rows(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 40)
    items = spark.createDataFrame([(i, f"this is benchmark item number {i} of many more items") for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x this is benchmark item number 4 of many more items y", 7), (2, "clean", 8), (None, None, 9)], "doc_id long, text string, item_id int")
    assert (1, 4) in {(r["doc_id"], r["item_id"]) for r in d.contaminated(spark, docs, items).collect()}
    assert [r["doc_id"] for r in d.clean_rows(spark, docs, items).collect()] == [2, None]
    assert d.contaminated(spark, docs, items.limit(0)).count() == 0
