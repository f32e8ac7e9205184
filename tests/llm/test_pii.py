import hashlib
import random
import re

from quillon.llm import pii
from quillon.llm.queries import op3_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda v: re.sub("[^0-9]", "", v)
    valid = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v)),
        "phone": lambda v: 8 <= len(digits(v)) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, r in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for m in r.finditer(text) if valid[k](m[0])]


def cases():
    draw = random.Random(3)
    fixed = [
        None, "", "no data", "a@b.c_d@e.f é a@b.c.d@x-y.z", "x@y x@y. x@y.z.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.0255.4", "9" * 400 + ".1.1.1 7.7.7.7",
        "4465758382889437 4465758382889437", "4111 1111 1111 1111", "4111-1111-1111-1111,", "4111  1111 1111 1111", "+1 (743) 555-3824 +1 2", "+123456789012345678 +12345678", "😀 mail me: jo.e+x@mail5.example.com 😀 8.196.197.208",
        "a.b.c." * 3000 + "@x.y", "1 2 3 4 5 6 7 8 9 " * 500, "+" * 500 + "1" + " " * 500, "a@" + "b." * 5000 + "c",
    ]
    pieces = ["1", "22", "255", "300", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "4111111111111111", "é", "x@y.zz", "\n", "_", "%"]
    return fixed + ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 40))) for _ in range(600)]


def test_base_spans_match_brute_force(spark, table):
    texts = cases()
    found = {r["doc_id"]: r for r in pii.sanitise(spark, table(texts)).collect()}
    for i, text in enumerate(texts):
        expected = brute(text)
        assert found[i]["base_report"] == ",".join(expected), text[:200]
        for kind in ("email", "ip", "card", "phone"):
            assert found[i][f"n_{kind}"] == sum(x.startswith(kind) for x in expected)
        assert (found[i]["clean_text"] == (text or "")) == (not expected)


def test_terms_that_reveal_an_entity_are_removed(spark, table):
    draw = random.Random(1)
    filler = lambda n: " ".join(f"w{draw.randrange(500)}" for _ in range(n))
    texts = [f"{filler(20)} Zorblatt writes from z@corp.example {filler(10)}" for _ in range(6)]
    texts += [f"{filler(20)} the contact q{i}@corp.example {filler(10)}" for i in range(30)] + [filler(30) for _ in range(100)]
    rows = {r["doc_id"]: r for r in pii.sanitise(spark, table(texts)).collect()}
    for i in range(6):
        assert "Zorblatt" not in rows[i]["clean_text"] and "[TERM]" in rows[i]["clean_text"] and "[EMAIL]" in rows[i]["clean_text"]
    assert all("term:" not in rows[i]["spans"] for i in range(36, 136))
    assert all("contact" in rows[i]["clean_text"] for i in range(6, 36))


def test_copies_of_one_context_are_one_piece_of_evidence(spark, table):
    texts = ["Same context Zorblatt z@corp.example here"] * 20 + ["filler text here"] * 50
    assert all("term:" not in r["spans"] for r in pii.sanitise(spark, table(texts)).collect())


def test_nulls_empty_table_and_extra_columns(spark, table):
    docs = spark.createDataFrame([(None, "me@x.yz", 1, "a"), (1, None, 2, "b"), (1, "me@x.yz", 3, "c")], "doc_id long, text string, base int, spans string")
    rows = pii.sanitise(spark, docs).orderBy("doc_id", "n_email").collect()
    assert [(r["doc_id"], r["n_email"]) for r in rows] == [(None, 1), (1, 0), (1, 1)]
    assert pii.sanitise(spark, table([])).count() == 0


def test_query_digest(spark, table, tmp_path):
    texts = ["a@b.cd", "x"]
    table(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in op3_pii(spark, str(tmp_path)).collect()}
    assert rows[0]["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest() and rows[0]["spans"] == "email:0:6"
    assert rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_terms_far_from_the_entity_count(spark, table):
    draw = random.Random(4)
    filler = lambda n: " ".join(f"w{draw.randrange(500)}" for _ in range(n))
    texts = [f"Zorblatt heads this letter {filler(120)} write to z@corp.example" for _ in range(6)]
    texts += [f"{filler(5)} Quibble y@corp.example {filler(60)} Quibble {filler(60)}" for _ in range(3)]
    texts += [f"Quibble {filler(120)} in the letter write to y@corp.example" for _ in range(12)] + [filler(100) for _ in range(300)]
    rows = {r["doc_id"]: r for r in pii.sanitise(spark, table(texts)).collect()}
    assert all("Zorblatt" not in rows[i]["clean_text"] for i in range(6))
    assert all("Quibble" not in rows[i]["clean_text"] for i in range(6, 21))
    assert all("letter" in rows[i]["clean_text"] for i in range(6))
    assert all("term:" not in rows[i]["spans"] for i in range(21, 321))


def test_parts_of_the_entity_are_terms(spark, table):
    draw = random.Random(6)
    filler = lambda n: " ".join(f"w{draw.randrange(500)}" for _ in range(n))
    texts = [f"{filler(20)} Alice writes from alice.smith@corp.example {filler(10)}" for _ in range(6)]
    texts += [f"{filler(20)} corp example {filler(10)}" for _ in range(30)] + [filler(30) for _ in range(100)]
    rows = {r["doc_id"]: r for r in pii.sanitise(spark, table(texts)).collect()}
    assert all("Alice" not in rows[i]["clean_text"] and "[EMAIL]" in rows[i]["clean_text"] for i in range(6))
    assert all("term:" not in rows[i]["spans"] for i in range(6, 136))


def test_terms_that_reveal_a_group_are_generalised(spark, table):
    draw = random.Random(9)
    filler = lambda n: " ".join(f"w{draw.randrange(400)}" for _ in range(n))
    texts = [f"{filler(20)} Quuxcorp 4711 offers {filler(5)} p{i}@quux.example {filler(10)}" for i in range(6)]  # each address once, one host
    texts += [f"{filler(20)} offers {filler(5)} p{i}@host{i}.example {filler(10)}" for i in range(40)] + [filler(30) for _ in range(700)]
    rows = {r["doc_id"]: r for r in pii.sanitise(spark, table(texts)).collect()}
    for i in range(6):
        assert "[WORD] [NUMBER] offers" in rows[i]["clean_text"] and "term:" not in rows[i]["spans"]
        kinds = [x.split(":")[0] for x in rows[i]["spans"].split(",")]
        assert kinds == ["email", "number", "word"]
    assert all(rows[i]["spans"] == rows[i]["base_report"] for i in range(6, len(texts)))


def test_common_groups_are_no_entities(spark, table):
    draw = random.Random(2)
    filler = lambda n: " ".join(f"w{draw.randrange(400)}" for _ in range(n))
    texts = [f"{filler(20)} bigmail {filler(5)} p{i}@big.example {filler(10)}" for i in range(60)] + [filler(30) for _ in range(200)]
    assert all(r["spans"] == r["base_report"] for r in pii.sanitise(spark, table(texts)).collect())
