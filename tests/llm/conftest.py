import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(texts, first=0):
    return [(first + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def table(spark):
    return lambda texts: spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, blanks, repeated rows, a very long text, near copies and shared passages."""
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    words = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    base, passage, small = words(120), words(60), words(3)
    near = [list(base) for _ in range(12)]
    for copy in near:
        copy[draw.randrange(120)] = "changed"
    out = [None, "", " \t\n", "one", "a b c d", " ".join(small), " ".join(small).upper(), " ".join(base), " ".join(base), *map(" ".join, near)]
    out += [" ".join(words(30) + passage + words(25)) for _ in range(6)] + [" ".join(words(200)) for _ in range(10)]
    out += [" ".join(words(9000) + passage)] + ["x" * 30000, "word " * 300]
    return out
