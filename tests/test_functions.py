import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays, coords, mathfn, sequences, similarity, vectors
from quillon.operators import counting, info, windows


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_bigrams_golden(spark):
    df = spark.createDataFrame([("acagtcaacctggagcctggt",)], "t string")
    got = {r["item"]: r["n"] for r in counting.ngram_frequencies(df, "t", 2).collect()}
    assert got == {"aa": 1, "ac": 2, "ag": 2, "ca": 2, "cc": 2, "ct": 2, "ga": 1, "gc": 1, "gg": 2, "gt": 2, "tc": 1, "tg": 2}


def test_symmetric_combinations_golden(spark):
    from itertools import combinations

    s = "GGCGGAAGACCGCCUCGA"
    df = spark.createDataFrame([(1, s, "")], "k int, q string, lang string")
    expected, ordered = {}, {}
    for a, b in combinations(s, 2):
        expected["".join(sorted(a + b))] = expected.get("".join(sorted(a + b)), 0) + 1
        ordered[a + b] = ordered.get(a + b, 0) + 1
    assert {r["item"]: r["n"] for r in counting.combination_frequencies(df, "q", "k", ["lang"]).collect()} == expected
    assert {r["item"]: r["n"] for r in counting.combination_frequencies(df, "q", "k", ["lang"], symmetric=False).collect()} == ordered


def test_entropy_goldens(spark):
    rows = spark.createDataFrame([(c,) for c in "AAAUUUGGGGCCCUUUAAA"], "c string")
    assert info.shannon_entropy(rows, "c").first()["entropy"] == pytest.approx(1.9440097497163569, abs=1e-12)
    copies = spark.createDataFrame([(c, c, c, c) for c in "AAAUUUGGGGCCCUUUAAA"], "a string, b string, c string, d string")
    assert info.total_correlation(copies, ["a", "b"]).first()[0] == pytest.approx(1.9440097497163569, abs=1e-12)
    assert info.total_correlation(copies, ["a", "b", "c", "d"]).first()[0] == pytest.approx(5.832029249149071, abs=1e-12)


def test_information_invariants(spark):
    import random

    draw = random.Random(4)
    rows = spark.createDataFrame([(draw.choice("ab"), draw.choice("xyz"), draw.choice("pq")) for _ in range(300)], "x string, y string, z string")
    assert info.mutual_information(rows, "x", "y").first()["mutual_information"] >= 0
    assert info.conditional_mutual_information(rows, "x", "y", "z").first()[0] >= 0
    dist = counting.with_probabilities(rows.groupBy("z", F.col("y").alias("item")).agg(F.count("*").alias("n")), ["z"])
    assert all(0 <= r["divergence"] <= 1 for r in info.jensen_shannon_pairs(dist, "z").collect())


def test_edit_distances(spark):
    pairs = [("foo", "foobar", 3), ("kitten", "sitting", 3), ("Saturday", "Sunday", 3), ("abcde", "bcdea", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    assert all(r["x"] == r["d"] for r in df.select(similarity.levenshtein("a", "b").alias("x"), "d").collect())
    arrays_ = spark.createDataFrame([([1, 2, 3, 4], [1, 1, 3])], "a array<int>, b array<int>")
    assert windows.edit_distances(arrays_, "a", "b").first()["distance"] == 2


def test_sequences(spark):
    assert one(spark, sequences.reverse_complement(F.lit("AAGGAAUUCC"))) == "GGAAUUCCUU"
    assert one(spark, sequences.reverse_complement(F.lit("AAGGTTn-"))) == "AACCTT"
    assert len(sequences.codon_map()) == 64 and sequences.codon_map()["AUG"] == "M" and sequences.codon_map()["UAG"] == "PY"
    assert one(spark, sequences.amino_acids(F.lit("AUGGCCUAA"))) == "MA" and one(spark, sequences.amino_acids(F.lit("AUGG"))) is None
    assert one(spark, sequences.chunks(F.lit("abcdefg"), 3)) == ["abc", "def", "g"] and one(spark, sequences.chunks(F.lit("abcd"), 3, pad="xx")) == ["abc", "dxx"]


def test_math(spark):
    got = [(r["p"], r["n"]) for r in one(spark, mathfn.prime_factors(F.lit(510)))]
    assert got == [(2, 1), (3, 1), (5, 1), (17, 1)]
    assert [(r["p"], r["n"]) for r in one(spark, mathfn.prime_factors(F.lit(72)))] == [(2, 3), (3, 2)]
    assert int(one(spark, mathfn.choose(F.lit(40), F.lit(20)))) == math.comb(40, 20)
    assert one(spark, mathfn.poisson_cdf(F.lit(0), F.lit(5), 8.0)) == pytest.approx(0.0996, abs=5e-5)
    assert one(spark, vectors.cross_sum(F.array(*map(F.lit, [1, 2, 3])), F.array(*map(F.lit, [1, 2, 3])))) == 36.0


def test_arrays(spark):
    a = F.array(*map(F.lit, [1, 2, 2, 3]))
    assert one(spark, arrays.take_until(a, lambda x: x == 3)) == [1, 2, 2] and one(spark, arrays.drop_until(a, lambda x: x == 2)) == [2, 2, 3]
    assert one(spark, arrays.take_until_nochange(a)) == [1, 2] and one(spark, arrays.positions(a, F.lit(2))) == [1, 2]
    assert one(spark, arrays.combinations(F.array(*map(F.lit, "abc")), 2)) == [["a", "b"], ["a", "c"], ["b", "c"]]
    assert sorted(map(tuple, one(spark, arrays.subsets(F.array(*map(F.lit, "ab")))))) == [(), ("a",), ("a", "b"), ("b",)]
    assert one(spark, arrays.transpose(F.array(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "de"))))) == [["a", "d"], ["b", "e"]]


def test_entries(spark):
    p = one(spark, coords.entry_parts(F.lit("NC_1/200-100")))
    assert (p["name"], p["start"], p["end"], p["strand"]) == ("NC_1", 100, 200, "-1")
    assert one(spark, coords.entry_parts(F.lit("NC_1")))["end"] == coords.OPEN_END
    assert one(spark, coords.entry_parts(F.lit("NC_1/5-9/1"), 10, 2))["start"] == 1
    assert one(spark, coords.next_sto_name(F.lit("a-3.sto"))) == "a-4.sto"
