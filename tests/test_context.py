from quillon.operators import context
from quillon.sources import hits


def test_rankings_and_aggregation(spark):
    rows = spark.createDataFrame([(1, 0.1, 5.0), (2, 0.2, 1.0), (3, 0.9, 2.0)], "k long, re double, ev double")
    assert context.compare_rankings(rows, "k", "re", "ev", 2).first().asDict() == {"both": 1, "score_only": 1, "evalue_only": 1}
    good, bad = context.aggregate(rows.select("k"), rows.filter("k = 1"), rows.filter("k < 3"))
    assert sorted(r["k"] for r in good.collect()) == [1, 2] and [r["k"] for r in bad.collect()] == [3]


def test_sizes(spark):
    notes = spark.createDataFrame([("f", "GF", "CTXSZ", "640"), ("f", "GC", "RF", "x")], "file string, tag string, key string, value string")
    assert context.saved_sizes(notes).first()["size"] == 640
    h = spark.createDataFrame([("g", 10, 100)], "name string, start long, end long")
    f = spark.createDataFrame([("g", 150, 331), ("g", 5, 40)], h.schema)
    assert [r["size"] for r in context.annotation_size(h, f).collect()] == [300]


def test_sequence_matches(spark):
    aln = spark.createDataFrame([("g/3-6/1", "GG-CC"), ("g/1-2/1", "UU"), ("g/9-12/1", "AAUU")], "name string, seq string")
    genomes = spark.createDataFrame([("g", "TTGGCCAAGG")], "name string, seq string")
    got = {r["name"]: (r["start"], r["end"], r["strand"], r["status"]) for r in hits.corrected_coordinates(aln, genomes).collect()}
    assert got == {"g/3-6/1": (3, 6, "1", "same"), "g/1-2/1": (1, 2, "1", "same"), "g/9-12/1": (None, None, None, "missing")}
    other = spark.createDataFrame([("NC_1/3-6/1", "GGCC"), ("NC_2/3-6/1", "GGCC")], aln.schema)
    assert hits.renamed(aln, other, 4).filter("new_name is not null").count() == 1
