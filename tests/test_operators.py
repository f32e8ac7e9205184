from pyspark.sql import functions as F

from quillon.operators import cluster, graph, intervals, phylo, scoring, setops, windows
from quillon.plans import config, jobs


def test_strong_components(spark):
    edges = {1: [2], 2: [3], 3: [1], 4: [2, 3, 5], 5: [4, 6], 6: [3, 7], 7: [6], 8: [5, 7, 8]}
    got = {}
    for r in graph.strong_components(graph.edges_of(spark, edges)).collect():
        got.setdefault(r["component"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [4, 5], [6, 7], [8]]


def test_prufer_round_trip():
    code = [4, 4, 3, 1, 3]
    assert graph.prufer_code(graph.prufer_tree(code)) == code


def test_kmeans_keeps_its_clusters(spark):
    points = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([2, 3, 5, 6, 10, 11, 100, 101, 102])], "id long, v array<double>")
    rows, centers = cluster.kmeans(points, [[2.0], [3.0], [100.0]])
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["cluster"], []).append(r["v"][0])
    assert sorted(map(sorted, groups.values())) == [[2.0, 3.0, 5.0, 6.0], [10.0, 11.0], [100.0, 101.0, 102.0]]
    assert len(cluster.kmeans_plus(points, 3, seed=2)[1]) == 3


def test_set_operations(spark):
    a = spark.createDataFrame([("x", 1, 5, "1"), ("x", 1, 5, "1"), ("y", 3, 9, "1")], "name string, start long, end long, strand string")
    b = spark.createDataFrame([("x", 3, 6, "1"), ("z", 3, 9, "1")], a.schema)
    assert setops.set_operation("union", a, b).count() == 4 and setops.set_operation("difference", a, a, b).count() == 0
    assert [r["name"] for r in setops.set_operation("intersect", a, b, full=False).collect()] == ["x"]
    assert [r["name"] for r in setops.set_operation("intersect", a, b, mode="fuzzy", delta=5).collect()] == ["x"]
    assert {r["name"] for r in setops.set_operation("union", a, b, mode="fuzzy", delta=5).collect()} == {"x", "y", "z"}
    genomes = spark.createDataFrame([("x", "ACGUACGU")], "name string, seq string")
    assert setops.set_operation("intersect", a, a, mode="seqs", genomes=genomes).first()["seq"] == "ACGUA"


def test_nested_sets(spark):
    nodes = spark.createDataFrame([(1, 1, 10), (2, 2, 5), (3, 3, 4), (4, 6, 9), (5, 7, 8)], "node long, left_value long, right_value long")
    assert {(r["node"], r["parent"]) for r in intervals.nested_parents(nodes).collect()} == {(2, 1), (3, 2), (4, 1), (5, 4)}
    got = intervals.descendants(nodes, nodes.filter("node in (1, 4)").select("node"), width=2)
    assert {(r["root"], r["node"]) for r in got.collect()} == {(1, k) for k in (1, 2, 3, 4, 5)} | {(4, 4), (4, 5)}


def test_greedy_dedupe(spark):
    rows = spark.createDataFrame([("a", 1, 10, 0), ("a", 3, 12, 1), ("a", 40, 50, 2), ("b", 1, 10, 3)], "name string, start long, end long, k int")
    assert sorted(r["k"] for r in windows.greedy_dedupe(rows, ["name"], 5, ["start", "k"]).collect()) == [0, 2, 3]


def test_scores(spark):
    row = spark.range(1).select(scoring.true_positive_rate(F.lit(0), F.lit(0)).alias("a"), scoring.false_positive_rate(F.lit(0), F.lit(0)).alias("b"), scoring.matthews(F.lit(5), F.lit(5), F.lit(0), F.lit(0)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (1.0, 0.0, 1.0)
    assert len(scoring.score_cuts()) == 25


def test_shuffles_keep_dinucleotides(spark):
    s = "ACGUUACGGACUUAGGCA"
    rows = phylo.shuffles(spark.createDataFrame([(1, s)], "k int, q string"), "q", 5, 1).collect()
    pairs = lambda x: sorted(x[i : i + 2] for i in range(len(x) - 1))
    assert rows and all(pairs(r["shuffled"]) == pairs(s) for r in rows)


def test_monte_carlo_rate(spark):
    r = phylo.monte_carlo_hits(spark, 20, 20_000, "AC", 3, 2).first()
    assert abs(r["frequency"] - 1 / 16) < 0.003 and r["total"] == 20 * 19_999


def test_task_graph():
    assert jobs.task_order({"c": ["b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    try:
        jobs.task_order({"a": ["b"], "b": ["a"]})
        raise AssertionError
    except jobs.CircularDependency:
        pass
    registry = jobs.Jobs()
    j = registry.add("me", {"x": (lambda: 2, []), "y": (lambda x: x + 3, ["x"])})
    registry.start(j)
    assert registry.result(j, "y") == 5 and registry.check(j) == "done" and registry.delete_done("me") == 1


def test_config():
    text = "StoDB: refseq\nOut-Dir: /tmp/x\nCluster: k 3-5, index s-dbw\nGen-CSVs: spread 50, aggregate\nCM-Search: eval 10.0\n  a/*.cm\n"
    c = config.parse_config(text)
    assert c.settings == {"stodb": "refseq", "out-dir": "/tmp/x"} and c.options["cluster"] == {"k": [3, 4, 5], "index": "s-dbw"}
    assert c.options["cm-search"] == {"eval": 10.0} and c.files == {"cm-search": ["a/*.cm"]}


def test_streaming_counts(spark, tmp_path):
    from quillon.streaming.counts import ngram_counts

    spark.createDataFrame([("abab",), ("ba",)], "t string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t string").parquet(f"{tmp_path}/in")
    q = ngram_counts(stream, "t", 2).writeStream.outputMode("complete").format("memory").queryName("grams").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r["item"]: r["n"] for r in spark.table("grams").collect()} == {"ab": 2, "ba": 2}
