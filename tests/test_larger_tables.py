"""Results that only larger tables or repeated rows show."""

import itertools
import random

import duckdb

from quillon.operators import cluster, graph
from quillon.plans import queries_models as models
from quillon.plans import queries_scalars as scalars


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def by_sql(sql, path, *names):
    with duckdb.connect() as c:
        for name in names:
            c.sql(f"create view {name} as select * from '{path}/{name}.parquet/*.parquet'")
        return c.sql(sql).fetchall()


def test_empirical_cdf_halfway_bins(spark, tmp_path):
    values = [k / 10 for k in range(1, 3000)] + [None]  # value / 1000 + 0.0001 often lies halfway between two bins
    spark.createDataFrame([(k, v) for k, v in enumerate(values)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("empirical_cdf", "cdf_cutpoint"):
        assert rows_of(scalars.QUERIES[name](spark, str(tmp_path))) == sorted(by_sql(scalars.ORACLE_SQL[name], tmp_path, "events"))


#: The pairs of parts one by one, as the classes stand for them.
_PAIRS = "with p as (select a.p_partkey as i, b.p_partkey as j, a.p_name as a, b.p_name as b from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_partkey < b.p_partkey) "


def write_parts(spark, path, copies):
    draw = random.Random(3)
    names = ["hot bolt", "cold plate", "cold plate old", "x", "hot  bolt", None]
    rows = [(k, draw.choice(names), draw.choice(["A", "B", None]), draw.choice(["S", "T"])) for k in range(24 * copies)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{path}/part.parquet")


def expanded(rows, ordered):
    """Every pair i < j of a block, with its values: what the classes say."""
    of = {r["i"]: r["j"] for r in rows if r["kind"] == "member"}
    copies = {r["j"]: tuple(r)[3:] for r in rows if r["kind"] == "member"}
    apart = {(r["i"], r["j"]): tuple(r)[3:] for r in rows if r["kind"] == "pair"}
    assert len(of) + len(apart) == len(rows)
    out = []
    for x, y in itertools.combinations(sorted(of), 2):
        a, b = of[x], of[y]
        values = copies[a] if a == b else apart.get((a, b) if ordered else (min(a, b), max(a, b)))
        if values is not None:
            out.append((x, y, *values))
    return out


def pairs_hold(spark, tmp_path, name, measures, ordered=False):
    write_parts(spark, tmp_path, 4)
    rows = scalars.QUERIES[name](spark, str(tmp_path)).collect()
    order = lambda found: sorted(str(tuple(r)) for r in found)
    assert order(expanded(rows, ordered)) == order(by_sql(_PAIRS + measures, tmp_path, "part"))
    assert order(rows) == order(by_sql(scalars.ORACLE_SQL[name], tmp_path, "part"))
    assert len(rows) < 24 * 4 + 4 * 6 * 6  # parts and pairs of names, not pairs of parts


def test_ngram_compare_pairs_by_class(spark, tmp_path):
    measures = f", g as (select i, j, {scalars._G.format('a')} as x, {scalars._G.format('b')} as y from p) select i, j, round(2 * len(list_intersect(x, y)) / (len(x) + len(y))::double, 6) from g"
    pairs_hold(spark, tmp_path, "ngram_compare_pairs", measures)


def test_edist_toss_keep_by_class(spark, tmp_path):
    measures = "select i, j, length(b) > 0.7 * length(a) and abs(levenshtein(a, b) - length(a)) / length(a)::double >= 0.5 from p"
    pairs_hold(spark, tmp_path, "edist_toss_keep", measures, ordered=True)


def test_set_similarities_by_class(spark, tmp_path):
    measures = """, g as (select i, j, list_distinct(string_split(a, ' ')) as x, list_distinct(string_split(b, ' ')) as y from p), m as (select i, j, len(x) as x, len(y) as y, len(list_intersect(x, y)) as m from g)
    select i, j, round(m / (x + y - m)::double, 6), round(1 - m / (x + y - m)::double, 6), round(2 * m / (x + y)::double, 6), round(m / (m + 0.3 * (x - m) + 0.7 * (y - m))::double, 6) from m"""
    pairs_hold(spark, tmp_path, "set_similarities", measures, ordered=True)


def test_levenshtein_pairs_by_class(spark, tmp_path):
    pairs_hold(spark, tmp_path, "levenshtein_pairs", "select i, j, levenshtein(a, b)::int from p")


def write_vectors(spark, path):
    draw = random.Random(5)
    vectors = [[draw.gauss(0, 1) for _ in range(3)] for _ in range(40)] + [[1.0, 2.0, 3.0]] * 12 + [[float(k % 3), float(k % 2), 0.0] for k in range(24)]  # copies and equal distances
    vectors += [None, None, [], [1.0], [1.0, None, 2.0], [-0.0, 0.0, 0.0]]
    draw.shuffle(vectors)
    rows = [(7 * k % 97, v, draw.choice([1, 1, 2, 3, None])) for k, v in enumerate(vectors)] + [(200, [0.5] * 3, 9), (201, [0.5] * 3, 9)]  # a small block
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


def neighbours_hold(spark, path, name, monkeypatch):
    write_vectors(spark, path)
    expected = sorted(by_sql(models.ORACLE_SQL[name], path, "embeddings"))
    assert rows_of(models.QUERIES[name](spark, str(path))) == expected
    monkeypatch.setattr(cluster, "QUERIES", 5)  # many tiles
    monkeypatch.setattr(cluster, "CANDIDATES", 8)
    assert rows_of(models.QUERIES[name](spark, str(path))) == expected


def test_knn_graph_by_tiles(spark, tmp_path, monkeypatch):
    neighbours_hold(spark, tmp_path, "knn_graph", monkeypatch)


def test_krnn_graph_by_tiles(spark, tmp_path, monkeypatch):
    neighbours_hold(spark, tmp_path, "krnn_graph", monkeypatch)


def test_components_by_block_need_no_rounds(spark, tmp_path, monkeypatch):
    draw = random.Random(6)
    edges = [(b, 100 * b + draw.randrange(25), 100 * b + draw.randrange(25)) for b in range(4) for _ in range(30)]
    df = spark.createDataFrame(edges, "b int, src long, dst long")
    expected = rows_of(graph.strong_components(df))
    assert rows_of(graph.strong_components_by_block(df, "b")) == expected and len({c for _, c in expected}) < len(expected)
    spark.createDataFrame([(i, [draw.gauss(3.0 * (i % 5), 1.0) for _ in range(3)], i % 2) for i in range(80)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    points, steps, settled = models._all_points(spark, str(tmp_path)), [], graph.settled
    knn = cluster.knn_graph(cluster.pair_distances(points, block="label"), 4)
    by_rounds = cluster.fold_outliers(knn, graph.strong_components(cluster.split_by_degree(knn, 4)[0]).withColumnRenamed("component", "cluster"))
    expected = rows_of(by_rounds)
    monkeypatch.setattr(graph, "settled", lambda df: steps.append(df) or settled(df))
    assert rows_of(models.krnn_clusters(spark, str(tmp_path))) == expected and len(steps) == 1
