import math

from lattiq.operators import graph as g
from lattiq.operators import quality as q
from lattiq.sources.kg_view import adjacency


def und(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "u long, v long").distinct()


def test_pair_scores(spark):
    graph = und(spark, [(1, 3), (2, 3), (1, 4), (2, 4), (4, 5)])
    pairs = spark.createDataFrame([(1, 2), (1, 99)], "u long, v long")
    s = {(r.u, r.v): r for r in g.pair_scores(pairs, adjacency(graph), g.degrees(graph)).collect()}
    assert (s[1, 2].cn, s[1, 2].jaccard) == (2, 1.0)
    assert math.isclose(s[1, 2].aa, 1 / math.log(2) + 1 / math.log(3))
    assert (s[1, 99].cn, s[1, 99].jaccard, s[1, 99].aa) == (0, 0.0, 0.0)


def test_loop_counts_two_in_degree(spark, rows):
    assert rows(g.degrees(und(spark, [(1, 1), (1, 2)]))) == [(1, 3), (2, 1)]


def test_components(spark, rows):
    assert rows(g.components(und(spark, [(1, 2), (2, 3), (4, 5), (6, 6)]))) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    chain = und(spark, [(i, i + 1) for i in range(40)])
    assert {r.component for r in g.components(chain).collect()} == {0}


def test_clustering(spark):
    c = g.clustering(und(spark, [(1, 2), (2, 3), (1, 3), (3, 4)])).first()
    assert (c.n_nodes, c.n_links) == (4, 4) and math.isclose(c.clustering, (1 + 1 + 1 / 3 + 0) / 4)


def test_hops_and_paths(spark, rows):
    adj = adjacency(und(spark, [(1, 2), (2, 3), (3, 4), (1, 3)]))
    pairs = spark.createDataFrame([(1, 4), (1, 1), (1, 9), (1, 3)], "u long, v long")
    assert rows(g.hop_distances(pairs, adj)) == [(1, 1, 0), (1, 3, 1), (1, 4, 2), (1, 9, None)]
    p = {(r.u, r.v): (r.p1, r.p2, r.p3) for r in g.path_counts(pairs, adj).collect()}
    assert p[1, 4] == (0, 1, 1) and p[1, 3] == (1, 1, 0)
    two = {(r.u, r.v): r.reached for r in g.within_two(pairs, adj).collect()}
    assert two == {(1, 4): True, (1, 1): True, (1, 9): False, (1, 3): True}


def test_modularity_of_two_cliques(spark):
    graph = und(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)])
    labels = spark.createDataFrame([(i, 0 if i < 4 else 1) for i in range(1, 7)], "idx long, community long")
    assert math.isclose(g.modularity(graph, labels).first().modularity, 2 * (3 / 7 - 0.25), abs_tol=1e-6)


def test_dropout_is_exact(spark):
    graph = und(spark, [(i, i + 1) for i in range(30)])
    from pyspark.sql import functions as F

    kept = g.kept_after_dropout(graph, spark.createDataFrame([(0.3, 0), (1.0, 0), (0.0, 0)], "rate double, trial int"), F.lit(7))
    assert {r.rate: r["count"] for r in kept.groupBy("rate").count().collect()} == {0.3: 21, 0.0: 30}


def test_ancestors_end_on_cycles(spark, rows):
    p = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long")
    assert len(rows(g.ancestors(p))) == 9


def test_coverage(spark, rows):
    s = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string")
    assert rows(q.coverage(s("bcde"), s("abc"), ["k"])) == [(4, 3, 2, 50.0)]
    assert rows(q.coverage(s(""), s("abc"), ["k"])) == [(0, 3, 0, None)]


def test_conformance_and_conflicts(spark, rows):
    e = spark.createDataFrame([("r", 1, "a", 2, "b"), ("r", 1, "a", 3, "b"), ("r", 1, "x", 4, "b"), ("s", 1, "a", 2, "q")], "rel string, x_index long, x_type string, y_index long, y_type string")
    allowed = spark.createDataFrame([("r", "a", "b")], "rel string, x_type string, y_type string")
    assert rows(q.conformance(e, allowed)) == [("r", 3, 2, 66.667, 66.667), ("s", 1, 1, 100.0, 0.0)]
    c = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("b", 2, 1)], "rel string, x_index long, y_index long")
    assert rows(q.conflict_rates(q.conflicts(c, [("a", "b")]))) == [("a/b", 1, 2, 50.0)]
