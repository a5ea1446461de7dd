"""Graph queries over the links of all relations, beside brute force."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import graph as g
from lattiq.plans import graph_queries
from lattiq.sources.kg_view import edges, undirected

SF = "/root/testdata/sf0.001"


def brute(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_components_of_all_relations(spark, rows):
    expected = brute(rows(undirected(edges(spark, SF))))
    assert dict(rows(graph_queries.graph_components(spark, SF))) == expected
    nodes = {r.idx for r in spark.read.parquet(f"{SF}/nodes_df.parquet").filter("kg = 'alder' AND idx IS NOT NULL").select("idx").collect()}
    sizes, isolated = Counter(expected.values()), len(nodes - set(expected))
    assert rows(graph_queries.connectivity(spark, SF)) == [(len(nodes | set(expected)), len(sizes) + isolated, max(sizes.values()), isolated)]


def test_connectivity_of_a_small_graph(spark, rows):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 6)], "idx long")
    und = spark.createDataFrame([(1, 2), (2, 3), (4, 4)], "u long, v long")
    assert rows(g.connectivity(nodes, und)) == [(6, 4, 3, 2)]
    assert rows(g.connectivity(nodes.limit(0), und.limit(0))) == [(0, 0, 0, 0)]


def test_proximity_beside_brute_force(spark, rows):
    """A path 0 - 1 - .. - 9 with leaves 100 + i, and a link apart: distances beyond two hops count in full."""
    links = [(i, i + 1) for i in range(9)] + [(i, 100 + i) for i in range(10)] + [(200, 201)]
    diseases, pairs = [*range(100, 110), 201], [(0, 104), (0, 100), (3, 109), (0, 201), (200, 201)]
    far = lambda u, d: abs(u - d + 100) + 1
    adj = spark.createDataFrame(links + [(b, a) for a, b in links], "a long, b long")
    df = g.proximity(spark.createDataFrame(pairs, "u long, v long"), spark.createDataFrame([(d,) for d in diseases], "d long"), adj, F.col("d"), most=6, least=2)
    expected = []
    for u, v in pairs[:3]:  # the others are not connected, or reach no other disease
        drawn = [far(u, d) for d in range(100, 110) if d != v][:6]
        p = np.mean([x <= far(u, v) for x in drawn])
        expected.append((u, v, far(u, v), 6, np.mean(drawn), *np.percentile(drawn, [2.5, 97.5]), p, min(3 * p, 1)))
    got = rows(df)
    assert len(got) == 3 and np.allclose(got, sorted(expected, key=lambda r: repr(tuple(int(x) for x in r[:2]))))
