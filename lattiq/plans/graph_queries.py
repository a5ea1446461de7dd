"""Graph, link-prediction and statistics queries over the graph view, each beside its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.functions import scores as sc
from lattiq.functions.ids import relation_key
from lattiq.operators import graph as g
from lattiq.operators import linkpred as lp
from lattiq.operators import ranking as rk
from lattiq.operators import resample as rs
from lattiq.operators.retrieval import capped_per_group
from lattiq.plans.lineage import written
from lattiq.sources.kg_view import SQL_ADJ, SQL_E, SQL_GOLD, SQL_HASH, SQL_NT, SQL_UND, SQL_WIDE, adjacency, edges, gold_pairs, node_types, undirected, with_
from lattiq.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_DEG = "deg AS (SELECT idx, count(*)::BIGINT AS deg FROM (SELECT u AS idx FROM und UNION ALL SELECT v FROM und) GROUP BY idx)"
_PAIRS = "prs AS (SELECT DISTINCT u, v FROM gold)"
_BASE = with_(SQL_E, SQL_UND, SQL_ADJ, SQL_GOLD, _DEG, _PAIRS)
_SCORED = """, met AS (SELECT p.u, p.v, count(CASE WHEN a.b NOT IN (p.u, p.v) THEN 1 END) AS cn, count(*) AS both_, sum(CASE WHEN a.b NOT IN (p.u, p.v) AND d.deg > 1 THEN 1.0::DOUBLE / ln(d.deg) ELSE 0.0::DOUBLE END) AS aa
      FROM prs p JOIN adj a ON a.a = p.u JOIN adj b ON b.a = p.v AND b.b = a.b JOIN deg d ON d.idx = a.b GROUP BY p.u, p.v),
    sz AS (SELECT a, count(*) AS n FROM adj GROUP BY a),
    scored AS (SELECT p.u, p.v, coalesce(cn, 0)::BIGINT AS cn, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(both_, 0) > 0 THEN coalesce(both_, 0) * 1.0::DOUBLE / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(both_, 0)) ELSE 0.0::DOUBLE END AS jaccard, coalesce(aa, 0.0::DOUBLE) AS aa
      FROM prs p LEFT JOIN met USING (u, v) LEFT JOIN sz x ON x.a = p.u LEFT JOIN sz y ON y.a = p.v)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    und = undirected(edges(spark, sf_dir))
    return und, adjacency(und), gold_pairs(spark, sf_dir)


@query(with_(SQL_E, SQL_UND, _DEG, SQL_NT) + "SELECT nt.idx, nt.type, coalesce(deg, 0)::BIGINT AS deg FROM nt LEFT JOIN deg USING (idx)")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return node_types(e).join(g.degrees(undirected(e)), "idx", "left").select("idx", "type", F.coalesce("deg", F.lit(0)).alias("deg"))


@query(_BASE + _SCORED + "SELECT u, v, cn, round(jaccard, 6) AS jaccard, round(aa, 6) AS aa FROM scored")
def neighbour_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    und, adj, gold = _graph(spark, sf_dir)
    s = g.pair_scores(gold, adj, g.degrees(und))
    return s.select("u", "v", "cn", F.round("jaccard", 6).alias("jaccard"), F.round("aa", 6).alias("aa"))


@query(with_(SQL_E, SQL_UND, _DEG, "s AS (SELECT * FROM und WHERE u <> v)", "n AS (SELECT u AS a, v AS b FROM s UNION ALL SELECT v, u FROM s)",
             "tri AS (SELECT x.a AS idx, count(*) / 2 AS t FROM n x JOIN n y ON x.b = y.a JOIN n z ON y.b = z.a AND z.b = x.a GROUP BY x.a)",
             "d AS (SELECT a AS idx, count(*) AS deg FROM n GROUP BY a)") + """
    SELECT count(*)::BIGINT AS n_nodes, (sum(deg) / 2)::BIGINT AS n_links, round(avg(CASE WHEN deg > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (deg * (deg - 1)) ELSE 0.0::DOUBLE END), 6) AS clustering FROM d LEFT JOIN tri USING (idx)""")
def mean_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = g.clustering(undirected(edges(spark, sf_dir)))
    return c.select("n_nodes", "n_links", F.round("clustering", 6).alias("clustering"))


@query(with_(SQL_E, SQL_UND, "s AS (SELECT * FROM und WHERE u <> v)", "n AS (SELECT u AS a, v AS b FROM s UNION ALL SELECT v, u FROM s)",
             "tri AS (SELECT x.a AS idx, count(*) / 2 AS t FROM n x JOIN n y ON x.b = y.a JOIN n z ON y.b = z.a AND z.b = x.a GROUP BY x.a)",
             "d AS (SELECT a AS idx, count(*) AS deg FROM n GROUP BY a)", "c AS (SELECT count(*) AS nn, sum(deg) / 2 AS m, avg(CASE WHEN deg > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (deg * (deg - 1)) ELSE 0.0::DOUBLE END) AS c FROM d LEFT JOIN tri USING (idx))",
             "r AS (SELECT round(c / (2.0::DOUBLE * m / nn / (nn - 1)), 1) AS ratio FROM c)") + "SELECT ratio, round(CASE WHEN ratio > 1 THEN least(1.0::DOUBLE, ln(ratio) / ln(1000.0::DOUBLE)) ELSE 0.0::DOUBLE END, 6) AS score FROM r")
def small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = g.clustering(undirected(edges(spark, sf_dir)))
    return c.select("ratio", F.round(sc.small_world(F.col("ratio")), 6).alias("score"))


_COMPONENTS = "WITH RECURSIVE " + ", ".join((SQL_E, SQL_UND, SQL_ADJ)) + """, ends AS (SELECT DISTINCT a AS idx FROM adj),
    cc(idx, component) USING KEY (idx) AS (SELECT idx, idx FROM ends UNION SELECT r.idx, min(c.component) FROM cc c JOIN adj ON adj.a = c.idx JOIN recurring.cc r ON r.idx = adj.b WHERE c.component < r.component GROUP BY r.idx)"""


@query(_COMPONENTS + " SELECT idx, component FROM cc")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over the links of all relations, named by their smallest node."""
    return g.components(undirected(edges(spark, sf_dir)))


_ALDER = "an AS (SELECT DISTINCT idx FROM nodes_df WHERE kg = 'alder' AND idx IS NOT NULL), sz AS (SELECT component, count(*) AS n FROM cc GROUP BY component), iso AS (SELECT count(*) AS k FROM an WHERE idx NOT IN (SELECT idx FROM cc))"


def _alder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes_df").filter("kg = 'alder' AND idx IS NOT NULL")


@query(_COMPONENTS + ", " + _ALDER + " SELECT (sum(n) + k)::BIGINT AS n_nodes, (count(*) + k)::BIGINT AS n_components, max(n)::BIGINT AS largest, k::BIGINT AS isolated FROM sz, iso GROUP BY k")
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, components (an isolated node is one), the largest of them and isolated nodes, over all relations and the node table."""
    return g.connectivity(_alder(spark, sf_dir).select("idx"), undirected(edges(spark, sf_dir)))


@query(_COMPONENTS + ", " + _ALDER + """, top AS (SELECT idx FROM cc WHERE component = (SELECT component FROM sz ORDER BY n DESC, component LIMIT 1)), ty AS (SELECT idx, min(type) AS type FROM nodes_df WHERE kg = 'alder' AND idx IS NOT NULL GROUP BY idx),
    c AS (SELECT coalesce(type, 'none') AS type, count(*) AS n FROM ty WHERE idx NOT IN (SELECT idx FROM top) GROUP BY 1) SELECT type, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, type)::INT AS rank FROM c ORDER BY n DESC, type LIMIT 3""")
def outside_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent types of nodes outside the largest component (a report)."""
    types = _alder(spark, sf_dir).groupBy("idx").agg(F.coalesce(F.min("type"), F.lit("none")).alias("type"))
    return g.outside_types(types, g.largest_component(undirected(edges(spark, sf_dir))))


@query(_COMPONENTS + """, sz AS (SELECT component, count(*) AS n FROM cc GROUP BY component), top AS (SELECT idx FROM cc WHERE component = (SELECT component FROM sz ORDER BY n DESC, component LIMIT 1)),
    """ + SQL_NT + ", " + SQL_GOLD + f""", hh AS (SELECT idx AS u, row_number() OVER (ORDER BY idx) - 1 AS no FROM nt WHERE type = 'drug' AND idx IN (SELECT idx FROM top)), vv AS (SELECT idx AS v, row_number() OVER (ORDER BY idx) - 1 AS no FROM nt WHERE type = 'disease' AND idx IN (SELECT idx FROM top)),
    dr AS (SELECT id, ({SQL_HASH("id")}) % (SELECT count(*) FROM hh) AS hn, ({SQL_HASH("id", seed=43)}) % (SELECT count(*) FROM vv) AS tn FROM range(25000) r(id)), f AS (SELECT hn, tn, min(id) AS id FROM dr GROUP BY hn, tn),
    pr AS (SELECT u, v, id FROM f JOIN hh ON hh.no = hn JOIN vv ON vv.no = tn WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE (g.u = hh.u AND g.v = vv.v)))
    SELECT u, v FROM (SELECT *, row_number() OVER (ORDER BY id) AS r FROM pr) WHERE r <= 500""")
def component_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 hashed drug - disease pairs of the largest component that are no gold pairs."""
    e = edges(spark, sf_dir)
    inside = node_types(e).join(g.largest_component(undirected(e)), "idx", "left_semi")
    of = lambda t, c: inside.filter(F.col("type") == t).select(F.col("idx").alias(c))
    return lp.random_negatives(gold_pairs(spark, sf_dir), of("drug", "u"), of("disease", "v"), 500, attempts=50)


_HOPS = _BASE + """, src AS (SELECT DISTINCT u FROM prs), b0 AS (SELECT u, u AS x FROM src), b1 AS (SELECT DISTINCT b0.u, a.b AS x FROM b0 JOIN adj a ON a.a = b0.x), b2 AS (SELECT DISTINCT b1.u, a.b AS x FROM b1 JOIN adj a ON a.a = b1.x), b3 AS (SELECT DISTINCT b2.u, a.b AS x FROM b2 JOIN adj a ON a.a = b2.x),
    b4 AS (SELECT DISTINCT b3.u, a.b AS x FROM b3 JOIN adj a ON a.a = b3.x), b5 AS (SELECT DISTINCT b4.u, a.b AS x FROM b4 JOIN adj a ON a.a = b4.x),
    al AS (SELECT u, x, min(h) AS h FROM (SELECT *, 0 AS h FROM b0 UNION ALL SELECT *, 1 FROM b1 UNION ALL SELECT *, 2 FROM b2 UNION ALL SELECT *, 3 FROM b3 UNION ALL SELECT *, 4 FROM b4 UNION ALL SELECT *, 5 FROM b5) GROUP BY u, x), hp AS (SELECT p.u, p.v, h::INT AS hops FROM prs p LEFT JOIN al ON al.u = p.u AND al.x = p.v)"""


@query(_HOPS + "SELECT u, v, hops FROM hp")
def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of each gold pair up to 5."""
    _, adj, gold = _graph(spark, sf_dir)
    return g.hop_distances(gold, adj)


@query(_HOPS + "SELECT k::INT AS k, round(avg((coalesce(hops, 99) <= k)::INT::DOUBLE), 6) AS recovered FROM hp, range(1, 6) r(k) GROUP BY k")
def hop_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of gold pairs within k hops, k from 1 to 5."""
    _, adj, gold = _graph(spark, sf_dir)
    h = g.hop_distances(gold, adj)
    return h.select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"), "hops").groupBy("k").agg(F.round(F.avg((F.coalesce("hops", F.lit(99)) <= F.col("k")).cast("double")), 6).alias("recovered"))


@query(_BASE + """, q AS (SELECT * FROM prs WHERE u % 3 < 3), n AS (SELECT * FROM adj WHERE a <> b)
    SELECT q.u, q.v, (SELECT count(*) FROM n WHERE n.a = q.u AND n.b = q.v)::BIGINT AS p1,
      (SELECT count(*) FROM n x JOIN n y ON y.a = x.b WHERE x.a = q.u AND y.b = q.v AND x.b <> q.v)::BIGINT AS p2,
      (SELECT count(*) FROM n x JOIN n y ON y.a = x.b JOIN n z ON z.a = y.b WHERE x.a = q.u AND z.b = q.v AND x.b <> q.v AND y.b <> q.u AND y.b <> q.v)::BIGINT AS p3 FROM q""")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, adj, gold = _graph(spark, sf_dir)
    return g.path_counts(gold, adj)


#: Six rates of dropout, three trials each.
_TRIALS = [(r / 10, t) for r in range(6) for t in range(3)]
_DROP = _BASE + ", tr AS (SELECT r::DOUBLE / 10 AS rate, t::INT AS trial FROM range(6) a(r), range(3) b(t)), dr AS (SELECT rate, trial, u, v, row_number() OVER (PARTITION BY rate, trial ORDER BY " + SQL_HASH("u", "v", "trial") + ", u, v) AS rn FROM und, tr), kept AS (SELECT rate, trial, u, v FROM dr WHERE rn > round(rate * (SELECT count(*) FROM und))), ka AS (SELECT rate, trial, u AS a, v AS b FROM kept UNION ALL SELECT rate, trial, v, u FROM kept WHERE u <> v)"


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    und = undirected(edges(spark, sf_dir))
    return g.kept_after_dropout(und, spark.createDataFrame(_TRIALS, "rate double, trial int"), sc.hashed(F.col("u"), F.col("v"), F.col("trial")))


@query(_DROP + "SELECT rate, trial, count(*)::BIGINT AS n, (sum(u) % 1000003)::BIGINT AS checksum FROM kept GROUP BY rate, trial")
def random_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).groupBy("rate", "trial").agg(F.count(F.lit(1)).alias("n"), (F.sum("u") % 1000003).alias("checksum"))


_RECOVERY = _DROP + """, x AS (SELECT rate, trial, p.u, p.v FROM prs p, tr), r1 AS (SELECT DISTINCT x.* FROM x JOIN ka USING (rate, trial) WHERE ka.a = x.u AND ka.b = x.v),
    r2 AS (SELECT DISTINCT x.rate, x.trial, x.u, x.v FROM x JOIN ka k ON k.rate = x.rate AND k.trial = x.trial AND k.a = x.u JOIN ka l ON l.rate = x.rate AND l.trial = x.trial AND l.a = k.b AND l.b = x.v),
    ok AS (SELECT rate, trial, (x.u = x.v OR r1.u IS NOT NULL OR r2.u IS NOT NULL)::INT::DOUBLE AS hit FROM x LEFT JOIN r1 USING (rate, trial, u, v) LEFT JOIN r2 USING (rate, trial, u, v)),
    cv AS (SELECT rate, avg(hit) AS recovery FROM ok GROUP BY rate)"""


def _recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    und = undirected(edges(spark, sf_dir))
    kept = written(g.dropout_marks(und, _TRIALS, lambda t: sc.hashed(F.col("u"), F.col("v"), F.lit(t))))
    adj = kept.select(F.col("u").alias("a"), F.col("v").alias("b"), "kept").unionByName(kept.filter("u <> v").select(F.col("v").alias("a"), F.col("u").alias("b"), "kept"))
    pairs = gold_pairs(spark, sf_dir).select("u", "v").distinct()
    trial = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("rate")) for i, (r, _) in enumerate(_TRIALS)])).alias("t")
    reached = (F.col("u") == F.col("v")) | (F.getbit("marks", F.col("t.i")) == 1)
    return g.within_two_marked(pairs, adj).select("u", "v", "marks", trial).groupBy(F.col("t.rate").alias("rate")).agg(F.avg(reached.cast("double")).alias("recovery"))


@query(_RECOVERY + "SELECT rate, round(recovery, 6) AS recovery FROM cv")
def dropout_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovery(spark, sf_dir).select("rate", F.round("recovery", 6).alias("recovery"))


@query(_RECOVERY + ", seg AS (SELECT rate, (rate - lag(rate) OVER (ORDER BY rate)) * (recovery + lag(recovery) OVER (ORDER BY rate)) / 2 AS a FROM cv) SELECT round(sum(a) / (max(rate) - min(rate)), 4) AS resilience FROM seg")
def resilience_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.resilience(_recovery(spark, sf_dir))


@query(with_(SQL_E, SQL_UND, _DEG) + """, o AS (SELECT u, v, row_number() OVER (ORDER BY least(x.deg, y.deg), u, v) AS rn FROM und JOIN deg x ON x.idx = u JOIN deg y ON y.idx = v),
    k AS (SELECT * FROM o WHERE rn > round(0.2::DOUBLE * (SELECT count(*) FROM und))) SELECT count(*)::BIGINT AS n, (sum(u) % 1000003)::BIGINT AS cu, (sum(v) % 1000003)::BIGINT AS cv FROM k""")
def periphery_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth of the links with the smallest end degree dropped."""
    und = undirected(edges(spark, sf_dir))
    deg = g.degrees(und)
    end = lambda c: deg.select(F.col("idx").alias(c), F.col("deg").alias(f"d_{c}"))
    ordered = und.join(end("u"), "u").join(end("v"), "v").select("u", "v", F.least("d_u", "d_v").alias("low"), F.lit(1).alias("one"))
    c = rk.cumulative(ordered, [], ["low", "u", "v"], ["one"])
    return c.filter(F.col("before_one") >= F.round(0.2 * F.lit(und.count()))).agg(F.count(F.lit(1)).alias("n"), (F.sum("u") % 1000003).alias("cu"), (F.sum("v") % 1000003).alias("cv"))


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.label_propagation(undirected(edges(spark, sf_dir)))


_BYTYPE = with_(SQL_E, SQL_UND, SQL_NT, "lab AS (SELECT idx, type AS community FROM nt)")


@query(_BYTYPE + """, s AS (SELECT * FROM und WHERE u <> v), ins AS (SELECT x.community, count(*) AS l FROM s JOIN lab x ON x.idx = u JOIN lab y ON y.idx = v WHERE x.community = y.community GROUP BY 1),
    vol AS (SELECT community, count(*) AS d FROM (SELECT u AS idx FROM s UNION ALL SELECT v FROM s) JOIN lab USING (idx) GROUP BY 1), m AS (SELECT count(*) AS m FROM s)
    SELECT count(*)::BIGINT AS n_communities, round(sum(coalesce(l, 0) * 1.0::DOUBLE / m - (d / (2.0::DOUBLE * m)) ** 2), 6) AS modularity FROM vol LEFT JOIN ins USING (community), m""")
def type_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return g.modularity(undirected(e), node_types(e).select("idx", F.col("type").alias("community")))


# the partition that SQL can state too: each node goes with its smallest neighbour
_NEAREST = with_(SQL_E, SQL_UND, SQL_NT) + ", lab AS (SELECT idx, min(o) AS community FROM (SELECT u AS idx, v AS o FROM und UNION ALL SELECT v, u FROM und) GROUP BY idx)"


def _nearest(und: DataFrame) -> DataFrame:
    return adjacency(und).groupBy(F.col("a").alias("idx")).agg(F.min("b").alias("community"))


@query(_NEAREST + """, c AS (SELECT community, type, count(*) AS n FROM lab JOIN nt USING (idx) GROUP BY ALL)
    SELECT community, sum(n)::BIGINT AS size, arg_max(type, (n, type)) AS dominant, round(max(n) * 1.0::DOUBLE / sum(n), 6) AS purity FROM c GROUP BY community""")
def neighbourhood_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent type of the nodes that share their smallest neighbour."""
    e = edges(spark, sf_dir)
    return g.purity(_nearest(undirected(e)), node_types(e))


@query(_NEAREST + """, p AS (SELECT type AS x, community AS y FROM lab JOIN nt USING (idx)), c AS (SELECT x, y, count(*)::DOUBLE AS n FROM p GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
    a AS (SELECT sum(n) AS n FROM c GROUP BY x), b AS (SELECT sum(n) AS n FROM c GROUP BY y),
    en AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM c, t) AS hxy, (SELECT -sum(n / t * ln(n / t)) FROM a, t) AS hx, (SELECT -sum(n / t * ln(n / t)) FROM b, t) AS hy, (SELECT sum(n * (n - 1) / 2) FROM c) AS sxy, (SELECT sum(n * (n - 1) / 2) FROM a) AS sx, (SELECT sum(n * (n - 1) / 2) FROM b) AS sy, (SELECT t * (t - 1) / 2 FROM t) AS st)
    SELECT round((hx + hy - hxy) / ((hx + hy) / 2), 6) AS nmi, round((sxy - sx * sy / st) / ((sx + sy) / 2 - sx * sy / st), 6) AS ari FROM en""")
def partition_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of types with the partition by smallest neighbour."""
    e = edges(spark, sf_dir)
    return g.agreement(_nearest(undirected(e)).join(node_types(e), "idx").select(F.col("type").alias("x"), F.col("community").alias("y")))


@query()
def community_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, most frequent type and its share of Louvain's communities of the whole graph."""
    e = edges(spark, sf_dir)
    return g.purity(g.louvain(undirected(e)), node_types(e))


@query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Louvain's communities of the whole graph."""
    return g.louvain(undirected(edges(spark, sf_dir)))


@query()
def label_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.label_propagation(undirected(edges(spark, sf_dir)))


@query()
def community_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    und = undirected(edges(spark, sf_dir))
    return g.modularity(und, g.label_propagation(und))


@query(with_(SQL_E, SQL_UND, SQL_ADJ, "c AS (SELECT DISTINCT drug_index AS centre FROM test_pos)") + """
    , n AS (SELECT * FROM adj WHERE a <> b), o AS (SELECT centre, b AS m FROM (SELECT centre, b, row_number() OVER (PARTITION BY centre ORDER BY b) AS r FROM c JOIN n ON n.a = c.centre) WHERE r <= 40),
    w AS (SELECT DISTINCT centre, b AS idx FROM (SELECT centre, m, b, row_number() OVER (PARTITION BY centre, m ORDER BY b) AS r FROM o JOIN n ON n.a = o.m WHERE b <> centre) WHERE r <= 30)
    SELECT centre, 1 AS hop, m AS idx FROM o UNION ALL SELECT centre, 2, idx FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.centre = w.centre AND o.m = w.idx)""")
def ego_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, adj, gold = _graph(spark, sf_dir)
    return g.ego_network(gold.select(F.col("u").alias("idx")).distinct(), adj)


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes_df").filter("kg = 'alder' AND idx > 0").select(F.col("idx").alias("child"), F.floor(F.col("idx") / 8).alias("parent")).distinct()


@query("""WITH RECURSIVE p AS (SELECT DISTINCT idx AS child, idx // 8 AS parent FROM nodes_df WHERE kg = 'alder' AND idx > 0),
    c AS (SELECT child, parent AS ancestor, 1 AS depth FROM p UNION ALL SELECT c.child, p.parent, c.depth + 1 FROM c JOIN p ON p.child = c.ancestor)
    SELECT child, ancestor, min(depth)::INT AS depth FROM c GROUP BY child, ancestor""")
def ontology_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.ancestors(_parents(spark, sf_dir))


_ROOTS, _TERMS = [(3, "metabolic"), (17, "immune"), (140, "rare")], [("leukemia", "cancer"), ("tumor", "cancer"), ("anemia", "blood"), ("neuropathy", "nerve")]


@query("""WITH RECURSIVE p AS (SELECT DISTINCT idx AS child, idx // 8 AS parent FROM nodes_df WHERE kg = 'alder' AND idx > 0),
    c AS (SELECT child, parent AS ancestor FROM p UNION SELECT c.child, p.parent FROM c JOIN p ON p.child = c.ancestor),
    r(priority, ancestor, d) AS (VALUES (0, 3, 'metabolic'), (1, 17, 'immune'), (2, 140, 'rare')), b AS (SELECT child AS idx, arg_min(d, priority) AS d FROM c JOIN r USING (ancestor) GROUP BY child),
    n AS (SELECT idx, min(name) AS name FROM nodes_df WHERE kg = 'alder' GROUP BY idx)
    SELECT idx, coalesce(d, t, 'unclassified') AS domain, CASE WHEN d IS NOT NULL THEN 'ontology' WHEN t IS NOT NULL THEN 'terms' ELSE 'unclassified' END AS method
    FROM (SELECT n.idx, b.d, CASE WHEN contains(lower(name), 'leukemia') THEN 'cancer' WHEN contains(lower(name), 'tumor') THEN 'cancer' WHEN contains(lower(name), 'anemia') THEN 'blood' WHEN contains(lower(name), 'neuropathy') THEN 'nerve' END AS t FROM n LEFT JOIN b USING (idx))""")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nodes_df").filter("kg = 'alder'").groupBy("idx").agg(F.min("name").alias("name"))
    return g.classify_domain(nodes, g.ancestors(_parents(spark, sf_dir)), _ROOTS, _TERMS)


# --- scores and ranking ------------------------------------------------------------------------------------------

# positives: gold pairs; negatives: the same drugs with the next disease index, where that is no gold pair
_LABELLED = ", neg AS (SELECT DISTINCT u, v + 1 AS v FROM gold EXCEPT SELECT u, v FROM gold), lab AS (SELECT u, v, 1 AS label FROM (SELECT DISTINCT u, v FROM gold) UNION ALL SELECT u, v, 0 FROM neg)"
_LABSCORE = with_(SQL_E, SQL_UND, SQL_ADJ, SQL_GOLD, _DEG) + _LABELLED + ", prs AS (SELECT u, v FROM lab)" + _SCORED + ", ls AS (SELECT u, v, label, round(aa, 9) AS score FROM lab JOIN scored USING (u, v))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = gold_pairs(spark, sf_dir).select("u", "v").distinct()
    neg = pos.select("u", (F.col("v") + 1).alias("v")).subtract(pos)
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    und, adj, _ = _graph(spark, sf_dir)
    lab = _labelled(spark, sf_dir)
    return lab.join(g.pair_scores(lab, adj, g.degrees(und)), ["u", "v"]).select("u", "v", "label", F.round("aa", 9).alias("score"))


_METRICS = """SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auroc, 4) AS auroc, round(ap, 4) AS ap, round(mrr, 4) AS mrr, round(h10, 4) AS hits10, round(h50, 4) AS hits50 FROM (
    SELECT sum(label) AS n_pos, sum(1 - label) AS n_neg, (sum(CASE WHEN label = 1 THEN mid END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label)) AS auroc,
      avg(CASE WHEN label = 1 THEN tp * 1.0::DOUBLE / rnk END) AS ap, avg(CASE WHEN label = 1 THEN 1.0::DOUBLE / rnk END) AS mrr, avg(CASE WHEN label = 1 THEN (rnk <= 10)::INT::DOUBLE END) AS h10, avg(CASE WHEN label = 1 THEN (rnk <= 50)::INT::DOUBLE END) AS h50
    FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mid, count(*) OVER w AS rnk, sum(label) OVER w AS tp FROM ls WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


@query(_LABSCORE + _METRICS)
def link_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rk.ranking_metrics(_scored(spark, sf_dir), [], (10, 50))
    return m.select("n_pos", "n_neg", *[F.round(c, 4).alias(c) for c in ("auroc", "ap", "mrr", "hits10", "hits50")])


@query(_LABSCORE + """SELECT DISTINCT score, count(*) OVER w AS n_above, sum(label) OVER w::BIGINT AS tp, round(sum(label) OVER w * 1.0::DOUBLE / count(*) OVER w, 6) AS precision, round(sum(label) OVER w * 1.0::DOUBLE / sum(label) OVER (), 6) AS recall
    FROM ls WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""".replace("sum(label) OVER w::BIGINT", "(sum(label) OVER w)::BIGINT"))
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rk.thresholds(_scored(spark, sf_dir), [])
    total = t.agg(F.sum("pos").alias("all_pos"))  # one row
    tp, n = F.col("before_pos") + F.col("pos"), F.col("before_pos") + F.col("pos") + F.col("before_neg") + F.col("neg")
    return t.join(F.broadcast(total)).select((F.lit(0.0) - F.col("s")).alias("score"), n.alias("n_above"), tp.alias("tp"), F.round(tp / n, 6).alias("precision"), F.round(tp / F.col("all_pos"), 6).alias("recall"))


@query(_LABSCORE + """, r AS (SELECT label, count(*) OVER (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rnk, count(*) OVER () AS n FROM ls), k(k) AS (VALUES (1), (5), (10), (20), (50), (100), (200), (500))
    SELECT k::INT AS k, round(avg((rnk <= k)::INT::DOUBLE), 6) AS recall, round(avg(100.0::DOUBLE * rnk / n), 4) AS mean_percentile FROM r, k WHERE label = 1 GROUP BY k""")
def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rk.thresholds(_scored(spark, sf_dir), [])
    total = t.agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))  # one row
    rank = F.col("before_pos") + F.col("pos") + F.col("before_neg") + F.col("neg")
    r = t.filter("pos > 0").join(F.broadcast(total)).select("pos", rank.alias("rank"), "n", F.explode(F.array(*[F.lit(k) for k in (1, 5, 10, 20, 50, 100, 200, 500)])).alias("k"))
    weigh = lambda c: F.sum(c * F.col("pos")) / F.sum("pos")
    return r.groupBy("k").agg(F.round(weigh((F.col("rank") <= F.col("k")).cast("double")), 6).alias("recall"), F.round(weigh(100.0 * F.col("rank") / F.col("n")), 4).alias("mean_percentile"))


@query(_BASE + _SCORED + """, x AS (SELECT rank() OVER (ORDER BY cn) + (count(*) OVER (PARTITION BY cn) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY round(aa, 9)) + (count(*) OVER (PARTITION BY round(aa, 9)) - 1) / 2.0::DOUBLE AS ry FROM scored)
    SELECT count(*)::BIGINT AS n, round(corr(rx, ry), 6) AS rho, round((corr(rx, ry) + 1) / 2, 6) AS effect FROM x""")
def scorer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of two scorers over the gold pairs."""
    und, adj, gold = _graph(spark, sf_dir)
    s = g.pair_scores(gold, adj, g.degrees(und)).select("cn", F.round("aa", 9).alias("aa"))
    return rk.spearman(s, "cn", "aa").select("n", "rho", F.round(sc.effect_size(F.col("rho")), 6).alias("effect"))


@query(_BASE + _SCORED + """, a AS (SELECT u, v FROM scored ORDER BY cn DESC, u, v LIMIT 50), b AS (SELECT u, v FROM scored ORDER BY round(aa, 9) DESC, u, v LIMIT 50)
    SELECT count(*)::BIGINT AS n_shared, round(count(*) / 50.0::DOUBLE, 6) AS overlap FROM a JOIN b USING (u, v)""")
def top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the top 50 of two rankings (a report)."""
    und, adj, gold = _graph(spark, sf_dir)
    s = g.pair_scores(gold, adj, g.degrees(und))
    top = lambda c: s.orderBy(F.desc(F.round(c, 9)), "u", "v").limit(50).select("u", "v")
    return top("cn").join(top("aa"), ["u", "v"]).agg(F.count(F.lit(1)).alias("n_shared"), F.round(F.count(F.lit(1)) / 50.0, 6).alias("overlap"))


@query(with_(SQL_E, SQL_UND, _DEG) + """, q AS (SELECT list_sort(list_distinct([quantile_cont(deg, 0), quantile_cont(deg, 0.25), quantile_cont(deg, 0.5), quantile_cont(deg, 0.75), quantile_cont(deg, 1)])) AS e FROM deg)
    SELECT CASE WHEN len(e) < 3 THEN 'Q1' WHEN deg <= e[2] THEN 'Q1' WHEN len(e) = 3 OR deg <= e[3] THEN 'Q2' WHEN len(e) = 4 OR deg <= e[4] THEN 'Q3' ELSE 'Q4' END AS tier, count(*)::BIGINT AS n, min(deg)::BIGINT AS least, max(deg)::BIGINT AS most FROM deg, q GROUP BY 1""")
def degree_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rk.quantile_tiers(g.degrees(undirected(edges(spark, sf_dir))), "deg")
    return t.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("deg").alias("least"), F.max("deg").alias("most"))


@query(with_(SQL_E, SQL_UND, _DEG, SQL_NT) + """, x AS (SELECT type, deg, rank() OVER (ORDER BY deg) + (count(*) OVER (PARTITION BY deg) - 1) / 2.0::DOUBLE AS r FROM deg JOIN nt USING (idx)),
    k AS (SELECT count(*) AS n, sum(r) AS r FROM x GROUP BY type), t AS (SELECT count(*)::DOUBLE AS t FROM x), ti AS (SELECT sum(c ** 3 - c) AS ti FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY deg))
    SELECT count(*)::BIGINT AS n_groups, round((12 / (t * (t + 1)) * sum(k.r * k.r / k.n) - 3 * (t + 1)) / (1 - ti / (t ** 3 - t)), 6) AS h FROM k, t, ti GROUP BY t, ti""")
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return rk.kruskal(g.degrees(undirected(e)).join(node_types(e), "idx").select("type", "deg"), "type", "deg")


@query(_LABSCORE + f""", nb AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY u, v) - 1 AS no, count(*) OVER (PARTITION BY label) AS n FROM ls), sn AS (SELECT label, max(n) AS n FROM nb GROUP BY label),
    bd AS ({SQL_WIDE("SELECT label, label AS stratum, n, boot, unnest(range(n)) AS draw FROM sn, range(1000) b(boot)", "label, boot")}), s AS (SELECT boot, score, sum(label) AS pos, sum(1 - label) AS neg FROM bd JOIN nb USING (label, no) GROUP BY boot, score),
    c AS (SELECT boot, pos, neg, pos * (sum(neg) OVER (PARTITION BY boot ORDER BY score) - neg / 2.0::DOUBLE) AS won, pos * 1.0::DOUBLE * sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w) AS pr FROM s WINDOW w AS (PARTITION BY boot ORDER BY score DESC)),
    a AS (SELECT boot, round(sum(won) / (sum(pos) * sum(neg)), 6) AS auroc, round(sum(pr) / sum(pos), 6) AS ap FROM c GROUP BY boot)
    SELECT count(*)::BIGINT AS n_valid, round(round(avg(auroc), 6) + 1e-9, 5) AS auroc, round(round(quantile_cont(auroc, 0.025), 6) + 1e-9, 5) AS auroc_low, round(round(quantile_cont(auroc, 0.975), 6) + 1e-9, 5) AS auroc_high, round(round(avg(ap), 6) + 1e-9, 5) AS ap, round(round(quantile_cont(ap, 0.025), 6) + 1e-9, 5) AS ap_low, round(round(quantile_cont(ap, 0.975), 6) + 1e-9, 5) AS ap_high FROM a""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC and average precision over 1000 stratified resamples, mean and 95 % interval."""
    b = rs.bootstrap(_scored(spark, sf_dir), [], ["u", "v"], whole=True)
    return b.select("n_valid", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in b.columns if c != "n_valid"])


@query(_LABSCORE + f""", nb AS (SELECT label, score, row_number() OVER (ORDER BY u % 2, u, v) - 1 AS row, count(*) FILTER (u % 2 = 0) OVER () AS na FROM ls),
    de AS (SELECT perm, label, score, na, row_number() OVER (PARTITION BY perm ORDER BY CASE WHEN perm = 0 THEN row ELSE {SQL_HASH("row", "perm")} END, row) - 1 AS place FROM nb, range(1001) p(perm)),
    s AS (SELECT perm, (place >= na)::INT AS side, score, sum(label) AS pos, sum(1 - label) AS neg FROM de GROUP BY ALL), w AS (SELECT perm, side, pos, neg, pos * (sum(neg) OVER (PARTITION BY perm, side ORDER BY score) - neg / 2.0::DOUBLE) AS won FROM s),
    a AS (SELECT perm, side, round(sum(won) / nullif(sum(pos) * sum(neg), 0), 6) AS auroc FROM w GROUP BY perm, side), d AS (SELECT perm, max(CASE WHEN side = 0 THEN auroc END) - max(CASE WHEN side = 1 THEN auroc END) AS d FROM a GROUP BY perm), o AS (SELECT d AS o FROM d WHERE perm = 0)
    SELECT round(o, 6) AS observed, round(avg(coalesce((abs(d) >= abs(o))::INT::DOUBLE, 0)), 6) AS p, round(least(avg(coalesce((abs(d) >= abs(o))::INT::DOUBLE, 0)) * 3, 1), 6) AS bonferroni FROM d, o WHERE perm > 0 GROUP BY o""")
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of AUROC between the pairs of even and of odd drugs against 1000 permutations, for three comparisons."""
    s = _scored(spark, sf_dir)
    return rs.permutation_test(s.filter("u % 2 = 0"), s.filter("u % 2 = 1"), ["u", "v"], comparisons=3)


@query(f"""WITH r AS (SELECT test_id, row_number() OVER (ORDER BY {SQL_HASH("test_id")}, test_id) AS rn, count(*) OVER () AS n FROM test_pos) SELECT test_id, CASE WHEN rn <= floor(0.9::DOUBLE * n) THEN 'train' ELSE 'test' END AS part FROM r""")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "test_pos").select("test_id", sc.hashed(F.col("test_id")).alias("h"))
    return rk.exact_split(t, "h", "test_id").select("test_id", "part")


@query(f"""WITH r AS (SELECT test_id, drug_id, {SQL_HASH("test_id")} AS h FROM test_pos) SELECT test_id, drug_id FROM (SELECT *, row_number() OVER (PARTITION BY drug_id ORDER BY h, test_id) AS r FROM r) WHERE r <= 5 ORDER BY h, test_id LIMIT 500""")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hashed pairs of each drug at most, 500 overall (a capped sample by definition)."""
    t = table(spark, sf_dir, "test_pos").select("test_id", "drug_id", sc.hashed(F.col("test_id")).alias("h"))
    return capped_per_group(t, "drug_id", ["h", "test_id"]).select("test_id", "drug_id")


_NEG = with_(SQL_E, SQL_GOLD) + f""", hh AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS no FROM (SELECT DISTINCT u FROM gold)), vv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS no FROM (SELECT DISTINCT v FROM gold)),
    dr AS (SELECT id, ({SQL_HASH("id")}) % (SELECT count(*) FROM hh) AS hn, ({SQL_HASH("id", seed=43)}) % (SELECT count(*) FROM vv) AS tn FROM range(15000) r(id)),
    f AS (SELECT hn, tn, min(id) AS id FROM dr GROUP BY hn, tn), pr AS (SELECT u, v, id FROM f JOIN hh ON hh.no = hn JOIN vv ON vv.no = tn WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.u = hh.u AND g.v = vv.v))"""


@query(_NEG + "SELECT u, v FROM (SELECT *, row_number() OVER (ORDER BY id) AS r FROM pr) WHERE r <= 500")
def random_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gold_pairs(spark, sf_dir)
    return lp.negatives("type_constrained", p, p, p, p, 500)


_TARGETS = "tg AS (SELECT DISTINCT CASE WHEN x_type = 'drug' THEN x_index ELSE y_index END AS drug, CASE WHEN x_type = 'drug' THEN y_index ELSE x_index END AS target FROM e WHERE rel = 'drugprotein' AND (x_type = 'drug') <> (y_type = 'drug'))"


@query(with_(SQL_E, SQL_GOLD, _TARGETS) + f""", pp AS (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS pn FROM (SELECT DISTINCT u, v FROM gold)), tl AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS no FROM (SELECT DISTINCT v FROM gold)),
    od AS (SELECT drug, target, row_number() OVER (PARTITION BY drug ORDER BY target) - 1 AS k, count(*) OVER (PARTITION BY drug) AS nd FROM tg), ot AS (SELECT target, drug, row_number() OVER (PARTITION BY target ORDER BY drug) - 1 AS k2, count(*) OVER (PARTITION BY target) AS nw FROM tg),
    d0 AS (SELECT id, u, ({SQL_HASH("id", seed=45)}) % (SELECT count(*) FROM tl) AS no FROM range(15000) r(id) JOIN pp ON pp.pn = ({SQL_HASH("id")}) % (SELECT count(*) FROM pp)),
    d1 AS (SELECT d0.*, od.target FROM d0 JOIN od ON od.drug = d0.u AND od.k = ({SQL_HASH("id", seed=43)}) % od.nd), d2 AS (SELECT d1.*, ot.k2 AS mine, nw, ({SQL_HASH("id", seed=44)}) % (nw - 1) AS pl FROM d1 JOIN ot ON ot.target = d1.target AND ot.drug = d1.u WHERE nw > 1),
    d3 AS (SELECT ot.drug AS u, tl.v, min(id) AS id FROM d2 JOIN ot ON ot.target = d2.target AND ot.k2 = pl + (pl >= mine)::INT JOIN tl ON tl.no = d2.no GROUP BY ALL)
    SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY id) AS r FROM d3 WHERE NOT EXISTS (SELECT 1 FROM gold WHERE gold.u = d3.u AND gold.v = d3.v)) WHERE r <= 500""")
def shared_target_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 hashed pairs whose drug shares a target with the drug of a gold pair."""
    p = gold_pairs(spark, sf_dir)
    return lp.negatives("shared_target", p, p, p, _targets(spark, sf_dir), 500)



def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).filter("rel = 'drugprotein' AND (x_type = 'drug') <> (y_type = 'drug')")
    forward = F.col("x_type") == "drug"
    return e.select(F.when(forward, F.col("x_index")).otherwise(F.col("y_index")).alias("drug"), F.when(forward, F.col("y_index")).otherwise(F.col("x_index")).alias("target")).distinct()


@query(with_(SQL_E, _TARGETS) + "SELECT drug, count(*)::BIGINT AS n_targets, min(target) AS first_target FROM tg GROUP BY drug")
def drug_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).groupBy("drug").agg(F.count(F.lit(1)).alias("n_targets"), F.min("target").alias("first_target"))


# --- time, resampling reports ------------------------------------------------------------------------------------


@query("""SELECT drug_id, CASE WHEN first_date < TIMESTAMP '2015-01-01' THEN 'known' ELSE 'new' END AS period, count(*)::BIGINT AS n FROM (SELECT drug_id, lower(trim(disease_name)) AS d, min(fda_date) AS first_date FROM table5_replication WHERE drug_id IS NOT NULL AND disease_name IS NOT NULL AND fda_date IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2""")
def prospective_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs first seen before and after a cut-off."""
    r = table(spark, sf_dir, "table5_replication").filter("drug_id IS NOT NULL AND disease_name IS NOT NULL AND fda_date IS NOT NULL")
    first = r.groupBy("drug_id", F.lower(F.trim("disease_name")).alias("d")).agg(F.min("fda_date").alias("first_date"))
    return first.groupBy("drug_id", F.when(F.col("first_date") < F.lit("2015-01-01").cast("timestamp_ntz"), "known").otherwise("new").alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT methodology, count(*)::BIGINT AS n, round(median(distance), 6) AS median_distance, round(median(random_mean), 6) AS median_random, round(avg((distance < ci_lo)::INT::DOUBLE), 6) AS below_interval FROM table5_replication WHERE distance IS NOT NULL AND ci_lo IS NOT NULL GROUP BY methodology""")
def proximity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "table5_replication").filter("distance IS NOT NULL AND ci_lo IS NOT NULL")
    return r.groupBy("methodology").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("distance"), 6).alias("median_distance"), F.round(F.median("random_mean"), 6).alias("median_random"), F.round(F.avg((F.col("distance") < F.col("ci_lo")).cast("double")), 6).alias("below_interval"))


@query("""WITH r AS (SELECT label AS model, vec_id % 5 AS rerun, avg(list_sum(embedding)::DOUBLE) AS score FROM embeddings GROUP BY 1, 2), b AS (SELECT rerun, score AS base FROM r WHERE model = 0)
    SELECT model::INT AS model, count(*)::BIGINT AS n, round(avg(score - base), 4) AS lift, round(1.96::DOUBLE * stddev_samp(score - base) / sqrt(count(*)), 4) AS half_width FROM r JOIN b USING (rerun) WHERE model <> 0 GROUP BY model""")
def paired_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference to a baseline over reruns, with its interval."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("model"), (F.col("vec_id") % 5).alias("rerun"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("s"))
    r = e.groupBy("model", "rerun").agg(F.avg("s").alias("score"))
    b = r.filter("model = 0").select("rerun", F.col("score").alias("base"))
    d = r.filter("model <> 0").join(b, "rerun").withColumn("d", F.col("score") - F.col("base"))
    return d.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 4).alias("lift"), F.round(1.96 * F.stddev_samp("d") / F.sqrt(F.count(F.lit(1))), 4).alias("half_width"))


# --- vectors -----------------------------------------------------------------------------------------------------

_NORM = lambda x: f"sqrt(list_sum(list_transform({x}, lambda z: z::DOUBLE * z::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


@query(f"""SELECT a.vec_id, round({_DOT} / ({_NORM("a.embedding")} * {_NORM("b.embedding")}), 5) AS cosine,
    round(-sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE + 0.01::DOUBLE - z[2]::DOUBLE) ** 2))), 5) AS translation
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and translation score of each vector with the next one; the relation is 0.01 in every place."""
    e = table(spark, sf_dir, "embeddings")
    j = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    r = F.transform("a", lambda x: F.lit(0.01))
    return j.select("vec_id", F.round(sc.cosine(F.col("a"), F.col("b")), 5).alias("cosine"), F.round(sc.translation_score(F.col("a"), r, F.col("b")), 5).alias("translation"))


@query("""SELECT a.vec_id, round(-sqrt(list_sum(list_transform(range(1, 5), lambda i: (a.embedding[i]::DOUBLE * cos(0.5::DOUBLE) - a.embedding[i + 4]::DOUBLE * sin(0.5::DOUBLE) - b.embedding[i]::DOUBLE) ** 2 + (a.embedding[i]::DOUBLE * sin(0.5::DOUBLE) + a.embedding[i + 4]::DOUBLE * cos(0.5::DOUBLE) - b.embedding[i + 4]::DOUBLE) ** 2)) + 1e-12::DOUBLE), 5) AS rotation
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def rotation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    j = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    phase = F.array(*[F.lit(0.5)] * 4)
    return j.select("vec_id", F.round(sc.rotation_score(F.slice("a", 1, 8), phase, F.slice("b", 1, 8), 4), 5).alias("rotation"))


@query(with_(SQL_E) + """, r AS (SELECT rel, row_number() OVER (ORDER BY min(row_id)) - 1 AS r FROM e GROUP BY rel), k AS (SELECT count(*) AS k FROM r), held AS (SELECT least(drug_index, disease_index) AS a, greatest(drug_index, disease_index) AS b FROM test_pos),
    f AS (SELECT DISTINCT x_index AS h, r, y_index AS t FROM e JOIN r USING (rel) WHERE NOT (rel = 'indication' AND EXISTS (SELECT 1 FROM held WHERE a = least(x_index, y_index) AND b = greatest(x_index, y_index))))
    SELECT h, r::BIGINT AS r, t FROM f UNION ALL SELECT t, (r + k)::BIGINT, h FROM f, k""")
def training_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples with inverse relations, without held-out indications in either direction; relations by first appearance."""
    e = edges(spark, sf_dir)
    first = e.groupBy("rel").agg(F.min("row_id").alias("first"))  # one row a relation
    numbers = F.broadcast(first.withColumn("r", F.row_number().over(Window.partitionBy().orderBy("first")) - 1).select("rel", "r", F.count(F.lit(1)).over(Window.partitionBy()).alias("k")))
    held = table(spark, sf_dir, "test_pos").select(F.least("drug_index", "disease_index").alias("a"), F.greatest("drug_index", "disease_index").alias("b")).distinct().withColumn("held", F.lit(True))
    kept = e.withColumns({"a": F.least("x_index", "y_index"), "b": F.greatest("x_index", "y_index")}).join(held, ["a", "b"], "left").filter("NOT (rel = 'indication' AND coalesce(held, false))")
    f = kept.join(numbers, "rel").select(F.col("x_index").alias("h"), F.col("r").cast("bigint").alias("r"), F.col("y_index").alias("t"), "k").distinct()
    return f.select("h", "r", "t").unionByName(f.select(F.col("t").alias("h"), (F.col("r") + F.col("k")).alias("r"), F.col("h").alias("t")))


@query()
def graph_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation vectors of the nodes of each training graph."""
    t = table(spark, sf_dir, "train_triples").filter("head_index IS NOT NULL AND tail_index IS NOT NULL")
    # the hash of the normalised relation is its number; embed_graphs numbers them anew
    return lp.embed_graphs(t.select("kg", F.col("head_index").alias("h"), F.xxhash64(relation_key(F.col("relation"))).alias("r"), F.col("tail_index").alias("t")))
