"""Evaluation by tier, domain and distance, resolvers and remaining graph reports, each beside its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import ids
from lattiq.functions import scores as sc
from lattiq.functions.vectors import name_vectors
from lattiq.operators import graph as g
from lattiq.operators import ranking as rk
from lattiq.plans.lineage import written
from lattiq.plans.graph_queries import _LABSCORE, _RECOVERY, _recovery, _scored, kruskal_wallis, scorer_agreement
from lattiq.sources.kg_view import SQL_E, SQL_HASH, SQL_NT, adjacency, edges, gold_pairs, node_types, undirected, with_
from lattiq.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_GROUPED = """, s AS (SELECT grp, score, sum(label) AS pos, sum(1 - label) AS neg FROM gs GROUP BY grp, score),
    c AS (SELECT grp, pos, neg, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
    SELECT grp, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 4) END AS auroc FROM c GROUP BY grp"""


def _by_group(scored: DataFrame) -> DataFrame:
    m = rk.ranking_metrics(scored.select("grp", "score", "label"), ["grp"])
    return m.select("grp", "n_pos", "n_neg", F.round("auroc", 4).alias("auroc"))


@query(_LABSCORE + ", nm AS (SELECT disease_index AS v, lower(min(disease_name)) AS name FROM test_pos GROUP BY disease_index), gs AS (SELECT CASE WHEN contains(name, 'leukemia') OR contains(name, 'tumor') THEN 'cancer' WHEN contains(name, 'anemia') THEN 'blood' WHEN name IS NULL THEN 'unnamed' ELSE 'other' END AS grp, score, label FROM ls LEFT JOIN nm USING (v))" + _GROUPED)
def domain_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC by the domain of the disease, from terms in its name."""
    nm = table(spark, sf_dir, "test_pos").groupBy(F.col("disease_index").alias("v")).agg(F.lower(F.min("disease_name")).alias("name"))
    n = F.col("name")
    return _by_group(_scored(spark, sf_dir).join(nm, "v", "left").withColumn("grp", F.when(n.contains("leukemia") | n.contains("tumor"), "cancer").when(n.contains("anemia"), "blood").when(n.isNull(), "unnamed").otherwise("other")))


@query(_RECOVERY + """, ri AS (SELECT sum((rate - pr) * (recovery + pv) / 2) / (max(rate) - min(rate)) AS r FROM (SELECT rate, recovery, lag(rate) OVER (ORDER BY rate) AS pr, lag(recovery) OVER (ORDER BY rate) AS pv FROM cv))
    SELECT round(r, 4) AS random_index, round(greatest(0.0::DOUBLE, (0.9::DOUBLE - round(r, 4)) / greatest(1e-6::DOUBLE, 1 - round(r, 4))), 3) AS differential FROM ri""")
def differential_resilience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resilience under random dropout, and how far an index of 0.9 is beyond it."""
    r = g.resilience(_recovery(spark, sf_dir))
    return r.select(F.col("resilience").alias("random_index"), F.round(sc.differential_resilience(F.lit(0.9), F.col("resilience")), 3).alias("differential"))


@query()
def proximity_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole distance of each gold pair beside up to 1000 other diseases that its drug reaches."""
    e = edges(spark, sf_dir)
    diseases = node_types(e).filter(F.regexp_replace(F.lower("type"), "[^a-z]", "") == "disease").select(F.col("idx").alias("d"))
    return g.proximity(gold_pairs(spark, sf_dir), diseases, adjacency(undirected(e)), sc.hashed(F.col("u"), F.col("v"), F.col("d")))


@query(f"""WITH must AS (SELECT drug_index AS idx FROM test_pos UNION SELECT disease_index FROM test_pos), pool AS (SELECT DISTINCT idx FROM nodes_df WHERE kg = 'alder' AND idx NOT IN (SELECT idx FROM must)),
    f AS (SELECT idx, row_number() OVER (ORDER BY {SQL_HASH("idx")}, idx) AS r FROM pool), k AS (SELECT idx FROM must UNION ALL SELECT idx FROM f WHERE r <= 300)
    SELECT idx, (row_number() OVER (ORDER BY idx) - 1)::BIGINT AS no FROM k""")
def entity_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities of the gold pairs and 300 hashed others, numbered from 0 (a sample of fixed size by definition)."""
    from lattiq.operators.linkpred import numbered

    t = table(spark, sf_dir, "test_pos")
    must = t.select(F.explode(F.array("drug_index", "disease_index")).alias("idx")).distinct()
    pool = table(spark, sf_dir, "nodes_df").filter("kg = 'alder'").select("idx").distinct().join(must, "idx", "left_anti")
    fill = rk.cumulative(pool.select("idx", sc.hashed(F.col("idx")).alias("h"), F.lit(1).alias("one")), [], ["h", "idx"], ["one"]).filter("before_one < 300").select("idx")
    return numbered(must.unionByName(fill), "idx")


@query("""WITH x AS (SELECT drug_name, lower(trim(disease_name)) AS d, disease_name, fda_date, rep_id FROM table5_replication WHERE drug_name IS NOT NULL AND disease_name IS NOT NULL)
    SELECT drug_name, d AS disease, arg_min(disease_name, rep_id) AS first_spelling, count(*)::BIGINT AS n FROM x GROUP BY drug_name, d""")
def merged_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive merge of a drug's diseases, the first spelling kept."""
    x = table(spark, sf_dir, "table5_replication").filter("drug_name IS NOT NULL AND disease_name IS NOT NULL")
    return x.groupBy("drug_name", F.lower(F.trim("disease_name")).alias("disease")).agg(F.min_by("disease_name", "rep_id").alias("first_spelling"), F.count(F.lit(1)).alias("n"))


@query(r"""SELECT xref_id, CASE WHEN ltrim(regexp_replace(external_id, '^CHEBI:?', ''), '0') = '' THEN '0' ELSE ltrim(regexp_replace(external_id, '^CHEBI:?', ''), '0') END AS bare, trim(regexp_replace(external_id || ' {note}', '\{.*?\}', '', 'g')) AS clean FROM drugbank_xref WHERE external_id IS NOT NULL""")
def bare_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "drugbank_xref").filter("external_id IS NOT NULL")
    return x.select("xref_id", ids.bare_number(F.col("external_id"), "CHEBI").alias("bare"), ids.mesh_clean(F.concat("external_id", F.lit(" {note}"))).alias("clean"))


@query()
def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of Louvain's communities, of label propagation and of the entity types."""
    e = edges(spark, sf_dir)
    und = undirected(e)
    types = node_types(e).select("idx", F.xxhash64("type").alias("community"))
    rows = lambda name, labels: g.modularity(und, labels).withColumn("method", F.lit(name))
    return rows("louvain", g.louvain(und)).unionByName(rows("label_propagation", g.label_propagation(und))).unionByName(rows("types", types))


@query()
def resolution_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Louvain's communities of the whole graph at three resolutions: number, modularity, and agreement with the entity types."""
    e = edges(spark, sf_dir)
    und, types, out = undirected(e), node_types(e).select("idx", "type"), None
    for resolution in (0.5, 1.0, 2.0):
        labels = written(g.louvain(und, resolution))
        pairs = labels.join(types, "idx").select(F.col("type").alias("x"), F.col("community").alias("y"))
        one = g.modularity(und, labels).join(g.agreement(pairs)).select(F.lit(resolution).alias("resolution"), "n_communities", "modularity", "nmi", "ari", F.lit(round(g.adjusted_mutual_information(pairs), 6)).alias("ami"))  # single rows
        out = one if out is None else out.unionByName(one)
    return out


@query()
def adjusted_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AMI of entity types and Louvain's communities of the whole graph."""
    e = edges(spark, sf_dir)
    ami = g.adjusted_mutual_information(g.louvain(undirected(e)).join(node_types(e), "idx").select(F.col("type").alias("x"), F.col("community").alias("y")))
    return spark.createDataFrame([(round(ami, 6),)], "ami double")


@query()
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the hashed name vectors of both ends of each gold pair."""
    t = table(spark, sf_dir, "test_pos")
    return t.select("test_id", F.round(sc.cosine(name_vectors(F.col("drug_name")), name_vectors(F.col("disease_name"))), 6).alias("cosine"))


@query()
def rank_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(test, n, statistic, p): Kruskal-Wallis of degrees by type, rank correlation of two scorers over the gold pairs."""
    k, s = kruskal_wallis(spark, sf_dir).first(), scorer_agreement(spark, sf_dir).first()  # one row each
    rows = [("kruskal", k.n_groups, k.h, sc.kruskal_p(k.h, k.n_groups)), ("spearman", s.n, s.rho, sc.correlation_p(s.rho, s.n))]
    return spark.createDataFrame(rows, "test string, n bigint, statistic double, p double")


_PARTS = with_(SQL_E, SQL_NT)


@query(_PARTS + """SELECT e.rel, count(*)::BIGINT AS n, count(a.idx)::BIGINT AS n_head, count(CASE WHEN a.type = 'drug' THEN 1 END)::BIGINT AS n_drug FROM e LEFT JOIN nt a ON a.idx = e.x_index WHERE e.rel IN ('indication', 'contraindication', 'offlabeluse') GROUP BY e.rel""")
def oriented_indications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation filter and end types."""
    e = edges(spark, sf_dir)
    nt = node_types(e).select(F.col("idx").alias("x_index"), "type", F.lit(1).alias("known"))
    return e.filter(F.col("rel").isin("indication", "contraindication", "offlabeluse")).select("rel", "x_index").join(nt, "x_index", "left").groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_head"), F.count(F.when(F.col("type") == "drug", 1)).alias("n_drug"))
