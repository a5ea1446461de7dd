"""Provenance tiers, audits, approvals, reruns of embeddings and the summary of all dimensions, beside SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import scores as sc
from lattiq.functions.ids import relation_key
from lattiq.operators import graph as g
from lattiq.operators import linkpred as lp
from lattiq.operators import quality as q
from lattiq.operators import ranking as rk
from lattiq.plans import bridge_queries, evaluation_queries, graph_queries, quality_queries, task_queries
from lattiq.plans.lineage import discard, written
from lattiq.plans.task_queries import indications
from lattiq.sources.kg_view import SQL_E, adjacency, edges, undirected, with_
from lattiq.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- provenance --------------------------------------------------------------------------------------------------

_NAMED = SQL_E + ", nm AS (SELECT e.*, CASE WHEN x_source IS NOT NULL THEN x_source || '::' || rel ELSE rel END AS relation FROM e)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose relation is named after the source of the head, where it has one."""
    return edges(spark, sf_dir).withColumn("relation", F.when(F.col("x_source").isNotNull(), F.concat("x_source", F.lit("::"), "rel")).otherwise(F.col("rel")))


@query(with_(_NAMED) + """SELECT 'columns' AS mode, source, (count(*) // 2)::BIGINT AS n FROM (SELECT x_source AS source FROM nm UNION ALL SELECT y_source FROM nm) WHERE source IS NOT NULL GROUP BY source
    UNION ALL SELECT 'relation_prefix', coalesce(nullif(regexp_extract(relation, '^([^:]+)::', 1), ''), 'other'), count(*) FROM nm GROUP BY 2 UNION ALL SELECT 'relation_values', relation, count(*) FROM nm GROUP BY relation""")
def source_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by source under the three ways in which graphs state it."""
    e, out = _named(spark, sf_dir), None
    for mode in ("columns", "relation_prefix", "relation_values"):
        one = q.source_modes(e, mode, ["x_source", "y_source"]).select(F.lit(mode).alias("mode"), "source", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_(_NAMED) + """SELECT 'nodes' AS kg, 1 AS tier, count(*)::BIGINT AS n, round(count(x_source) * 100.0::DOUBLE / count(*), 1) AS pct_attributed, 5 AS n_sources, round(count(CASE WHEN x_source <> y_source THEN 1 END) * 100.0::DOUBLE / count(x_source), 1) AS pct_cross, 0.5::DOUBLE AS traceability FROM nm
    UNION ALL SELECT 'edges', 2, count(*), round(count(CASE WHEN display_relation <> '' THEN 1 END) * 100.0::DOUBLE / count(*), 1), 3, NULL, 1.0 FROM nm UNION ALL SELECT 'prefixes', 2, count(*), round(count(CASE WHEN contains(relation, '::') THEN 1 END) * 100.0::DOUBLE / count(*), 1), 6, 0.0, 1.0 FROM nm
    UNION ALL SELECT 'types', 0, count(*), 100.0, 13, NULL, 0.0 FROM nm""")
def granularity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance under the four arrangements: columns of both ends, one column of the edge, prefix of the relation, type only."""
    e = _named(spark, sf_dir)
    out = q.granularity_row(e, "nodes", "columns", 1, 5, ["x_source", "y_source"])
    for row in (("edges", "columns", 2, 3, ["display_relation"]), ("prefixes", "relation_prefix", 2, 6), ("types", "relation_values", 0, 13)):
        out = out.unionByName(q.granularity_row(e, *row))
    return out


# --- audit of pairs ----------------------------------------------------------------------------------------------

_AUDIT = with_(
    r"""sh AS (SELECT DISTINCT head_id AS d, tail_index AS t FROM train_triples WHERE regexp_replace(lower(relation), '[^a-z]', '', 'g') = 'contraindication' AND regexp_full_match(head_id, 'DB[0-9]{5,}') AND tail_index IS NOT NULL),
    gd AS (SELECT DISTINCT least(x.d, y.d) AS a, greatest(x.d, y.d) AS b FROM sh x JOIN sh y ON x.t = y.t AND x.d < y.d),
    nd AS (SELECT id, nullif(regexp_extract(concat_ws(' ', id, equivalent_identifiers), '\b(DB\d{5,})\b', 1), '') AS mapped FROM biolink_nodes WHERE regexp_matches(category, 'SmallMolecule|Drug|ChemicalEntity|MolecularMixture|Food')),
    lk AS (SELECT nullif(regexp_extract(x_id, '\b(DB\d{5,})\b', 1), '') AS a, nullif(regexp_extract(y_id, '\b(DB\d{5,})\b', 1), '') AS b, regexp_replace(lower(relation), '[^a-z]', '', 'g') AS predicate FROM kg_df),
    mp AS (SELECT * FROM lk WHERE a IS NOT NULL AND b IS NOT NULL), f AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n, max((predicate = 'drugdrug')::INT) AS d FROM mp GROUP BY 1, 2)"""
)


def _audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold pairs (drugs with a contraindication in common), drug-like nodes with their DrugBank id, and links between such ids."""
    db = lambda c: F.nullif(F.regexp_extract(c, r"\b(DB\d{5,})\b", 1), F.lit(""))
    t = table(spark, sf_dir, "train_triples").filter((relation_key(F.col("relation")) == "contraindication") & F.col("head_id").rlike("^DB[0-9]{5,}$") & F.col("tail_index").isNotNull())
    shared = t.select(F.col("head_id").alias("a"), F.col("tail_index").alias("t")).distinct()
    gold = shared.join(shared.withColumnRenamed("a", "b"), "t").filter("a < b").select("a", "b").distinct()
    n = table(spark, sf_dir, "biolink_nodes").filter(F.col("category").rlike("SmallMolecule|Drug|ChemicalEntity|MolecularMixture|Food"))
    nodes = n.select("id", db(F.concat_ws(" ", "id", "equivalent_identifiers")).alias("mapped"))
    links = table(spark, sf_dir, "kg_df").select(db("x_id").alias("a"), db("y_id").alias("b"), relation_key(F.col("relation")).alias("predicate"))
    return gold, nodes, links


@query(_AUDIT + """, j AS (SELECT gd.a IS NOT NULL AS g, f.n, f.d FROM gd FULL JOIN f ON f.a = gd.a AND f.b = gd.b), c AS (SELECT count(CASE WHEN g THEN 1 END)::DOUBLE AS gold_pairs, sum(n)::DOUBLE AS edges_mapped, count(n)::DOUBLE AS pairs_any, count(CASE WHEN d = 1 THEN 1 END)::DOUBLE AS pairs_meant, count(CASE WHEN g AND n IS NOT NULL THEN 1 END)::DOUBLE AS overlap_any, count(CASE WHEN g AND d = 1 THEN 1 END)::DOUBLE AS overlap_meant, count(CASE WHEN g AND n IS NULL THEN 1 END)::DOUBLE AS missing FROM j),
    v AS (SELECT count(*)::DOUBLE AS nodes, count(mapped)::DOUBLE AS nodes_mapped, count(DISTINCT mapped)::DOUBLE AS distinct_mapped FROM nd), one AS (SELECT *, round(100.0::DOUBLE * overlap_any / gold_pairs, 2) AS coverage_any_pct, round(100.0::DOUBLE * overlap_meant / gold_pairs, 2) AS coverage_meant_pct FROM c, v)
    SELECT key, value FROM (UNPIVOT one ON COLUMNS(*) INTO NAME key VALUE value)""")
def pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.pair_audit(*_audited(spark, sf_dir), ["drugdrug"])


@query(_AUDIT + """SELECT predicate, count(*)::BIGINT AS n FROM mp GROUP BY predicate ORDER BY n DESC, predicate LIMIT 30""")
def audit_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most frequent predicates between mapped ends (a report)."""
    return _audited(spark, sf_dir)[2].filter("a IS NOT NULL AND b IS NOT NULL").groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "predicate").limit(30)


@query(_AUDIT + """SELECT a, b FROM gd WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.a = gd.a AND f.b = gd.b) ORDER BY a, b LIMIT 20""")
def audit_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 gold pairs that no link states (a report)."""
    gold, _, links = _audited(spark, sf_dir)
    stated = links.filter("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return gold.join(stated, ["a", "b"], "left_anti").orderBy("a", "b").limit(20)


# --- approvals ---------------------------------------------------------------------------------------------------

_APPROVED = "ap AS (SELECT drug_id, drug_name, lower(trim(disease_name)) AS disease, fda_date AS date, methodology AS agency FROM table5_replication)"


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals of the replication table; its method stands for the agency."""
    return table(spark, sf_dir, "table5_replication").select("drug_id", "drug_name", F.lower(F.trim("disease_name")).alias("disease"), F.col("fda_date").alias("date"), F.col("methodology").alias("agency"))


@query(with_(_APPROVED) + """, p AS (SELECT drug_id, disease, min(date) AS date, coalesce(array_to_string(list_sort(list(DISTINCT agency) FILTER (agency IS NOT NULL)), ';'), '') AS agencies, min(drug_name) AS drug_name FROM ap WHERE drug_id IS NOT NULL AND disease IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT *, coalesce(strftime(date, '%Y-%m-%d'), '') || ' ' || disease || ' [' || agencies || ']' AS line FROM p)
    SELECT drug_id, min(drug_name) AS drug_name, string_agg(line, ' | ' ORDER BY date ASC NULLS FIRST, disease, agencies) AS approvals FROM t GROUP BY drug_id""")
def approval_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each drug its approvals as lines of date, disease and agencies."""
    line = lambda x: F.concat(F.coalesce(F.date_format(x["date"], "yyyy-MM-dd"), F.lit("")), F.lit(" "), x["disease"], F.lit(" ["), x["agencies"], F.lit("]"))
    return q.approval_lists(_approvals(spark, sf_dir)).select("drug_id", "drug_name", F.array_join(F.transform("approvals", line), " | ").alias("approvals"))


@query(with_(_APPROVED) + """SELECT drug_id, disease, date, agency FROM ap WHERE drug_id IS NOT NULL AND disease IS NOT NULL AND agency IS DISTINCT FROM 'all other diseases' AND NOT EXISTS (SELECT 1 FROM ap o WHERE o.agency = 'all other diseases' AND o.drug_id = ap.drug_id AND o.disease = ap.disease)""")
def approvals_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals of other agencies for pairs that the first one does not have."""
    return q.pairs_beyond(_approvals(spark, sf_dir).filter("drug_id IS NOT NULL AND disease IS NOT NULL"), "all other diseases").select("drug_id", "disease", "date", "agency")


@query(with_(_APPROVED) + """, p AS (SELECT drug_id, disease, count(DISTINCT agency) AS k FROM ap WHERE drug_id IS NOT NULL AND disease IS NOT NULL GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM ap)::BIGINT AS n_records, count(*)::BIGINT AS n_pairs, count(CASE WHEN k > 1 THEN 1 END)::BIGINT AS n_several, count(DISTINCT drug_id)::BIGINT AS n_drugs, count(DISTINCT disease)::BIGINT AS n_diseases FROM p""")
def approval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _approvals(spark, sf_dir)
    p = a.filter("drug_id IS NOT NULL AND disease IS NOT NULL").groupBy("drug_id", "disease").agg(F.count_distinct("agency").alias("k"))
    one = p.agg(F.count(F.lit(1)).alias("n_pairs"), F.count(F.when(F.col("k") > 1, 1)).alias("n_several"), F.count_distinct("drug_id").alias("n_drugs"), F.count_distinct("disease").alias("n_diseases"))
    return a.agg(F.count(F.lit(1)).alias("n_records")).join(one)  # single rows


# --- reruns of embeddings ----------------------------------------------------------------------------------------

SEEDS = (42, 1042, 2042)


def _reruns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(triples, pairs, heuristics, inverse) of reruns: a fresh split of the indications for each seed, held-out pairs left out of
    the triples in both directions, negatives by two strategies, and the same pairs scored by shared neighbours. Each triple
    stands for (t, r + inverse, h) as well."""
    e = edges(spark, sf_dir)
    ind = written(indications(e))
    first = e.groupBy("rel").agg(F.min("row_id").alias("first"))  # one row a relation
    relations = [r.rel for r in first.orderBy("first").collect()]
    number = F.create_map(*[F.lit(x) for i, r in enumerate(relations) for x in (r, i)])
    r = relations.index("indication") if "indication" in relations else 0
    # all reruns start from these tables, so that no plan holds more than one step of one rerun
    every = written(e.select(F.col("x_index").alias("h"), number[F.col("rel")].alias("r"), F.col("y_index").alias("t")).distinct())
    links, targets = written(undirected(e)), written(graph_queries._targets(spark, sf_dir))
    triples = pairs = heuristics = None
    add = lambda whole, part: part if whole is None else whole.unionByName(part)
    for rerun, seed in enumerate(SEEDS):
        split = rk.exact_split(ind.withColumn("h", sc.hashed(F.col("u"), F.col("v"), seed=seed)).withColumn("key", F.col("u") * 1_000_003 + F.col("v")), "h", "key")
        test = written(split.filter("part = 'test'").select("u", "v"))
        held = test.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        stated = every.filter(F.col("r") == r).withColumns({"a": F.least("h", "t"), "b": F.greatest("h", "t")}).join(held, ["a", "b"], "left_anti")
        triples = add(triples, every.filter(F.col("r") != r).unionByName(stated.select("h", "r", "t")).select(F.lit(rerun).alias("rerun"), "h", "r", "t"))
        n, labelled = 5 * test.count(), None
        for strategy in ("type_constrained", "shared_target"):
            neg = lp.negatives(strategy, ind, ind, ind, targets, n, seed=seed)
            one = test.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))
            labelled = add(labelled, written(one.select(F.lit(rerun).alias("rerun"), F.lit(strategy).alias("strategy"), "u", "v", "label")))
        pairs = add(pairs, labelled.withColumns({"r": F.lit(r), "r_inv": F.lit(r + len(relations))}))
        und = written(links.join(held.toDF("u", "v"), ["u", "v"], "left_anti"))
        s = g.pair_scores(labelled, adjacency(und), g.degrees(und))
        long = s.select("u", "v", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(c).cast("double").alias("score")) for k, c in lp.SCORERS.items()])).alias("m")).select("u", "v", "m.*")
        heuristics = add(heuristics, written(labelled.join(long, ["u", "v"]).select("rerun", "model", "strategy", "u", "v", "label", "score")))
        discard(und)
    discard(links, targets)
    return triples, pairs, heuristics, len(relations)


@query()
def rerun_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, strategy, n, auroc, half_width, ap, hits100, heuristic_auroc, lift, lift_half_width): embeddings and scorers over reruns.

    Means over fresh splits with 1.96 standard errors, the best scorer by shared neighbours of the strategy, and the paired
    lift of each model over it."""
    triples, pairs, heuristics, inverse = _reruns(spark, sf_dir)
    scored = written(lp.score_reruns(triples, pairs, seeds=SEEDS, inverse=inverse).unionByName(heuristics.select("rerun", "model", "strategy", "u", "v", F.col("label").cast("int").alias("label"), "score")))
    m = written(rk.ranking_metrics(scored.select("rerun", "model", "strategy", "score", "label"), ["rerun", "model", "strategy"], (10, 50, 100)))
    listed = F.col("model").isin(list(lp.SCORERS))
    best = m.filter(listed).groupBy("rerun", "strategy").agg(F.max("auroc").alias("base"))
    d = m.join(best, ["rerun", "strategy"]).withColumn("d", F.col("auroc") - F.col("base"))
    half = lambda c: F.round(1.96 * F.stddev_samp(c) / F.sqrt(F.count(F.lit(1))), 6)
    mean = lambda c: F.round(F.avg(c), 6)
    return d.groupBy("model", "strategy").agg(F.count(F.lit(1)).alias("n"), mean("auroc").alias("auroc"), half("auroc").alias("half_width"), mean("ap").alias("ap"), mean("hits100").alias("hits100"), mean("base").alias("heuristic_auroc"), mean("d").alias("lift"), half("d").alias("lift_half_width"))


@query("""SELECT a.vec_id, round(greatest(-sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE + 0.01::DOUBLE - z[2]::DOUBLE) ** 2))), -sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - 0.02::DOUBLE - z[2]::DOUBLE) ** 2)))), 5) AS score,
    round(sqrt(list_sum(list_transform(a.embedding, lambda z: z::DOUBLE * z::DOUBLE))), 5) AS length FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def best_direction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of the scores by a relation and by its inverse, for each vector and the next; and the length that scaling to one takes off."""
    e = table(spark, sf_dir, "embeddings")
    j = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    by = lambda x: sc.translation_score(F.col("a"), F.transform("a", lambda _: F.lit(x)), F.col("b"))
    unit = sc.unit(F.col("a"))
    return j.select("vec_id", F.round(F.greatest(by(0.01), by(-0.02)), 5).alias("score"), F.round(sc.dot(F.col("a"), unit), 5).alias("length"))


# --- summary -----------------------------------------------------------------------------------------------------


@query()
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 19 sub-metrics of the graph, the mean of each dimension and of all of them."""
    one = lambda df, value: df.agg(F.max(value).cast("double").alias("score"))  # noqa: E731  (a single value each)
    tq, gq, qq, bq, eq = task_queries, graph_queries, quality_queries, bridge_queries, evaluation_queries
    run = lambda f: written(f(spark, sf_dir))
    stable = run(tq.rank_stability)
    mean = lambda df, c: df.agg(F.avg(c).alias("score"))
    parts = {
        "Entity Coverage": mean(run(qq.coverage_by_type).filter("n_gold > 0"), F.col("pct") / 100), "Relation Coverage": mean(run(bq.pair_coverage), F.col("pct") / 100),
        "Entity Validity": one(run(qq.macro_validity).filter("kg = 'alder'"), F.col("macro")), "Relational Consistency": mean(run(qq.schema_conformance), F.col("pct") / 100),
        "Source Diversity": mean(run(qq.source_diversity), F.col("diversity")), "Edge Traceability": one(run(granularity_tiers).filter("kg = 'nodes'"), F.col("traceability")), "Uncertainty Quantification": one(run(qq.uncertainty_coverage), F.col("share")),
        "Graph Cohesion": one(run(gq.connectivity), F.col("largest") / F.col("n_nodes")), "Clustering Coefficient": one(run(gq.small_world), F.col("score")), "Graph Reachability": one(run(eq.differential_resilience), F.col("random_index")), "Community Purity": one(run(eq.adjusted_information), F.col("ami")),
        "Random Dropout": one(stable.filter("kind = 'random'"), F.col("effect")), "Periph. Dropout": one(stable.filter("kind = 'periphery'"), F.col("effect")),
        "Link Prediction": one(run(gq.link_prediction), F.col("auroc")), "Neighborhood Retrieval": one(run(tq.neighbourhood_retrieval), F.col("hits100")), "Multi-hop Reasoning": one(run(tq.multi_hop_retrieval), F.col("hits100")),
        "Data-Sparse Gen.": one(run(tq.tier_evaluation).filter("grp = 'Q1'"), F.col("auroc")), "Cross-Domain Gen.": mean(run(tq.area_evaluation), F.col("auroc")), "Prospective Gen.": one(run(tq.prospective_evaluation).filter("grp = 'new'"), F.col("auroc")),
    }
    out = None
    for metric, df in parts.items():
        row = df.select(F.lit("alder").alias("kg"), F.lit(metric).alias("metric"), "score")
        out = row if out is None else out.unionByName(row)
    return q.summary_table(written(out).filter("score IS NOT NULL"))
