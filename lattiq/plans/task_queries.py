"""Link prediction, retrieval, generalisation and stability as whole evaluations, each beside its SQL where SQL can state it."""

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
from lattiq.operators import retrieval as rt
from lattiq.plans.lineage import written
from lattiq.sources.kg_view import SQL_ADJ, SQL_E, SQL_GOLD, SQL_HASH, SQL_NT, SQL_UND, adjacency, edges, gold_pairs, node_types, undirected, with_
from lattiq.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- shared SQL: scores of pairs over a set of links, hashed negatives by group, metrics by group -------------------------

_DEG = "deg AS (SELECT idx, count(*)::BIGINT AS deg FROM (SELECT u AS idx FROM und UNION ALL SELECT v FROM und) GROUP BY idx)"


def sql_scored(pairs: str, und: str = "und", tag: str = "") -> str:
    """Adamic-Adar of the pairs (u, v) over links, as CTE sc<tag> (u, v, aa)."""
    return f"""ad{tag} AS (SELECT u AS a, v AS b FROM {und} UNION ALL SELECT v, u FROM {und} WHERE u <> v), dg{tag} AS (SELECT idx, count(*) AS deg FROM (SELECT u AS idx FROM {und} UNION ALL SELECT v FROM {und}) GROUP BY idx),
    mt{tag} AS (SELECT p.u, p.v, sum(CASE WHEN x.b NOT IN (p.u, p.v) AND d.deg > 1 THEN 1.0::DOUBLE / ln(d.deg) ELSE 0.0::DOUBLE END) AS aa FROM {pairs} p JOIN ad{tag} x ON x.a = p.u JOIN ad{tag} y ON y.a = p.v AND y.b = x.b JOIN dg{tag} d ON d.idx = x.b GROUP BY p.u, p.v),
    sc{tag} AS (SELECT p.u, p.v, round(coalesce(aa, 0.0::DOUBLE), 9) AS aa FROM {pairs} p LEFT JOIN mt{tag} USING (u, v))"""


_PLACES = ", np AS (SELECT grp, count(*) AS n FROM pos GROUP BY grp), hh AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS no FROM (SELECT DISTINCT u FROM heads)), tv AS (SELECT grp, v, row_number() OVER (PARTITION BY grp ORDER BY v) - 1 AS no FROM (SELECT DISTINCT grp, v FROM tails)), tn AS (SELECT grp, count(*) AS nt FROM tv GROUP BY grp)"
#: pos (grp, u, v), known (u, v), heads (u), tails (grp, v) -> lab (grp, u, v, label)
_NEGATIVES = _PLACES + f""", dr AS (SELECT grp, nt, unnest(range(150 * n)) AS id FROM np JOIN tn USING (grp)), dn AS (SELECT grp, ({SQL_HASH("id")}) % (SELECT count(*) FROM hh) AS hn, ({SQL_HASH("id", seed=43)}) % nt AS tno, min(id) AS id FROM dr GROUP BY ALL),
    ng AS (SELECT d.grp, hh.u, tv.v, row_number() OVER (PARTITION BY d.grp ORDER BY d.id) AS r FROM dn d JOIN hh ON hh.no = d.hn JOIN tv ON tv.grp = d.grp AND tv.no = d.tno WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.u = hh.u AND k.v = tv.v)),
    lab AS (SELECT grp, u, v, 1 AS label FROM pos UNION ALL SELECT grp, u, v, 0 FROM ng JOIN np USING (grp) WHERE r <= 5 * n), prs AS (SELECT DISTINCT u, v FROM lab)"""
_GROUPED = """, gs AS (SELECT lab.grp, label, aa AS score FROM lab JOIN sc USING (u, v)), rw AS (SELECT grp, label, count(*) OVER w AS rnk, sum(label) OVER w AS tp, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0::DOUBLE AS mid
      FROM gs WINDOW w AS (PARTITION BY grp ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    mx AS (SELECT grp, sum(label) AS p, sum(1 - label) AS q, (sum(CASE WHEN label = 1 THEN mid END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / nullif(sum(label) * sum(1 - label), 0) AS auroc,
      avg(CASE WHEN label = 1 THEN tp * 1.0::DOUBLE / rnk END) AS ap, avg(CASE WHEN label = 1 THEN 1.0::DOUBLE / rnk END) AS mrr, avg(CASE WHEN label = 1 THEN (rnk <= 10)::INT::DOUBLE END) AS h10, avg(CASE WHEN label = 1 THEN (rnk <= 50)::INT::DOUBLE END) AS h50, avg(CASE WHEN label = 1 THEN (rnk <= 100)::INT::DOUBLE END) AS h100 FROM rw GROUP BY grp)"""
_METRICS = "p::BIGINT AS n_pos, q::BIGINT AS n_neg, round(round(auroc, 6), 4) AS auroc, round(round(ap, 6), 4) AS ap, round(round(mrr, 6), 4) AS mrr, round(round(h10, 6), 4) AS hits10, round(round(h50, 6), 4) AS hits50, round(round(h100, 6), 4) AS hits100"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    und = written(undirected(edges(spark, sf_dir)))
    return und, adjacency(und), g.degrees(und)


def _evaluated(pos: DataFrame, known: DataFrame, heads: DataFrame, tails: DataFrame, adj: DataFrame, deg: DataFrame) -> DataFrame:
    """(grp, u, v, label, score) of positives and their hashed negatives, by Adamic-Adar."""
    lab = written(pos.select("grp", "u", "v", F.lit(1).alias("label")).unionByName(lp.grouped_negatives(pos, known, heads, tails).withColumn("label", F.lit(0))))
    s = lp.score_pairs("adamic_adar", lab, adj, deg).select("u", "v", F.round("score", 9).alias("score"))
    return lab.join(s, ["u", "v"])


def _metrics(scored: DataFrame) -> DataFrame:
    m = rk.ranking_metrics(scored.select("grp", "score", "label"), ["grp"], (10, 50, 100))
    return m.select("grp", "n_pos", "n_neg", *[F.round(c, 4).alias(c) for c in ("auroc", "ap", "mrr", "hits10", "hits50", "hits100")])


_BOTH_WAYS = "(x_type = 'drug' AND y_type = 'disease') OR (x_type = 'disease' AND y_type = 'drug')"
_IND = f"ind AS (SELECT DISTINCT CASE WHEN x_type = 'drug' THEN x_index ELSE y_index END AS u, CASE WHEN x_type = 'drug' THEN y_index ELSE x_index END AS v FROM e WHERE rel = 'indication' AND ({_BOTH_WAYS}))"


def indications(e: DataFrame) -> DataFrame:
    """(u, v): drug and disease of every indication, whichever way it is stated."""
    forward = F.col("x_type") == "drug"
    return e.filter(f"rel = 'indication' AND ({_BOTH_WAYS})").select(F.when(forward, F.col("x_index")).otherwise(F.col("y_index")).alias("u"), F.when(forward, F.col("y_index")).otherwise(F.col("x_index")).alias("v")).distinct()


def _sampled(pos: DataFrame, most: int = 500) -> DataFrame:
    """At most most pairs of each grp, in order of their hash (a sample of fixed size by definition)."""
    w = Window.partitionBy("grp").orderBy(sc.hashed(F.col("u"), F.col("v")), "u", "v")
    return pos.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__r")


_SAMPLED = f"(SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {SQL_HASH('u', 'v')}, u, v) AS r FROM ap) WHERE r <= 500"


def _sql_intervals(stratified: bool) -> str:
    """Bootstrap intervals by grp after _NEGATIVES and sc: 1000 resamples, classes drawn apart (stratified) or together."""
    by, order, stratum = ("grp, label", "u, v", "label") if stratified else ("grp", "label, u, v", "0")
    return f""", gl AS (SELECT lab.grp, lab.u, lab.v, label, aa AS score FROM lab JOIN sc USING (u, v)), gk AS (SELECT * FROM gl WHERE grp IN (SELECT grp FROM gl GROUP BY grp HAVING sum(label) >= 2 AND sum(1 - label) >= 2)),
    nb AS (SELECT grp, label, score, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS no FROM gk), sn AS (SELECT {by}, count(*) AS n FROM gk GROUP BY {by}),
    bd AS (SELECT {by}, boot, ({SQL_HASH("boot", "draw", stratum)}) % n AS no FROM (SELECT {by}, n, boot, unnest(range(n)) AS draw FROM sn, range(1000) b(boot))), dr2 AS (SELECT {by}, boot, no, count(*) AS k FROM bd GROUP BY ALL),
    sb AS (SELECT grp, boot, score, sum(label * k) AS pos, sum((1 - label) * k) AS neg FROM (SELECT * FROM dr2 JOIN nb USING ({by}, no)) GROUP BY ALL),
    sw AS (SELECT grp, boot, pos, neg, pos * (sum(neg) OVER (PARTITION BY grp, boot ORDER BY score) - neg / 2.0::DOUBLE) AS won, pos * 1.0::DOUBLE * sum(pos) OVER w / (sum(pos) OVER w + sum(neg) OVER w) AS pr FROM sb WINDOW w AS (PARTITION BY grp, boot ORDER BY score DESC)),
    sa AS (SELECT grp, boot, round(sum(won) / (sum(pos) * sum(neg)), 6) AS auroc, round(sum(pr) / sum(pos), 6) AS ap FROM sw GROUP BY grp, boot HAVING sum(pos) > 0 AND sum(neg) > 0)
    SELECT grp, count(*)::BIGINT AS n_valid, round(round(avg(auroc), 6) + 1e-9, 5) AS auroc, round(round(quantile_cont(auroc, 0.025), 6) + 1e-9, 5) AS auroc_low, round(round(quantile_cont(auroc, 0.975), 6) + 1e-9, 5) AS auroc_high, round(round(avg(ap), 6) + 1e-9, 5) AS ap, round(round(quantile_cont(ap, 0.025), 6) + 1e-9, 5) AS ap_low, round(round(quantile_cont(ap, 0.975), 6) + 1e-9, 5) AS ap_high FROM sa GROUP BY grp HAVING count(*) >= 10"""


def _rounded(intervals: DataFrame) -> DataFrame:
    # halves of the last place go up in either engine
    return intervals.select("grp", "n_valid", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in intervals.columns if c not in ("grp", "n_valid")])


# --- by degree of the disease ------------------------------------------------------------------------------------

_TIERS = with_(SQL_E, SQL_UND, SQL_NT, _DEG, _IND) + """, dd AS (SELECT nt.idx AS v, deg FROM nt JOIN deg USING (idx) WHERE type = 'disease'),
    eg AS (SELECT list_sort(list_distinct([quantile_cont(deg, 0), quantile_cont(deg, 0.25), quantile_cont(deg, 0.5), quantile_cont(deg, 0.75), quantile_cont(deg, 1)])) AS e FROM dd),
    ti AS (SELECT v, CASE WHEN len(e) < 3 THEN 'Q1' WHEN deg <= e[2] THEN 'Q1' WHEN len(e) = 3 OR deg <= e[3] THEN 'Q2' WHEN len(e) = 4 OR deg <= e[4] THEN 'Q3' ELSE 'Q4' END AS grp FROM dd, eg),
    ap AS (SELECT grp, u, v FROM ind JOIN ti USING (v)), pos AS (SELECT grp, u, v FROM """ + _SAMPLED + """), known AS (SELECT u, v FROM ind), heads AS (SELECT idx AS u FROM nt WHERE type = 'drug'), tails AS (SELECT grp, v FROM ti)""" + _NEGATIVES + ", " + sql_scored("prs") + _GROUPED


def _tier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    _, adj, deg = _graph(spark, sf_dir)
    nt, ind = node_types(e), indications(e)
    diseases = nt.filter("type = 'disease'").select("idx").join(deg, "idx").select(F.col("idx").alias("v"), "deg")
    tiers = written(rk.quantile_tiers(diseases, "deg").select("v", F.col("tier").alias("grp")))
    pos = written(_sampled(ind.join(tiers, "v").select("grp", "u", "v")))
    return _evaluated(pos, ind, nt.filter("type = 'drug'").select(F.col("idx").alias("u")), tiers, adj, deg)


@query(_TIERS + f"SELECT grp, {_METRICS} FROM mx")
def tier_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indications against negatives of the same tier, by quartile of the disease's degree."""
    return _metrics(_tier_scores(spark, sf_dir))


@query(_TIERS + """, k AS (SELECT max(CASE WHEN grp = 'Q4' THEN round(round(auroc, 6), 4) END) AS q4, max(CASE WHEN grp = 'Q1' THEN round(round(auroc, 6), 4) END) AS q1 FROM mx) SELECT q4, q1, round((q4 - q1) / nullif(q4, 0) * 100, 1) AS gap FROM k""")
def generalisation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative loss of AUROC from the best connected diseases to the sparse ones, in percent."""
    m = _metrics(_tier_scores(spark, sf_dir))
    of = lambda t: F.max(F.when(F.col("grp") == t, F.col("auroc")))
    return m.agg(of("Q4").alias("q4"), of("Q1").alias("q1")).withColumn("gap", F.round((F.col("q4") - F.col("q1")) / F.nullif(F.col("q4"), F.lit(0.0)) * 100, 1))


# --- by area of the disease --------------------------------------------------------------------------------------

_AREA = "leukemia|tumor|edema|arthritis|ataxia|neuropathy|hemorrhage|esophagitis|dystrophy|syndrome|anemia|deficiency"
_AREAS = with_(SQL_E, SQL_UND, SQL_NT, _DEG, _IND) + f""", ar AS (SELECT idx AS v, coalesce(nullif(regexp_extract(lower(name), '({_AREA})', 1), ''), 'other') AS grp FROM nt WHERE type = 'disease'),
    aa AS (SELECT grp, u, v FROM ind JOIN ar USING (v)), ap AS (SELECT * FROM aa WHERE grp IN (SELECT grp FROM aa GROUP BY grp HAVING count(*) >= 25)), pos AS (SELECT grp, u, v FROM """ + _SAMPLED + """), known AS (SELECT u, v FROM ind), heads AS (SELECT idx AS u FROM nt WHERE type = 'drug'), tails AS (SELECT grp, v FROM ar)""" + _NEGATIVES + ", " + sql_scored("prs") + _GROUPED


def _area_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattiq.operators.bridges import supported

    e = edges(spark, sf_dir)
    _, adj, deg = _graph(spark, sf_dir)
    nt, ind = node_types(e), indications(e)
    word = F.nullif(F.regexp_extract(F.lower("name"), f"({_AREA})", 1), F.lit(""))
    areas = nt.filter("type = 'disease'").select(F.col("idx").alias("v"), F.coalesce(word, F.lit("other")).alias("grp"))
    pos = written(_sampled(supported(ind.join(areas, "v").select("grp", "u", "v"), ["grp"], 25)))
    return _evaluated(pos, ind, nt.filter("type = 'drug'").select(F.col("idx").alias("u")), areas, adj, deg)


@query(_AREAS + f"SELECT grp, {_METRICS} FROM mx")
def area_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indications by the class word of the disease, areas with at least 25 pairs, against negatives of the same area."""
    return _metrics(_area_scores(spark, sf_dir))


@query(_AREAS + """, m AS (SELECT round(round(auroc, 6), 4) AS a FROM mx), ps AS (SELECT grp, score FROM gs WHERE label = 1), x AS (SELECT grp, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM ps),
    kk AS (SELECT count(*) AS n, sum(r) AS r FROM x GROUP BY grp), t AS (SELECT count(*)::DOUBLE AS t FROM x), ti AS (SELECT sum(c ** 3 - c) AS ti FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY score)),
    h AS (SELECT count(*)::BIGINT AS n_groups, round((12 / (t * (t + 1)) * sum(kk.r * kk.r / kk.n) - 3 * (t + 1)) / (1 - ti / (t ** 3 - t)), 6) AS h FROM kk, t, ti GROUP BY t, ti)
    SELECT count(a)::BIGINT AS n, round(avg(a), 4) AS mean, round(stddev_pop(a), 4) AS sd, CASE WHEN count(a) >= 2 THEN round(stddev_pop(a) / avg(a) * 100, 2) END AS cv, round(max(a) - min(a), 4) AS spread, coalesce((SELECT n_groups FROM h), 0)::BIGINT AS n_groups, (SELECT h FROM h) AS h FROM m""")
def area_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How AUROC varies over areas, and the Kruskal-Wallis statistic of the positives' scores."""
    scored = written(_area_scores(spark, sf_dir))
    v = rs.variation(_metrics(scored), "auroc")
    return v.join(F.broadcast(rk.kruskal(scored.filter("label = 1").select("grp", "score"), "grp", "score")))  # single rows


@query(_AREAS + _sql_intervals(False))
def area_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals (1000 resamples, classes drawn together) of AUROC and average precision by area."""
    return _rounded(rs.bootstrap(_area_scores(spark, sf_dir), ["grp"], ["u", "v"], stratified=False))


# --- prospective -------------------------------------------------------------------------------------------------

_NEWPAIRS = with_(SQL_E, SQL_UND, SQL_NT, _DEG, _IND) + """, ap AS (SELECT DISTINCT drug_id, lower(trim(disease_name)) AS disease FROM table5_replication WHERE drug_id IS NOT NULL AND disease_name IS NOT NULL),
    drg AS (SELECT id, min(idx) AS u FROM nodes_df WHERE kg = 'alder' AND lower(type) = 'drug' AND idx IS NOT NULL GROUP BY id), dss AS (SELECT lower(name) AS disease, min(idx) AS v FROM nodes_df WHERE kg = 'alder' AND lower(type) = 'disease' AND idx IS NOT NULL AND name IS NOT NULL GROUP BY 1),
    rp AS (SELECT ap.*, drg.u, dss.v, coalesce(deg.deg, 0) AS deg FROM ap LEFT JOIN drg ON drg.id = ap.drug_id LEFT JOIN dss USING (disease) LEFT JOIN deg ON deg.idx = drg.u),
    st AS (SELECT drug_id, disease, u, v, CASE WHEN u IS NULL OR deg < 5 THEN 'unmatched_drug' WHEN v IS NULL THEN 'unmatched_disease' WHEN EXISTS (SELECT 1 FROM ind WHERE ind.u = rp.u AND ind.v = rp.v) THEN 'leaked' ELSE 'new' END AS state FROM rp)"""


def _prospective(spark: SparkSession, sf_dir: str, deg: DataFrame, ind: DataFrame) -> DataFrame:
    """(drug_id, disease, u, v, state) of approvals: new, leaked (stated already), or which end was not found."""
    ap = table(spark, sf_dir, "table5_replication").filter("drug_id IS NOT NULL AND disease_name IS NOT NULL").select("drug_id", F.lower(F.trim("disease_name")).alias("disease")).distinct()
    n = table(spark, sf_dir, "nodes_df").filter("kg = 'alder' AND idx IS NOT NULL")
    dr = n.filter("lower(type) = 'drug'").groupBy(F.col("id").alias("drug_id")).agg(F.min("idx").alias("u"))
    ds = n.filter("lower(type) = 'disease' AND name IS NOT NULL").groupBy(F.lower("name").alias("disease")).agg(F.min("idx").alias("v"))
    rp = ap.join(dr, "drug_id", "left").join(ds, "disease", "left").join(deg.select(F.col("idx").alias("u"), "deg"), "u", "left").join(ind.withColumn("stated", F.lit(True)), ["u", "v"], "left")
    state = F.when(F.col("u").isNull() | (F.coalesce("deg", F.lit(0)) < 5), "unmatched_drug").when(F.col("v").isNull(), "unmatched_disease").when(F.col("stated"), "leaked").otherwise("new")
    return rp.select("drug_id", "disease", "u", "v", state.alias("state"))


@query(_NEWPAIRS + "SELECT drug_id, disease, u, v, state FROM st")
def prospective_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    _, _, deg = _graph(spark, sf_dir)
    return _prospective(spark, sf_dir, deg, indications(e))


_PROSPECT = _NEWPAIRS + """, nw AS (SELECT DISTINCT u, v FROM st WHERE state = 'new'), k AS (SELECT count(*) AS k FROM nw),
    al AS (SELECT 'new' AS grp, u, v FROM nw UNION ALL SELECT * FROM (SELECT 'all_known', u, v FROM ind ORDER BY """ + SQL_HASH("u", "v") + """, u, v LIMIT (SELECT k FROM k)) UNION ALL SELECT * FROM (SELECT 'same_drugs', u, v FROM ind WHERE u IN (SELECT u FROM nw) ORDER BY """ + SQL_HASH("u", "v") + """, u, v LIMIT (SELECT k FROM k))),
    pos AS (SELECT * FROM al WHERE (SELECT k FROM k) >= 10), known AS (SELECT u, v FROM ind UNION SELECT u, v FROM nw), heads AS (SELECT idx AS u FROM nt WHERE type = 'drug'), tails AS (SELECT grp, idx AS v FROM nt, (SELECT DISTINCT grp FROM pos) WHERE type = 'disease')""" + _NEGATIVES + ", " + sql_scored("prs") + _GROUPED


def _prospective_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    _, adj, deg = _graph(spark, sf_dir)
    ind, nt = written(indications(e)), node_types(e)
    new = written(_prospective(spark, sf_dir, deg, ind).filter("state = 'new'").select("u", "v").distinct())
    k = new.count()
    first = lambda df, name: df.orderBy(sc.hashed(F.col("u"), F.col("v")), "u", "v").limit(k).select(F.lit(name).alias("grp"), "u", "v")
    same = ind.join(new.select("u").distinct(), "u", "left_semi").select("u", "v")
    pos = new.select(F.lit("new").alias("grp"), "u", "v").unionByName(first(ind, "all_known")).unionByName(first(same, "same_drugs"))
    pos = written(pos if k >= 10 else pos.limit(0))
    of = lambda t, c: nt.filter(F.col("type") == t).select(F.col("idx").alias(c))
    tails = of("disease", "v").select(F.explode(F.array(*[F.lit(x) for x in ("new", "all_known", "same_drugs")])).alias("grp"), "v")
    return _evaluated(pos, ind.unionByName(new), of("drug", "u"), tails, adj, deg)


@query(_PROSPECT + f"SELECT grp, {_METRICS} FROM mx")
def prospective_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New pairs, as many known ones, and known ones of the same drugs, each against hashed negatives; none below ten new pairs."""
    return _metrics(_prospective_scores(spark, sf_dir))


@query(_PROSPECT + _sql_intervals(True))
def prospective_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap intervals (1000 stratified resamples) of the prospective evaluation."""
    return _rounded(rs.bootstrap(_prospective_scores(spark, sf_dir), ["grp"], ["u", "v"]))


# --- retrieval ---------------------------------------------------------------------------------------------------

_GENES = "dg AS (SELECT DISTINCT CASE WHEN x_type <> 'gene/protein' THEN x_index ELSE y_index END AS d, CASE WHEN x_type <> 'gene/protein' THEN y_index ELSE x_index END AS g FROM e WHERE (x_type IN ('disease', 'drug') AND y_type = 'gene/protein') OR (x_type = 'gene/protein' AND y_type IN ('disease', 'drug'))), pool AS (SELECT idx AS g FROM nt WHERE type = 'gene/protein')"


def _known_genes(e: DataFrame) -> DataFrame:
    """(d, g): genes of diseases and of drugs, whichever way they are stated."""
    forward = F.col("x_type") != "gene/protein"
    both = "(x_type IN ('disease', 'drug') AND y_type = 'gene/protein') OR (x_type = 'gene/protein' AND y_type IN ('disease', 'drug'))"
    return e.filter(both).select(F.when(forward, F.col("x_index")).otherwise(F.col("y_index")).alias("d"), F.when(forward, F.col("y_index")).otherwise(F.col("x_index")).alias("g")).distinct()


_HELD = with_(SQL_E, SQL_UND, SQL_ADJ, SQL_NT, _DEG, _GENES) + f""", ho AS (SELECT d, arg_min(g, ({SQL_HASH("d", "g")}, g)) AS g FROM dg GROUP BY d HAVING count(*) >= 5 ORDER BY {SQL_HASH("d", seed=43)}, d LIMIT 300),
    s AS (SELECT ho.d, y.b AS g, round(sum(CASE WHEN deg.deg > 1 THEN 1.0::DOUBLE / ln(deg.deg) ELSE 0.0::DOUBLE END), 9) AS s FROM ho JOIN adj x ON x.a = ho.d AND x.b <> ho.g JOIN deg ON deg.idx = x.b JOIN adj y ON y.a = x.b JOIN pool ON pool.g = y.b
      WHERE NOT EXISTS (SELECT 1 FROM dg WHERE dg.d = ho.d AND dg.g = y.b AND dg.g <> ho.g) GROUP BY ho.d, y.b),
    sz AS (SELECT ho.d, (SELECT count(*) FROM pool) - (SELECT count(*) FROM dg JOIN pool USING (g) WHERE dg.d = ho.d AND dg.g <> ho.g) AS n FROM ho),
    own AS (SELECT ho.d, ho.g, coalesce(s.s, 0) AS s FROM ho JOIN pool USING (g) LEFT JOIN s ON s.d = ho.d AND s.g = ho.g),
    rk AS (SELECT own.d, own.g, CASE WHEN own.s > 0 THEN (SELECT count(*) FROM s WHERE s.d = own.d AND s.s >= own.s) ELSE n END AS rank FROM own JOIN sz USING (d))"""
_SUMMARY = "count(*)::BIGINT AS n, round(avg((rank <= 10)::INT::DOUBLE), 6) AS hits10, round(avg((rank <= 50)::INT::DOUBLE), 6) AS hits50, round(avg((rank <= 100)::INT::DOUBLE), 6) AS hits100, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank"


def _held_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    _, adj, deg = _graph(spark, sf_dir)
    targets = written(_known_genes(e))
    pool = node_types(e).filter("type = 'gene/protein'").select(F.col("idx").alias("g"))
    return rt.leave_one_out_ranks(rt.held_out_targets(targets), targets, adj, deg, pool)


@query(_HELD + "SELECT d, g, rank::BIGINT AS rank FROM rk")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of a held-out gene of each disease and drug with at least five, among all genes but its others."""
    return _held_ranks(spark, sf_dir)


@query(_HELD + f"SELECT {_SUMMARY} FROM rk")
def neighbourhood_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.rank_summary(_held_ranks(spark, sf_dir))


_RANKBOOT = f""", nr AS (SELECT (rank <= 100)::INT::DOUBLE AS hit, row_number() OVER (ORDER BY d, g) - 1 AS no FROM rk), sn AS (SELECT count(*) AS n, avg(hit) AS hits FROM nr),
    bd AS (SELECT boot, ({SQL_HASH("boot", "draw", "0")}) % n AS no FROM (SELECT boot, n, unnest(range(n)) AS draw FROM sn, range(1000) b(boot))), bh AS (SELECT boot, avg(hit) AS h FROM bd JOIN nr USING (no) GROUP BY boot)
    SELECT n::BIGINT AS n, round(hits, 6) AS hits, CASE WHEN n >= 10 THEN (SELECT round(quantile_cont(h, 0.025), 6) FROM bh) END AS low, CASE WHEN n >= 10 THEN (SELECT round(quantile_cont(h, 0.975), 6) FROM bh) END AS high FROM sn"""


@query(_HELD + _RANKBOOT)
def retrieval_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits at 100 with the interval of 1000 resamples of the ranks."""
    return rs.rank_bootstrap(_held_ranks(spark, sf_dir), [], ["d", "g"])


_TRIPLETS = r"""cg AS (SELECT DISTINCT lower(head_name) AS chem_name, head_id AS chem_id, TRY_CAST(tail_id AS BIGINT) AS gene_id, tail_name AS gene_symbol FROM train_triples WHERE regexp_replace(lower(relation), '[^a-z]', '', 'g') = 'drugprotein' AND head_name IS NOT NULL AND regexp_full_match(tail_id, '[0-9]{1,18}')),
    gd AS (SELECT DISTINCT TRY_CAST(x_id AS BIGINT) AS gene_id, lower(y_name) AS disease_name, y_id AS disease_id FROM kg_df WHERE regexp_replace(lower(relation), '[^a-z]', '', 'g') = 'diseaseprotein' AND x_type = 'gene/protein' AND regexp_full_match(x_id, '[0-9]{1,18}')),
    tr AS (SELECT * FROM cg JOIN gd USING (gene_id)), nd AS (SELECT idx, CASE lower(type) WHEN 'drug' THEN 'drug' WHEN 'disease' THEN 'disease' WHEN 'gene/protein' THEN 'gene' END AS kind, id, name FROM nodes_df WHERE kg = 'alder' AND idx IS NOT NULL AND type IS NOT NULL),
    mm AS (SELECT 'MESH:D' || right(doid, 6) AS mesh, min(doid) AS vd FROM do_diseases GROUP BY 1),
    g1 AS (SELECT TRY_CAST(id AS BIGINT) AS k, max(idx) AS i FROM nd WHERE kind = 'gene' AND regexp_full_match(id, '[0-9]{1,18}') GROUP BY 1), g2 AS (SELECT TRY_CAST(name AS BIGINT) AS k, max(idx) AS i FROM nd WHERE kind = 'gene' AND regexp_full_match(name, '[0-9]{1,18}') GROUP BY 1), g3 AS (SELECT upper(name) AS k, max(idx) AS i FROM nd WHERE kind = 'gene' AND name IS NOT NULL GROUP BY 1),
    d1 AS (SELECT lower(name) AS k, max(idx) AS i FROM nd WHERE kind = 'drug' AND name IS NOT NULL GROUP BY 1), d2 AS (SELECT k, max(idx) AS i FROM (SELECT unnest([name, regexp_replace(name, '^.*?::', '')]) AS k, idx FROM nd WHERE kind = 'drug') WHERE k IS NOT NULL GROUP BY 1),
    s1 AS (SELECT lower(name) AS k, max(idx) AS i FROM nd WHERE kind = 'disease' AND name IS NOT NULL GROUP BY 1), s2 AS (SELECT k, max(idx) AS i FROM (SELECT unnest([regexp_replace(id, '^.*?::', ''), name]) AS k, idx FROM nd WHERE kind = 'disease') WHERE k IS NOT NULL GROUP BY 1),
    rv AS (SELECT DISTINCT coalesce(d1.i, d2.i) AS u, coalesce(g1.i, g2.i, g3.i) AS g, coalesce(s1.i, s2.i) AS v FROM tr LEFT JOIN g1 ON g1.k = gene_id LEFT JOIN g2 ON g2.k = gene_id LEFT JOIN g3 ON g3.k = upper(gene_symbol) LEFT JOIN d1 ON d1.k = lower(chem_name) LEFT JOIN d2 ON d2.k = 'MESH:' || chem_id LEFT JOIN s1 ON s1.k = lower(disease_name) LEFT JOIN mm ON mm.mesh = disease_id LEFT JOIN s2 ON s2.k = mm.vd)"""


def _triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drug - gene - disease triplets from the training triples and the disease genes of the graph, as nodes."""
    rel = lambda c: relation_key(F.col(c))
    digits = lambda c: F.col(c).rlike(r"^\d{1,18}$")
    t = table(spark, sf_dir, "train_triples").filter((rel("relation") == "drugprotein") & F.col("head_name").isNotNull() & digits("tail_id"))
    cg = t.select(F.lower("head_name").alias("chem_name"), F.col("head_id").alias("chem_id"), F.col("tail_id").cast("bigint").alias("gene_id"), F.col("tail_name").alias("gene_symbol")).distinct()
    k = table(spark, sf_dir, "kg_df").filter((rel("relation") == "diseaseprotein") & (F.col("x_type") == "gene/protein") & digits("x_id"))
    gd = k.select(F.col("x_id").cast("bigint").alias("gene_id"), F.lower("y_name").alias("disease_name"), F.col("y_id").alias("disease_id")).distinct()
    low = F.lower("type")
    nodes = table(spark, sf_dir, "nodes_df").filter("kg = 'alder' AND idx IS NOT NULL AND type IS NOT NULL").select("idx", F.when(low == "drug", "drug").when(low == "disease", "disease").when(low == "gene/protein", "gene").alias("kind"), "id", "name")
    mesh = table(spark, sf_dir, "do_diseases").select(F.expr("'MESH:D' || right(doid, 6)").alias("mesh"), "doid")
    return rt.resolve_triplets(cg.join(gd, "gene_id"), nodes, mesh)


@query(with_(_TRIPLETS) + "SELECT u, g, v FROM rv WHERE u IS NOT NULL AND g IS NOT NULL AND v IS NOT NULL")
def resolved_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triplets(spark, sf_dir)


_PATHS = with_(SQL_E, SQL_UND, SQL_ADJ, SQL_NT, _DEG, _TRIPLETS) + f""", tc AS (SELECT u, g, v, {SQL_HASH("u", "g", "v")} AS h FROM rv WHERE u IS NOT NULL AND g IS NOT NULL AND v IS NOT NULL),
    ts AS (SELECT u, g, v FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY h, u, g, v) AS r FROM tc) WHERE r <= 5 ORDER BY h, u, g, v LIMIT 500),
    pool AS (SELECT idx AS g FROM nt WHERE type = 'gene/protein'), en AS (SELECT DISTINCT u, v FROM ts),
    f1 AS (SELECT en.u, en.v, y.b AS g, sum(1.0::DOUBLE / ln(deg)) AS s FROM en JOIN adj x ON x.a = en.u AND x.b <> en.v JOIN deg ON deg.idx = x.b AND deg > 1 JOIN adj y ON y.a = x.b JOIN pool ON pool.g = y.b GROUP BY ALL),
    f2 AS (SELECT en.u, en.v, y.b AS g, sum(1.0::DOUBLE / ln(deg)) AS s FROM en JOIN adj x ON x.a = en.v AND x.b <> en.u JOIN deg ON deg.idx = x.b AND deg > 1 JOIN adj y ON y.a = x.b JOIN pool ON pool.g = y.b GROUP BY ALL),
    ps AS (SELECT u, v, g, round(f1.s * f2.s, 9) AS s FROM f1 JOIN f2 USING (u, v, g)),
    rk AS (SELECT ts.u, ts.g, ts.v, coalesce((SELECT count(*) FROM ps q WHERE q.u = ts.u AND q.v = ts.v AND q.s >= ps.s AND ps.s > 0), 0) AS r0, ps.s FROM ts JOIN pool USING (g) LEFT JOIN ps ON ps.u = ts.u AND ps.v = ts.v AND ps.g = ts.g),
    rf AS (SELECT u, g, v, CASE WHEN s > 0 THEN r0 ELSE (SELECT count(*) FROM pool) END AS rank FROM rk)"""


def _path_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    _, adj, deg = _graph(spark, sf_dir)
    t = _triplets(spark, sf_dir).withColumn("h", sc.hashed(F.col("u"), F.col("g"), F.col("v")))
    sample = written(rt.capped_per_group(t, "u", ["h", "u", "g", "v"]).select("u", "g", "v"))
    return rt.path_ranks(sample, adj, deg, node_types(e).filter("type = 'gene/protein'").select(F.col("idx").alias("g")))


@query(_PATHS + "SELECT u, g, v, rank::BIGINT AS rank FROM rf")
def gene_path_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the gene of each sampled triplet by the product of its scores with the drug and with the disease."""
    return _path_ranks(spark, sf_dir)


@query(_PATHS.replace("rf AS (SELECT u, g, v, CASE", "rf AS (SELECT CASE") + f"SELECT {_SUMMARY} FROM rf")
def multi_hop_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.rank_summary(_path_ranks(spark, sf_dir))


# --- stability ---------------------------------------------------------------------------------------------------

_PERTURBED = with_(SQL_E, SQL_UND, _DEG, SQL_GOLD, "prs AS (SELECT DISTINCT u, v FROM gold)", "m AS (SELECT floor(0.1::DOUBLE * count(*)) AS k FROM und)") + f"""
    , ur AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY {SQL_HASH("u", "v", "0")}, u, v) AS r FROM und) WHERE r > (SELECT k FROM m)),
    up AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (ORDER BY least(x.deg, y.deg), u, v) AS r FROM und JOIN deg x ON x.idx = u JOIN deg y ON y.idx = v) WHERE r > (SELECT k FROM m)),
    """ + sql_scored("prs") + ", " + sql_scored("prs", "ur", "r") + ", " + sql_scored("prs", "up", "p") + """,
    ch AS (SELECT 'random' AS kind, u, v, sc.aa AS a, scr.aa AS b FROM sc JOIN scr USING (u, v) UNION ALL SELECT 'periphery', u, v, sc.aa, scp.aa FROM sc JOIN scp USING (u, v)),
    ne AS (SELECT * FROM ch WHERE a > 0 OR b > 0), ra AS (SELECT kind, rank() OVER (PARTITION BY kind ORDER BY a) + (count(*) OVER (PARTITION BY kind, a) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY kind ORDER BY b) + (count(*) OVER (PARTITION BY kind, b) - 1) / 2.0::DOUBLE AS y FROM ne),
    rh AS (SELECT kind, count(*) AS n, CASE WHEN count(*) > 10 THEN round(corr(x, y), 6) END AS rho FROM ra GROUP BY kind),
    tp AS (SELECT kind, count(*) / 100.0::DOUBLE AS top FROM (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY a DESC, u, v) AS i, row_number() OVER (PARTITION BY kind ORDER BY b DESC, u, v) AS j FROM ch) WHERE i <= 100 AND j <= 100 GROUP BY kind)"""


@query(_PERTURBED + " SELECT kind, n::BIGINT AS n, rho, round(top, 6) AS top_overlap, round(coalesce((rho + 1) / 2, 0), 6) AS effect FROM rh JOIN tp USING (kind)")
def rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adamic-Adar of the gold pairs before and after a tenth of the links is dropped, at random or at the periphery:
    rank correlation over pairs that score at all (more than ten), overlap of the first 100, effect size."""
    und, adj, deg = _graph(spark, sf_dir)
    drop, pairs = int(0.1 * und.count()), gold_pairs(spark, sf_dir).select("u", "v").distinct()
    end = lambda c: deg.select(F.col("idx").alias(c), F.col("deg").alias(f"d_{c}"))
    order = {"random": und.withColumn("o", sc.hashed(F.col("u"), F.col("v"), F.lit(0))), "periphery": und.join(end("u"), "u").join(end("v"), "v").select("u", "v", F.least("d_u", "d_v").alias("o"))}
    score = lambda links: lp.score_pairs("adamic_adar", pairs, adjacency(links), g.degrees(links)).select("u", "v", F.round("score", 9).alias("s"))
    base = written(score(und).withColumnRenamed("s", "a"))
    out = None
    for kind, ordered in order.items():
        kept = written(rs.numbered_within(ordered, [], ["o", "u", "v"]).filter(F.col("no") >= drop).select("u", "v"))
        both = written(base.join(score(kept).withColumnRenamed("s", "b"), ["u", "v"]))
        rho = rk.spearman(both.filter("a > 0 OR b > 0"), "a", "b")
        first = lambda c: both.orderBy(F.desc(c), "u", "v").limit(100).select("u", "v")  # noqa: B023, E731
        top = first("a").join(first("b"), ["u", "v"]).agg((F.count(F.lit(1)) / 100.0).alias("top"))
        one = rho.join(F.broadcast(top)).select(F.lit(kind).alias("kind"), "n", F.when(F.col("n") > 10, F.col("rho")).alias("rho"), F.round("top", 6).alias("top_overlap"))  # single rows
        out = one if out is None else out.unionByName(one)
    return out.withColumn("effect", F.round(sc.effect_size(F.col("rho")), 6))
