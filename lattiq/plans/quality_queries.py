"""Coverage, annotation, provenance and reshaping queries over the graph view, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.functions import ids
from lattiq.operators import quality as q
from lattiq.sources.kg_view import SQL_E, SQL_GOLD, SQL_NT, SQL_T, SQL_UND, edges, gold_pairs, node_types, triples, undirected, with_
from lattiq.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- identifiers -------------------------------------------------------------------------------------------------


@query(r"""
    SELECT node_key, nullif(trim(id), '') AS known, list_extract(string_split(id, '::'), -1) AS last_segment,
      regexp_replace(id, '^.*?::', '') AS after_first,
      CASE WHEN contains(id, '::') THEN split_part(id, '::', 1) WHEN id IS NOT NULL THEN 'unknown' END AS type_prefix,
      nullif(regexp_extract(id, '\b(DB\d{5,})\b', 1), '') AS drugbank, nullif(regexp_extract(id, '(R-HSA-\d+)', 1), '') AS reactome, nullif(regexp_extract(id, '(R-[A-Z]{3}-\d+)', 1), '') AS reactome_any,
      coalesce(regexp_full_match(name, '[A-Z0-9:_.\-]*'), true) AS opaque,
      coalesce(nullif(ltrim(regexp_replace(id, '^HP:?', ''), '0'), ''), CASE WHEN id IS NOT NULL THEN '0' END) AS bare
    FROM nodes_df""")
def id_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return table(spark, sf_dir, "nodes_df").select(
        "node_key", ids.known(i).alias("known"), ids.last_segment(i).alias("last_segment"), ids.after_first_segment(i).alias("after_first"), ids.type_prefix(i).alias("type_prefix"),
        ids.extract(i, "drugbank").alias("drugbank"), ids.extract(i, "reactome").alias("reactome"), F.nullif(F.regexp_extract(i, ids.REACTOME_ANY, 1), F.lit("")).alias("reactome_any"), ids.looks_opaque(F.col("name")).alias("opaque"), ids.bare_number(i, "HP").alias("bare"))


@query(r"""
    SELECT row_id, len(regexp_extract_all(equivalent_identifiers, '([A-Za-z][\w.]*:[\w.\-]+)', 1))::BIGINT AS n_curies,
      list_extract(regexp_extract_all(equivalent_identifiers, '([A-Za-z][\w.]*:[\w.\-]+)', 1), 1) AS first_curie,
      array_to_string(regexp_extract_all(upstream_data_source, '([a-zA-Z][\w-]*)', 1), '|') AS sources
    FROM biolink_nodes WHERE equivalent_identifiers IS NOT NULL AND upstream_data_source IS NOT NULL""")
def curie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "biolink_nodes").filter("equivalent_identifiers IS NOT NULL AND upstream_data_source IS NOT NULL")
    c = ids.curies(F.col("equivalent_identifiers"))
    return b.select("row_id", F.size(c).cast("bigint").alias("n_curies"), F.try_element_at(c, F.lit(1)).alias("first_curie"), ids.source_tokens(F.col("upstream_data_source")).alias("sources"))


@query(r"""
    WITH s AS (SELECT rep_id, CASE rep_id % 3 WHEN 0 THEN disease_mondo_id WHEN 1 THEN regexp_replace(disease_mondo_id, '^MONDO:', '') ELSE regexp_replace(disease_mondo_id, '^MONDO:', '') || '.0' END AS v FROM table5_replication)
    SELECT rep_id, CAST(CAST(TRY_CAST(regexp_replace(v, '^MONDO:', '') AS DOUBLE) AS BIGINT) AS VARCHAR) AS mondo, d.doid
    FROM s LEFT JOIN do_diseases d ON CAST(CAST(TRY_CAST(regexp_replace(v, '^MONDO:', '') AS DOUBLE) AS BIGINT) AS VARCHAR) = CAST(CAST(regexp_replace(d.mondo_id, '^MONDO:', '') AS BIGINT) AS VARCHAR)""")
def disease_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written in three ways, normalised to a number and bridged to the ontology."""
    r = table(spark, sf_dir, "table5_replication")
    bare = F.regexp_replace("disease_mondo_id", "^MONDO:", "")
    v = r.select("rep_id", F.when(F.col("rep_id") % 3 == 0, F.col("disease_mondo_id")).when(F.col("rep_id") % 3 == 1, bare).otherwise(F.concat(bare, F.lit(".0"))).alias("v"))
    d = table(spark, sf_dir, "do_diseases").select(ids.mixed_number(F.col("mondo_id")).alias("mondo"), "doid")
    return v.select("rep_id", ids.mixed_number(F.col("v")).alias("mondo")).join(d, "mondo", "left").select("rep_id", "mondo", "doid")


@query("""
    SELECT kg, lower(trim(name)) AS key, min(node_key) AS first_key, max(node_key) AS last_key, count(*)::BIGINT AS n
    FROM nodes_df WHERE name IS NOT NULL AND trim(name) <> '' GROUP BY kg, lower(trim(name))""")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive name lookup, first and last row."""
    n = table(spark, sf_dir, "nodes_df").filter("name IS NOT NULL AND trim(name) <> ''")
    return n.groupBy("kg", F.lower(F.trim("name")).alias("key")).agg(F.min("node_key").alias("first_key"), F.max("node_key").alias("last_key"), F.count(F.lit(1)).alias("n"))


@query(with_(SQL_E) + """
    SELECT idx, arg_min(type, (side, row_id)) AS type, arg_min(type, (side, row_id)) || '/' || arg_min(id, (side, row_id)) AS uid FROM (
      SELECT x_index AS idx, x_type AS type, x_id AS id, 0 AS side, row_id FROM e UNION ALL SELECT y_index, y_type, y_id, 1, row_id FROM e) GROUP BY idx""")
def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from edge ends, the first row of each index wins, with uid = type/id."""
    e = edges(spark, sf_dir)
    ends = e.select("row_id", F.explode(F.array(*[F.struct(F.col(f"{s}_index").alias("idx"), F.col(f"{s}_type").alias("type"), F.col(f"{s}_id").alias("id"), F.lit(k).alias("side")) for k, s in enumerate("xy")])).alias("n")).select("n.*", "row_id")
    first = F.struct("side", "row_id")
    return ends.groupBy("idx").agg(F.min_by("type", first).alias("type"), F.concat(F.min_by("type", first), F.lit("/"), F.min_by("id", first)).alias("uid"))


# --- coverage ----------------------------------------------------------------------------------------------------


@query(with_(SQL_T) + """
    , g AS (SELECT DISTINCT drug_id AS k FROM test_pos), f AS (SELECT DISTINCT kg, head_id AS k FROM t WHERE head_id IS NOT NULL),
    kgs AS (SELECT DISTINCT kg FROM t), gk AS (SELECT kg, k FROM g, kgs)
    SELECT kg, count(gk.k)::BIGINT AS n_gold, count(f.k)::BIGINT AS n_found, count(CASE WHEN gk.k IS NOT NULL AND f.k IS NOT NULL THEN 1 END)::BIGINT AS n_overlap,
      CASE WHEN count(gk.k) > 0 THEN round(count(CASE WHEN gk.k IS NOT NULL AND f.k IS NOT NULL THEN 1 END) * 100.0::DOUBLE / count(gk.k), 2) END AS pct
    FROM gk FULL JOIN f USING (kg, k) GROUP BY kg""")
def coverage_by_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triples(spark, sf_dir)
    graphs = t.select("kg").distinct().agg(F.collect_set("kg").alias("kgs"))  # one row
    gold = table(spark, sf_dir, "test_pos").select(F.col("drug_id").alias("k")).distinct().join(F.broadcast(graphs)).select(F.explode("kgs").alias("kg"), "k")
    return q.coverage(gold, t.filter("head_id IS NOT NULL").select("kg", F.col("head_id").alias("k")), ["k"], ["kg"])


@query(with_(SQL_E) + """
    , f AS (SELECT DISTINCT y_type AS type, y_name AS k FROM e WHERE y_name IS NOT NULL), g AS (SELECT 'disease' AS type, mondo_name AS k FROM do_diseases)
    SELECT type, count(g.k)::BIGINT AS n_gold, count(f.k)::BIGINT AS n_found, count(CASE WHEN g.k IS NOT NULL AND f.k IS NOT NULL THEN 1 END)::BIGINT AS n_overlap,
      CASE WHEN count(g.k) > 0 THEN round(count(CASE WHEN g.k IS NOT NULL AND f.k IS NOT NULL THEN 1 END) * 100.0::DOUBLE / count(g.k), 2) END AS pct
    FROM g FULL JOIN f USING (type, k) GROUP BY type""")
def coverage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edges(spark, sf_dir).filter("y_name IS NOT NULL").select(F.col("y_type").alias("type"), F.col("y_name").alias("k"))
    gold = table(spark, sf_dir, "do_diseases").select(F.lit("disease").alias("type"), F.col("mondo_name").alias("k"))
    return q.coverage(gold, found, ["k"], ["type"])


@query("""
    WITH r AS (SELECT y_type AS type, y_name AS raw, lower(trim(regexp_replace(y_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS norm FROM kg_df WHERE y_name IS NOT NULL),
    g AS (SELECT DISTINCT lower(trim(regexp_replace(mondo_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS norm FROM do_diseases)
    SELECT type, count(DISTINCT raw)::BIGINT AS n_raw, count(DISTINCT r.norm)::BIGINT AS n_normalised, count(DISTINCT g.norm)::BIGINT AS n_matched
    FROM r LEFT JOIN g ON r.norm = g.norm GROUP BY type""")
def coverage_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))
    r = table(spark, sf_dir, "kg_df").filter("y_name IS NOT NULL").select(F.col("y_type").alias("type"), F.col("y_name").alias("raw"), norm("y_name").alias("norm")).distinct()
    g = table(spark, sf_dir, "do_diseases").select(norm("mondo_name").alias("norm")).distinct().withColumn("matched", F.col("norm"))
    return r.join(g, "norm", "left").groupBy("type").agg(F.count_distinct("raw").alias("n_raw"), F.count_distinct("norm").alias("n_normalised"), F.count_distinct("matched").alias("n_matched"))


@query(with_(SQL_T) + """
    , g AS (SELECT DISTINCT drug_id AS k FROM test_pos), p AS (SELECT g.k, count(DISTINCT t.kg) AS n FROM g LEFT JOIN t ON t.head_id = g.k GROUP BY g.k)
    SELECT b.n_sources::BIGINT AS n_sources, count(p.k)::BIGINT AS n_keys FROM range(5) b(n_sources) LEFT JOIN p ON p.n = b.n_sources GROUP BY b.n_sources""")
def coverage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "test_pos").select(F.col("drug_id").alias("k"))
    return q.overlap_histogram(gold, triples(spark, sf_dir).select(F.col("head_id").alias("k"), "kg"), "k", "kg", 4)


@query(with_(SQL_E, SQL_GOLD) + """
    , f AS (SELECT DISTINCT rel, least(x_index, y_index) AS a, greatest(x_index, y_index) AS b FROM e),
    g AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM gold)
    SELECT rel, count(*)::BIGINT AS n_pairs, count(g.a)::BIGINT AS n_gold FROM f LEFT JOIN g USING (a, b) GROUP BY rel""")
def relation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda df, x, y, *c: df.select(*c, F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    g = pair(gold_pairs(spark, sf_dir), "u", "v").withColumn("g", F.lit(1))
    return pair(edges(spark, sf_dir), "x_index", "y_index", "rel").join(g, ["a", "b"], "left").groupBy("rel").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("g").alias("n_gold"))


@query(with_(SQL_E, SQL_UND, SQL_GOLD, SQL_NT) + """
    SELECT CASE WHEN l.u IS NOT NULL THEN 'linked' WHEN a.idx IS NULL AND b.idx IS NULL THEN 'both_absent' WHEN a.idx IS NULL OR b.idx IS NULL THEN 'one_absent' ELSE 'not_curated' END AS reason, count(*)::BIGINT AS n
    FROM (SELECT DISTINCT u, v FROM gold) g LEFT JOIN und l ON l.u = least(g.u, g.v) AND l.v = greatest(g.u, g.v) LEFT JOIN nt a ON a.idx = g.u LEFT JOIN nt b ON b.idx = g.v GROUP BY 1""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return q.pair_gaps(gold_pairs(spark, sf_dir), undirected(e), node_types(e))


@query("""
    WITH s AS (SELECT kg, lower(type) AS type, avg(CASE WHEN synonym IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM nodes_df WHERE type IS NOT NULL GROUP BY kg, lower(type)),
    sh AS (SELECT type FROM s GROUP BY type HAVING count(DISTINCT kg) = 2)
    SELECT kg, round(avg(score), 6) AS score FROM s JOIN sh USING (type) GROUP BY kg""")
def shared_type_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "nodes_df").filter("type IS NOT NULL").groupBy("kg", F.lower("type").alias("type")).agg(F.avg(F.col("synonym").isNotNull().cast("double")).alias("score"))
    return q.shared_type_mean(s, 2)


@query(with_(SQL_E) + """
    SELECT rel, count(*)::BIGINT AS n_edges, count(DISTINCT x_index)::BIGINT AS n_heads, count(DISTINCT y_index)::BIGINT AS n_tails FROM e GROUP BY rel ORDER BY n_edges DESC, rel LIMIT 30""")
def predicate_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most frequent predicates (a report)."""
    return edges(spark, sf_dir).groupBy("rel").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("x_index").alias("n_heads"), F.count_distinct("y_index").alias("n_tails")).orderBy(F.desc("n_edges"), "rel").limit(30)


@query(with_(SQL_E, SQL_GOLD) + """
    , g AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM gold), f AS (SELECT rel, least(x_index, y_index) AS a, greatest(x_index, y_index) AS b FROM e),
    k AS (SELECT 'gold_pairs' AS key, count(*) AS v FROM g UNION ALL SELECT 'graph_pairs', count(*) FROM (SELECT DISTINCT a, b FROM f)
      UNION ALL SELECT 'overlap_any', count(*) FROM (SELECT DISTINCT a, b FROM f) JOIN g USING (a, b)
      UNION ALL SELECT 'overlap_indication', count(*) FROM (SELECT DISTINCT a, b FROM f WHERE rel = 'indication') JOIN g USING (a, b)
      UNION ALL SELECT 'edges', count(*) FROM f UNION ALL SELECT 'predicates', count(DISTINCT rel) FROM f)
    SELECT key, v::BIGINT AS value FROM k""")
def gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of the pair audit, in one pass over the pairs."""
    f = edges(spark, sf_dir).groupBy(F.least("x_index", "y_index").alias("a"), F.greatest("x_index", "y_index").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("rel") == "indication").cast("int")).alias("ind"), F.collect_set("rel").alias("rels"))
    g = gold_pairs(spark, sf_dir).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct().withColumn("g", F.lit(1))
    j = f.join(g, ["a", "b"], "full")
    c = lambda x: F.count(F.when(x, 1))
    one = j.agg(c(F.col("g") == 1).alias("gold_pairs"), c(F.col("n").isNotNull()).alias("graph_pairs"), c((F.col("g") == 1) & F.col("n").isNotNull()).alias("overlap_any"), c((F.col("g") == 1) & (F.col("ind") == 1)).alias("overlap_indication"), F.sum("n").alias("edges"), F.size(F.array_distinct(F.flatten(F.collect_set("rels")))).cast("bigint").alias("predicates"))
    return one.unpivot([], one.columns, "key", "value")


# --- annotation accuracy -----------------------------------------------------------------------------------------

_PATTERNS = {"gene/protein": [r"^\d{8}$"], "drug": ["DB"], "disease": [r"^\d{7}(_\d{7})*$"], "effect/phenotype": ["HP:"], "pathway": ["R-"], "Gene": ["Gene::"], "Compound": ["Compound::"], "Disease": ["Disease::"], "biolink:Gene": ["GN:"], "biolink:Disease": [r"^DIS:\d+$"]}


@query(r"""
    WITH f AS (SELECT kg, type, coalesce(CASE type WHEN 'gene/protein' THEN regexp_matches(id, '^[0-9]{8}$') WHEN 'drug' THEN starts_with(id, 'DB') WHEN 'disease' THEN regexp_matches(id, '^[0-9]{7}(_[0-9]{7})*$')
        WHEN 'effect/phenotype' THEN starts_with(id, 'HP:') WHEN 'pathway' THEN starts_with(id, 'R-') WHEN 'Gene' THEN starts_with(id, 'Gene::') WHEN 'Compound' THEN starts_with(id, 'Compound::') WHEN 'Disease' THEN starts_with(id, 'Disease::')
        WHEN 'biolink:Gene' THEN starts_with(id, 'GN:') WHEN 'biolink:Disease' THEN regexp_matches(id, '^DIS:[0-9]+$') END, false)::INT AS ok FROM nodes_df
      WHERE type IN ('gene/protein', 'drug', 'disease', 'effect/phenotype', 'pathway', 'Gene', 'Compound', 'Disease', 'biolink:Gene', 'biolink:Disease'))
    SELECT kg, type, count(*)::BIGINT AS n, sum(ok)::BIGINT AS n_valid, round(sum(ok) * 100.0::DOUBLE / count(*), 1) AS pct FROM f GROUP BY ROLLUP (kg, type)""")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.validity(table(spark, sf_dir, "nodes_df"), _PATTERNS)


@query("""
    WITH m AS (SELECT CASE type WHEN 'gene/protein' THEN 'gene' WHEN 'Gene' THEN 'gene' WHEN 'biolink:Gene' THEN 'gene' WHEN 'disease' THEN 'disease' WHEN 'Disease' THEN 'disease' WHEN 'biolink:Disease' THEN 'disease' END AS c, kg, regexp_matches(id, '[0-9]')::INT AS ok FROM nodes_df),
    r AS (SELECT kg, c, sum(ok) * 1.0::DOUBLE / count(*) AS rate FROM m WHERE c IS NOT NULL GROUP BY kg, c)
    SELECT kg, round(avg(rate), 6) AS macro FROM r GROUP BY kg""")
def macro_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"gene/protein": "gene", "Gene": "gene", "biolink:Gene": "gene", "disease": "disease", "Disease": "disease", "biolink:Disease": "disease"}
    m = table(spark, sf_dir, "nodes_df").withColumn("c", F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("type")]).filter("c IS NOT NULL")
    rates = m.groupBy("kg", "c").agg((F.sum(F.col("id").rlike("[0-9]").cast("int")) * 1.0 / F.count(F.lit(1))).cast("double").alias("rate"))
    return rates.groupBy("kg").agg(F.round(F.avg("rate"), 6).alias("macro"))


@query(r"""
    WITH c AS (SELECT kg, coalesce(nullif(regexp_extract(id, '^([A-Za-z]+)', 1), ''), 'number') AS prefix, count(*) AS n, list_slice(list_sort(list(DISTINCT id)), 1, 3) AS ex FROM nodes_df WHERE id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY kg ORDER BY n DESC, prefix) AS rank FROM c)
    SELECT kg, rank::INT AS rank, prefix, n::BIGINT AS n, array_to_string(ex, ' ') AS examples FROM r WHERE rank <= 5""")
def top_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent id prefixes of each graph (a report)."""
    n = table(spark, sf_dir, "nodes_df").filter("id IS NOT NULL")
    return q.top_prefixes(n, ["kg"], F.coalesce(F.nullif(F.regexp_extract("id", "^([A-Za-z]+)", 1), F.lit("")), F.lit("number")), "id")


@query("""SELECT kg, count(*)::BIGINT AS n, count(DISTINCT idx)::BIGINT AS n_distinct, round(count(DISTINCT idx) * 1.0::DOUBLE / count(*), 6) AS uniqueness FROM nodes_df GROUP BY kg""")
def index_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nodes_df").groupBy("kg").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("n_distinct")).withColumn("uniqueness", F.round(F.col("n_distinct") / F.col("n"), 6))


# The end types that the relations allow.
_ALLOWED = [("drugprotein", "drug", "gene/protein"), ("diseaseprotein", "gene/protein", "disease"), ("proteinprotein", "gene/protein", "gene/protein"), ("indication", "drug", "disease"), ("contraindication", "drug", "disease"), ("drugdrug", "drug", "drug"), ("pathwayprotein", "gene/protein", "pathway")]


@query(with_(SQL_E, """allowed(rel, x_type, y_type) AS (VALUES ('drugprotein', 'drug', 'gene/protein'), ('diseaseprotein', 'gene/protein', 'disease'), ('proteinprotein', 'gene/protein', 'gene/protein'),
    ('indication', 'drug', 'disease'), ('contraindication', 'drug', 'disease'), ('drugdrug', 'drug', 'drug'), ('pathwayprotein', 'gene/protein', 'pathway'))""") + """
    SELECT e.rel, count(*)::BIGINT AS n, count(CASE WHEN a.rel IS NOT NULL OR l.rel IS NULL THEN 1 END)::BIGINT AS n_ok,
      round(count(CASE WHEN a.rel IS NOT NULL OR l.rel IS NULL THEN 1 END) * 100.0::DOUBLE / count(*), 3) AS pct, round(count(a.rel) * 100.0::DOUBLE / count(*), 3) AS strict_pct
    FROM e LEFT JOIN allowed a ON e.rel = a.rel AND e.x_type = a.x_type AND e.y_type = a.y_type LEFT JOIN (SELECT DISTINCT rel FROM allowed) l ON e.rel = l.rel GROUP BY e.rel""")
def schema_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.conformance(edges(spark, sf_dir), spark.createDataFrame(_ALLOWED, "rel string, x_type string, y_type string"))


@query(with_(SQL_E) + """
    SELECT rel, x_type, y_type, count(*)::BIGINT AS n, (split_part(lower(display_relation), ' ', 1) = split_part(lower(x_type), '/', 1)) AS named_after_head
    FROM e WHERE display_relation IS NOT NULL GROUP BY ALL""")
def derived_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End types by relation, and whether the display name begins with the head's type."""
    e = edges(spark, sf_dir).filter("display_relation IS NOT NULL")
    named = F.substring_index(F.lower("display_relation"), " ", 1) == F.substring_index(F.lower("x_type"), "/", 1)
    return e.groupBy("rel", "x_type", "y_type", named.alias("named_after_head")).agg(F.count(F.lit(1)).alias("n"))


_EXCLUSIVE = [("indication", "contraindication"), ("indication", "offlabeluse"), ("contraindication", "offlabeluse"), ("proteinprotein", "coexpression")]
_CONFLICTS = with_(SQL_E, SQL_NT, "x(p, q) AS (VALUES ('indication', 'contraindication'), ('indication', 'offlabeluse'), ('contraindication', 'offlabeluse'), ('proteinprotein', 'coexpression'))", "pr AS (SELECT DISTINCT rel, least(x_index, y_index) AS a, greatest(x_index, y_index) AS b FROM e)", "l AS (SELECT p || '/' || q AS conflict, a, b, count(DISTINCT rel) = 2 AS is_both FROM x JOIN pr ON rel IN (p, q) GROUP BY ALL)")


@query(_CONFLICTS + """SELECT conflict, count(CASE WHEN is_both THEN 1 END)::BIGINT AS n_both, count(*)::BIGINT AS n_any, round(count(CASE WHEN is_both THEN 1 END) * 100.0::DOUBLE / count(*), 3) AS pct FROM l GROUP BY conflict""")
def exclusive_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.conflict_rates(q.conflicts(edges(spark, sf_dir), _EXCLUSIVE))


@query(_CONFLICTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY conflict ORDER BY a, b) AS rank FROM l WHERE is_both)
    SELECT conflict, rank::INT AS rank, r.a, r.b, m.name AS name_a, n.name AS name_b FROM r LEFT JOIN nt m ON m.idx = r.a LEFT JOIN nt n ON n.idx = r.b WHERE rank <= 20""")
def conflict_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 conflicts of each kind (a report)."""
    e = edges(spark, sf_dir)
    return q.conflict_details(q.conflicts(e, _EXCLUSIVE), node_types(e))


# --- provenance --------------------------------------------------------------------------------------------------


@query(with_(SQL_E) + """SELECT source, (count(*) // 2)::BIGINT AS n FROM (SELECT coalesce(x_source, 'none') AS source FROM e UNION ALL SELECT coalesce(y_source, 'none') FROM e) GROUP BY source""")
def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.source_counts(edges(spark, sf_dir), ["x_source", "y_source"])


@query(with_(SQL_E) + """
    SELECT count(*)::BIGINT AS n, round(count(CASE WHEN x_source IS NOT NULL OR y_source IS NOT NULL THEN 1 END) * 100.0::DOUBLE / count(*), 4) AS pct_attributed,
      round(count(CASE WHEN x_source <> y_source THEN 1 END) * 100.0::DOUBLE / count(CASE WHEN x_source IS NOT NULL OR y_source IS NOT NULL THEN 1 END), 4) AS pct_cross FROM e""")
def provenance_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.granularity(edges(spark, sf_dir))


@query(with_(SQL_E) + """
    , c AS (SELECT rel AS kg, count(DISTINCT x_source)::BIGINT AS n_sources FROM e GROUP BY rel HAVING count(DISTINCT x_source) > 0)
    SELECT kg, n_sources, round(ln(n_sources) / ln(max(n_sources) OVER ()), 4) AS diversity FROM c""")
def source_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.diversity(edges(spark, sf_dir).groupBy(F.col("rel").alias("kg")).agg(F.count_distinct("x_source").alias("n_sources")).filter("n_sources > 0"))


@query("""SELECT count(*)::BIGINT AS n, 3::BIGINT AS n_columns, round(avg(CASE WHEN p_raw IS NOT NULL OR p_bonferroni IS NOT NULL OR n_permutations IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM table5_replication""")
def uncertainty_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.uncertainty(table(spark, sf_dir, "table5_replication"), ("p_raw", "bonferroni", "permutations"))


_LEVELS = ["knowledge_assertion", "logical_entailment", "statistical_association", "observation", "prediction", "not_provided"]


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the edges, as far as the tables tell: loaded soon after it was stated an edge is asserted, later predicted, else not told."""
    k = table(spark, sf_dir, "kg_df")
    late = F.datediff("loaded_at", "asserted_at")
    return k.select(F.when(late.isNull(), "unstated").when(late <= 5, "knowledge_assertion").when(late <= 60, "observation").when(F.col("x_source") == F.col("y_source"), "logical_entailment").when(F.col("x_source").isNotNull(), "prediction").otherwise("not_provided").alias("level"))


_SQL_LEVELS = """r AS (SELECT CASE WHEN d IS NULL THEN 'unstated' WHEN d <= 5 THEN 'knowledge_assertion' WHEN d <= 60 THEN 'observation' WHEN x_source = y_source THEN 'logical_entailment' WHEN x_source IS NOT NULL THEN 'prediction' ELSE 'not_provided' END AS level
    FROM (SELECT *, date_diff('day', asserted_at::DATE, loaded_at::DATE) AS d FROM kg_df))"""


@query(with_(_SQL_LEVELS, "l(level) AS (VALUES ('knowledge_assertion'), ('logical_entailment'), ('statistical_association'), ('observation'), ('prediction'), ('not_provided'))") + """
    , c AS (SELECT l.level, count(r.level) AS n FROM l LEFT JOIN r ON l.level = r.level GROUP BY l.level)
    SELECT level, n::BIGINT AS n, round(sum(CASE WHEN level IN ('knowledge_assertion', 'logical_entailment') THEN n ELSE 0 END) OVER () * 1.0::DOUBLE / sum(n) OVER (), 6) AS trusted_share FROM c""")
def level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.level_distribution(_levels(spark, sf_dir), _LEVELS, ["knowledge_assertion", "logical_entailment"])


@query(with_(_SQL_LEVELS) + """
    SELECT level, CASE level WHEN 'knowledge_assertion' THEN 1.0 WHEN 'logical_entailment' THEN 0.9 WHEN 'statistical_association' THEN 0.6 WHEN 'observation' THEN 0.5 WHEN 'prediction' THEN 0.3 END::DOUBLE AS confidence, count(*)::BIGINT AS n FROM r GROUP BY level""")
def level_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", ids.level_confidence(F.col("level")).alias("confidence"), "n")


@query("""
    SELECT drug_id, lower(trim(disease_name)) AS disease, min(fda_date) AS first_date, coalesce(array_to_string(list_sort(list(DISTINCT methodology) FILTER (methodology IS NOT NULL)), ';'), '') AS agencies, count(DISTINCT methodology)::BIGINT AS n_agencies
    FROM table5_replication WHERE drug_id IS NOT NULL AND disease_name IS NOT NULL GROUP BY 1, 2""")
def merged_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "table5_replication").withColumn("disease", F.lower(F.trim("disease_name")))
    return q.merge_approvals(r, "drug_id", "disease", "fda_date", "methodology")


@query("""
    SELECT methodology, count(*)::BIGINT AS n, round(avg(random_mean), 6) AS mean, round(stddev_samp(random_mean), 6) AS sd, min(random_mean) AS least, max(random_mean) AS most, round(quantile_cont(random_mean, 0.9), 6) AS p90, round(median(distance), 6) AS median_distance
    FROM table5_replication GROUP BY methodology""")
def grouped_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "table5_replication")
    return r.groupBy("methodology").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("random_mean"), 6).alias("mean"), F.round(F.stddev_samp("random_mean"), 6).alias("sd"), F.min("random_mean").alias("least"), F.max("random_mean").alias("most"), F.round(F.percentile("random_mean", 0.9), 6).alias("p90"), F.round(F.median("distance"), 6).alias("median_distance"))


_SCORES = """s AS (SELECT kg, 'coverage' AS dimension, 'synonym' AS metric, avg(CASE WHEN synonym IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM nodes_df GROUP BY kg
    UNION ALL SELECT kg, 'coverage', 'name', avg(CASE WHEN name IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM nodes_df GROUP BY kg
    UNION ALL SELECT kg, 'trust', 'pipeline', avg(CASE WHEN upstream_pipeline IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM nodes_df GROUP BY kg)"""


def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes_df")
    wide = n.groupBy("kg").agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in ("synonym", "name", "upstream_pipeline")])
    long = wide.unpivot("kg", ["synonym", "name", "upstream_pipeline"], "metric", "score")
    return long.select("kg", F.when(F.col("metric") == "upstream_pipeline", "trust").otherwise("coverage").alias("dimension"), "metric", "score")


@query(with_(_SCORES, "d AS (SELECT kg, dimension, avg(score) AS score FROM s GROUP BY kg, dimension)") + """
    SELECT kg, dimension, round(score, 6) AS score FROM d UNION ALL SELECT kg, 'overall', round(avg(score), 6) FROM d GROUP BY kg""")
def score_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.roll_up(_metric_rows(spark, sf_dir))


@query(with_(_SCORES, "d AS (SELECT kg, dimension, round(avg(score), 6) AS score FROM s GROUP BY kg, dimension)") + """
    SELECT kg, max(CASE WHEN dimension = 'coverage' THEN score END) AS coverage, max(CASE WHEN dimension = 'trust' THEN score END) AS trust FROM d GROUP BY kg""")
def score_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.roll_up(_metric_rows(spark, sf_dir)).groupBy("kg").pivot("dimension", ["coverage", "trust"]).agg(F.max("score"))


# --- reshaping, sets, windows ------------------------------------------------------------------------------------


@query("""SELECT xref_id, 'namespace' AS field, trim(namespace) AS value FROM drugbank_xref WHERE namespace IS NOT NULL UNION ALL SELECT xref_id, 'external_id', trim(external_id) FROM drugbank_xref WHERE external_id IS NOT NULL""")
def unpivoted_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "drugbank_xref").select("xref_id", F.trim("namespace").alias("namespace"), F.trim("external_id").alias("external_id"))
    return x.unpivot("xref_id", ["namespace", "external_id"], "field", "value").filter("value IS NOT NULL")


@query("""SELECT member, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(id, '_')) AS member FROM nodes_df WHERE kg = 'alder' AND type = 'disease') WHERE member <> '' GROUP BY member""")
def exploded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes_df").filter("kg = 'alder' AND type = 'disease'")
    return n.select(F.explode(F.split("id", "_")).alias("member")).filter("member <> ''").groupBy("member").agg(F.count(F.lit(1)).alias("n"))


@query(with_(SQL_T) + """
    , h AS (SELECT DISTINCT head_id AS id FROM t WHERE head_id IS NOT NULL), l AS (SELECT DISTINCT drug_id AS id FROM test_pos)
    SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT id FROM h UNION SELECT id FROM l) UNION ALL SELECT 'intersect', count(*) FROM (SELECT id FROM h INTERSECT SELECT id FROM l) UNION ALL SELECT 'except', count(*) FROM (SELECT id FROM h EXCEPT SELECT id FROM l)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = triples(spark, sf_dir).filter("head_id IS NOT NULL").select(F.col("head_id").alias("id")).distinct()
    g = table(spark, sf_dir, "test_pos").select(F.col("drug_id").alias("id")).distinct()
    count = lambda op, df: df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return count("union", h.union(g).distinct()).unionAll(count("intersect", h.intersect(g))).unionAll(count("except", h.subtract(g)))


@query("""
    SELECT kg, idx, arg_min(name, node_key) AS first_name, arg_max(name, node_key) AS last_name FROM nodes_df WHERE name IS NOT NULL GROUP BY kg, idx""")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-wins and last-wins removal of repeated rows."""
    return table(spark, sf_dir, "nodes_df").filter("name IS NOT NULL").groupBy("kg", "idx").agg(F.min_by("name", "node_key").alias("first_name"), F.max_by("name", "node_key").alias("last_name"))


@query("""
    WITH k AS (SELECT event_type, user_id, sum(value) AS total FROM events GROUP BY event_type, user_id)
    SELECT event_type, user_id, rank::INT AS rank, round(total, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(total, 4) DESC, user_id) AS rank FROM k) WHERE rank <= 10""")
def top_k_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten largest totals of each event type (a report)."""
    k = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return k.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("total"), "user_id"))).filter("rank <= 10").select("event_type", "user_id", "rank", "total")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rolled_up_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return li.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
