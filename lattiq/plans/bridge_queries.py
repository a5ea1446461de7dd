"""Canonical ids, id schemes, resolvers and pair coverage over the test tables, each beside its SQL.

The tables hold no MeSH bridge and no protein table. Where one is needed, it is a stand-in made from do_diseases: the MeSH id
of a disease is D and the last six digits of its doid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import ids
from lattiq.operators import bridges as b
from lattiq.operators import quality as q
from lattiq.sources.kg_view import SQL_E, SQL_NT, edges, with_
from lattiq.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_TYPE = r"""CASE WHEN replace(category, 'biolink:', '') IN ('SmallMolecule', 'Drug', 'ChemicalEntity') THEN 'drug' WHEN replace(category, 'biolink:', '') = 'Disease' THEN 'disease' WHEN replace(category, 'biolink:', '') = 'PhenotypicFeature' THEN 'effect/phenotype'
      WHEN replace(category, 'biolink:', '') IN ('Gene', 'Protein') THEN 'gene/protein' WHEN replace(category, 'biolink:', '') = 'Pathway' THEN 'pathway' WHEN category LIKE '%Drug%' THEN 'drug' ELSE lower(replace(category, 'biolink:', '')) END"""
_CURIE = r"'([A-Za-z][\w.]*:[\w.\-]+)'"
_CANON = (
    rf"""hay AS (SELECT row_id, id, name, {_TYPE} AS type, concat_ws(' ', id, equivalent_identifiers) AS h, upstream_data_source FROM biolink_nodes),
    xr AS (SELECT upper(trim(namespace)) AS ns, trim(external_id) AS ext, arg_min(drugbank_id, (xref_id, drugbank_id)) AS db FROM drugbank_xref WHERE drugbank_id IS NOT NULL AND namespace IS NOT NULL AND external_id IS NOT NULL GROUP BY 1, 2),
    dm AS (SELECT ltrim(replace(doid, 'DOID:', ''), '0') AS doid, min(ltrim(replace(mondo_id, 'MONDO:', ''), '0')) AS mondo FROM do_diseases GROUP BY 1),
    tok AS (SELECT row_id, unnest(regexp_extract_all(h, {_CURIE}, 1)) AS c, generate_subscripts(regexp_extract_all(h, {_CURIE}, 1), 1) AS pos FROM hay),
    ref AS (SELECT row_id, arg_min(db, pos) AS db FROM tok JOIN xr ON xr.ns = upper(split_part(c, ':', 1)) AND xr.ext = regexp_replace(c, '^[^:]*:', '') GROUP BY row_id),
    x AS (SELECT hay.*, nullif(regexp_extract(h, '\b(DB\d{{5,}})\b', 1), '') AS direct, nullif(regexp_extract(h, '(?i:NCBIGene):(\d+)', 1), '') AS gene, nullif(regexp_extract(h, '(R-HSA-\d+)', 1), '') AS react,
      nullif(regexp_extract(h, '(?i:DOID):(\d+)', 1), '') AS doid_id, CAST(TRY_CAST(nullif(regexp_extract(h, '(?i:MONDO):(\d+)', 1), '') AS BIGINT) AS VARCHAR) AS mondo_direct, nullif(regexp_extract(h, '(?i:PUBCHEM\.COMPOUND):(\d+)', 1), '') AS cid FROM hay),
    cn AS (SELECT x.row_id, x.type, coalesce(direct, CASE WHEN type = 'drug' THEN coalesce(p.db, ref.db) END) AS drugbank_id, gene AS ncbigene_id, react AS reactome_id, x.doid_id,
      CASE type WHEN 'drug' THEN coalesce(direct, p.db, ref.db, id) WHEN 'disease' THEN coalesce(mondo_direct, dm.mondo) WHEN 'gene/protein' THEN coalesce(gene, id) WHEN 'pathway' THEN coalesce(react, id) ELSE id END AS canonical_id
      FROM x LEFT JOIN xr p ON p.ns = 'PUBCHEM.COMPOUND' AND p.ext = cid LEFT JOIN ref ON ref.row_id = x.row_id LEFT JOIN dm ON dm.doid = x.doid_id)"""
)


def _ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.ontology_bridge(table(spark, sf_dir, "do_diseases").withColumn("pos", F.lit(0)))


def _mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "do_diseases")
    return d.groupBy(F.concat(F.lit("MESH:D"), F.expr("right(doid, 6)")).alias("mesh")).agg(F.min(ids.bare_number(F.col("doid"), "DOID")).alias("doid"))


_SQL_DM = "dm AS (SELECT ltrim(replace(doid, 'DOID:', ''), '0') AS doid, ltrim(replace(mondo_id, 'MONDO:', ''), '0') AS mondo FROM do_diseases), mm AS (SELECT 'MESH:D' || right(doid, 6) AS mesh, min(ltrim(replace(doid, 'DOID:', ''), '0')) AS doid FROM do_diseases GROUP BY 1)"


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "drugbank_xref").dropna(subset=["drugbank_id", "namespace", "external_id"])
    return x.groupBy(F.upper(F.trim("namespace")).alias("namespace"), F.trim("external_id").alias("external_id")).agg(F.min_by("drugbank_id", F.struct("xref_id", "drugbank_id")).alias("drugbank_id"))


@query(f"SELECT row_id, {_TYPE} AS type FROM biolink_nodes")
def category_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "biolink_nodes").select("row_id", b.canonical_type(F.col("category")).alias("type"))


@query(with_(_CANON) + "SELECT row_id, type, drugbank_id, ncbigene_id, reactome_id, doid_id, canonical_id FROM cn WHERE canonical_id IS NOT NULL")
def canonical_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascades of drugs, diseases, genes and pathways over the bridges that the tables hold."""
    n = table(spark, sf_dir, "biolink_nodes").select(F.col("row_id").alias("row"), "id", b.canonical_type(F.col("category")).alias("type"), F.col("equivalent_identifiers").alias("equivalents"))
    refs = _references(spark, sf_dir)
    cids = refs.filter("namespace = 'PUBCHEM.COMPOUND'").select(F.col("external_id").alias("cid"), "drugbank_id")
    bridges = b.Bridges(pubchem=cids, references=refs, ontology=b.first_wins(_ontology(spark, sf_dir), "doid", "mondo", "pos", "mondo"))
    return b.canonical_nodes(n, bridges).select(F.col("row").alias("row_id"), "type", "drugbank_id", "ncbigene_id", "reactome_id", "doid_id", "canonical_id")


_MEMBERS = "mem AS (SELECT DISTINCT CASE WHEN ltrim(m, '0') = '' THEN '0' ELSE ltrim(m, '0') END AS mondo, ltrim(replace(doid, 'DOID:', ''), '0') AS doid FROM (SELECT unnest(string_split(n.id, '_')) AS m, d.doid FROM nodes_df n JOIN do_diseases d ON d.mondo_name = n.name WHERE n.kg = 'alder' AND n.type = 'disease'))"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mondo, doid, pos): the members of grouped disease ids of the first graph and the doid of the disease of that name; many to many."""
    n = table(spark, sf_dir, "nodes_df").filter("kg = 'alder' AND type = 'disease'").select("id", "name")
    d = table(spark, sf_dir, "do_diseases").select(F.col("mondo_name").alias("name"), "doid")
    m = n.join(d, "name").select(F.explode(F.split("id", "_")).alias("m"), "doid")
    return m.select(ids.bare_number(F.col("m"), "").alias("mondo"), ids.bare_number(F.col("doid"), "DOID").alias("doid"), F.lit(0).alias("pos")).distinct()


@query(with_(_SQL_DM, _MEMBERS) + r"""
    , a AS (SELECT DISTINCT 'mondo' AS scheme, mem.doid FROM (SELECT DISTINCT unnest(string_split(y_id, '_')) AS m FROM kg_df WHERE y_type = 'disease') k JOIN mem ON mem.mondo = CASE WHEN ltrim(trim(m), '0') = '' THEN '0' ELSE ltrim(trim(m), '0') END),
    r AS (SELECT rep_id, disease_mondo_id, d.doid FROM table5_replication t JOIN do_diseases d ON d.mondo_id = t.disease_mondo_id),
    b AS (SELECT DISTINCT 'doid' AS scheme, ltrim(replace(doid, 'DOID:', ''), '0') AS doid FROM r),
    c AS (SELECT DISTINCT 'doid_mesh' AS scheme, coalesce(mm.doid, ltrim(replace(i, 'DOID:', ''), '0')) AS doid FROM (SELECT DISTINCT CASE WHEN rep_id % 2 = 0 THEN doid ELSE 'MESH:D' || right(doid, 6) END AS i FROM r) LEFT JOIN mm ON mm.mesh = i WHERE i LIKE 'DOID:%' OR mm.doid IS NOT NULL),
    d AS (SELECT DISTINCT 'mesh' AS scheme, mm.doid FROM r JOIN mm ON mm.mesh = 'MESH:D' || right(r.doid, 6))
    SELECT scheme, doid FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d""")
def disease_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disease numbers under the four id schemes."""
    ontology, mesh, members = _ontology(spark, sf_dir), _mesh(spark, sf_dir), _members(spark, sf_dir)
    kg = table(spark, sf_dir, "kg_df").filter("y_type = 'disease'").select(F.col("y_id").alias("i"))
    d = table(spark, sf_dir, "do_diseases").select(F.col("mondo_id").alias("disease_mondo_id"), "doid")
    r = table(spark, sf_dir, "table5_replication").select("rep_id", "disease_mondo_id").join(d, "disease_mondo_id")
    short = F.expr("'D' || right(doid, 6)")
    parts = {
        "mondo": b.disease_numbers(kg, "i", "mondo", members, mesh, "_"), "doid": b.disease_numbers(r, "doid", "doid", ontology, mesh),
        "doid_mesh": b.disease_numbers(r.select(F.when(F.col("rep_id") % 2 == 0, F.col("doid")).otherwise(F.concat(F.lit("MESH:"), short)).alias("i")), "i", "doid_mesh", ontology, mesh),
        "mesh": b.disease_numbers(r.select(short.alias("i")), "i", "mesh", ontology, mesh),
    }
    out = None
    for scheme, found in parts.items():
        one = found.select(F.lit(scheme).alias("scheme"), "doid")
        out = one if out is None else out.unionByName(one)
    return out


@query(with_(_SQL_DM) + """, i AS (SELECT rep_id, CASE rep_id % 4 WHEN 0 THEN d.doid WHEN 1 THEN 'MESH:D' || right(d.doid, 6) WHEN 2 THEN 'D' || right(d.doid, 6) ELSE t.drug_id END AS i FROM table5_replication t LEFT JOIN do_diseases d ON d.mondo_id = t.disease_mondo_id),
    k AS (SELECT rep_id, i, CASE WHEN i LIKE 'DOID:%' THEN ltrim(replace(i, 'DOID:', ''), '0') WHEN i LIKE 'MESH:%' THEN mm.doid WHEN regexp_full_match(i, '[DC][0-9]+') THEN mm.doid END AS doid FROM i LEFT JOIN mm ON mm.mesh = CASE WHEN i LIKE 'MESH:%' THEN i ELSE 'MESH:' || i END)
    SELECT rep_id, i AS written, (SELECT min(mondo) FROM dm WHERE dm.doid = k.doid) AS mondo FROM k""")
def ids_to_mondo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disease ids written in three schemes (and drug ids, which are none) as MONDO numbers, over two bridges."""
    d = table(spark, sf_dir, "do_diseases").select(F.col("mondo_id").alias("disease_mondo_id"), "doid")
    r = table(spark, sf_dir, "table5_replication").select("rep_id", "disease_mondo_id", "drug_id").join(d, "disease_mondo_id", "left")
    way, short = F.col("rep_id") % 4, F.expr("'D' || right(doid, 6)")
    written = r.select("rep_id", F.when(way == 0, F.col("doid")).when(way == 1, F.concat(F.lit("MESH:"), short)).when(way == 2, short).otherwise(F.col("drug_id")).alias("written"))
    return b.to_mondo(written, "written", _ontology(spark, sf_dir), _mesh(spark, sf_dir))


@query("""SELECT symbol, arg_max(id, (node_key, id)) AS gene FROM (SELECT node_key, id, upper(unnest(regexp_split_to_array(trim(coalesce(name, '') || ' ' || coalesce(synonym, '')), '[ \t\n\r]+'))) AS symbol FROM nodes_df WHERE kg = 'alder' AND type = 'gene/protein' AND id IS NOT NULL) WHERE symbol <> '' GROUP BY symbol""")
def gene_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of gene names to gene ids, the last row wins."""
    n = table(spark, sf_dir, "nodes_df").filter("kg = 'alder' AND type = 'gene/protein'")
    names = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("synonym", F.lit("")))
    return b.symbol_bridge(n.select(F.trim(names).alias("names"), F.col("id").alias("gene_ids"), F.col("node_key").alias("pos")))


@query("""WITH m AS (SELECT row_id, unnest(list_filter(list_transform(string_split(upstream_data_source, '|'), lambda x: trim(x)), lambda x: x <> '')) AS member, len(list_filter(list_transform(string_split(upstream_data_source, '|'), lambda x: trim(x)), lambda x: x <> '')) AS k FROM biolink_nodes WHERE upstream_data_source IS NOT NULL)
    SELECT member, count(*)::BIGINT AS n, count(CASE WHEN k = 1 THEN 1 END)::BIGINT AS n_alone FROM m GROUP BY member""")
def exploded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of nodes that name several, and how often each stands alone."""
    n = table(spark, sf_dir, "biolink_nodes").select("row_id", "upstream_data_source")
    alone = b.exploded_ids(n, "upstream_data_source", "|", True).groupBy("member").agg(F.count(F.lit(1)).alias("n_alone"))
    return b.exploded_ids(n, "upstream_data_source", "|").groupBy("member").agg(F.count(F.lit(1)).alias("n")).join(alone, "member", "left").select("member", "n", F.coalesce("n_alone", F.lit(0)).alias("n_alone"))


@query(r"""WITH n AS (SELECT node_key, idx, id, lower(type) AS t FROM nodes_df WHERE kg = 'alder' AND type IS NOT NULL),
    k AS (SELECT 'drug' AS kind, nullif(regexp_extract(id, '(DB\d{5})', 1), '') AS key, idx, node_key FROM n WHERE t IN ('drug', 'compound') UNION ALL SELECT 'disease', CASE WHEN ltrim(m, '0') = '' THEN '0' ELSE ltrim(m, '0') END, idx, node_key FROM (SELECT unnest(string_split(id, '_')) AS m, idx, node_key FROM n WHERE t = 'disease'))
    SELECT kind, key, arg_max(idx, (node_key, idx)) AS idx FROM k WHERE key IS NOT NULL GROUP BY kind, key""")
def id_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DrugBank ids and members of grouped disease ids to nodes, the last row wins."""
    n = table(spark, sf_dir, "nodes_df").filter("kg = 'alder' AND type IS NOT NULL").select("idx", "id", "type", F.col("node_key").alias("row"))
    return b.index_of_ids(n, "mondo", _ontology(spark, sf_dir), _mesh(spark, sf_dir))


@query("""WITH w AS (SELECT DISTINCT drug_id, drug_name FROM table5_replication), n AS (SELECT node_key, idx, id, name, lower(type) IN ('drug', 'compound', 'smallmolecule') AS is_drug FROM nodes_df WHERE kg = 'alder')
    SELECT w.drug_id, w.drug_name, coalesce((SELECT arg_min(idx, (node_key, idx)) FROM n WHERE is_drug AND n.id = w.drug_id AND idx IS NOT NULL), (SELECT arg_min(idx, (node_key, idx)) FROM n WHERE n.id = w.drug_id AND idx IS NOT NULL), (SELECT arg_min(idx, (node_key, idx)) FROM n WHERE is_drug AND lower(n.name) = lower(w.drug_name) AND idx IS NOT NULL)) AS idx FROM w""")
def resolved_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drugs of the replication table as nodes: by type and id, by id, by name."""
    w = table(spark, sf_dir, "table5_replication").select("drug_id", "drug_name").distinct()
    n = table(spark, sf_dir, "nodes_df").filter("kg = 'alder'").select("idx", "id", "type", "name", F.col("node_key").alias("row"))
    return b.resolve_drugs(w, n)


_SQL_TERMS = r"""tm AS (SELECT DISTINCT disease_name AS term FROM table5_replication WHERE disease_name IS NOT NULL), al AS (SELECT lower(term) AS t, trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')) AS a FROM tm GROUP BY ALL)"""


def _terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Typed disease names, and as alias of each the name without marks."""
    t = table(spark, sf_dir, "table5_replication").filter("disease_name IS NOT NULL").select(F.col("disease_name").alias("term")).distinct()
    plain = F.trim(F.regexp_replace(F.lower("term"), "[^a-z0-9]+", " "))
    return t, t.select(F.lower("term").alias("term"), plain.alias("alias")).distinct()


@query(with_(_SQL_TERMS) + """, d AS (SELECT lower(mondo_name) AS n, mondo_id FROM do_diseases),
    m AS (SELECT tm.term, mondo_id, n, CASE WHEN n = a THEN 0 WHEN n = lower(tm.term) THEN 1 WHEN contains(n, a) THEN 2 ELSE 3 END AS rank FROM tm JOIN al ON al.t = lower(tm.term) JOIN d ON contains(n, a) OR contains(n, lower(tm.term)))
    SELECT tm.term, (SELECT arg_min(mondo_id, (rank, length(n), n, mondo_id)) FROM m WHERE m.term = tm.term) AS mondo_id FROM tm""")
def resolved_typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed disease names: exact alias, exact name, shortest name with the alias, shortest with the name."""
    t, aliases = _terms(spark, sf_dir)
    names = table(spark, sf_dir, "do_diseases").select(F.col("mondo_name").alias("name"), F.col("mondo_id").alias("idx"))
    return b.resolve_terms(t, aliases, names).withColumnRenamed("idx", "mondo_id")


@query(with_(_SQL_TERMS) + """, d AS (SELECT lower(mondo_name) AS n, doid, 'MESH:D' || right(doid, 6) AS mesh, right(doid, 1)::INT AS digit FROM do_diseases), nd AS (SELECT CASE WHEN digit < 4 THEN doid ELSE mesh END AS id, min(right(doid, 8)::BIGINT) AS idx FROM d WHERE digit < 8 GROUP BY 1),
    s AS (SELECT term, 0 AS w, lower(term) AS n FROM tm UNION ALL SELECT tm.term, 1, a FROM tm JOIN al ON al.t = lower(tm.term)),
    k AS (SELECT s.term, s.w, d.doid, d.mesh FROM s JOIN d USING (n)), f AS (SELECT term, w, 0 AS r, idx FROM k JOIN nd ON nd.id = k.doid UNION ALL SELECT term, w, 1, idx FROM k JOIN nd ON nd.id = k.mesh)
    SELECT tm.term, (SELECT arg_min(idx, (w, r)) FROM f WHERE f.term = tm.term) AS idx FROM tm""")
def resolved_by_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed disease names over the ontology to nodes that bear a disease number or a MeSH id (a stand-in graph)."""
    t, aliases = _terms(spark, sf_dir)
    d = table(spark, sf_dir, "do_diseases").select(F.col("mondo_name").alias("name"), "doid", F.expr("'MESH:D' || right(doid, 6)").alias("mesh"), F.expr("cast(right(doid, 1) AS int)").alias("digit"))
    nodes = d.filter("digit < 8").select(F.when(F.col("digit") < 4, F.col("doid")).otherwise(F.col("mesh")).alias("id"), F.expr("cast(right(doid, 8) AS bigint)").alias("idx"))
    spelled = t.join(aliases.withColumnRenamed("term", "t"), F.lower("term") == F.col("t")).select("term", "alias")
    return b.resolve_by_ontology(t, spelled, d.select("name", "doid"), d.select("doid", "mesh"), nodes)


@query(with_(_SQL_DM) + """, i AS (SELECT rep_id, CASE rep_id % 4 WHEN 0 THEN d.doid WHEN 1 THEN 'MESH:D' || right(d.doid, 6) WHEN 2 THEN replace(d.doid, 'DOID:', '') ELSE t.drug_name END AS written FROM table5_replication t LEFT JOIN do_diseases d ON d.mondo_id = t.disease_mondo_id)
    SELECT rep_id, written, coalesce(n.mondo_name, CASE WHEN written LIKE 'DOID:%' OR written LIKE 'MESH:%' THEN '' ELSE written END) AS resolved_name
    FROM i LEFT JOIN mm ON mm.mesh = written LEFT JOIN do_diseases n ON n.doid = CASE WHEN written LIKE 'DOID:%' THEN written WHEN written LIKE 'MESH:%' THEN 'DOID:' || mm.doid ELSE 'DOID:' || written END""")
def resolved_id_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of disease ids written in three ways; what is no id is its own name."""
    d = table(spark, sf_dir, "do_diseases")
    r = table(spark, sf_dir, "table5_replication").select("rep_id", F.col("disease_mondo_id").alias("mondo_id"), "drug_name").join(d.select("mondo_id", "doid"), "mondo_id", "left")
    way = F.col("rep_id") % 4
    written = r.select("rep_id", F.when(way == 0, F.col("doid")).when(way == 1, F.expr("'MESH:D' || right(doid, 6)")).when(way == 2, F.replace("doid", F.lit("DOID:"), F.lit(""))).otherwise(F.col("drug_name")).alias("written"))
    return b.resolve_names(written, "written", d.select("doid", F.col("mondo_name").alias("name")), _mesh(spark, sf_dir).select("mesh", F.concat(F.lit("DOID:"), "doid").alias("doid")))


@query("""SELECT lower(coalesce(type, '')) AS type, CASE lower(coalesce(type, '')) WHEN '' THEN 'other' WHEN 'compound' THEN 'compound' WHEN 'small molecule' THEN 'compound' WHEN 'effect/phenotype' THEN 'phenotype' WHEN 'phenotypic feature' THEN 'phenotype' ELSE replace(lower(type), ' ', '_') END AS shown, count(*)::BIGINT AS n FROM nodes_df GROUP BY 1, 2""")
def display_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes_df")
    return n.groupBy(F.lower(F.coalesce("type", F.lit(""))).alias("type"), ids.display_type(F.col("type")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT relation, count(*)::BIGINT AS n FROM kg_df WHERE regexp_matches(lower(relation), 'indication|off-label') AND x_type IN ('drug', 'disease') GROUP BY relation""")
def therapeutic_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations found by patterns, heads that are drugs or diseases."""
    return b.relation_filter(table(spark, sf_dir, "kg_df"), "pattern", ["indication", "off-label"], ["drug", "disease"]).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT rep_id, drug_id FROM table5_replication WHERE length(coalesce(disease_mondo_id, '')) = 0 AND (rep_id IS NULL OR rep_id NOT IN (7, 203)) AND (methodology IS NULL OR methodology NOT IN ('all other diseases'))""")
def exclusion_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a flag, without the listed numbers and without a listed value."""
    return b.without_excluded(table(spark, sf_dir, "table5_replication"), "disease_mondo_id", "rep_id", [7, 203], "methodology", ["all other diseases"]).select("rep_id", "drug_id")


@query(with_(SQL_E) + r"""
    , tt AS (SELECT regexp_replace(regexp_replace(lower(relation), '[^a-z]', '', 'g'), 'inv$', '') AS rel, head_index AS h, tail_index AS t FROM train_triples WHERE head_index IS NOT NULL AND tail_index IS NOT NULL),
    g AS (SELECT DISTINCT 'drug_target' AS kind, least(h, t) AS a, greatest(h, t) AS b FROM tt WHERE rel = 'drugprotein' UNION SELECT DISTINCT 'drug_disease', drug_index, disease_index FROM test_pos
      UNION SELECT DISTINCT 'drug_disease', CASE WHEN h > 10800 THEN h ELSE t END, CASE WHEN h > 10800 THEN t ELSE h END FROM tt WHERE rel = 'indication' UNION SELECT DISTINCT 'drug_drug', least(x.h, y.h), greatest(x.h, y.h) FROM tt x JOIN tt y ON x.t = y.t AND x.rel = 'contraindication' AND y.rel = 'contraindication' AND x.h < y.h),
    f AS (SELECT DISTINCT 'drug_target' AS kind, least(x_index, y_index) AS a, greatest(x_index, y_index) AS b FROM e WHERE rel = 'drugprotein' AND ((x_type = 'drug' AND y_type = 'gene/protein') OR (y_type = 'drug' AND x_type = 'gene/protein'))
      UNION SELECT DISTINCT 'drug_disease', CASE WHEN x_type = 'drug' THEN x_index ELSE y_index END, CASE WHEN x_type = 'drug' THEN y_index ELSE x_index END FROM e WHERE rel = 'indication' AND ((x_type = 'drug' AND y_type = 'disease') OR (y_type = 'drug' AND x_type = 'disease'))
      UNION SELECT DISTINCT 'drug_drug', least(x_index, y_index), greatest(x_index, y_index) FROM e WHERE rel = 'drugdrug')
    SELECT kind, count(g.a)::BIGINT AS n_gold, count(f.a)::BIGINT AS n_found, count(CASE WHEN g.a IS NOT NULL AND f.a IS NOT NULL THEN 1 END)::BIGINT AS n_overlap,
      CASE WHEN count(g.a) > 0 THEN round(count(CASE WHEN g.a IS NOT NULL AND f.a IS NOT NULL THEN 1 END) * 100.0::DOUBLE / count(g.a), 2) END AS pct FROM g FULL JOIN f USING (kind, a, b) GROUP BY kind""")
def pair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of drug-target, drug-disease and (unordered) drug-drug pairs against gold pairs.

    Gold: targets and indications of the training triples, held-out indications, and drugs that share a contraindication."""
    e = edges(spark, sf_dir)
    as_edges = e.select(F.col("rel").alias("relation"), F.col("x_index").cast("string").alias("x_id"), "x_type", F.col("y_index").cast("string").alias("y_id"), "y_type")
    t = table(spark, sf_dir, "train_triples").filter("head_index IS NOT NULL AND tail_index IS NOT NULL").select(F.regexp_replace(ids.relation_key(F.col("relation")), "inv$", "").alias("rel"), F.col("head_index").alias("h"), F.col("tail_index").alias("t"))
    pair = lambda df, a, c: df.select(F.col(a).cast("long").alias("a"), F.col(c).cast("long").alias("b"))
    number = lambda df: pair(df, "a", "b")
    drug_first = F.col("h") > 10800
    shared = t.filter("rel = 'contraindication'").select("t", F.col("h").alias("a")).distinct()
    gold = {
        "drug_target": b.unordered(pair(t.filter("rel = 'drugprotein'"), "h", "t")),
        "drug_disease": pair(table(spark, sf_dir, "test_pos"), "drug_index", "disease_index").unionByName(t.filter("rel = 'indication'").select(F.when(drug_first, F.col("h")).otherwise(F.col("t")).alias("a"), F.when(drug_first, F.col("t")).otherwise(F.col("h")).alias("b"))),
        "drug_drug": shared.join(shared.select("t", F.col("a").alias("b")), "t").filter("a < b").select("a", "b"),
    }
    found = {
        "drug_target": b.unordered(number(b.extract_pairs(as_edges, ["drugprotein"], "drug", "gene/protein"))),
        "drug_disease": number(b.extract_pairs(as_edges, ["indication"], "drug", "disease")),
        "drug_drug": b.unordered(number(b.extract_pairs(as_edges, ["drugdrug"]))),
    }
    tagged = lambda parts: [df.select(F.lit(k).alias("kind"), "a", "b") for k, df in parts.items()]
    g, f = tagged(gold), tagged(found)
    return q.coverage(g[0].unionByName(g[1]).unionByName(g[2]), f[0].unionByName(f[1]).unionByName(f[2]), ["a", "b"], ["kind"])


@query("""WITH f AS (SELECT DISTINCT kg, CASE WHEN lower(type) IN ('drug', 'compound', 'biolink:drug', 'biolink:smallmolecule') THEN 'drug' WHEN lower(type) IN ('pathway', 'biolink:pathway') THEN 'pathway' WHEN lower(type) IN ('disease', 'biolink:disease') THEN 'disease' END AS type, lower(name) AS k FROM nodes_df WHERE name IS NOT NULL),
    g AS (SELECT DISTINCT type, k FROM f WHERE kg = 'alder' AND type IS NOT NULL), kgs AS (SELECT DISTINCT kg, kg IN (SELECT kg FROM nodes_df WHERE id LIKE 'R-%' OR id LIKE 'PW:%') AS pathways FROM nodes_df),
    gk AS (SELECT kg, type, k FROM g, kgs WHERE type <> 'pathway' OR pathways), ff AS (SELECT f.* FROM f JOIN kgs USING (kg) WHERE type IS NOT NULL AND (type <> 'pathway' OR pathways))
    SELECT kg, type, count(gk.k)::BIGINT AS n_gold, count(ff.k)::BIGINT AS n_found, count(CASE WHEN gk.k IS NOT NULL AND ff.k IS NOT NULL THEN 1 END)::BIGINT AS n_overlap, CASE WHEN count(gk.k) > 0 THEN round(count(CASE WHEN gk.k IS NOT NULL AND ff.k IS NOT NULL THEN 1 END) * 100.0::DOUBLE / count(gk.k), 2) END AS pct
    FROM gk FULL JOIN ff USING (kg, type, k) GROUP BY kg, type""")
def eligible_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of names by graph and type; pathways only for graphs that number them in the gold set's way or a known other."""
    low = F.lower("type")
    kind = F.when(low.isin("drug", "compound", "biolink:drug", "biolink:smallmolecule"), "drug").when(low.isin("pathway", "biolink:pathway"), "pathway").when(low.isin("disease", "biolink:disease"), "disease")
    nodes = table(spark, sf_dir, "nodes_df")
    graphs = nodes.groupBy("kg").agg(F.max(F.coalesce(F.col("id").startswith("R-") | F.col("id").startswith("PW:"), F.lit(False))).alias("pathways"))  # one row a graph
    found = nodes.filter("name IS NOT NULL").select("kg", kind.alias("type"), F.lower("name").alias("k")).filter("type IS NOT NULL").distinct()
    allowed = (F.col("type") != "pathway") | F.col("pathways")
    listed = graphs.agg(F.collect_list(F.struct("kg", "pathways")).alias("graphs"))  # one row
    gold = found.filter("kg = 'alder'").select("type", "k").join(F.broadcast(listed)).select("type", "k", F.explode("graphs").alias("g")).select("type", "k", "g.*").filter(allowed)
    return q.coverage(gold, found.join(F.broadcast(graphs), "kg").filter(allowed), ["k"], ["kg", "type"])


@query(with_(SQL_E) + """, r AS (SELECT rel, x_type, y_type, 'src::' || rel || '::' || x_type || ':' || (CASE WHEN rel = 'indication' THEN 'disease' ELSE y_type END) AS name FROM e)
    SELECT rel, count(*)::BIGINT AS n, count(CASE WHEN (x_type = split_part(split_part(name, '::', 3), ':', 1) AND y_type = split_part(split_part(name, '::', 3), ':', 2)) OR (y_type = split_part(split_part(name, '::', 3), ':', 1) AND x_type = split_part(split_part(name, '::', 3), ':', 2)) THEN 1 END)::BIGINT AS n_ok FROM r GROUP BY rel""")
def segment_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End types beside those that the last segment of the relation's name states, in either order."""
    name = F.concat(F.lit("src::"), "rel", F.lit("::"), "x_type", F.lit(":"), F.when(F.col("rel") == "indication", "disease").otherwise(F.col("y_type")))
    e = edges(spark, sf_dir).select("rel", F.concat_ws("|", "x_type", "y_type").alias("ends"), b.derived_types(name).alias("allowed"))
    return e.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.array_contains("allowed", F.col("ends")), 1)).alias("n_ok"))


@query(with_(SQL_E, SQL_NT) + """, p AS (SELECT least(x_id, y_id) AS a, greatest(x_id, y_id) AS b FROM e WHERE rel IN ('proteinprotein', 'coexpression') AND x_id IS NOT NULL AND y_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT rel) = 2)
    SELECT row_id, rel AS relation, x_id, y_id, x_source, y_source FROM e JOIN p ON p.a = least(x_id, y_id) AND p.b = greatest(x_id, y_id) WHERE rel IN ('proteinprotein', 'coexpression')""")
def conflict_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges behind pairs that are stated under two exclusive relations, found by the ids of their ends."""
    e = edges(spark, sf_dir).withColumnRenamed("rel", "relation")
    both = e.filter(F.col("relation").isin("proteinprotein", "coexpression") & F.col("x_id").isNotNull() & F.col("y_id").isNotNull()).groupBy(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).agg(F.count_distinct("relation").alias("n")).filter("n = 2")
    return b.suffix_records(e, both.select("a", "b"), ["proteinprotein", "coexpression"]).select("row_id", "relation", "x_id", "y_id", "x_source", "y_source")


@query(with_(_MEMBERS) + """SELECT k.edge_id, mem.mondo AS member, mem.doid FROM (SELECT edge_id, unnest(string_split(y_id, '_')) AS m FROM kg_df WHERE y_type = 'disease') k JOIN mem ON mem.mondo = CASE WHEN ltrim(m, '0') = '' THEN '0' ELSE ltrim(m, '0') END""")
def many_to_many_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every doid of every member of grouped disease ids."""
    k = table(spark, sf_dir, "kg_df").filter("y_type = 'disease'").select("edge_id", F.explode(F.split("y_id", "_")).alias("m"))
    return k.select("edge_id", ids.bare_number(F.col("m"), "").alias("mondo")).join(_members(spark, sf_dir), "mondo").select("edge_id", F.col("mondo").alias("member"), "doid")
