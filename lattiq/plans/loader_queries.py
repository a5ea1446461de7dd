"""Readers of all file shapes over files that are written from the test tables first, each beside SQL over the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions.ids import relation_key
from lattiq.operators.bridges import Bridges
from lattiq.plans.bridge_queries import _CANON, _references
from lattiq.plans.lineage import shared_dir
from lattiq.sources import graph_files as gf
from lattiq.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _file(df: DataFrame, order: str, sep: str = "\t", header: bool = False, gz: bool = False) -> str:
    """df as text files whose order of names is that of a column, which is not written; deleted when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattiq-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(parts, order).sortWithinPartitions(order).drop(order)
    out.write.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("compression", "gzip" if gz else "none").csv(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def _whole(column: str):
    """Ids that are a number, or hold a letter and so are none; what casts make of other marks is not compared."""
    return F.col(column).rlike(r"^\d{1,18}$") | F.col(column).rlike("[A-Za-z]")


_EDGES = r"ed AS (SELECT edge_id, regexp_replace(lower(relation), '[^a-z]', '', 'g') AS relation, x_index, x_id, x_type, y_index, y_id, y_type, x_source, y_source FROM kg_df WHERE x_index IS NOT NULL AND y_index IS NOT NULL)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "kg_df").filter("x_index IS NOT NULL AND y_index IS NOT NULL")
    return k.withColumn("relation", relation_key(F.col("relation")))


@query(f"WITH {_EDGES}, en AS (SELECT x_index AS idx, x_id AS id, x_type AS type, 0 AS k, edge_id FROM ed UNION ALL SELECT y_index, y_id, y_type, 1, edge_id FROM ed) SELECT idx, arg_min(id, (k, edge_id)) AS id, arg_min(type, (k, edge_id)) AS type FROM en GROUP BY idx")
def load_single_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one wide CSV, the first row of each index wins."""
    e = _edges(spark, sf_dir).select("edge_id", *gf.EDGE_COLUMNS, F.lit("more").alias("extra"))
    _, nodes = gf.load_graph(spark, "single_edge_csv", _file(e, "edge_id", ",", header=True))
    return nodes.select("idx", "id", "type")


@query(r"""WITH n AS (SELECT node_key, trim(id) AS id, type, row_number() OVER (ORDER BY node_key) - 1 AS idx FROM nodes_df WHERE kg = 'alder' AND id IS NOT NULL AND type IS NOT NULL), l AS (SELECT id, max(idx) AS idx, arg_max(type, idx) AS type FROM n GROUP BY id),
    t AS (SELECT trim(head_id) AS h, regexp_replace(lower(relation), '[^a-z]', '', 'g') AS r, trim(tail_id) AS t FROM train_triples WHERE head_id IS NOT NULL AND tail_id IS NOT NULL)
    SELECT x.idx AS x_index, t.r AS relation, y.idx AS y_index, x.type AS x_type, count(*)::BIGINT AS n FROM t JOIN l x ON x.id = t.h JOIN l y ON y.id = t.t GROUP BY ALL""")
def load_node_edge_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nodes_df").filter("kg = 'alder' AND id IS NOT NULL AND type IS NOT NULL").select("node_key", F.trim("id").alias("id"), F.regexp_replace("name", r"\s", " ").alias("name"), F.col("type").alias("kind"))
    t = table(spark, sf_dir, "train_triples").filter("head_id IS NOT NULL AND tail_id IS NOT NULL").select("triple_id", F.trim("head_id").alias("source"), relation_key(F.col("relation")).alias("metaedge"), F.trim("tail_id").alias("target"))
    edges, _ = gf.load_graph(spark, "node_edge_tsv", _file(n, "node_key", header=True), _file(t, "triple_id", header=True))
    return edges.groupBy("x_index", "relation", "y_index", "x_type").agg(F.count(F.lit(1)).alias("n"))


_TYPED = f"WITH {_EDGES}, t AS (SELECT edge_id, CASE WHEN edge_id % 10 = 0 THEN x_id ELSE x_type || '::' || x_id END AS h, relation AS r, y_type || '::' || y_id AS t FROM ed WHERE x_id IS NOT NULL AND y_id IS NOT NULL)"


@query(_TYPED + """, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT h AS id FROM t UNION SELECT t FROM t)) SELECT idx, id, CASE WHEN contains(id, '::') THEN split_part(id, '::', 1) ELSE 'unknown' END AS type FROM i""")
def load_prefixed_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).filter("x_id IS NOT NULL AND y_id IS NOT NULL")
    head = F.when(F.col("edge_id") % 10 == 0, F.col("x_id")).otherwise(F.concat("x_type", F.lit("::"), "x_id"))
    t = e.select("edge_id", head.alias("h"), "relation", F.concat("y_type", F.lit("::"), "y_id").alias("t"))
    return gf.load_graph(spark, "prefixed_triples", _file(t, "edge_id", gz=True))[1].select("idx", "id", "type")


_SCORED = f"WITH {_EDGES}" + r""", s AS (SELECT 'NCBIGENE:' || x_index AS h, relation AS r, CASE WHEN y_type = 'drug' THEN 'PUBCHEM.COMPOUND:' || y_index WHEN y_type = 'disease' THEN 'DOID:' || y_index WHEN y_type = 'pathway' THEN 'ODD:' || y_index ELSE 'plain' || y_index END AS t,
    CASE edge_id % 4 WHEN 0 THEN (edge_id % 1000)::VARCHAR WHEN 1 THEN 'gold quality' WHEN 2 THEN 'low quality' ELSE (edge_id % 1400)::VARCHAR END AS score, CASE edge_id % 3 WHEN 0 THEN 'STRING' WHEN 1 THEN 'Bgee' ELSE 'SIDER' END AS source FROM ed),
    k AS (SELECT * FROM s WHERE CASE source WHEN 'STRING' THEN coalesce(TRY_CAST(score AS DOUBLE) >= 700, false) WHEN 'Bgee' THEN score IN ('gold quality', 'high quality') ELSE true END), b AS (SELECT trim(external_id) AS cid, min(drugbank_id) AS db FROM drugbank_xref WHERE upper(trim(namespace)) = 'PUBCHEM.COMPOUND' AND drugbank_id IS NOT NULL GROUP BY 1)"""


@query(_SCORED + """, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT h AS id FROM k UNION SELECT t FROM k))
    SELECT idx, id, CASE WHEN NOT contains(id, ':') THEN 'unknown' WHEN id LIKE 'NCBIGENE:%' THEN 'Gene' WHEN id LIKE 'PUBCHEM.COMPOUND:%' THEN 'Drug' WHEN id LIKE 'DOID:%' THEN 'Disease' ELSE split_part(id, ':', 1) END AS type, b.db AS drugbank_id FROM i LEFT JOIN b ON id = 'PUBCHEM.COMPOUND:' || b.cid""")
def load_scored_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of scored triples of good quality, drugs with their DrugBank id."""
    i = F.col("edge_id")
    tail = F.when(F.col("y_type") == "drug", F.concat(F.lit("PUBCHEM.COMPOUND:"), "y_index")).when(F.col("y_type") == "disease", F.concat(F.lit("DOID:"), "y_index")).when(F.col("y_type") == "pathway", F.concat(F.lit("ODD:"), "y_index")).otherwise(F.concat(F.lit("plain"), "y_index"))
    score = F.when(i % 4 == 0, (i % 1000).cast("string")).when(i % 4 == 1, "gold quality").when(i % 4 == 2, "low quality").otherwise((i % 1400).cast("string"))
    source = F.when(i % 3 == 0, "STRING").when(i % 3 == 1, "Bgee").otherwise("SIDER")
    t = _edges(spark, sf_dir).select("edge_id", F.concat(F.lit("NCBIGENE:"), "x_index").alias("h"), "relation", tail.alias("t"), score.alias("score"), source.alias("source"))
    bridge = table(spark, sf_dir, "drugbank_xref").filter("upper(trim(namespace)) = 'PUBCHEM.COMPOUND'").select(F.trim("external_id").alias("pubchem_cid"), "drugbank_id")
    return gf.load_graph(spark, "scored_triples", _file(t, "edge_id"), drug_bridge=bridge)[1].select("idx", "id", "type", "drugbank_id")


_PREDICATES = f"WITH {_EDGES}" + """, t AS (SELECT edge_id, x_id AS h, CASE relation WHEN 'proteinprotein' THEN 'PPI' WHEN 'drugprotein' THEN 'DRUG_TARGET' WHEN 'drugdrug' THEN 'DDI' WHEN 'diseaseprotein' THEN 'PROTEIN_DISEASE_ASSOCIATION' WHEN 'indication' THEN 'DRUG_INDICATION_ASSOCIATION' WHEN 'pathwayprotein' THEN 'MEMBER_OF_COMPLEX' WHEN 'proteincomplex' THEN 'COMPLEX_IN_PATHWAY' ELSE relation END AS r, y_id AS t FROM ed WHERE x_id IS NOT NULL AND y_id IS NOT NULL),
    p(r, x, y) AS (VALUES ('PPI', 'Gene/Protein', 'Gene/Protein'), ('DRUG_TARGET', 'Drug', 'Gene/Protein'), ('DDI', 'Drug', 'Drug'), ('PROTEIN_DISEASE_ASSOCIATION', 'Gene/Protein', 'Disease'), ('DRUG_INDICATION_ASSOCIATION', 'Drug', 'Disease'), ('MEMBER_OF_COMPLEX', 'Gene/Protein', 'Complex'), ('COMPLEX_IN_PATHWAY', 'Complex', 'Pathway')),
    v AS (SELECT h AS id, coalesce(x, 'unknown') AS type, 0 AS k, edge_id FROM t LEFT JOIN p USING (r) UNION ALL SELECT t, coalesce(y, 'unknown'), 1, edge_id FROM t LEFT JOIN p USING (r)), w AS (SELECT *, CASE type WHEN 'unknown' THEN 0 WHEN 'Complex' THEN 2 ELSE 5 END AS rank FROM v),
    ty AS (SELECT id, arg_min(type, (-rank, k, edge_id)) AS type FROM w GROUP BY id), nm AS (SELECT id, arg_min(name, node_key) AS name FROM nodes_df WHERE kg = 'alder' AND id IS NOT NULL AND name IS NOT NULL GROUP BY id)"""


@query(_PREDICATES + "SELECT row_number() OVER (ORDER BY ty.id) - 1 AS idx, ty.id, type, coalesce(regexp_replace(nm.name, '\\s', ' ', 'g'), ty.id) AS name FROM ty LEFT JOIN nm ON nm.id = ty.id")
def load_typed_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare ids typed by their predicates, named by a file of attributes."""
    e = _edges(spark, sf_dir).filter("x_id IS NOT NULL AND y_id IS NOT NULL")
    names = {"proteinprotein": "PPI", "drugprotein": "DRUG_TARGET", "drugdrug": "DDI", "diseaseprotein": "PROTEIN_DISEASE_ASSOCIATION", "indication": "DRUG_INDICATION_ASSOCIATION", "pathwayprotein": "MEMBER_OF_COMPLEX", "proteincomplex": "COMPLEX_IN_PATHWAY"}
    r = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("relation")], "relation")
    t = e.select("edge_id", "x_id", r.alias("r"), "y_id")
    m = table(spark, sf_dir, "nodes_df").filter("kg = 'alder' AND id IS NOT NULL AND name IS NOT NULL").select("node_key", "id", F.lit("NAME").alias("a"), F.regexp_replace("name", r"\s", " ").alias("v"))
    other = m.select((F.col("node_key") + 0.5).alias("node_key"), "id", F.lit("OTHER").alias("a"), F.lit("no").alias("v"))
    meta = _file(m.withColumn("node_key", F.col("node_key").cast("double")).unionByName(other), "node_key")
    return gf.load_graph(spark, "typed_triples", _file(t, "edge_id", gz=True), metadata_glob=f"{meta}/*.csv")[1].select("idx", "id", "type", "name")


@query("WITH " + _CANON + r""", la AS (SELECT cn.*, b.id AS curie, row_number() OVER (PARTITION BY b.id ORDER BY cn.row_id DESC) AS r FROM cn JOIN biolink_nodes b ON b.row_id = cn.row_id WHERE b.id <> ''),
    ke AS (SELECT curie, type, canonical_id FROM la WHERE r = 1 AND type IN ('drug', 'disease', 'gene/protein') AND canonical_id IS NOT NULL), ids AS (SELECT DISTINCT id, row_number() OVER (ORDER BY id) AS p FROM (SELECT DISTINCT id FROM biolink_nodes WHERE id <> '')), ed AS (SELECT a.id AS s, b.id AS o, a.p FROM ids a JOIN ids b ON b.p = a.p + 1)
    SELECT x.canonical_id AS x_id, x.type AS x_type, y.canonical_id AS y_id, CASE p % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.6 WHEN 3 THEN 0.5 WHEN 4 THEN 0.3 END::DOUBLE AS confidence_score, count(*)::BIGINT AS n FROM ed JOIN ke x ON x.curie = s JOIN ke y ON y.curie = o GROUP BY ALL""")
def load_biolink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between kept nodes of a node file and an edge file (each id linked to the next one), their ids canonical."""
    b = table(spark, sf_dir, "biolink_nodes")
    flat = lambda c: F.regexp_replace(c, r"[\t\n\r]", " ").alias(c)
    nodes = b.select("row_id", "id", flat("name"), "category", flat("equivalent_identifiers"), flat("upstream_data_source"))
    from lattiq.operators.linkpred import numbered

    ids = numbered(b.filter("id <> ''").select("id"), "id").select("id", (F.col("no") + 1).alias("p"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("knowledge_assertion", "logical_entailment", "statistical_association", "observation", "prediction", "not_provided", "other")]), (F.col("p") % 7 + 1).cast("int"))
    links = ids.join(ids.select(F.col("id").alias("object"), (F.col("p") - 1).alias("p")), "p").select("p", F.col("id").alias("subject"), F.lit("biolink:related_to").alias("predicate"), "object", F.lit("infores:x").alias("primary_knowledge_source"), F.lit("").alias("aggregator_knowledge_source"), F.lit("u").alias("upstream_data_source"), level.alias("knowledge_level"), F.lit("m").alias("agent_type"), F.lit("3").alias("num_references"))
    from lattiq.operators.bridges import first_wins
    from lattiq.plans.bridge_queries import _ontology

    refs = _references(spark, sf_dir)
    bridges = Bridges(pubchem=refs.filter("namespace = 'PUBCHEM.COMPOUND'").select(F.col("external_id").alias("cid"), "drugbank_id"), references=refs, ontology=first_wins(_ontology(spark, sf_dir), "doid", "mondo", "pos", "mondo"))
    edges, _ = gf.load_graph(spark, "biolink", _file(nodes, "row_id", header=True), _file(links, "p", header=True), keep={"drug", "disease", "gene/protein"}, bridges=bridges)
    return edges.groupBy("x_id", "x_type", "y_id", "confidence_score").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT mondo_id AS mondo, CASE WHEN right(doid, 1)::INT % 2 = 0 THEN doid ELSE 'MESH:D' || right(doid, 6) END AS other FROM do_diseases WHERE right(doid, 1)::INT <> 7""")
def load_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equivalent ids of a mapping file, whichever side the namespace is on."""
    d = table(spark, sf_dir, "do_diseases").withColumn("digit", F.expr("cast(right(doid, 1) AS int)"))
    predicate = F.when(F.col("digit") == 7, "skos:broadMatch").when(F.col("digit") % 3 == 0, "skos:exactMatch").when(F.col("digit") % 3 == 1, "skos:closeMatch").otherwise("owl:equivalentClass")
    other = F.when(F.col("digit") % 2 == 0, F.col("doid")).otherwise(F.expr("'MESH:D' || right(doid, 6)"))
    turned = F.col("digit") > 4
    m = d.select(F.col("mondo_id").alias("o"), F.when(turned, other).otherwise(F.col("mondo_id")).alias("subject_id"), predicate.alias("predicate_id"), F.when(turned, F.col("mondo_id")).otherwise(other).alias("object_id"))
    return gf.sssom(spark, _file(m, "o", header=True))


@query(r"""SELECT DISTINCT lower(trim(head_name)) AS chem_name, TRY_CAST(tail_id AS BIGINT) AS gene_id FROM train_triples WHERE triple_id % 3 <> 0 AND head_name IS NOT NULL AND trim(head_name) <> '' AND regexp_full_match(tail_id, '[0-9]{1,18}')""")
def load_chemical_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "train_triples").filter("head_name IS NOT NULL AND trim(head_name) <> ''").filter(_whole("tail_id"))
    organism = F.when(F.col("triple_id") % 3 == 0, "Mus musculus").otherwise("Homo sapiens")
    rows = t.select("triple_id", F.trim(F.regexp_replace("head_name", r"[\t\n\r]", " ")).alias("n"), F.lit("C1").alias("i"), F.lit("").alias("c"), F.lit("G").alias("g"), "tail_id", F.lit("f").alias("f"), organism.alias("o"))
    return gf.chemical_genes(spark, _file(rows, "triple_id", gz=True))


@query(r"""WITH k AS (SELECT edge_id, TRY_CAST(x_id AS BIGINT) AS g, y_id AS d, lower(trim(y_name)) AS n FROM kg_df WHERE x_type = 'gene/protein' AND y_type = 'disease' AND edge_id % 4 < 2 AND regexp_full_match(x_id, '[0-9]{1,18}') AND y_id IS NOT NULL AND y_name IS NOT NULL) SELECT g AS gene_id, d AS disease_id, arg_min(n, edge_id) AS disease_name FROM k GROUP BY g, d""")
def load_gene_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with direct evidence, the first row of each."""
    k = table(spark, sf_dir, "kg_df").filter("x_type = 'gene/protein' AND y_type = 'disease' AND y_id IS NOT NULL AND y_name IS NOT NULL").filter(_whole("x_id"))
    evidence = F.element_at(F.array(F.lit("therapeutic"), F.lit("marker/mechanism"), F.lit("inferred"), F.lit("")), (F.col("edge_id") % 4 + 1).cast("int"))
    rows = k.select("edge_id", F.lit("G").alias("s"), "x_id", F.trim("y_name").alias("n"), "y_id", evidence.alias("e"))
    return gf.gene_diseases(spark, _file(rows, "edge_id")).select("gene_id", "disease_id", "disease_name")


@query(r"""WITH x AS (SELECT trim(drugbank_id) AS db, upper(trim(namespace)) AS ns, trim(external_id) AS ext FROM drugbank_xref WHERE drugbank_id IS NOT NULL AND namespace IS NOT NULL AND external_id IS NOT NULL AND trim(external_id) <> ''),
    w AS (SELECT db, 'CAS' AS ns, ext FROM x WHERE ns = 'CAS' UNION ALL SELECT db, 'UNII', ext FROM x WHERE ns = 'UNII'), a AS (SELECT db, ns, ext, 1 AS priority FROM w UNION ALL SELECT db, 'PUBCHEM.COMPOUND', ext, 2 FROM x WHERE ns = 'PUBCHEM.COMPOUND' UNION ALL SELECT db, ns, ext, 3 FROM x)
    SELECT db AS drugbank_id, ns AS namespace, ext AS external_id, min(priority)::INT AS priority FROM a GROUP BY ALL""")
def load_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of three sources in order of priority: a wide file with packed cells, a bridge, and a long table."""
    x = table(spark, sf_dir, "drugbank_xref").dropna(subset=["drugbank_id", "namespace", "external_id"]).select("drugbank_id", F.upper(F.trim("namespace")).alias("namespace"), F.trim("external_id").alias("external_id")).filter("external_id <> ''")
    packed = x.filter("namespace IN ('CAS', 'UNII')").groupBy("drugbank_id").pivot("namespace", ["CAS", "UNII"]).agg(F.array_join(F.array_sort(F.collect_set("external_id")), "|"))
    wide = packed.select(F.col("drugbank_id").alias("o"), F.col("drugbank_id").alias("DrugBank ID"), F.col("CAS").alias("CAS Number"), F.col("UNII").alias("UNII Code"))
    links = gf.cross_references(spark, _file(wide, "o", ",", header=True), {"CAS Number": "CAS", "UNII Code": "UNII"})
    pubchem = x.filter("namespace = 'PUBCHEM.COMPOUND'").select("drugbank_id", F.col("external_id").alias("pubchem_cid"))
    return gf.combined_references(links, pubchem, x)


@query("SELECT row_id, id, category FROM biolink_nodes WHERE id IS NOT NULL")
def converted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet written as TSV and read again."""
    path = f"{shared_dir(spark)}/lattiq-{uuid.uuid4().hex}"
    gf.write_table(table(spark, sf_dir, "biolink_nodes").filter("id IS NOT NULL").select("row_id", "id", "category"), path, "tsv")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return gf.csv(spark, path, ["row_id", "id", "category"], sep="\t").select(F.col("row_id").cast("bigint").alias("row_id"), "id", "category")
