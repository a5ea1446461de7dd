"""Readers and writers of the file shapes in which graphs and bridges come. Schemas are always given, never inferred."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.functions.ids import level_confidence, source_tokens, type_prefix
from lattiq.operators.bridges import Bridges, canonical_nodes, canonical_type
from lattiq.operators.linkpred import numbered
from lattiq.operators.resample import numbered_within

EDGE_COLUMNS = ["relation", "display_relation", "x_index", "x_id", "x_type", "x_name", "x_source", "y_index", "y_id", "y_type", "y_name", "y_source"]
# The kind of thing that a CURIE prefix names.
PREFIX_TYPES = {"NCBIGENE": "Gene", "PUBCHEM.COMPOUND": "Drug", "DOID": "Disease", "GO": "GO", "UBERON": "Anatomy", "HP": "Phenotype", "CL": "Cell", "REACTOME": "Pathway", "KEGG": "Pathway"}


# The types of both ends of a predicate.
PREDICATE_TYPES = {
    "PPI": ("Gene/Protein", "Gene/Protein"), "DPI": ("Drug", "Gene/Protein"), "DDI": ("Drug", "Drug"),
    "DRUG_TARGET": ("Drug", "Gene/Protein"), "DRUG_CARRIER": ("Drug", "Gene/Protein"), "DRUG_ENZYME": ("Drug", "Gene/Protein"), "DRUG_TRANSPORTER": ("Drug", "Gene/Protein"),
    "PROTEIN_DISEASE_ASSOCIATION": ("Gene/Protein", "Disease"), "DRUG_DISEASE_ASSOCIATION": ("Drug", "Disease"),
    "PROTEIN_PATHWAY_ASSOCIATION": ("Gene/Protein", "Pathway"), "DRUG_PATHWAY_ASSOCIATION": ("Drug", "Pathway"), "DISEASE_PATHWAY_ASSOCIATION": ("Disease", "Pathway"),
    "MEMBER_OF_COMPLEX": ("Gene/Protein", "Complex"), "MEMBER_OF_PATHWAY": ("Complex", "Pathway"), "MEMBER_OF_TOP_LEVEL_PATHWAY": ("Complex", "Pathway"),
    "COMPLEX_IN_PATHWAY": ("Complex", "Pathway"), "COMPLEX_TOP_LEVEL_PATHWAY": ("Complex", "Pathway"), "HAS_PARENT_PATHWAY": ("Pathway", "Pathway"),
    "DISEASE_GENETIC_DISORDER": ("Disease", "GeneticDisorder"), "RELATED_GENETIC_DISORDER": ("Gene/Protein", "GeneticDisorder"), "DISEASE_SUPERGRP": ("Disease", "DiseaseCategory"),
    "DRUG_SIDEEFFECT_ASSOCIATION": ("Drug", "SideEffect"), "DRUG_INDICATION_ASSOCIATION": ("Drug", "Disease"), "DRUG_ATC_CODE": ("Drug", "ATC"),
    "PROTEIN_EXPRESSED_IN": ("Gene/Protein", "Tissue"), "PART_OF_TISSUE": ("Cell", "Tissue"),
}
# Which type an entity has that several predicates type differently.
TYPE_PRIORITY = {"Drug": 5, "Disease": 5, "Gene/Protein": 5, "Pathway": 5, "GeneticDisorder": 4, "SideEffect": 4, "ATC": 4, "DiseaseCategory": 3, "Tissue": 3, "Cell": 3, "Complex": 2, "unknown": 0}
#: Columns that file_order() adds.
ORDER = ["__file", "__block", "__row"]


def csv(spark: SparkSession, path: str, columns: list[str], header: bool = True, sep: str = ",", comment: str | None = None, malformed: str = "fail") -> DataFrame:
    """Strings only; .gz is read as it is. With a header only the columns named are kept.

    A malformed row fails the read; malformed="skip" drops it, for bridges that are known to hold such rows."""
    mode = {"fail": "FAILFAST", "skip": "DROPMALFORMED"}[malformed]
    reader = spark.read.option("sep", sep).option("header", header).option("mode", mode).option("quote", '"').option("escape", '"').option("columnPruning", False)
    if comment:
        reader = reader.option("comment", comment)
    if header:
        return reader.csv(path).select(*[f"`{c}`" for c in columns], "_metadata")
    return reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path).select(*[f"`{c}`" for c in columns], "_metadata")


def file_order(rows: DataFrame) -> DataFrame:
    """rows of csv() with the columns ORDER: their place in the files, which are taken in order of name."""
    return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")).drop("_metadata")


def node_table(edges: DataFrame) -> DataFrame:
    """(idx, id, type, name, uid) of edge ends; heads before tails, the first row of the file wins; edges as of file_order()."""
    order = F.struct("k", *ORDER)
    ends = edges.select(*ORDER, F.explode(F.array(*[F.struct(F.col(f"{s}_index").alias("idx"), F.lit(k).alias("k"), F.col(f"{s}_id").alias("id"), F.col(f"{s}_type").alias("type"), F.col(f"{s}_name").alias("name")) for k, s in enumerate("xy")])).alias("n")).select("n.*", *ORDER)
    one = ends.groupBy("idx").agg(F.min_by(F.struct("id", "type", "name"), order).alias("n"))
    return one.select("idx", "n.id", "n.type", "n.name", F.concat_ws("/", "n.type", "n.id").alias("uid"))


def single_edge_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One CSV with everything; extra columns are not read."""
    e = file_order(csv(spark, path, EDGE_COLUMNS)).withColumns({c: F.col(c).cast("bigint") for c in ("x_index", "y_index")})
    return e.drop(*ORDER), node_table(e)


def _ends(nodes: DataFrame, s: str, key: str) -> DataFrame:
    return nodes.select(F.col("id").alias(key), F.col("idx").alias(f"{s}_index"), F.col("id").alias(f"{s}_id"), F.col("type").alias(f"{s}_type"), F.col("name").alias(f"{s}_name"))


def node_edge_tsv(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, kind) and edges (source, metaedge, target); edges with an unknown end are dropped; idx in order of the file.

    A repeated id keeps all its rows; edges go to the last one."""
    n = numbered_within(file_order(csv(spark, nodes_path, ["id", "name", "kind"], sep="\t")), [], ORDER, "idx")
    n = n.select("idx", "id", F.col("kind").alias("type"), "name", F.concat_ws("/", "kind", "id").alias("uid"))
    last = n.filter("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("idx", "type", "name")).alias("n")).select("id", "n.*")
    e = csv(spark, edges_path, ["source", "metaedge", "target"], sep="\t").drop("_metadata")
    j = e.join(_ends(last, "x", "source"), "source").join(_ends(last, "y", "target"), "target").withColumnRenamed("metaedge", "relation")
    return j.drop("source", "target"), n


def _from_triples(t: DataFrame, type_of: Callable[[str], Column], extra: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of triples (head, relation, tail); idx in order of id; the id is the name."""
    t = t.dropna(subset=["head", "tail"])
    no = numbered(t.select(F.explode(F.array("head", "tail")).alias("id")), "id")
    end = lambda s, key: no.select(F.col("id").alias(key), F.col("no").alias(f"{s}_index"))
    j = t.join(end("x", "head"), "head").join(end("y", "tail"), "tail")
    e = j.select("relation", "x_index", F.col("head").alias("x_id"), type_of("head").alias("x_type"), F.col("head").alias("x_name"), "y_index", F.col("tail").alias("y_id"), type_of("tail").alias("y_type"), F.col("tail").alias("y_name"), *extra)
    n = no.select(F.col("no").alias("idx"), "id", type_of("id").alias("type"), F.col("id").alias("name"), F.concat_ws("/", type_of("id"), "id").alias("uid"))
    return e, n


def prefixed_triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header-less triples whose ids are Type::local; without a prefix the type is "unknown"."""
    return _from_triples(csv(spark, path, ["head", "relation", "tail"], header=False, sep="\t").drop("_metadata"), lambda c: type_prefix(F.col(c)))


def high_quality(score: Column, source: Column) -> Column:
    """Scored sources need 700 points, expression calls a good grade; any other source passes."""
    number = score.try_cast("double")
    return F.when(source.isin("STRING", "STITCH"), F.coalesce(number >= 700, F.lit(False))).when(source == "Bgee", F.coalesce(score.isin("gold quality", "high quality"), F.lit(False))).otherwise(F.lit(True))


def scored_triples(spark: SparkSession, path: str, hq_filter: bool = True, drug_bridge: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Header-less head, relation, tail, score, source with CURIE ids. drug_bridge: (pubchem_cid, drugbank_id), smallest id wins."""
    t = csv(spark, path, ["head", "relation", "tail", "score", "source"], header=False, sep="\t").drop("_metadata")
    t = t.withColumns({c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\r$", "") for c in t.columns})
    if hq_filter:
        t = t.filter(high_quality(F.col("score"), F.col("source")))
    known = F.create_map(*[F.lit(x) for kv in PREFIX_TYPES.items() for x in kv])

    def type_of(c: str) -> Column:
        prefix = F.substring_index(c, ":", 1)
        return F.when(~F.col(c).contains(":"), "unknown").otherwise(F.coalesce(known[prefix], prefix))

    e, n = _from_triples(t, type_of, ["score", F.col("source").alias("x_source"), F.col("source").alias("y_source")])
    if drug_bridge is not None:
        b = drug_bridge.groupBy(F.concat(F.lit("PUBCHEM.COMPOUND:"), F.col("pubchem_cid").cast("string")).alias("id")).agg(F.min("drugbank_id").alias("drugbank_id"))
        n = n.join(b, "id", "left")
    return e, n


def typed_triples(spark: SparkSession, path: str, predicates: DataFrame | None = None, metadata_glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Bare ids typed by predicate. predicates: (relation, x_type, y_type, priority), without them PREDICATE_TYPES.

    An entity takes its type of highest priority, of equal ones the first in the file, heads before tails; one that only
    unlisted predicates name is "unknown". metadata_glob: files of (id, attribute, value); the first NAME of the first file
    wins, an entity without name is named by its id."""
    t = file_order(csv(spark, path, ["head", "relation", "tail"], header=False, sep="\t").dropna(subset=["head", "relation", "tail"]))
    if predicates is None:
        rows = [(p, x, y, TYPE_PRIORITY[x], TYPE_PRIORITY[y]) for p, (x, y) in PREDICATE_TYPES.items()]
        listed = spark.createDataFrame(rows, "relation string, x_type string, y_type string, x_rank int, y_rank int")
    else:
        listed = predicates.select("relation", "x_type", "y_type", F.col("priority").alias("x_rank"), F.col("priority").alias("y_rank"))
    typed = t.join(F.broadcast(listed), "relation", "left")  # one row a predicate
    vote = lambda c, s, k: F.struct(F.col(c).alias("id"), F.coalesce(f"{s}_type", F.lit("unknown")).alias("type"), F.coalesce(f"{s}_rank", F.lit(0)).alias("rank"), F.lit(k).alias("k"))
    votes = typed.select(*ORDER, F.explode(F.array(vote("head", "x", 0), vote("tail", "y", 1))).alias("v")).select("v.*", *ORDER)
    types = votes.groupBy("id").agg(F.min_by("type", F.struct(-F.col("rank"), "k", *ORDER)).alias("type"))
    n = types.join(numbered(types, "id"), "id").withColumnRenamed("no", "idx")
    if metadata_glob:
        m = file_order(csv(spark, metadata_glob, ["id", "attribute", "value"], header=False, sep="\t")).filter("attribute = 'NAME'")
        n = n.join(m.groupBy("id").agg(F.min_by("value", F.struct(*ORDER)).alias("name")), "id", "left")
    else:
        n = n.withColumn("name", F.lit(None).cast("string"))
    n = n.select("idx", "id", "type", F.coalesce("name", "id").alias("name"), F.concat_ws("/", "type", "id").alias("uid"))
    e = t.select("head", "relation", "tail").join(_ends(n, "x", "head"), "head").join(_ends(n, "y", "tail"), "tail").drop("head", "tail")
    return e, n


def biolink(spark: SparkSession, nodes_path: str, edges_path: str, keep: set[str] | None = None, bridges: Bridges = Bridges(), trim_isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes of the canonical types in keep (all without it), their ids canonicalised over bridges, and the edges between kept nodes.

    A disease that no bridge leads to a canonical id goes, unless all types are kept. Of repeated ids the last row wins; idx
    follows the file. Edges bear the provenance of both nodes and their own; isolated nodes go unless asked for."""
    columns = ["id", "name", "category", "equivalent_identifiers", "upstream_data_source"]
    n = file_order(csv(spark, nodes_path, columns, sep="\t")).na.fill("", columns).filter("id <> ''").withColumn("type", canonical_type(F.col("category")))
    if keep:
        n = n.filter(F.col("type").isin(list(keep)))
    n = numbered_within(n, [], ORDER, "row").select("row", "id", "type", "name", F.col("equivalent_identifiers").alias("equivalents"), source_tokens(F.col("upstream_data_source")).alias("upstream_pipeline"))
    last = n.groupBy("id").agg(F.max_by(F.struct("row", "type", "name", "equivalents", "upstream_pipeline"), "row").alias("n")).select("id", "n.*")
    n = canonical_nodes(last, bridges, keep_all=not keep)
    n = n.join(numbered(n, "row").withColumnRenamed("no", "idx"), "row").select("idx", F.col("id").alias("curie"), F.col("canonical_id").alias("id"), "type", "name", "drugbank_id", "ncbigene_id", "reactome_id", "doid_id", "upstream_pipeline")
    named = ["subject", "predicate", "object", "primary_knowledge_source", "aggregator_knowledge_source", "upstream_data_source", "knowledge_level", "agent_type", "num_references"]
    e = csv(spark, edges_path, named, sep="\t").drop("_metadata")
    end = lambda s, key: n.select(F.col("curie").alias(key), *[F.col(c).alias(f"{s}_{o}") for c, o in (("idx", "index"), ("id", "id"), ("type", "type"), ("name", "name"), ("upstream_pipeline", "source"))])
    j = e.join(end("x", "subject"), "subject").join(end("y", "object"), "object").select(
        F.replace("predicate", F.lit("biolink:"), F.lit("")).alias("relation"), "x_index", "x_id", "x_type", "x_name", "x_source", "y_index", "y_id", "y_type", "y_name", "y_source", F.col("primary_knowledge_source").alias("edge_source"), F.col("aggregator_knowledge_source").alias("aggregator_source"),
        F.col("upstream_data_source").alias("edge_upstream"), "knowledge_level", level_confidence(F.col("knowledge_level")).alias("confidence_score"), "agent_type", F.col("num_references").try_cast("double").alias("num_references"))
    if trim_isolated:
        n = n.join(j.select(F.explode(F.array("x_index", "y_index")).alias("idx")).distinct(), "idx", "left_semi")
    return j, n


def sssom(spark: SparkSession, path: str, namespace: str = "MONDO") -> DataFrame:
    """(mondo, other) of exact, close and equivalent mappings, whichever side the namespace is on; # lines are comments."""
    m = csv(spark, path, ["subject_id", "predicate_id", "object_id"], sep="\t", comment="#")
    m = m.filter(F.col("predicate_id").isin("skos:exactMatch", "skos:closeMatch", "owl:equivalentClass"))
    ours = lambda c: F.col(c).startswith(f"{namespace}:")
    return m.filter(ours("subject_id")).select(F.col("subject_id").alias("mondo"), F.col("object_id").alias("other")).unionByName(m.filter(ours("object_id") & ~ours("subject_id")).select(F.col("object_id").alias("mondo"), F.col("subject_id").alias("other"))).distinct()


def chemical_genes(spark: SparkSession, path: str, organism: str = "Homo sapiens") -> DataFrame:
    """(chem_name, gene_id) of a positional TSV with # comments, for one organism; names in lower case, ids that are numbers."""
    t = csv(spark, path, ["chem_name", "chem_id", "cas", "gene_symbol", "gene_id", "forms", "organism"], header=False, sep="\t", comment="#")
    return t.filter(F.col("organism") == organism).select(F.lower("chem_name").alias("chem_name"), F.col("gene_id").try_cast("bigint").alias("gene_id")).dropna().distinct()


# Evidence that states a gene's part in a disease directly.
DIRECT_EVIDENCE = ("marker/mechanism", "therapeutic")


def gene_diseases(spark: SparkSession, path: str, evidence: tuple[str, ...] = DIRECT_EVIDENCE) -> DataFrame:
    """(gene_id, disease_id, gene_symbol, disease_name) of a positional TSV with # comments, of the evidence given; the first row of each pair."""
    t = file_order(csv(spark, path, ["gene_symbol", "gene_id", "disease_name", "disease_id", "evidence"], header=False, sep="\t", comment="#"))
    kept = t.filter(F.col("evidence").isin(list(evidence))).withColumn("gene_id", F.col("gene_id").try_cast("bigint")).dropna(subset=["gene_id", "disease_id"])
    one = kept.groupBy("gene_id", "disease_id").agg(F.min_by(F.struct("gene_symbol", "disease_name"), F.struct(*ORDER)).alias("n"))
    return one.select("gene_id", "disease_id", "n.gene_symbol", F.lower("n.disease_name").alias("disease_name"))


def combined_references(links: DataFrame, pubchem: DataFrame | None = None, other: DataFrame | None = None) -> DataFrame:
    """Distinct (drugbank_id, namespace, external_id, priority) of up to three sources, the smallest priority of equal rows.

    links and other: (drugbank_id, namespace, external_id); pubchem: (drugbank_id, pubchem_cid). Blank parts are left out."""
    parts = [links.withColumn("priority", F.lit(1))]
    if pubchem is not None:
        parts.append(pubchem.select("drugbank_id", F.lit("PUBCHEM.COMPOUND").alias("namespace"), F.col("pubchem_cid").cast("string").alias("external_id"), F.lit(2).alias("priority")))
    if other is not None:
        parts.append(other.withColumns({"namespace": F.upper("namespace"), "priority": F.lit(3)}))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    cleaned = whole.select(*[F.trim(c).alias(c) for c in ("drugbank_id", "namespace", "external_id")], "priority").filter("drugbank_id <> '' AND namespace <> '' AND external_id <> ''")
    return cleaned.groupBy("drugbank_id", "namespace", "external_id").agg(F.min("priority").alias("priority"))


def cross_references(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """(drugbank_id, namespace, external_id) of a wide CSV; columns: its column -> namespace; several ids stand between |."""
    wide = csv(spark, path, ["DrugBank ID", *columns])
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    long = wide.select(F.col("DrugBank ID").alias("drugbank_id"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()]).unpivot("drugbank_id", list(names.values()), "c", "packed")
    of = F.create_map(*[F.lit(x) for c, n in names.items() for x in (n, columns[c])])
    return long.filter("packed IS NOT NULL").select("drugbank_id", of[F.col("c")].alias("namespace"), F.explode(F.split("packed", r"\|")).alias("external_id")).withColumn("external_id", F.trim("external_id")).filter("external_id <> ''").distinct()


@dataclass(frozen=True)
class Config:
    """Where the graphs lie and with which options they are read; JSON or YAML beside the data."""

    graphs: dict = field(default_factory=dict)
    base_dir: str = "."


def find_config(start: str | Path, names: tuple[str, ...] = ("config.json", "config.yaml")) -> Path:
    """The config file in start or the folder above it."""
    for folder in (Path(start), Path(start).resolve().parent):
        for name in names:
            if (folder / name).exists():
                return folder / name
    raise FileNotFoundError(names[0])


def load_config(path: str | Path) -> Config:
    text = Path(path).read_text()
    if str(path).endswith((".yaml", ".yml")):
        import yaml  # only where a config is written in it

        read = yaml.safe_load(text) or {}
    else:
        read = json.loads(text)
    return Config(read.get("graphs", {}), str(Path(path).parent))


LOADERS: dict[str, Callable] = {"single_edge_csv": single_edge_csv, "node_edge_tsv": node_edge_tsv, "prefixed_triples": prefixed_triples, "scored_triples": scored_triples, "typed_triples": typed_triples, "biolink": biolink}


def load_graph(spark: SparkSession, shape: str, *args, **options) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) by the loader of a file shape."""
    if shape not in LOADERS:
        raise ValueError(f"unknown graph shape {shape!r}; known: {sorted(LOADERS)}")
    return LOADERS[shape](spark, *args, **options)


def _modified(spark: SparkSession, path: str) -> int:
    """When a file, or the newest file of a folder, was last changed; -1 if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return -1
    return max([fs.getFileStatus(place).getModificationTime(), *(s.getModificationTime() for s in (fs.listStatus(place) if fs.getFileStatus(place).isDirectory() else []))])


def cached(spark: SparkSession, folder: str, parameters: dict, build: Callable[[], DataFrame], sources: tuple[str, ...] = ()) -> DataFrame:
    """The table of build() kept as Parquet under folder by its parameters.

    It is built again if it was not finished, or if one of sources changed since."""
    key = hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:8]
    path = f"{folder}/cache-{key}"
    kept = _modified(spark, f"{path}/_SUCCESS")
    if kept < 0 or any(_modified(spark, s) >= kept for s in sources):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, CSV with header, TSV or JSON lines; the committer makes it appear at once."""
    if kind in ("csv", "tsv"):
        df.write.mode("overwrite").option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind in ("parquet", "json"):
        getattr(df.write.mode("overwrite"), kind)(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def write_report(values: dict, path: str | Path, kind: str = "json") -> None:
    """A small nested report (scalars, lists, arrays) as JSON, pickle or npz (arrays by name); written beside its name and moved there."""
    import os
    import pickle

    part = f"{path}.part"
    if kind == "json":
        Path(part).write_text(json.dumps(values, indent=2, sort_keys=True, default=str))
    elif kind in ("pickle", "npz"):
        with open(part, "wb") as f:
            if kind == "pickle":
                pickle.dump(values, f)
            else:
                import numpy as np

                np.savez(f, **values)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    os.replace(part, path)


def top_frequent(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values of column, with rank (a report)."""
    c = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)
    return c.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), column)))
