"""Bridges between id schemes, the cascades that canonicalise ids over them, and resolvers of names and ids to nodes.

A bridge is a table of two id columns, mostly with an order column; "first wins" and "last wins" are minima and maxima
over that order, so a bridge of any size is aggregated, never held as a dictionary. Lookups are left joins; Spark
broadcasts a bridge only where its size allows it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions import ids

# The canonical type of a Biolink category.
CATEGORY_TYPES = {
    "SmallMolecule": "drug", "Drug": "drug", "ChemicalEntity": "drug", "ChemicalMixture": "drug", "MolecularMixture": "drug",
    "ComplexMolecularMixture": "drug", "ProcessedMaterial": "drug", "ChemicalOrDrugOrTreatment": "drug", "Food": "drug",
    "Disease": "disease", "DiseaseOrPhenotypicFeature": "disease", "PathologicalProcess": "disease",
    "PhenotypicFeature": "effect/phenotype", "BehavioralFeature": "effect/phenotype",
    "Gene": "gene/protein", "Protein": "gene/protein", "Polypeptide": "gene/protein", "GeneOrGeneProduct": "gene/protein", "GeneFamily": "gene/protein",
    "GenomicEntity": "gene/protein", "NucleicAcidEntity": "gene/protein", "Transcript": "gene/protein", "Exon": "gene/protein",
    "RNAProduct": "gene/protein", "NoncodingRNAProduct": "gene/protein", "MicroRNA": "gene/protein",
    "BiologicalProcess": "biological_process", "PhysiologicalProcess": "biological_process", "MolecularActivity": "molecular_function",
    "CellularComponent": "cellular_component", "Pathway": "pathway", "AnatomicalEntity": "anatomy", "GrossAnatomicalStructure": "anatomy",
    "Cell": "anatomy", "CellLine": "anatomy", "OrganismTaxon": "organism", "SequenceVariant": "variant", "Haplotype": "variant",
    "Procedure": "procedure", "MolecularEntity": "molecular_entity",
}
# Predicates that state that two ids mean the same.
EQUIVALENT = ("skos:exactMatch", "skos:closeMatch", "owl:equivalentClass")


def canonical_type(category: Column) -> Column:
    """The canonical type of a category: listed as it is, else its first listed word, else itself in lower case."""
    known = F.create_map(*[F.lit(x) for kv in CATEGORY_TYPES.items() for x in kv])
    bare = F.trim(F.replace(F.coalesce(category, F.lit("")), F.lit("biolink:"), F.lit("")))
    words = F.regexp_extract_all(bare, F.lit(r"([A-Z][a-zA-Z0-9/]*)"), F.lit(1))
    first = F.get(F.filter(F.transform(words, lambda w: known[w]), lambda t: t.isNotNull()), F.lit(0))
    return F.coalesce(known[bare], first, F.lower(bare))


def first_wins(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, value) of the first row of each key; null keys and values are left out."""
    return rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def last_wins(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def ontology_bridge(rows: DataFrame) -> DataFrame:
    """(doid, mondo, pos) of rows (doid, mondo_id, pos) as bare numbers; many to many."""
    r = rows.filter("doid IS NOT NULL AND mondo_id IS NOT NULL")
    return r.select(ids.bare_number(F.col("doid"), "DOID").alias("doid"), ids.bare_number(F.col("mondo_id"), "MONDO").alias("mondo"), "pos").distinct()


def mesh_bridge(rows: DataFrame) -> DataFrame:
    """(mesh, doid) of rows (mesh_id, doid, source): notes cut off, the ontology's own mapping before others, then smallest; with the MESH: prefix."""
    clean = rows.filter("doid IS NOT NULL").select(ids.mesh_clean(F.col("mesh_id")).alias("mesh"), ids.bare_number(F.col("doid"), "DOID").alias("doid"), "source")
    rank = F.when(F.col("source") == "DO", 0).when(F.col("source") == "MONDO", 1).otherwise(2)
    return clean.filter("mesh <> ''").groupBy("mesh").agg(F.min_by("doid", F.struct(rank, "doid")).alias("doid"))


def mesh_to_mondo(mesh: DataFrame, ontology: DataFrame) -> DataFrame:
    """(mesh, mondo), first of each: the bridge from MeSH over the disease ontology; mesh: (mesh, doid), ontology: (doid, mondo, pos)."""
    first = first_wins(ontology, "doid", "mondo", "pos", "mondo")
    return mesh.join(first, "doid").select("mesh", "mondo")


def mapping_bridge(rows: DataFrame, namespace: str = "MONDO") -> DataFrame:
    """(curie, number), first of each, of mappings (subject_id, predicate_id, object_id, pos) between the namespace and others."""
    m = rows.filter(F.col("predicate_id").isin(*EQUIVALENT))
    ours = lambda c: F.col(c).startswith(f"{namespace}:")
    both = m.select("pos", F.when(ours("subject_id") & ~ours("object_id"), F.struct(F.col("object_id").alias("c"), F.col("subject_id").alias("m"))).when(ours("object_id") & ~ours("subject_id"), F.struct(F.col("subject_id").alias("c"), F.col("object_id").alias("m"))).alias("p")).filter("p IS NOT NULL")
    return first_wins(both.select(F.col("p.c").alias("curie"), ids.bare_number(F.col("p.m"), namespace).alias("number"), "pos"), "curie", "number", "pos", "number")


def protein_bridge(rows: DataFrame, ambiguous: str = "first") -> DataFrame:
    """(entry, gene) of rows (entry, gene_ids, pos) whose gene ids stand between ;: the first one, or only those with one."""
    genes = F.filter(F.transform(F.split("gene_ids", ";"), lambda g: F.trim(g)), lambda g: g.rlike(r"^\d+$"))
    r = rows.select(F.trim("entry").alias("entry"), genes.alias("g"), "pos").filter("size(g) > 0")
    if ambiguous == "reject":
        r = r.filter("size(g) = 1")
    elif ambiguous != "first":
        raise ValueError(f"unknown way {ambiguous!r}; known: first, reject")
    return first_wins(r.select("entry", F.get("g", F.lit(0)).alias("gene"), "pos"), "entry", "gene", "pos", "gene")


def symbol_bridge(rows: DataFrame) -> DataFrame:
    """(symbol, gene) of rows (names, gene_ids, pos): every word of names in capitals, the first gene id; the last row wins."""
    r = rows.filter("gene_ids IS NOT NULL").select(F.explode(F.split(F.trim("names"), r"\s+")).alias("symbol"), F.trim(F.substring_index("gene_ids", ";", 1)).alias("gene"), "pos")
    return last_wins(r.filter("symbol <> ''").select(F.upper("symbol").alias("symbol"), "gene", "pos"), "symbol", "gene", "pos", "gene")


def exploded_ids(rows: DataFrame, field: str, sep: str = ";", unambiguous: bool = False) -> DataFrame:
    """rows once for each trimmed id in field, as "member"; unambiguous: only rows with a single one."""
    members = F.filter(F.transform(F.split(F.col(field), rf"\Q{sep}\E"), lambda x: F.trim(x)), lambda x: x != "")
    r = rows.withColumn("__m", members)
    return (r.filter("size(__m) = 1") if unambiguous else r).withColumn("member", F.explode("__m")).drop("__m")


@dataclass(frozen=True)
class Bridges:
    """What a graph's ids are canonicalised over; any of them may be missing."""

    pubchem: DataFrame | None = None  # (cid, drugbank_id), one row a cid
    references: DataFrame | None = None  # (namespace in capitals, external_id, drugbank_id), one row an external id
    ontology: DataFrame | None = None  # (doid, mondo), one row a doid
    mesh: DataFrame | None = None  # (mesh without prefix, mondo), one row a mesh
    mappings: DataFrame | None = None  # (curie, number), one row a curie
    proteins: DataFrame | None = None  # (entry, gene), one row an entry


def _lookup(rows: DataFrame, bridge: DataFrame | None, on: str, key: str, value: str, name: str) -> DataFrame:
    if bridge is None:
        return rows.withColumn(name, F.lit(None).cast("string"))
    return rows.join(bridge.select(F.col(key).alias(on), F.col(value).alias(name)), on, "left")


def _first_token(rows: DataFrame, bridge: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows (row, haystack, ..) with the value of the first CURIE of haystack that the bridge knows."""
    tokens = rows.select("row", F.posexplode(ids.curies(F.col("haystack"))).alias("pos", "curie"))
    tokens = tokens.withColumns({"ns": F.upper(F.substring_index("curie", ":", 1)), "ext": F.regexp_replace("curie", "^[^:]*:", "")})
    hits = tokens.join(bridge, keys).groupBy("row").agg(F.min_by(value, "pos").alias(name))
    return rows.join(hits, "row", "left")


def canonical_nodes(nodes: DataFrame, bridges: Bridges, keep_all: bool = False) -> DataFrame:
    """nodes (row, id, type, equivalents) with drugbank_id, ncbigene_id, reactome_id, doid_id, canonical_id.

    row is unique. Drugs: a DrugBank id, else over PubChem, else the first reference known, else their id. Diseases: a
    MONDO number, else over the disease ontology, over MeSH, over mappings of their id, then of their equivalents; others
    go, or with keep_all keep their id. Genes: a gene number, else over their protein, else their id. Pathways: a Reactome
    id, else their id. Anything else keeps its id. Missing ids are null.
    """
    h = nodes.withColumn("haystack", F.concat_ws(" ", "id", "equivalents"))
    x = lambda kind: ids.extract(F.col("haystack"), kind)
    h = h.withColumns({"direct": x("drugbank"), "gene": x("ncbigene"), "reactome_id": x("reactome"), "doid_id": x("doid"), "mondo": ids.mixed_number(x("mondo")), "cid": x("pubchem"), "mesh": x("mesh"), "entry": ids.first_accession(x("uniprot"))})
    drug, disease, gene = (F.col("type") == t for t in ("drug", "disease", "gene/protein"))
    h = _lookup(h, bridges.pubchem, "cid", "cid", "drugbank_id", "by_cid")
    h = _lookup(h, bridges.ontology, "doid_id", "doid", "mondo", "by_doid")
    h = _lookup(h, bridges.mesh, "mesh", "mesh", "mondo", "by_mesh")
    h = _lookup(h, bridges.mappings, "id", "curie", "number", "by_id")
    h = _lookup(h, bridges.proteins, "entry", "entry", "gene", "by_protein")
    none = F.lit(None).cast("string")
    if bridges.references is not None:
        refs = bridges.references.select(F.col("namespace").alias("ns"), F.col("external_id").alias("ext"), F.col("drugbank_id").alias("db"))
        h = _first_token(h, refs, ["ns", "ext"], "db", "by_reference")
    else:
        h = h.withColumn("by_reference", none)
    if bridges.mappings is not None:
        h = _first_token(h, bridges.mappings.select("curie", F.col("number").alias("m")), ["curie"], "m", "by_equivalent")
    else:
        h = h.withColumn("by_equivalent", none)
    db = F.coalesce("direct", F.when(drug, F.coalesce("by_cid", "by_reference")))
    entrez = F.coalesce("gene", F.when(gene, F.col("by_protein")))
    mondo = F.coalesce("mondo", "by_doid", "by_mesh", "by_id", "by_equivalent", F.col("id") if keep_all else none)
    canonical = F.when(drug, F.coalesce(db, "id")).when(disease, mondo).when(gene, F.coalesce(entrez, "id")).when(F.col("type") == "pathway", F.coalesce("reactome_id", "id")).otherwise(F.col("id"))
    out = h.select(*nodes.columns, db.alias("drugbank_id"), entrez.alias("ncbigene_id"), "reactome_id", "doid_id", canonical.alias("canonical_id"))
    return out.filter("canonical_id IS NOT NULL")


# --- id schemes --------------------------------------------------------------------------------------------------


def disease_numbers(rows: DataFrame, field: str, scheme: str, ontology: DataFrame, mesh: DataFrame, sep: str | None = None) -> DataFrame:
    """Distinct (doid) that the disease ids in field stand for.

    Schemes: "mondo" (bare numbers, sep between the members of a group; every doid of each), "doid" (with prefix; others
    have none), "doid_mesh" (either prefix), "mesh" (bare MeSH). ontology: (doid, mondo), mesh: (mesh with prefix, doid)."""
    raw = rows.select(F.trim(F.col(field).cast("string")).alias("i")).filter("i <> ''").distinct()
    own = raw.filter("i LIKE 'DOID:%'").select(F.ltrim(F.replace("i", F.lit("DOID:"), F.lit("")), F.lit("0")).alias("doid"))
    if scheme == "mondo":
        members = raw.select(F.explode(F.split("i", rf"\Q{sep}\E")).alias("i")) if sep else raw
        return members.select(ids.bare_number(F.trim("i"), "").alias("mondo")).join(ontology, "mondo").select("doid").distinct()
    if scheme == "doid":
        return own.distinct()
    if scheme == "doid_mesh":
        return own.unionByName(raw.select(F.col("i").alias("mesh")).join(mesh, "mesh").select("doid")).distinct()
    if scheme == "mesh":
        return raw.select(F.concat(F.lit("MESH:"), "i").alias("mesh")).join(mesh, "mesh").select("doid").distinct()
    raise ValueError(f"unknown disease id scheme {scheme!r}")


def to_mondo(rows: DataFrame, field: str, ontology: DataFrame, mesh: DataFrame, name: str = "mondo") -> DataFrame:
    """rows with the first MONDO number of an id DOID:*, MESH:* or bare MeSH in field; null for any other id."""
    i = F.trim(F.col(field).cast("string"))
    keyed = rows.withColumns({"__doid": F.when(i.startswith("DOID:"), ids.bare_number(i, "DOID")), "__mesh": F.when(i.startswith("MESH:"), i).when(ids.bare_mesh(i), F.concat(F.lit("MESH:"), i))})
    over = keyed.join(mesh.select(F.col("mesh").alias("__mesh"), F.col("doid").alias("__over")), "__mesh", "left").withColumn("__doid", F.coalesce("__doid", "__over"))
    first = first_wins(ontology, "doid", "mondo", "pos", "mondo").select(F.col("doid").alias("__doid"), F.col("mondo").alias(name))
    return over.join(first, "__doid", "left").select(*rows.columns, name)


def index_of_ids(nodes: DataFrame, scheme: str, ontology: DataFrame, mesh: DataFrame) -> DataFrame:
    """(kind, key, idx): drugs by DrugBank id, diseases by MONDO number under the scheme of the graph; the last row wins.

    nodes: (idx, id, type, row), with drugbank_id where it was attached before. A grouped id counts for each member."""
    low = F.lower("type")
    attached = F.col("drugbank_id") if "drugbank_id" in nodes.columns else F.lit(None).cast("string")
    drugs = nodes.filter(low.isin("drug", "compound")).select(F.lit("drug").alias("kind"), F.coalesce(attached, F.nullif(F.regexp_extract("id", r"(DB\d{5})", 1), F.lit(""))).alias("key"), "idx", "row")
    d = nodes.filter(low == "disease").select("id", "idx", "row")
    of_mesh = mesh.join(ontology.select("doid", "mondo").distinct(), "doid").select("mesh", "mondo")
    by_doid = d.withColumn("doid", F.regexp_extract("id", r"DOID:(\d+)", 1)).join(ontology.select("doid", "mondo").distinct(), "doid").select("mondo", "idx", "row")
    by_mesh = lambda pattern: d.withColumn("mesh", F.concat(F.lit("MESH:"), F.regexp_extract("id", pattern, 1))).join(of_mesh, "mesh").select("mondo", "idx", "row")
    if scheme == "mondo":
        diseases = d.select(F.explode(F.split("id", "_")).alias("m"), "idx", "row").select(ids.bare_number(F.trim("m"), "").alias("mondo"), "idx", "row")
    elif scheme == "doid":
        diseases = by_doid
    elif scheme == "doid_mesh":
        diseases = by_doid.unionByName(by_mesh(r"MESH:(D\d+)"))
    elif scheme == "mesh":
        diseases = by_mesh(r"^([DC]\d+)")
    else:
        raise ValueError(f"unknown disease id scheme {scheme!r}")
    both = drugs.unionByName(diseases.select(F.lit("disease").alias("kind"), F.col("mondo").alias("key"), "idx", "row")).filter("key IS NOT NULL")
    return both.groupBy("kind", "key").agg(F.max_by("idx", F.struct("row", "idx")).alias("idx"))


# --- resolvers ---------------------------------------------------------------------------------------------------


def resolve_drugs(wanted: DataFrame, nodes: DataFrame, ways: tuple[str, ...] = ("uid", "id", "drugbank", "name")) -> DataFrame:
    """wanted (drug_id, drug_name) with idx: by the first of ways that finds a drug; nodes: (idx, id, type, name, row) and drugbank_id.

    "uid" looks for the type and the id, "id" for the id of any node, "drugbank" for an attached DrugBank id, "name" for a
    drug of that name in any letter case. First rows win; a drug that nothing finds has a null idx."""
    drug = F.lower("type").isin("drug", "compound", "smallmolecule")
    attached = F.col("drugbank_id") if "drugbank_id" in nodes.columns else F.lit(None).cast("string")
    keys = {"uid": (nodes.filter(drug), F.col("id"), "drug_id"), "id": (nodes, F.col("id"), "drug_id"), "drugbank": (nodes.filter(drug), attached, "drug_id"), "name": (nodes.filter(drug), F.lower("name"), "drug_name")}
    out = wanted.withColumn("__name", F.lower("drug_name"))
    for way in ways:
        rows, key, on = keys[way]
        table = first_wins(rows.select(key.alias("k"), "idx", "row"), "k", "idx", "row", "idx").select(F.col("k").alias("__name" if on == "drug_name" else on), F.col("idx").alias(f"__by_{way}"))
        out = out.join(table, "__name" if on == "drug_name" else on, "left")
    return out.select(*wanted.columns, F.coalesce(*[f"__by_{w}" for w in ways]).alias("idx"))


def resolve_terms(terms: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """(term, idx) of distinct terms: an exact alias, else the exact term, else the shortest name with the alias in it, else with the term.

    aliases: (term, alias), one alias a term, its own where it has none; names: (name, idx). Letter case plays no part;
    ties go to the smallest name and idx."""
    t = terms.select(F.lower("term").alias("t"), "term").distinct().join(aliases.select(F.lower("term").alias("t"), F.lower("alias").alias("a")), "t", "left").withColumn("a", F.coalesce("a", "t")).filter("t <> ''")
    n = names.filter("name IS NOT NULL").select(F.lower("name").alias("n"), "idx").distinct()
    # a name that holds a text holds its first three letters: an equality that a join can hash
    needles = t.select("term", "t", "a", F.explode(F.array_distinct(F.array("t", "a"))).alias("needle")).withColumn("gram", F.substring("needle", 1, 3))
    grams = F.expr("array_distinct(flatten(transform(array(1, 2, 3), k -> transform(sequence(1, greatest(length(n) - k + 1, 1)), i -> substring(n, i, k)))))")
    met = n.select("n", "idx", F.explode(grams).alias("gram")).join(needles, "gram").filter(F.col("n").contains(F.col("needle")))
    rank = F.when(F.col("n") == F.col("a"), 0).when(F.col("n") == F.col("t"), 1).when(F.col("n").contains(F.col("a")), 2).otherwise(3)
    best = met.groupBy("term").agg(F.min_by("idx", F.struct(rank, F.length("n"), "n", "idx")).alias("idx"))
    return terms.select("term").distinct().join(best, "term", "left")


def resolve_by_ontology(terms: DataFrame, aliases: DataFrame, ontology: DataFrame, mesh: DataFrame, nodes: DataFrame) -> DataFrame:
    """(term, idx): the node of the term's disease number, else of its MeSH id, else both for the term's alias.

    ontology: (name, doid with prefix), mesh: (doid with prefix, mesh with prefix), nodes: (id, idx); smallest of equals wins."""
    t = terms.select("term").distinct()
    spelled = t.select("term", F.lit(0).alias("w"), F.lower("term").alias("n")).unionByName(t.join(aliases.select("term", "alias"), "term").select("term", F.lit(1).alias("w"), F.lower("alias").alias("n")))
    known = spelled.join(ontology.select(F.lower("name").alias("n"), "doid").groupBy("n").agg(F.min("doid").alias("doid")), "n")
    found = nodes.groupBy("id").agg(F.min("idx").alias("idx"))
    by_doid = known.join(found.withColumnRenamed("id", "doid"), "doid").select("term", "w", F.lit(0).alias("k"), "idx")
    by_mesh = known.join(mesh.groupBy("doid").agg(F.min("mesh").alias("mesh")), "doid").join(found.withColumnRenamed("id", "mesh"), "mesh").select("term", "w", F.lit(1).alias("k"), "idx")
    best = by_doid.unionByName(by_mesh).groupBy("term").agg(F.min_by("idx", F.struct("w", "k")).alias("idx"))
    return t.join(best, "term", "left")


def resolve_names(rows: DataFrame, field: str, names: DataFrame, mesh: DataFrame) -> DataFrame:
    """rows with resolved_name of a disease id: of DOID:*, over MESH:*, of a bare number; any other id is its own name, an unknown prefixed one has none.

    names: (doid with prefix, name), one row each; mesh: (mesh with prefix, doid with prefix), one row each."""
    i = F.col(field)
    keyed = rows.withColumn("__mesh", F.when(i.startswith("MESH:"), i)).join(mesh.select(F.col("mesh").alias("__mesh"), F.col("doid").alias("__over")), "__mesh", "left")
    keyed = keyed.withColumn("__doid", F.when(i.startswith("DOID:"), i).when(i.startswith("MESH:"), F.col("__over")).otherwise(F.concat(F.lit("DOID:"), i)))
    named = keyed.join(names.select(F.col("doid").alias("__doid"), F.col("name").alias("__name")), "__doid", "left")
    prefixed = i.startswith("DOID:") | i.startswith("MESH:")
    return named.select(*rows.columns, F.coalesce("__name", F.when(prefixed, F.lit("")).otherwise(i)).alias("resolved_name"))


# --- filters -----------------------------------------------------------------------------------------------------


def relation_filter(edges: DataFrame, mode: str, values: list[str], types: list[str] = ()) -> DataFrame:
    """edges whose relation is one of values ("exact"), or holds one of them as a pattern in any letter case ("pattern") with the head of one of types."""
    if mode == "exact":
        return edges.filter(F.col("relation").isin(list(values)))
    if mode == "pattern":
        kept = edges.filter(F.lower("relation").rlike("|".join(values)))
        return kept.filter(F.col("x_type").isin(list(types))) if types else kept
    raise ValueError(f"unknown mode {mode!r}; known: exact, pattern")


def without_excluded(rows: DataFrame, flag: str, key: str, keys: list, value: str, values: list[str]) -> DataFrame:
    """rows whose flag is null or empty, whose key is none of keys and whose value is none of values; nulls are none of any."""
    none_of = lambda c, listed: F.col(c).isNull() | ~F.col(c).isin(list(listed)) if listed else F.lit(True)
    return rows.filter((F.coalesce(F.length(flag), F.lit(0)) == 0) & none_of(key, keys) & none_of(value, values))


def with_status(rows: DataFrame, flags: list[str]) -> DataFrame:
    """rows with any of the boolean flags; null is false."""
    return rows.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags]))


def supported(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """rows of the groups that have at least so many; counted first, so a large group is no problem."""
    enough = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(*by)
    return rows.join(enough, by, "left_semi")


def extract_pairs(edges: DataFrame, relations: list[str], x_type: str | None = None, y_type: str | None = None, display: str | None = None) -> DataFrame:
    """Distinct (a, b): last segments of the end ids of edges of the relations, turned so that a is of x_type and b of y_type where both are given."""
    e = edges.filter(F.col("relation").isin(list(relations)))
    if display is not None:
        e = e.filter(F.col("display_relation") == display)
    a, b = ids.last_segment(F.col("x_id")), ids.last_segment(F.col("y_id"))
    if x_type and y_type:
        forward, back = (F.col("x_type") == x_type) & (F.col("y_type") == y_type), (F.col("x_type") == y_type) & (F.col("y_type") == x_type)
        pair = F.when(forward, F.struct(a.alias("a"), b.alias("b"))).when(back, F.struct(b.alias("a"), a.alias("b")))
        return e.select(pair.alias("p")).select("p.a", "p.b").dropna().distinct()
    return e.select(a.alias("a"), b.alias("b")).dropna().distinct()


def unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def derived_types(relation: Column) -> Column:
    """The end types that a relation name SOURCE::name::X:Y states, in both orders, as an array of "X|Y"; null for any other form."""
    parts = F.split(relation, "::")
    last = F.element_at(parts, -1)
    x, y = F.substring_index(last, ":", 1), F.regexp_replace(last, "^[^:]*:", "")
    return F.when((F.size(parts) >= 3) & last.contains(":"), F.array_distinct(F.array(F.concat_ws("|", x, y), F.concat_ws("|", y, x))))


def suffix_records(edges: DataFrame, pairs: DataFrame, relations: list[str]) -> DataFrame:
    """Edges of the relations whose end ids without their prefix are a pair (a, b), in either order: equality of the local ids, so that C1 is not found in AC1."""
    local = lambda c: F.regexp_replace(c, "^.*:", "")
    e = edges.filter(F.col("relation").isin(list(relations))).withColumns({"__x": local("x_id"), "__y": local("y_id")})
    e = e.withColumns({"a": F.least("__x", "__y"), "b": F.greatest("__x", "__y")})
    return e.join(unordered(pairs), ["a", "b"], "left_semi").drop("__x", "__y", "a", "b")
