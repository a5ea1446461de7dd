import pytest
from pyspark.sql import functions as F

from lattiq.operators import bridges as b


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_types(spark):
    t = df(spark, "c string", ("biolink:Gene",), ("['biolink:NamedThing' 'biolink:Disease' 'biolink:Gene']",), ("biolink:Oddity",), (None,))
    assert [r[0] for r in t.select(b.canonical_type(F.col("c"))).collect()] == ["gene/protein", "disease", "oddity", ""]


@pytest.fixture(scope="module")
def made(spark):
    ontology = b.ontology_bridge(df(spark, "doid string, mondo_id string, pos int", ("DOID:0011", "MONDO:0005", 1), ("DOID:0011", "MONDO:0006", 2), ("DOID:12", "MONDO:0007", 3), (None, "MONDO:1", 4)))
    mesh = b.mesh_bridge(df(spark, "mesh_id string, doid string, source string", ('MESH:D1 {source="x"}', "DOID:12", "MONDO"), ("MESH:D1", "DOID:11", "DO"), ("MESH:C2", "DOID:12", None)))
    return ontology, mesh


def test_bridges(spark, rows, made):
    ontology, mesh = made
    assert rows(mesh) == [("MESH:C2", "12"), ("MESH:D1", "11")]
    assert rows(b.mesh_to_mondo(mesh, ontology)) == [("MESH:C2", "7"), ("MESH:D1", "5")]
    m = df(spark, "subject_id string, predicate_id string, object_id string, pos int", ("MONDO:0009", "skos:exactMatch", "OMIM:1", 2), ("OMIM:1", "skos:closeMatch", "MONDO:0008", 1), ("MONDO:1", "skos:broadMatch", "X:1", 3), ("MONDO:1", "skos:exactMatch", "MONDO:2", 4))
    assert rows(b.mapping_bridge(m)) == [("OMIM:1", "8")]
    p = df(spark, "entry string, gene_ids string, pos int", ("P1", "7;8;", 1), ("P2", "9;", 2), ("P2", "10", 3), ("P3", None, 4))
    assert rows(b.protein_bridge(p)) == [("P1", "7"), ("P2", "9")] and rows(b.protein_bridge(p, "reject")) == [("P2", "9")]
    with pytest.raises(ValueError):
        b.protein_bridge(p, "other")
    s = df(spark, "names string, gene_ids string, pos int", ("ab cd", "1;2", 1), ("AB", "3", 2), ("x", None, 3))
    assert rows(b.symbol_bridge(s)) == [("AB", "3"), ("CD", "1")]
    assert rows(b.exploded_ids(df(spark, "i int, g string", (1, "a; b;"), (2, "c"), (3, None)), "g").select("i", "member")) == [(1, "a"), (1, "b"), (2, "c")]
    assert rows(b.exploded_ids(df(spark, "i int, g string", (1, "a|b"), (2, "c")), "g", "|", True).select("member")) == [("c",)]


def test_cascades(spark, made):
    ontology, mesh = made
    nodes = df(spark, "row int, id string, type string, equivalents string",
        (1, "X:1", "drug", "PUBCHEM.COMPOUND:5 DRUGBANK:DB00001"), (2, "PUBCHEM.COMPOUND:5", "drug", None), (3, "X:3", "drug", "NO:1 UNII:Q9 CAS:1-2"), (4, "X:4", "drug", ""),
        (5, "A:5", "disease", "MONDO:0012 DOID:12"), (6, "DOID:12", "disease", None), (7, "A:7", "disease", "MESH:D1"), (8, "OMIM:1", "disease", ""), (9, "A:9", "disease", "Z:1 OMIM:1"), (10, "A:10", "disease", "Z:1"),
        (11, "UniProtKB:P1-2", "gene/protein", ""), (12, "NCBIGene:44", "gene/protein", "UniProtKB:P1"), (13, "UniProtKB:P9", "gene/protein", ""),
        (14, "P:1", "pathway", "REACT:R-HSA-12"), (15, "P:2", "pathway", ""), (16, "HP:1", "effect/phenotype", "DOID:11"))
    bridges = b.Bridges(
        df(spark, "cid string, drugbank_id string", ("5", "DB00002")), df(spark, "namespace string, external_id string, drugbank_id string", ("CAS", "1-2", "DB00004"), ("UNII", "Q9", "DB00003")),
        b.first_wins(ontology, "doid", "mondo", "pos"), b.mesh_to_mondo(mesh, ontology).withColumn("mesh", F.replace("mesh", F.lit("MESH:"), F.lit(""))), df(spark, "curie string, number string", ("OMIM:1", "8")), df(spark, "entry string, gene string", ("P1", "7")))
    got = {r.row: r.canonical_id for r in b.canonical_nodes(nodes, bridges).collect()}
    assert got == {1: "DB00001", 2: "DB00002", 3: "DB00003", 4: "X:4", 5: "12", 6: "7", 7: "5", 8: "8", 9: "8", 11: "7", 12: "44", 13: "UniProtKB:P9", 14: "R-HSA-12", 15: "P:2", 16: "HP:1"}
    kept = {r.row: (r.canonical_id, r.drugbank_id, r.ncbigene_id) for r in b.canonical_nodes(nodes, b.Bridges(), keep_all=True).collect()}
    assert kept[10] == ("A:10", None, None) and kept[2] == ("PUBCHEM.COMPOUND:5", None, None) and kept[6] == ("DOID:12", None, None) and kept[12][2] == "44"


def test_schemes(spark, rows, made):
    ontology, mesh = made
    i = lambda *x: df(spark, "i string", *[(v,) for v in x])
    assert rows(b.disease_numbers(i("0005_7", "99", None, ""), "i", "mondo", ontology, mesh, "_")) == [("11",), ("12",)]
    assert rows(b.disease_numbers(i("DOID:0011", "MESH:D1", "x"), "i", "doid", ontology, mesh)) == [("11",)]
    assert rows(b.disease_numbers(i("DOID:7", "MESH:C2", "MESH:D9"), "i", "doid_mesh", ontology, mesh)) == [("12",), ("7",)]
    assert rows(b.disease_numbers(i("C2", "CDK2"), "i", "mesh", ontology, mesh)) == [("12",)]
    with pytest.raises(ValueError):
        b.disease_numbers(i("1"), "i", "other", ontology, mesh)
    assert dict(rows(b.to_mondo(i("DOID:0011", "MESH:C2", "D1", "CDK2", " DOID:12 "), "i", ontology, mesh))) == {"DOID:0011": "5", "MESH:C2": "7", "D1": "5", "CDK2": None, " DOID:12 ": "7"}
    nodes = df(spark, "idx long, id string, type string, row int", (1, "Compound::DB00001", "Compound", 1), (2, "DB000019", "drug", 2), (3, "5_0006", "disease", 3), (4, "6", "Disease", 4), (5, "5", "gene", 5))
    assert rows(b.index_of_ids(nodes, "mondo", ontology, mesh)) == [("disease", "5", 3), ("disease", "6", 4), ("drug", "DB00001", 2)]
    other = df(spark, "idx long, id string, type string, row int", (1, "Disease::DOID:11", "Disease", 1), (2, "Disease::MESH:D1", "Disease", 2), (3, "C2", "Disease", 3))
    assert rows(b.index_of_ids(other, "doid", ontology, mesh)) == [("disease", "5", 1), ("disease", "6", 1)]
    assert rows(b.index_of_ids(other, "doid_mesh", ontology, mesh)) == [("disease", "5", 2), ("disease", "6", 2)]
    assert rows(b.index_of_ids(other, "mesh", ontology, mesh)) == [("disease", "7", 3)]
    with pytest.raises(ValueError):
        b.index_of_ids(nodes, "other", ontology, mesh)


def test_resolvers(spark, rows):
    nodes = df(spark, "idx long, id string, type string, name string, row int", (1, "DB1", "disease", "Aspirin", 1), (2, "DB1", "drug", "Asp", 2), (3, "X3", "Drug", "Ibu", 3), (4, "X4", "Drug", "IBU", 4))
    want = df(spark, "drug_id string, drug_name string", ("DB1", "x"), ("no", "ibu"), ("no", None))
    assert {(r.drug_id, r.drug_name): r.idx for r in b.resolve_drugs(want, nodes).collect()} == {("DB1", "x"): 2, ("no", "ibu"): 3, ("no", None): None}
    assert b.resolve_drugs(want, nodes, ("id",)).filter("drug_name = 'x'").first().idx == 1
    names = df(spark, "name string, idx long", ("Chronic Kidney Disease", 1), ("kidney disease", 2), ("acute kidney disease type 2", 3), ("xy", 4), (None, 5))
    terms = df(spark, "term string", ("CKD",), ("Kidney disease",), ("kidney",), ("acute",), ("x",), ("nothing",), ("acute",))
    aliases = df(spark, "term string, alias string", ("ckd", "chronic kidney disease"), ("acute", "not there"))
    assert dict(rows(b.resolve_terms(terms, aliases, names))) == {"CKD": 1, "Kidney disease": 2, "kidney": 2, "acute": 3, "x": 4, "nothing": None}
    ont = df(spark, "name string, doid string", ("Flu", "DOID:1"), ("cold", "DOID:2"), ("gout", "DOID:3"))
    ms = df(spark, "doid string, mesh string", ("DOID:2", "MESH:D2"))
    found = df(spark, "id string, idx long", ("DOID:1", 10), ("MESH:D2", 20))
    got = dict(rows(b.resolve_by_ontology(df(spark, "term string", ("flu",), ("COLD",), ("grippe",), ("gout",)), df(spark, "term string, alias string", ("grippe", "Flu"),), ont, ms, found)))
    assert got == {"flu": 10, "COLD": 20, "grippe": 10, "gout": None}
    named = b.resolve_names(df(spark, "i string", ("DOID:1",), ("MESH:D2",), ("3",), ("plain",), ("DOID:9",)), "i", ont, ms.select("mesh", "doid"))
    assert dict(rows(named)) == {"DOID:1": "Flu", "MESH:D2": "cold", "3": "gout", "plain": "plain", "DOID:9": ""}


def test_filters_and_pairs(spark, rows):
    e = df(spark, "relation string, display_relation string, x_id string, x_type string, y_id string, y_type string",
        ("A::Treats::C:D", "t", "Compound::1", "Compound", "Disease::2", "Disease"), ("treats", None, "D:2", "Disease", "C:1", "Compound"), ("other", "t", "D:2", "Disease", "AC:1", "Compound"), ("treats", "t", "g", "Gene", "C:1", "Compound"))
    assert b.relation_filter(e, "exact", ["treats"]).count() == 2 and b.relation_filter(e, "pattern", ["treat", "indication"], ["Compound", "Disease"]).count() == 2
    with pytest.raises(ValueError):
        b.relation_filter(e, "no", [])
    assert rows(b.extract_pairs(e, ["A::Treats::C:D", "treats"], "Compound", "Disease")) == [("1", "2"), ("C:1", "D:2")]
    assert rows(b.unordered(b.extract_pairs(e, ["treats"], display="t"))) == [("C:1", "g")]
    assert [r[0] for r in e.select(b.derived_types(F.col("relation"))).collect()] == [["C|D", "D|C"], None, None, None]
    assert b.suffix_records(e, df(spark, "a string, b string", ("1", "2")), ["treats", "other"]).count() == 2
    x = df(spark, "flag string, no int, what string", ("", 1, "a"), (None, 203, "a"), ("c", 3, "a"), (None, None, None), (None, 5, "MRI"))
    assert rows(b.without_excluded(x, "flag", "no", [203], "what", ["MRI"])) == [("", 1, "a"), (None, None, None)]
    s = df(spark, "k string, a boolean, b boolean", ("x", True, None), ("x", False, True), ("y", None, False))
    assert b.with_status(s, ["a", "b"]).count() == 2 and rows(b.supported(s, ["k"], 2).select("k")) == [("x",), ("x",)]
