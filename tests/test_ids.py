from pyspark.sql import functions as F

from lattiq.functions import ids


def test_extract(spark):
    cases = {
        "drugbank": ("x DB00123 DB4", "DB00123"), "mondo": ("MONDO:0012", "0012"), "doid": ("a DOID:7", "7"), "ncbigene": ("NCBIGene:12", "12"), "pubchem": ("PUBCHEM.COMPOUND:5", "5"),
        "uniprot": ("UniProtKB:P12345-2", "P12345-2"), "reactome": ("R-HSA-77", "R-HSA-77"), "mesh": ("MESH:D001|x", "D001"),
    }
    df = spark.createDataFrame([tuple(text for text, _ in cases.values())], list(cases))
    assert tuple(df.select(*[ids.extract(F.col(c), c) for c in cases]).first()) == tuple(want for _, want in cases.values())
    none = spark.createDataFrame([("R-INV-1", "MESH:X1", "NCBIGENE:9")], ["reactome", "mesh", "ncbigene"])
    assert tuple(none.select(*[ids.extract(F.col(c), c) for c in none.columns]).first()) == (None, None, "9")


def test_level_confidence(spark):
    levels = ["knowledge_assertion", "logical_entailment", "statistical_association", "observation", "prediction", "not_provided", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(levels)], "i int, level string")
    assert [r[0] for r in df.orderBy("i").select(ids.level_confidence(F.col("level"))).collect()] == [1.0, 0.9, 0.6, 0.5, 0.3, None, None]


def test_small_functions(spark):
    df = spark.createDataFrame([("DOID:0012",), ("DOID:000",), ("12",), (None,)], "x string")
    assert [r[0] for r in df.select(ids.bare_number(F.col("x"), "DOID")).collect()] == ["12", "0", "12", None]
    t = spark.createDataFrame([("Small Molecule",), ("Effect/Phenotype",), ("New Thing",), ("",), (None,)], "x string")
    assert [r[0] for r in t.select(ids.display_type(F.col("x"))).collect()] == ["compound", "phenotype", "new_thing", "other", "other"]
    m = spark.createDataFrame([("D1 {source=x}", "CDK2", "P1-2")], "a string, b string, c string")
    assert tuple(m.select(ids.mesh_clean(F.col("a")), ids.mesh_head(F.col("a")), ids.bare_mesh(F.col("b")), ids.first_accession(F.col("c"))).first()) == ("D1", "D1", False, "P1")
