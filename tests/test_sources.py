import gzip

import pytest

from lattiq.operators.bridges import Bridges
from lattiq.sources import graph_files as gf


def write(path, text):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt") as f:
        f.write(text)
    return str(path)


def test_single_edge_csv(spark, tmp_path, rows):
    head = ",".join(gf.EDGE_COLUMNS) + ",extra\n"
    p = write(tmp_path / "e.csv", head + "ind,treats,1,DB1,drug,A,s,2,007,disease,\"B, minor\",t,zzz\n")
    e, n = gf.load_graph(spark, "single_edge_csv", p)
    assert rows(n) == [(1, "DB1", "drug", "A", "drug/DB1"), (2, "007", "disease", "B, minor", "disease/007")]
    with pytest.raises(ValueError):
        gf.load_graph(spark, "nothing")


def test_node_edge_tsv(spark, tmp_path, rows):
    n = write(tmp_path / "n.tsv", "id\tname\tkind\nb\tBee\tGene\na\tAy\tDrug\n")
    e = write(tmp_path / "e.tsv", "source\tmetaedge\ttarget\na\tr\tb\na\tr\tmissing\n")
    edges, nodes = gf.node_edge_tsv(spark, n, e)
    assert [(r.x_index, r.relation, r.y_index) for r in edges.collect()] == [(1, "r", 0)]  # idx follows the file
    assert rows(nodes.select("idx", "id", "type")) == [(0, "b", "Gene"), (1, "a", "Drug")]


def test_prefixed_and_typed(spark, tmp_path):
    p = write(tmp_path / "t.tsv.gz", "Gene::1\tA::b::Gene:Drug\tCompound::DB1\nplain\tr\tGene::1\n")
    edges, nodes = gf.prefixed_triples(spark, p)
    assert {(r.x_type, r.y_type) for r in edges.collect()} == {("Gene", "Compound"), ("unknown", "Gene")}
    t = write(tmp_path / "b.tsv", "x\tp\ty\ny\tq\tz\n")
    m = write(tmp_path / "names.1.tsv", "x\tNAME\tEx\nx\tOTHER\tno\n")
    pred = spark.createDataFrame([("p", "gene", "drug", 1), ("q", "pathway", "disease", 2)], "relation string, x_type string, y_type string, priority int")
    _, nodes = gf.typed_triples(spark, t, pred, m)
    assert {r.id: (r.type, r.name) for r in nodes.collect()} == {"x": ("gene", "Ex"), "y": ("pathway", "y"), "z": ("disease", "z")}


def test_typed_by_the_listed_predicates(spark, tmp_path):
    t = write(tmp_path / "b.tsv", "r1\tMEMBER_OF_PATHWAY\tp\np1\tMEMBER_OF_COMPLEX\tr1\nx\tPROTEIN_PATHWAY_ASSOCIATION\tr1\nq\tNOT_LISTED\tw\nd\tDDI\td\nd\tPPI\tp1\n")
    edges, nodes = gf.typed_triples(spark, t)
    assert {r.id: r.type for r in nodes.collect()} == {"r1": "Pathway", "p": "Pathway", "p1": "Gene/Protein", "x": "Gene/Protein", "q": "unknown", "w": "unknown", "d": "Drug"}
    assert edges.count() == 6


def test_malformed_rows_fail_or_are_skipped_on_demand(spark, tmp_path):
    p = write(tmp_path / "m.csv", "a,b\n1,2\n3,4,5\n6,7\n")
    assert gf.csv(spark, p, ["a", "b"], malformed="skip").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        gf.csv(spark, p, ["a", "b"]).select("a", "b").collect()


def test_references_and_gene_diseases(spark, tmp_path, rows):
    d = lambda *x: spark.createDataFrame(list(x), "drugbank_id string, namespace string, external_id string")
    whole = gf.combined_references(d(("DB1", "CAS", "1-2"), ("DB1", "CAS", " ")), spark.createDataFrame([("DB1", 5), (None, 6)], "drugbank_id string, pubchem_cid long"), d(("DB1", "cas", "1-2"), ("DB2", "unii", "Q")))
    assert rows(whole) == [("DB1", "CAS", "1-2", 1), ("DB1", "PUBCHEM.COMPOUND", "5", 2), ("DB2", "UNII", "Q", 3)]
    p = write(tmp_path / "g.tsv", "# c\nA\t1\tFlu\tMESH:D1\ttherapeutic\nB\t1\tFLU 2\tMESH:D1\tmarker/mechanism\nC\t2\tx\tMESH:D2\tinferred\nD\tz\tx\tMESH:D2\ttherapeutic\n")
    assert rows(gf.gene_diseases(spark, p)) == [(1, "MESH:D1", "A", "flu")]


def test_scored(spark, tmp_path):
    lines = [("699", "STRING"), ("700", "STITCH"), ("gold quality", "Bgee"), ("low", "Bgee"), ("", "SIDER"), ("abc", "STRING")]
    p = write(tmp_path / "s.tsv", "".join(f"NCBIGENE:{i}\tr\tPUBCHEM.COMPOUND:9\t{s}\t{x}\n" for i, (s, x) in enumerate(lines)))
    bridge = spark.createDataFrame([("DB2", 9), ("DB1", 9)], "drugbank_id string, pubchem_cid long")
    edges, nodes = gf.scored_triples(spark, p, drug_bridge=bridge)
    assert sorted(r.x_id for r in edges.collect()) == ["NCBIGENE:1", "NCBIGENE:2", "NCBIGENE:4"]
    assert {r.drugbank_id for r in nodes.filter("type = 'Drug'").collect()} == {"DB1"}


def test_biolink_and_bridges(spark, tmp_path, rows):
    n = write(tmp_path / "n.tsv", "id\tname\tcategory\tequivalent_identifiers\tupstream_data_source\nA:1\tx\t['biolink:Gene']\t[]\ts\nB:2\ty\tbiolink:Disease\t[]\ts\nC:3\tz\tbiolink:Agent\t[]\ts\nD:4\tz\tbiolink:Gene\t[]\ts\n")
    e = write(tmp_path / "e.tsv", "subject\tpredicate\tobject\tprimary_knowledge_source\taggregator_knowledge_source\tupstream_data_source\tknowledge_level\tagent_type\tnum_references\nA:1\tp\tB:2\ts\t\tu\tprediction\tm\t3\nA:1\tp\tC:3\ts\t\tu\tother\tm\tx\n")
    edges, nodes = gf.biolink(spark, n, e, {"gene/protein", "disease"}, bridges=Bridges(mappings=spark.createDataFrame([("B:2", "77")], "curie string, number string")))
    assert [(r.relation, r.y_id, r.x_source, r.confidence_score, r.num_references) for r in edges.collect()] == [("p", "77", "s", 0.3, 3.0)] and nodes.count() == 2
    assert gf.biolink(spark, n, e, {"gene/protein", "disease"})[1].count() == 0  # a disease without canonical id goes, and with it the edge
    kept, every = gf.biolink(spark, n, e, trim_isolated=False)
    assert kept.count() == 2 and {r.curie: r.type for r in every.collect()} == {"A:1": "gene/protein", "B:2": "disease", "C:3": "agent", "D:4": "gene/protein"}
    s = write(tmp_path / "m.tsv", "# c\nsubject_id\tpredicate_id\tobject_id\nMONDO:1\tskos:exactMatch\tDOID:2\nMESH:3\tskos:closeMatch\tMONDO:1\nMONDO:1\tskos:broadMatch\tX:1\n")
    assert rows(gf.sssom(spark, s)) == [("MONDO:1", "DOID:2"), ("MONDO:1", "MESH:3")]
    c = write(tmp_path / "c.tsv.gz", "# c\nAsp\tC1\t\tG\t12\t\tHomo sapiens\nAsp\tC1\t\tG\tx\t\tHomo sapiens\nAsp\tC1\t\tG\t13\t\tMus\n")
    assert rows(gf.chemical_genes(spark, c)) == [("asp", 12)]
    w = write(tmp_path / "w.csv", "DrugBank ID,CAS Number,ChEBI ID\nDB1,1-2|3-4,\nDB1,1-2,77\n")
    assert rows(gf.cross_references(spark, w, {"CAS Number": "CAS", "ChEBI ID": "CHEBI"})) == [("DB1", "CAS", "1-2"), ("DB1", "CAS", "3-4"), ("DB1", "CHEBI", "77")]


def test_cache_config_and_sinks(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert gf.cached(spark, str(tmp_path), {"a": 1}, build).count() == 3
    assert len(calls) == 1
    (tmp_path / "config.json").write_text('{"graphs": {"g": {"path": "x"}}}')
    (tmp_path / "sub").mkdir()
    assert gf.load_config(gf.find_config(tmp_path / "sub")).graphs["g"]["path"] == "x"
    for kind in ("csv", "tsv", "parquet", "json"):
        gf.write_table(spark.range(2), str(tmp_path / kind), kind)
    with pytest.raises(ValueError):
        gf.write_table(spark.range(2), str(tmp_path / "x"), "pickle")
    import json
    import os
    import pickle

    import numpy as np

    gf.write_report({"a": [1]}, tmp_path / "r.json")
    gf.write_report({"a": (1, 2)}, tmp_path / "r.pkl", "pickle")
    gf.write_report({"v": np.arange(3)}, tmp_path / "r.npz", "npz")
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": [1]} and pickle.loads((tmp_path / "r.pkl").read_bytes()) == {"a": (1, 2)} and np.load(tmp_path / "r.npz")["v"].tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        gf.write_report({}, tmp_path / "x", "csv")
    # a source that changed since makes the cache stale
    source = tmp_path / "source.txt"
    source.write_text("x")
    os.utime(source, (1, 1))
    for when, expected in ((1, 1), (1, 1), (4_000_000_000, 2)):
        os.utime(source, (when, when))
        gf.cached(spark, str(tmp_path), {"b": 1}, lambda: (calls.append(2), spark.range(1))[1], (str(source),))
        assert calls.count(2) == expected
    (tmp_path / "config.yaml").write_text("graphs:\n  h:\n    path: y\n")
    assert gf.load_config(tmp_path / "config.yaml").graphs["h"]["path"] == "y"


def test_stream(spark, tmp_path, rows):
    from lattiq.streaming import degrees as st

    df = spark.createDataFrame([(1, 2), (1, 3)], "x_index long, y_index long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = st.run_once(st.running_degrees(st.edge_stream(spark, str(tmp_path / "in"), df.schema)), "deg", "complete", str(tmp_path / "cp"))
    assert rows(spark.table("deg")) == [(1, 2), (2, 1), (3, 1)]
    q.stop()
