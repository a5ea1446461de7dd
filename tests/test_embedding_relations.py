from lattiq.operators import linkpred as lp
from lattiq.plans import graph_queries


def test_relations_are_numbered_by_their_normalised_name(spark, tmp_path, monkeypatch):
    triples = [("k", "drug_gene", 1, 2), ("k", "Drug Gene", 3, 4), ("k", "gene_drug", 5, 6)]  # equally long, one of them written in two ways
    spark.createDataFrame(triples, "kg string, relation string, head_index long, tail_index long").write.parquet(str(tmp_path / "train_triples.parquet"))
    seen = []
    monkeypatch.setattr(lp, "embed_graphs", lambda t, **options: seen.append(({r.h: r.r for r in t.collect()}, options)))
    graph_queries.graph_embeddings(spark, str(tmp_path))
    r, options = seen[0]
    assert r[1] == r[3] != r[5] and not options
