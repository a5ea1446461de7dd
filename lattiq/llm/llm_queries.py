"""Queries of the operators in this subpackage, over the test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.copies import canonical_id, canonical_word, copy_groups
from lattiq.llm.canonical import map_to_list
from lattiq.llm.entities import match_entities
from lattiq.llm.groups import connected_groups, shared_value_links
from lattiq.llm.languages import NO_LABEL, language_segments
from lattiq.llm.leaks import find_leaks
from lattiq.llm.mixture import mix_sources, token_counts
from lattiq.llm.overlap import record_overlaps
from lattiq.operators.skew import join_groups
from lattiq.plans.lineage import written
from lattiq.sources.tables import table


def _edge_copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, sf_dir, "kg_df").select("edge_id", "x_id", "relation", "y_id")
    x, y = canonical_id(F.col("x_id")), canonical_id(F.col("y_id"))
    ordered = edges.select("edge_id", x.alias("x"), canonical_word(F.col("relation")).alias("r"), y.alias("y"))
    either = F.col("x").isNull() | F.col("y").isNull()
    ends = [F.when(~either, F.least("x", "y")), F.when(~either, F.greatest("x", "y"))]
    return copy_groups(ordered, "edge_id", [ends[0], F.col("r"), ends[1]])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_copies(spark, sf_dir)[1].select(F.col("first_id").alias("edge_id_first"), F.col("copy_id").alias("edge_id_copy"))


def p2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_copies(spark, sf_dir)[0].select(F.col("first_id").alias("edge_id"), "n_copies")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "do_diseases").select(F.col("mondo_id").alias("entry_id"), F.col("mondo_name").alias("name"))
    edges = table(spark, sf_dir, "kg_df").filter("y_type = 'disease'").select(F.lit("kg_df.y_name").alias("field_name"), F.col("edge_id").alias("row_id"), F.col("y_name").alias("name"))
    reps = table(spark, sf_dir, "table5_replication").select(F.lit("table5_replication.disease_name").alias("field_name"), F.col("rep_id").alias("row_id"), F.col("disease_name").alias("name"))
    typed = written(edges.unionByName(reps).filter("name IS NOT NULL").join(listed.select("name"), "name", "left_anti"))
    names = written(typed.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    mapped = written(names.join(map_to_list(names.select("name"), listed), "name"))  # read twice by join_groups
    return join_groups(typed, mapped, ["name"], "n", max(typed.count(), 1)).select("field_name", "row_id", F.col("entry_id").alias("mondo_id"))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_entities(table(spark, sf_dir, "nodes_df"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("node_key_a", "node_key_b")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = table(spark, sf_dir, "test_pos")
    sides = {"drug": "a", "disease": "b"}
    test = test.select("test_id", "relation", *[F.col(f"{k}_{c}").alias(f"{s}_{c}") for k, s in sides.items() for c in ("index", "id", "name")])
    return record_overlaps(table(spark, sf_dir, "train_triples"), test)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by split of the test pair and graph of the triple: test pairs concerned, triples, and links."""
    found = _overlaps(spark, sf_dir)
    split = table(spark, sf_dir, "test_pos").select("test_id", "split")
    graph = table(spark, sf_dir, "train_triples").select("triple_id", "kg")
    return found.join(split, "test_id").join(graph, "triple_id").groupBy("split", "kg").agg(F.count_distinct("test_id").alias("n_test"), F.count_distinct("triple_id").alias("n_triples"), F.count(F.lit(1)).alias("n_links"))


def _drug_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    xref = table(spark, sf_dir, "drugbank_xref").select("drugbank_id", "namespace", "external_id")
    return connected_groups(shared_value_links(xref, "drugbank_id", ["namespace", "external_id"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drug_groups(spark, sf_dir).filter("member <> group_id").select(F.col("group_id").alias("group_drugbank_id"), F.col("member").alias("drugbank_id"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drug_groups(spark, sf_dir).select(F.col("member").alias("drugbank_id"), F.col("group_id").alias("group_drugbank_id"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked item with the number of documents that hold it and the most words of it that one holds."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("most_words"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = written(token_counts(table(spark, sf_dir, "documents"), os.environ.get("LATTIQ_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")))
    return mix_sources(sizes, table(spark, sf_dir, "source_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_segments(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the documents whose label is missing, wrong or not the whole truth."""
    segments = written(_segments(spark, sf_dir).select("doc_id", "seg_no", "lang"))
    label = F.lower(F.trim(F.coalesce("lang", F.lit(""))))
    labels = table(spark, sf_dir, "documents").select("doc_id", F.when(label.isin(*NO_LABEL), None).otherwise(label).alias("label"))
    per = segments.groupBy("doc_id").agg(F.max("seg_no").alias("n"), F.min_by("lang", "seg_no").alias("first"))
    odd = per.join(labels, "doc_id").filter((F.col("n") > 1) | F.col("label").isNull() | (F.col("label") != F.col("first"))).select("doc_id").distinct()
    return segments.join(odd, "doc_id").select("doc_id", "seg_no", "lang").distinct()


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


QUERIES = {"p2_found": p2_found, "p2_edges": p2_edges, "p3_found": p3_found, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p5_groups": p5_groups, "p7_found": p7_found, "p7_report": p7_report, "p8_found": p8_found, "p8_items": p8_items, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_segments": p10_segments}

_CANON = r"""
        WITH w AS (
          SELECT edge_id,
            regexp_replace(lower(x_id), '[^\p{L}\p{N}]+', '', 'g') AS x,
            regexp_replace(lower(relation), '[^\p{L}\p{N}]+', '', 'g') AS r,
            regexp_replace(lower(y_id), '[^\p{L}\p{N}]+', '', 'g') AS y
          FROM kg_df),
        g AS (
          SELECT edge_id, r,
            CASE WHEN regexp_full_match(x, '(\d{7}){2,}') THEN array_to_string(list_sort(regexp_extract_all(x, '\d{7}')), '') ELSE x END AS x,
            CASE WHEN regexp_full_match(y, '(\d{7}){2,}') THEN array_to_string(list_sort(regexp_extract_all(y, '\d{7}')), '') ELSE y END AS y
          FROM w),
        k AS (
          SELECT edge_id, CASE WHEN x IS NULL OR r IS NULL OR y IS NULL THEN 'row ' || edge_id
            ELSE least(x, y) || '|' || r || '|' || greatest(x, y) END AS key
          FROM g)"""

_GROUPS = r"""
        WITH RECURSIVE m AS (
          SELECT DISTINCT drugbank_id AS d,
            nullif(regexp_replace(lower(namespace), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS n,
            nullif(regexp_replace(lower(external_id), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS e
          FROM drugbank_xref WHERE drugbank_id IS NOT NULL),
        l AS (SELECT d, min(d) OVER (PARTITION BY n, e) AS h FROM m WHERE n IS NOT NULL AND e IS NOT NULL),
        s AS (SELECT d AS u, h AS v FROM l UNION SELECT h, d FROM l UNION SELECT d, d FROM m),
        reach AS (SELECT u, v FROM s UNION SELECT r.u, s.v FROM reach r JOIN s ON r.v = s.u)"""

SQL = {
    "p2_found": _CANON + """
        SELECT first AS edge_id_first, edge_id AS edge_id_copy
        FROM (SELECT edge_id, min(edge_id) OVER (PARTITION BY key) AS first FROM k) WHERE edge_id <> first""",
    "p2_edges": _CANON + """
        SELECT min(edge_id) AS edge_id, count(*)::BIGINT AS n_copies FROM k GROUP BY key""",
    "p5_found": _GROUPS + """
        SELECT min(v) AS group_drugbank_id, u AS drugbank_id FROM reach GROUP BY u HAVING min(v) <> u""",
    "p5_groups": _GROUPS + """
        SELECT u AS drugbank_id, min(v) AS group_drugbank_id FROM reach GROUP BY u""",
}
