"""Queries of the general record operators: packed fields (p1) and heavy keys (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattiq.operators.packed import explode_packed
from lattiq.operators.skew import heavy_keys, per_key_states
from lattiq.sources.tables import table

#: A value is heavy if it holds more than this share of all rows.
HEAVY_SHARE = 0.01


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "biolink_nodes").select("row_id", "equivalent_identifiers")
    return explode_packed(nodes, "equivalent_identifiers", value="identifier").select("row_id", "pos", "identifier")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "kg_df").select("edge_id", "x_id", "relation", "y_id")
    return per_key_states(edges, {"x_id": "y_id", "relation": "y_id"}, order="edge_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(_states(spark, sf_dir), table(spark, sf_dir, "kg_df").count(), HEAVY_SHARE)


def p6_key_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p6_found": p6_found, "p6_key_states": p6_key_states}

SQL = {
    "p6_found": """
        SELECT field_name, key_value FROM (
          SELECT 'x_id' AS field_name, x_id AS key_value FROM kg_df
          UNION ALL SELECT 'relation', relation FROM kg_df)
        WHERE key_value IS NOT NULL
        GROUP BY field_name, key_value
        HAVING count(*) > 0.01::DOUBLE * (SELECT count(*) FROM kg_df)""",
    "p6_key_states": """
        SELECT field_name, key_value, count(*)::BIGINT AS n_rows, count(DISTINCT y_id)::BIGINT AS n_neighbours FROM (
          SELECT 'x_id' AS field_name, x_id AS key_value, y_id FROM kg_df
          UNION ALL SELECT 'relation', relation, y_id FROM kg_df)
        WHERE key_value IS NOT NULL
        GROUP BY field_name, key_value""",
}
