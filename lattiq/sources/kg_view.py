"""The graph view of the test tables: clean edges, nodes, undirected pairs, and gold pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions.ids import relation_key
from lattiq.sources.tables import table


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both indexes; rel is the relation as letters only."""
    k = table(spark, sf_dir, "kg_df").filter("x_index IS NOT NULL AND y_index IS NOT NULL")
    return k.select(F.col("edge_id").alias("row_id"), relation_key(F.col("relation")).alias("rel"), "display_relation", "x_index", "x_id", "x_type", "x_name", "x_source", "y_index", "y_id", "y_type", "y_name", "y_source")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training triples of several graphs, forward relations as letters only."""
    t = table(spark, sf_dir, "train_triples")
    return t.select("triple_id", "kg", F.regexp_replace(relation_key(F.col("relation")), "inv$", "").alias("rel"), "head_index", "head_id", "tail_index", "tail_id")


def undirected(e: DataFrame) -> DataFrame:
    """(u, v), u <= v, once for each linked pair."""
    return e.select(F.least("x_index", "y_index").alias("u"), F.greatest("x_index", "y_index").alias("v")).distinct()


def adjacency(und: DataFrame) -> DataFrame:
    """(a, b) in both directions; a loop once."""
    return und.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(und.filter("u <> v").select(F.col("v").alias("a"), F.col("u").alias("b")))


def gold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "test_pos").select("test_id", F.col("drug_index").alias("u"), F.col("disease_index").alias("v"))


def node_types(e: DataFrame) -> DataFrame:
    """(idx, type, name) from edge ends, the first row that has one wins."""
    ends = e.select("row_id", F.explode(F.array(F.struct(F.col("x_index").alias("idx"), F.col("x_type").alias("type"), F.col("x_name").alias("name"), F.lit(0).alias("end")), F.struct(F.col("y_index").alias("idx"), F.col("y_type").alias("type"), F.col("y_name").alias("name"), F.lit(1).alias("end")))).alias("n"))
    return ends.select("n.*", "row_id").groupBy("idx").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("end", "row_id"))).alias(c) for c in ("type", "name")])


SQL_E = r"""e AS (SELECT edge_id AS row_id, regexp_replace(lower(relation), '[^a-z]', '', 'g') AS rel, display_relation, x_index, x_id, x_type, x_name, x_source, y_index, y_id, y_type, y_name, y_source
    FROM kg_df WHERE x_index IS NOT NULL AND y_index IS NOT NULL)"""
SQL_T = r"""t AS (SELECT triple_id, kg, regexp_replace(regexp_replace(lower(relation), '[^a-z]', '', 'g'), 'inv$', '') AS rel, head_index, head_id, tail_index, tail_id FROM train_triples)"""
SQL_UND = "und AS (SELECT DISTINCT least(x_index, y_index) AS u, greatest(x_index, y_index) AS v FROM e)"
SQL_ADJ = "adj AS (SELECT u AS a, v AS b FROM und UNION ALL SELECT v, u FROM und WHERE u <> v)"
SQL_GOLD = "gold AS (SELECT test_id, drug_index AS u, disease_index AS v FROM test_pos)"
SQL_NT = """nt AS (SELECT idx, arg_min(type, (side, row_id)) AS type, arg_min(name, (side, row_id)) AS name FROM (
    SELECT x_index AS idx, x_type AS type, x_name AS name, 0 AS side, row_id FROM e UNION ALL SELECT y_index, y_type, y_name, 1, row_id FROM e) GROUP BY idx)"""
SQL_HASH = lambda *terms, seed=42: (lambda h: f"(({h}) * ({h}) + ({h}) * 31 + {seed}) % 1000003")(f"(({seed * 1299709} + {' + '.join(f'({t})::BIGINT * {f}' for f, t in zip((7919, 104729, 15485863), terms))}) % 1000003)")
#: (keep.., no): places of the wide draws of rows (keep.., n, boot, draw, stratum), as functions.scores.wide_array makes them.
SQL_WIDE = lambda rows, keep, seed=42: (lambda fifth: f"""SELECT {keep}, (x * 2147483647 + {fifth("b")}) % n AS no FROM (SELECT *, (x * 1000003 + draw * 48271 + boot * 16807) % 2147483647 AS b FROM
    (SELECT *, {fifth("a")} AS x FROM (SELECT *, (draw * 16807 + ({seed * 1299709} + boot * 48271 + stratum::BIGINT * 69621)) % 2147483647 AS a FROM ({rows}))))""")(lambda x: f"(({x} * {x} % 2147483647) * ({x} * {x} % 2147483647) % 2147483647) * {x} % 2147483647")  # noqa: E731


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
