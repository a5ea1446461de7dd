"""Edges that arrive over time: running link counts of nodes, and counts by window of event time with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def edge_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Edge files of a folder as they appear, one file a trigger at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def running_degrees(edges: DataFrame) -> DataFrame:
    """(idx, n) of edge ends so far (complete or update mode)."""
    return edges.select(F.explode(F.array("x_index", "y_index")).alias("idx")).filter("idx IS NOT NULL").groupBy("idx").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) by tumbling window; events later than the watermark are dropped."""
    return events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).groupBy(F.window("__t", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over all that is there into a table in memory (tests and small reports)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
