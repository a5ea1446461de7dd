"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Setting by which Spark deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a local master gets a temporary one; a
    cluster, whose executors would each write to a folder of their own, is refused."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lattiq-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Compute df once into a compressed Parquet table of the shared folder; later plans start from there and survive the
    loss of executors. Its shuffle files go as soon as the table is there (else they stay until the driver happens to collect
    its garbage); discard() deletes the table itself, or else the file system when the session's JVM ends, even if Python
    ends first."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattiq-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() returned and that no plan still to be run reads."""
    for df in tables:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
