"""Order statistics and ranking metrics without a window over all rows: sums before each value, by range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.plans.lineage import written


def cumulative(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """rows with before_<value>: the sum of value over all rows of the same group that come before in order.

    (by, order) must be unique. Rows are range-partitioned by it; partitions add up by themselves, and the sums of earlier
    partitions, one row for each partition and group in it, are added. No partition holds more than its range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__part").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__part", *[F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__o_{v}") for v in values])
    within = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    j = ranged.join(offsets, [*by, "__part"])
    return j.select(*rows.columns, *[(F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"__o_{v}")).alias(f"before_{v}") for v in values])


def thresholds(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by.., s, pos, neg, before_pos, before_neg) for each distinct score, highest first (s = -score).

    scored: (by.., score, label), and weight where a row stands for several."""
    label = F.col("label").cast("int")
    weight = F.col("weight") if "weight" in scored.columns else F.lit(1)
    counts = scored.groupBy(*by, (-F.col("score")).alias("s")).agg(F.sum(label * weight).alias("pos"), F.sum((1 - label) * weight).alias("neg"))
    return cumulative(counts, by, ["s"], ["pos", "neg"])


def ranking_metrics(scored: DataFrame, by: list[str], ks: tuple[int, ...] = (10,)) -> DataFrame:
    """(by.., n_pos, n_neg, auroc, ap, mrr, hits@k..) to 6 places; scored: (by.., score, label 0/1).

    A positive's rank is the number of scores not below its own, so ties count against it. auroc is null without both
    labels, the others without positives."""
    t = thresholds(scored, by)
    rank = F.col("before_pos") + F.col("before_neg") + F.col("pos") + F.col("neg")
    won = F.col("pos") * F.col("before_neg") + F.col("pos") * F.col("neg") / 2.0
    precise = F.col("pos") * (F.col("before_pos") + F.col("pos")) / rank
    agg = t.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(won).alias("lost"), F.sum(precise).alias("ap"), F.sum(F.col("pos") / rank).alias("mrr"), *[F.sum(F.when(rank <= k, F.col("pos")).otherwise(0)).alias(f"hits{k}") for k in ks])
    share = lambda c: F.when(F.col("n_pos") > 0, F.round(F.col(c) / F.col("n_pos"), 6))
    auroc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.round(1 - F.col("lost") / (F.col("n_pos") * F.col("n_neg")), 6))
    return agg.select(*by, "n_pos", "n_neg", auroc.alias("auroc"), share("ap").alias("ap"), share("mrr").alias("mrr"), *[share(f"hits{k}").alias(f"hits{k}") for k in ks])


def mid_ranks(rows: DataFrame, by: list[str], value: str, name: str = "mid_rank") -> DataFrame:
    """(by.., value, mid_rank, n) for each distinct value: the mean 1-based rank of its rows, lowest first."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    c = cumulative(counts, by, [value], ["n"])
    return c.select(*by, value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(name), "n")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho): rank correlation with ties at their mean rank."""
    rx, ry = mid_ranks(rows, [], x, "rx").drop("n"), mid_ranks(rows, [], y, "ry").drop("n")
    j = rows.join(rx, x).join(ry, y)
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(n_groups, h): tie-corrected Kruskal-Wallis statistic."""
    ranks = mid_ranks(rows, [], value)
    j = rows.join(ranks.drop("n"), value).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("mid_rank").alias("r"))
    tie = ranks.agg(F.sum("n").cast("double").alias("total"), F.sum(F.pow("n", 3) - F.col("n")).alias("tie"))  # one row
    one = j.agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q")).join(F.broadcast(tie))
    t = F.col("total")
    return one.select("n_groups", F.round((12 / (t * (t + 1)) * F.col("q") - 3 * (t + 1)) / (1 - F.col("tie") / (t * t * t - t)), 6).alias("h"))


def quantile_tiers(rows: DataFrame, value: str, labels: tuple[str, ...] = ("Q1", "Q2", "Q3", "Q4")) -> DataFrame:
    """rows with tier: right-closed bins at the quartiles, equal edges merged, labels taken from the first on."""
    edges = rows.agg(F.percentile(value, F.array(*[F.lit(i / len(labels)) for i in range(len(labels) + 1)])).alias("e")).first()["e"]  # a handful of numbers
    cuts = sorted(set(edges or []))
    tier = F.lit(labels[0]) if len(cuts) < 3 else None
    if tier is None:
        tier = F.lit(labels[len(cuts) - 2])
        for i in range(len(cuts) - 2, 0, -1):
            tier = F.when(F.col(value) <= cuts[i], F.lit(labels[i - 1])).otherwise(tier)
    return rows.withColumn("tier", F.when(F.col(value).isNotNull(), tier))


def exact_split(rows: DataFrame, order: str, key: str, share: float = 0.9) -> DataFrame:
    """rows with part "train" for the first floor(share * n) rows by (order, key), "test" for the rest; (order, key) unique."""
    total = rows.count()
    c = cumulative(rows.withColumn("__one", F.lit(1)), [], [order, key], ["__one"])
    return c.withColumn("part", F.when(F.col("before___one") < int(share * total), "train").otherwise("test")).drop("__one", "before___one")
