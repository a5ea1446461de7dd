"""Bootstrap intervals and permutation tests whose draws any engine repeats: every draw is a hash of its number.

Resamples are rows, not rounds on the driver: the draws of all of them are made, counted and ranked together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scores import HASHES, hashed, hashed_array, wide_array
from lattiq.operators.ranking import cumulative, ranking_metrics
from lattiq.plans.lineage import written

RESAMPLES = 1000
#: Parts into which the resamples of a group are cut, each with a copy of its rows.
PARTS = 16
#: Fewest positives, and negatives, of a sample, and fewest valid resamples.
LEAST_CLASS, LEAST_VALID = 2, 10
#: Draws made at once.
DRAWS = 1 << 16


def numbered_within(rows: DataFrame, by: list[str], order: list[str], name: str = "no") -> DataFrame:
    """rows with their place from 0 in order within by; (by, order) must be unique. No group is sorted in one task."""
    c = cumulative(rows.withColumn("__one", F.lit(1)), by, order, ["__one"])
    return c.withColumn(name, F.col("before___one")).drop("__one", "before___one")


def _draws(sizes: DataFrame, by: list[str], resamples: int, stratum: Column, seed: int) -> DataFrame:
    """(by.., boot, no, times) of sizes (by.., n): n draws with replacement from 0 .. n - 1 in each resample."""
    boots = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("boot"))
    each = boots.repartition("boot").select(*by, "n", "boot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("draw"))
    no = hashed(F.col("boot"), F.col("draw"), stratum, seed=seed) % F.col("n")
    return each.select(*by, "boot", no.alias("no")).groupBy(*by, "boot", "no").agg(F.count(F.lit(1)).alias("times"))


def _resampled(rows: pd.DataFrame, boots: range, stratified: bool, seed: int, whole: bool = False) -> pd.DataFrame:
    """(boot, auroc, ap), not rounded, of the resamples of one group in which both labels occur.

    rows: (label, no, n, score); no is the place in the stratum of n rows, of which a draw reaches only the first HASHES,
    or, if whole, every one. A resample is counted by (distinct score, label), never listed."""
    score, missing = rows["score"].to_numpy(float, na_value=np.nan), rows["score"].isna().to_numpy() & ~rows["nan"].to_numpy()
    s = np.where(np.isnan(score), np.inf, -score) + 0.0
    order = np.where(missing, -1, np.where(np.isnan(score), 1, 0))  # a null comes before all scores, NaN after them
    sorting = np.lexsort((s, order))
    step, code = (np.diff(order[sorting]) != 0) | (s[sorting][1:] != s[sorting][:-1]), np.zeros(len(s), np.int64)
    code[sorting[1:]] = np.cumsum(step)
    label, no, n = rows["label"].to_numpy(float, na_value=np.nan), rows["no"].to_numpy(), rows["n"].to_numpy()
    cell = 3 * code + np.where(label == 1, 1, np.where(label == 0, 0, 2))  # a row without a label counts for neither
    width, strata = 3 * (int(code.max()) + 1), []
    for stratum in np.unique(label) if stratified else [0]:
        own = label == stratum if stratified else np.ones(len(rows), bool)
        at = np.empty(own.sum(), np.int64)
        at[no[own]] = cell[own]
        strata.append((int(stratum), at, int(n[own][0])))
    out = []
    for boot in boots:
        counts = np.zeros(width, np.int64)
        for stratum, at, size in strata:
            if whole:
                for first in range(0, size, DRAWS):
                    draws = np.arange(first, min(first + DRAWS, size))
                    counts += np.bincount(at[wide_array(boot, draws, stratum, seed=seed) % size], minlength=width)
                continue
            rounds, rest = divmod(size, HASHES)  # draws repeat after HASHES of them
            for draws, times in ((HASHES if rounds else 0, rounds), (rest, 1)):
                if draws:
                    counts += times * np.bincount(at[hashed_array(boot, np.arange(draws), stratum, seed=seed) % size], minlength=width)
        neg, pos = counts[0::3], counts[1::3]
        n_pos, n_neg = int(pos.sum()), int(neg.sum())
        if n_pos and n_neg:
            drawn = pos > 0
            won = pos * (np.cumsum(neg) - neg / 2.0)
            precise = (pos * np.cumsum(pos))[drawn] / (np.cumsum(pos) + np.cumsum(neg))[drawn]
            out.append((boot, 1 - won.sum() / (float(n_pos) * n_neg), precise.sum() / n_pos))
    return pd.DataFrame(out, columns=["boot", "auroc", "ap"]).astype({"boot": "int64", "auroc": "float64", "ap": "float64"})


def bootstrap(scored: DataFrame, by: list[str], key: list[str], resamples: int = RESAMPLES, stratified: bool = True, point: str = "mean", level: float = 0.95, seed: int = 42, whole: bool = False) -> DataFrame:
    """(by.., n_valid, auroc, auroc_low, auroc_high, ap, ap_low, ap_high) over resamples of scored (by.., key.., score, label).

    key orders the rows of a class and must be unique in it. stratified draws positives and negatives apart, in their own
    numbers; point is the mean of the resamples ("mean") or the value of the whole sample ("full"). Samples with fewer than
    LEAST_CLASS of either label, or with fewer than LEAST_VALID resamples that hold both, have no values. whole draws from all
    rows of a class, each as likely as the others; else, as the SQL of the intervals by group does, from the first HASHES.

    The rows of a group are shuffled once for each of PARTS tasks, which draw and rank its resamples as counts of scores.
    """
    if point not in ("mean", "full"):
        raise ValueError(f"unknown point {point!r}; known: mean, full")
    groups = [*by, "label"] if stratified else list(by)
    rows = written(scored.select(*by, *key, "score", F.col("label").cast("bigint").alias("label")))
    enough = rows.groupBy(*by).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).filter((F.col("p") >= LEAST_CLASS) & (F.col("q") >= LEAST_CLASS)).drop("p", "q") if by else None
    kept = rows.join(enough, by, "left_semi") if by else rows
    kept = kept.filter("label IS NOT NULL") if stratified else kept
    numbered = numbered_within(kept, groups, key if stratified else ["label", *key])
    numbered = numbered if whole else numbered.filter(F.col("no") < HASHES)
    sizes = kept.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    sized = numbered.join(sizes, groups) if groups else numbered.join(F.broadcast(sizes))
    tasks = min(PARTS, resamples)
    names = [f"__by{i}" for i in range(len(by))]
    score = F.col("score").cast("double")
    each = sized.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(names, by)], "label", "no", "n", score.alias("score"), F.coalesce(F.isnan(score), F.lit(False)).alias("nan"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part"))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        out = _resampled(group, range(int(group["part"].iloc[0]), resamples, tasks), stratified, seed, whole)
        for c in names:
            out[c] = group[c].iloc[0]
        return out[[*names, "boot", "auroc", "ap"]]

    kinds = ", ".join(f"{k} {each.schema[k].dataType.simpleString()}" for k in names)
    per = each.groupBy(*names, "part").applyInPandas(draw, f"{kinds + ', ' if kinds else ''}boot bigint, auroc double, ap double")
    per = per.select(*[F.col(k).alias(c) for k, c in zip(names, by)], *[F.round(c, 6).alias(c) for c in ("auroc", "ap")])
    tail = (1 - level) / 2
    q = lambda c, x: F.round(F.percentile(c, x), 6)
    parts = [x for c in ("auroc", "ap") for x in (F.round(F.avg(c), 6).alias(c), q(c, tail).alias(f"{c}_low"), q(c, 1 - tail).alias(f"{c}_high"))]
    out = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_valid"), *parts).filter(F.col("n_valid") >= LEAST_VALID)
    if point == "full":
        whole = ranking_metrics(rows, by).select(*by, F.col("auroc").alias("__auroc"), F.col("ap").alias("__ap"))
        out = (out.join(whole, by) if by else out.join(F.broadcast(whole))).withColumns({"auroc": F.col("__auroc"), "ap": F.col("__ap")}).drop("__auroc", "__ap")
    return out


def rank_bootstrap(ranks: DataFrame, by: list[str], key: list[str], k: int = 100, resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """(by.., n, hits, low, high): share of ranks (by.., key.., rank) up to k, with the 95 % interval of resampled ranks; null below ten ranks."""
    rows = ranks.select(*by, *key, (F.col("rank") <= k).cast("double").alias("hit"))
    numbered = numbered_within(rows, by, key)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("hits"))
    drawn = _draws(sizes.filter("n > 0"), by, resamples, F.lit(0), seed)
    per = drawn.join(numbered.select(*by, "no", "hit"), [*by, "no"]).groupBy(*by, "boot").agg((F.sum(F.col("hit") * F.col("times")) / F.sum("times")).alias("h"))
    q = per.groupBy(*by).agg(F.round(F.percentile("h", 0.025), 6).alias("low"), F.round(F.percentile("h", 0.975), 6).alias("high"))
    out = sizes.join(q, by) if by else sizes.join(F.broadcast(q))
    wide = F.col("n") >= LEAST_VALID
    return out.select(*by, "n", F.round("hits", 6).alias("hits"), F.when(wide, F.col("low")).alias("low"), F.when(wide, F.col("high")).alias("high"))


def permutation_test(a: DataFrame, b: DataFrame, key: list[str], permutations: int = RESAMPLES, comparisons: int = 1, seed: int = 42) -> DataFrame:
    """(observed, p, bonferroni): two-sided test of the difference of the AUROCs of two samples (key.., score, label).

    The rows of both are pooled and dealt anew, as many to each side as before; permutations in which a side lacks a label
    do not count as reached. bonferroni is p times the comparisons made, at most 1. key must be unique in a sample."""
    side = lambda df, s: df.select(F.lit(s).alias("side"), *key, "score", F.col("label").cast("bigint").alias("label"))
    pooled = numbered_within(side(a, 0).unionByName(side(b, 1)), [], ["side", *key], "row")
    n_a = a.count()
    rows = pooled.select("side", "row", "score", "label", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("perm"))
    order = F.when(F.col("perm") == 0, F.col("row")).otherwise(hashed(F.col("row"), F.col("perm"), seed=seed))
    dealt = numbered_within(rows.withColumn("h", order), ["perm"], ["h", "row"], "place")
    m = ranking_metrics(dealt.select("perm", (F.col("place") >= n_a).cast("int").alias("side"), "score", "label"), ["perm", "side"])
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("auroc")))
    d = m.groupBy("perm").agg((of(0) - of(1)).alias("d"))
    observed = d.filter("perm = 0").select(F.col("d").alias("observed"))  # one row
    reached = F.coalesce((F.abs("d") >= F.abs("observed")).cast("double"), F.lit(0.0))
    out = d.filter("perm > 0").join(F.broadcast(observed)).groupBy("observed").agg(F.avg(reached).alias("p"))
    return out.select(F.round("observed", 6).alias("observed"), F.round("p", 6).alias("p"), F.round(F.least(F.col("p") * comparisons, F.lit(1.0)), 6).alias("bonferroni"))


def variation(scores: DataFrame, value: str) -> DataFrame:
    """(n, mean, sd, cv, spread): mean, population deviation, their ratio in percent and the range of scores; nulls are left out, cv needs two."""
    v = scores.filter(F.col(value).isNotNull())
    one = v.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), (F.max(value) - F.min(value)).alias("spread"))
    r = lambda c: F.round(c, 4)
    return one.select("n", r("mean").alias("mean"), r("sd").alias("sd"), F.when(F.col("n") >= 2, F.round(F.col("sd") / F.col("mean") * 100, 2)).alias("cv"), r("spread").alias("spread"))
