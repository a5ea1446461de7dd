"""Mixing sources to target weights by Pareto order sampling.

The largest mix in which every source can have its target share of all tokens, none being repeated more often than its
cap, fixes how many tokens each source must give. Of those, as many whole copies of the source as fit are certain; the
rest is a fixed-size sample with unequal inclusion probabilities, in proportion to a document's tokens: documents are
ranked by random odds over inclusion odds (Rosén's Pareto order) and taken in that order until the rest is reached.

The rank at which a source's rest is reached is found by histograms of the ranks, each refining the last one, so that
no source is sorted or gathered anywhere; only histograms of a fixed number of bins reach the driver.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.plans.lineage import written

BINS, REFINEMENTS = 2048, 4
SEED = 20_240_613
#: The inclusion probability of a certain document is one less this.
CERTAIN = 1e-12


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, n_tokens) of documents (doc_id, source, text), over whole texts; null and empty texts have none.

    tokenizer: path of the ranks file of a byte pair encoding, which every executor must be able to read."""

    def count(column: pd.Series) -> pd.Series:
        encode = _encoding(tokenizer).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in column], dtype="int64")

    return documents.select("doc_id", "source", F.pandas_udf(count, T.LongType())("text").alias("n_tokens"))


def _rate(bins: list[tuple[float, float, float]], rest: float) -> float:
    """k for which the sum of min(1, k t) t is rest; bins: (mean size t, sum of t, sum of t squared)."""
    low, high = 0.0, 1.0 / max(min((t for t, _, _ in bins if t > 0), default=1.0), 1e-12)
    for _ in range(200):
        k = (low + high) / 2
        got = sum(s if k * t >= 1 else k * s2 for t, s, s2 in bins)
        low, high = (k, high) if got < rest else (low, k)
    return (low + high) / 2


def plan_shares(totals: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, tuple[int, float]]:
    """source -> (whole copies, further tokens) in the largest mix that keeps shares and caps.

    Targets without a share, a cap or tokens have nothing to give and are left out; the others keep their proportions."""
    live = [(s, w, m) for s, w, m in targets if s is not None and w and w > 0 and m and m > 0 and totals.get(s, 0) > 0]
    size = min((m * totals[s] / w for s, w, m in live), default=0.0)
    plan = {}
    for s, w, m in live:
        need = min(size * w, float(m * totals[s]))
        copies = min(m, math.floor(need / totals[s] + 1e-9))
        plan[s] = (copies, max(0.0, need - copies * totals[s]))
    return plan


def mix_sources(sizes: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mix, shares) of sizes (doc_id, source, n_tokens) under targets (source, target_share, max_repeats; one row a source).

    mix: (doc_id, source, n_tokens, copies), one row for each row of sizes that is in the mix. shares: (source,
    target_share, max_repeats, n_tokens, reached_share, n_documents, most_copies), one row for each target, also where it
    gives nothing. A null source, one without target and documents without tokens are not mixed. Reached shares are off
    by at most the one document at which a source's rest is reached. Empty input gives an empty mix.
    """
    wanted = [(r.source, r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").collect()]  # one row a source
    names = [s for s, _, _ in wanted if s is not None]
    rows = sizes.select("doc_id", "source", "n_tokens").filter(F.col("source").isin(names) & (F.col("n_tokens") > 0))
    # sizes in a fixed number of classes, eight to each doubling
    classes = rows.groupBy("source", F.floor(F.log2("n_tokens") * 8).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("s"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("s2")).collect()
    totals: dict[str, int] = {}
    for r in classes:
        totals[r.source] = totals.get(r.source, 0) + r.s
    plan = plan_shares(totals, wanted)
    rates = {s: _rate([(r.s / r.n, r.s, r.s2) for r in classes if r.source == s], rest) if rest > 0 else 0.0 for s, (_, rest) in plan.items()}
    lookup = lambda values: F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col("source")] if values else F.lit(None)
    u = (F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    # documents as good as certain keep ranks of their own, before all others but without ties
    p = F.least(F.lit(1 - CERTAIN), lookup(rates) * F.col("n_tokens"))
    rank = F.when(p > 0, F.log(u / (1 - u)) - F.log(p / (1 - p)))
    ranked = written(rows.filter(F.col("source").isin(list(plan))).withColumn("rank", rank)) if plan else rows.withColumn("rank", F.lit(0.0)).limit(0)
    low, high = dict.fromkeys(plan, -101.0), dict.fromkeys(plan, 101.0)
    left = {s: rest for s, (_, rest) in plan.items() if rest > 0}
    for refinement in range(REFINEMENTS if left else 0):
        width = {s: (high[s] - low[s]) / BINS for s in left}
        bin_ = F.floor((F.col("rank") - lookup({s: low[s] for s in left})) / lookup(width))
        counted = ranked.filter(F.col("source").isin(list(left)) & (F.col("rank") > lookup({s: low[s] for s in left})) & (F.col("rank") <= lookup({s: high[s] for s in left}))).groupBy("source", bin_.alias("b")).agg(F.sum("n_tokens").alias("s")).collect()
        for s in left:
            start = low[s]
            for r in sorted((r for r in counted if r.source == s), key=lambda r: r.b):
                if r.s > left[s]:
                    low[s], high[s] = start + r.b * width[s], start + (r.b + 1) * width[s]
                    if refinement == REFINEMENTS - 1 and 2 * left[s] > r.s:
                        low[s] = high[s]
                    break
                left[s] -= r.s
            else:
                low[s] = high[s]
    # what is below the last bin is in; the bin itself, narrower than any gap that matters, too if more than half of it is needed
    copies = F.coalesce(lookup({s: c for s, (c, _) in plan.items()}), F.lit(0))
    cut = lookup({s: low[s] for s in left})
    taken = F.when(F.col("rank").isNotNull() & cut.isNotNull() & (F.col("rank") <= cut), 1).otherwise(0) if left else F.lit(0)
    mix = ranked.withColumn("copies", (copies + taken).cast("int")).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("n_tokens").alias("all")).collect()[0]["all"] or 0
    shares = targets.select("source", "target_share", "max_repeats").join(F.broadcast(got), "source", "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("n_tokens", "n_documents", "most_copies")}
    return mix, shares.withColumns(filled).withColumn("reached_share", F.col("n_tokens") / F.lit(float(whole or 1)))
