"""Consolidating pairwise links into groups: connected components by low-diameter decomposition.

Each level grows clusters from exponentially shifted start times (a vertex joins the cluster whose shifted wave reaches
it first; waves run until no vertex changes), contracts every cluster to one super-vertex, and recurses on the edges
between clusters until none is left; the assignments of the levels are composed. A level cuts about a share BETA of the
edges, so levels grow with the logarithm of the links, and waves of a level with that over BETA.

While a level has more than LOCAL_EDGES edges its waves are joins; below that, which is a fixed size, one task runs the
same levels over arrays. Nothing is gathered on the driver but counts and the hubs of a level (at most MOST_HUBS
vertices, by arithmetic).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.operators.skew import join_groups
from lattiq.plans.lineage import written

#: Rate of the exponential shifts: about a share BETA of all edges is cut at each level by the decomposition itself.
BETA = 0.4
#: A vertex with more than 1 / MOST_HUBS of all edges is a hub; its rows are joined by broadcast.
MOST_HUBS = 1000
#: Edges of a level that one task takes, both ways counted.
LOCAL_EDGES = 1_000_000


def _along(edges: DataFrame, state: DataFrame, hubs: DataFrame) -> DataFrame:
    """edges (u, v, hub) with the state of u; hubs: the hubs, at most MOST_HUBS, broadcast."""
    hub_state = state.join(F.broadcast(hubs), "u")
    return edges.filter("hub").join(F.broadcast(hub_state), "u").unionByName(edges.filter("NOT hub").join(state, "u"))


def _level(edges: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(assignment (u, center), edges between clusters) of a symmetric edge list (u, v)."""
    total = edges.count()
    degrees = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    hubs = degrees.filter(F.col("n") > total / MOST_HUBS).select("u")
    edges = written(edges.join(F.broadcast(hubs.withColumn("is_hub", F.lit(True))), "u", "left").select("u", "v", F.coalesce("is_hub", F.lit(False)).alias("hub")))
    uniform = (F.pmod(F.xxhash64("u", F.lit(level)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # a wave that starts earlier has a smaller key; the largest shift starts first
    state = degrees.select("u", (F.log(uniform) / BETA).alias("time"), F.col("u").alias("center"))
    state = written(state)
    while True:
        waves = _along(edges, state, hubs).select(F.col("v").alias("u"), (F.col("time") + 1).alias("time"), "center")
        reached = waves.groupBy("u").agg(F.min(F.struct("time", "center")).alias("w"))
        # no wave that comes by an edge is later than a step after the sender's own, so times only fall and waves end
        better = F.col("w") < F.struct("time", "center")
        state = written(state.join(reached, "u", "left").select("u", F.coalesce(F.when(better, F.col("w.time")), "time").alias("time"), F.coalesce(F.when(better, F.col("w.center")), "center").alias("center"), F.coalesce(better, F.lit(False)).alias("changed")))
        if state.filter("changed").isEmpty():
            break
    assignment = state.select("u", "center")
    one = _along(edges, assignment, hubs).select(F.col("center").alias("cu"), "v", "hub")
    half = one.filter("cu IS NOT NULL").select(F.col("v").alias("u"), F.col("cu").alias("v")).distinct()
    between = _along(half.join(F.broadcast(hubs.withColumn("is_hub", F.lit(True))), "u", "left").select("u", "v", F.coalesce("is_hub", F.lit(False)).alias("hub")), assignment, hubs)
    contracted = between.select(F.col("center").alias("u"), "v").filter("u <> v").distinct()
    return assignment, written(contracted)


def decompose(u: np.ndarray, v: np.ndarray, vertices: int, seed: int = 0) -> np.ndarray:
    """The cluster of each vertex (0 .. vertices - 1) after all levels, for edges u - v in both directions."""
    composed, level = np.arange(vertices), seed
    while len(u):
        shift = np.random.default_rng(level).exponential(1 / BETA, vertices)
        time, center = -shift, np.arange(vertices)
        while True:
            # the earliest wave at each end; ties go to the smaller center
            order = np.lexsort((center[u], time[u], v))
            first = np.ones(len(order), bool)
            first[1:] = v[order][1:] != v[order][:-1]
            at, sender = v[order][first], u[order][first]
            better = (time[sender] + 1 < time[at]) | ((time[sender] + 1 == time[at]) & (center[sender] < center[at]))
            if not better.any():
                break
            time[at[better]], center[at[better]] = time[sender[better]] + 1, center[sender[better]]
        composed = center[composed]
        u, v = center[u], center[v]
        edges = np.unique(np.stack([u, v], 1)[u != v], axis=0)
        u, v, level = edges[:, 0], edges[:, 1], level + 1
    return composed


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if parts:
        edges = pd.concat(parts)
        codes, names = pd.factorize(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]))
        cluster = decompose(codes[: len(edges)], codes[len(edges) :], len(names))
        yield pd.DataFrame({"u": names, "center": names[cluster]})


def connected_groups(links: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(member, group_id) of every record in links (a, b); group_id is the smallest member of the group.

    Links may repeat, point either way or join a record to itself; a link with a null end links nothing (its other end
    still comes out, alone if nothing else links it). Empty links give no rows.
    """
    pairs = links.select(F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y"))
    members = written(pairs.select(F.explode(F.array("x", "y")).alias("member")).filter("member IS NOT NULL").distinct())
    real = pairs.filter("x <> y")
    edges = written(real.selectExpr("x AS u", "y AS v").unionByName(real.selectExpr("y AS u", "x AS v")).distinct())
    composed, level, n = members.withColumn("center", F.col("member")), 0, edges.count()
    while n:
        if n <= local_edges:
            kind = edges.schema["u"].dataType.simpleString()
            assignment, n = written(edges.coalesce(1).mapInPandas(_local, f"u {kind}, center {kind}")), 0
        else:
            assignment, edges = _level(edges, level)
            n = edges.count()
        sizes = composed.groupBy("center").agg(F.count(F.lit(1)).alias("n"))
        step = sizes.join(assignment.select(F.col("u").alias("center"), F.col("center").alias("next")), "center")
        total = max(composed.count(), 1)
        moved = join_groups(composed, step, ["center"], "n", total).select("member", F.col("next").alias("center"))
        settled = composed.join(assignment.select(F.col("u").alias("center")), "center", "left_anti").select("member", "center")
        composed = written(moved.unionByName(settled))
        level += 1
    names = composed.groupBy("center").agg(F.min("member").alias("group_id"), F.count(F.lit(1)).alias("n"))
    return join_groups(composed, names, ["center"], "n", max(composed.count(), 1)).select("member", "group_id")


def shared_value_links(rows: DataFrame, member: str, values: list[str]) -> DataFrame:
    """Links (a, b) that tie each member to the smallest member with the same values: one a row, never all pairs.

    Values are compared without outer blanks (of any kind) and letter case; a null or blank one links nothing, and a row
    with a null member plays no part. A member without any link comes out linked to itself.
    """
    from lattiq.llm.text import trimmed

    known = rows.select(F.col(f"`{member}`").alias("a"), *[F.nullif(trimmed(F.lower(F.col(f"`{v}`"))), F.lit("")).alias(f"v{i}") for i, v in enumerate(values)]).filter("a IS NOT NULL")
    names = [f"v{i}" for i in range(len(values))]
    given = known.dropna(subset=names).distinct()
    heads = given.groupBy(*names).agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n"))
    linked = join_groups(given, heads, names, "n", max(given.count(), 1)).select("a", "b")
    return linked.unionByName(known.select("a", F.col("a").alias("b"))).distinct()
