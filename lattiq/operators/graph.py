"""Graph operators over pair lists: degree, scores of pairs, clustering, hops, components, communities, ontologies.

Pairs to be scored are always the start of a join, never all wedges of the graph, so a hub costs its own degree once for
each pair that touches it. Iterative operators cut their lineage into reliable storage each round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.operators.ranking import cumulative
from lattiq.operators.skew import salted_join
from lattiq.plans.lineage import discard, written

#: Links that one task may take, in the last steps of operators that shrink a graph.
LOCAL_LINKS = 2_000_000
#: Sources whose surroundings are followed together, one bit of a row each.
BLOCK = 2048


def degrees(und: DataFrame) -> DataFrame:
    """(idx, deg) of every node with a link; a loop counts twice."""
    return und.select(F.explode(F.array("u", "v")).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("deg"))


def pair_scores(pairs: DataFrame, adj: DataFrame, deg: DataFrame) -> DataFrame:
    """(u, v, cn, jaccard, aa) of distinct pairs: common neighbours, Jaccard and Adamic-Adar; absent nodes score 0.

    cn and aa leave the two nodes themselves out, jaccard does not; a neighbour of degree 1 adds nothing to aa."""
    pairs = pairs.select("u", "v").distinct()
    inverse = deg.select(F.col("idx").alias("w"), F.when(F.col("deg") > 1, 1 / F.ln("deg")).otherwise(0.0).alias("inv"))
    # a hub's neighbours are many rows of one key, and so are the pairs of a frequent end
    near_u = salted_join(adj.select(F.col("a").alias("u"), F.col("b").alias("w")), pairs, ["u"])
    shared = near_u.join(adj.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
    inner = (F.col("w") != F.col("u")) & (F.col("w") != F.col("v"))
    met = shared.join(inverse, "w").groupBy("u", "v").agg(F.count(F.when(inner, 1)).alias("cn"), F.count(F.lit(1)).alias("both"), F.sum(F.when(inner, F.col("inv")).otherwise(0.0)).alias("aa"))
    size = adj.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    end = lambda c: size.select(F.col("a").alias(c), F.col("n").alias(f"n_{c}"))
    j = pairs.join(met, ["u", "v"], "left").join(end("u"), "u", "left").join(end("v"), "v", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    union = zero("n_u") + zero("n_v") - zero("both")
    return j.select("u", "v", zero("cn").alias("cn"), F.when(union > 0, zero("both") / union).otherwise(0.0).alias("jaccard"), F.coalesce("aa", F.lit(0.0)).alias("aa"))


def triangles(und: DataFrame) -> DataFrame:
    """(idx, n) triangles through each node. Links point from the lower to the higher degree, which bounds every fan-out by the square root of the links."""
    und = und.filter("u <> v")
    deg = degrees(und)
    end = lambda c: deg.select(F.col("idx").alias(c), F.col("deg").alias(f"d_{c}"))
    j = und.join(end("u"), "u").join(end("v"), "v")
    up = F.struct("d_u", "u") < F.struct("d_v", "v")
    links = written(j.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("p"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("q")))
    wedges = links.join(links.select("p", F.col("q").alias("r")), "p").filter("q <> r")
    closed = wedges.join(links.select(F.col("p").alias("q"), F.col("q").alias("r")), ["q", "r"])
    return closed.select(F.explode(F.array("p", "q", "r")).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("n"))


def clustering(und: DataFrame) -> DataFrame:
    """(n_nodes, n_links, clustering, expected, ratio): mean local clustering (0 below degree 2) beside that of a random graph."""
    simple = und.filter("u <> v")
    local = degrees(simple).join(triangles(und), "idx", "left").select(F.when(F.col("deg") > 1, 2.0 * F.coalesce("n", F.lit(0)) / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0).alias("c"), "deg")
    out = local.agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("deg") / 2).cast("bigint").alias("n_links"), F.avg("c").alias("clustering"))
    expected = F.when(F.col("n_nodes") > 1, 2.0 * F.col("n_links") / F.col("n_nodes") / (F.col("n_nodes") - 1))
    return out.withColumn("expected", expected).withColumn("ratio", F.when(F.col("expected") > 0, F.round(F.col("clustering") / F.col("expected"), 1)))


def _bit_words(no: Column, first: int, n: int) -> list[Column]:
    """Columns w0.. of bits, of which only that of number no is set; numbers start at first, n of them."""
    at = no - first
    return [F.when(F.floor(at / 64) == i, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("bigint")).alias(f"w{i}") for i in range(-(-n // 64))]


def _spread(bits: DataFrame, links: DataFrame) -> DataFrame:
    """bits (x, w0.., and block where they have one) one link on: each node's are those of all x that links (x, y) to it. Hubs are cut by a salted join."""
    words, by = [c for c in bits.columns if c not in ("x", "block")], [c for c in bits.columns if c == "block"]
    return salted_join(links, bits, ["x"]).groupBy("y", *by).agg(*[F.bit_or(w).alias(w) for w in words]).withColumnRenamed("y", "x")


def _together(bits: DataFrame, degree: DataFrame, most: int) -> list[list[int]]:
    """The blocks of bits (x, block, ..) in groups that may go one link on at once: most rows of links each, or a single block."""
    costs = bits.join(degree, "x").groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()  # a row for each 2048 sources
    groups, size = [], 0
    for c in costs:
        if not groups or size + c.n > most:
            groups, size = [*groups, []], 0
        groups[-1].append(c.block)
        size += c.n
    return groups


def hop_distances(pairs: DataFrame, adj: DataFrame, most: int = 5, block: int = BLOCK) -> DataFrame:
    """(u, v, hops) of distinct pairs; hops is null beyond most, which is 5 at the highest.

    The rarer of both ends are sources, each a bit; block of them share a row, which goes from node to node, a link a round,
    so that a node costs a few numbers for all its sources and a hub no more than its links. No wedge or path is ever a row.
    As many blocks go together as reach no more rows than there are links, so that blocks of parts of the graph that do not
    meet need no pass over all links each. After two rounds only what leads to pairs not yet found is followed.
    What a round has read is deleted after it."""
    if most > 5:
        raise ValueError("distances beyond 5 hops are those of distances_from()")
    every = written(pairs.select("u", "v").distinct())
    ends = every.agg(F.count_distinct("u").alias("u"), F.count_distinct("v").alias("v")).first()
    s, t = ("v", "u") if ends.v <= ends.u else ("u", "v")
    x, y = ("b", "a") if s == "v" else ("a", "b")
    links = written(adj.select(F.col(x).alias("x"), F.col(y).alias("y")))  # repeated links change nothing
    degree = written(links.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    n_links = links.count()
    sources = written(cumulative(every.select(F.col(s).alias("s")).filter("s IS NOT NULL").distinct().withColumn("one", F.lit(1)), [], ["s"], ["one"]).select("s", F.floor(F.col("before_one") / block).alias("block"), F.pmod("before_one", F.lit(block)).alias("at")))
    apart = written(every.filter("u <> v").select(F.col(s).alias("s"), F.col(t).alias("t")).join(sources, "s"))
    found = [every.filter("u = v").select("u", "v", F.lit(0).alias("hops"))]
    into = lambda nodes: links.join(nodes.withColumnRenamed("x", "y"), "y", "left_semi").select("x", "y")

    def reach(bits: DataFrame, nodes: DataFrame, further: int) -> DataFrame:
        """bits so many links on, at nodes only."""
        if further > 1:
            bits = reach(bits, into(nodes).select("x").distinct(), further - 1)
        return _spread(bits, into(nodes))

    def follow(bits: DataFrame, gone: int, rest: DataFrame, hops: int) -> None:
        """Adds what of rest is found at hops and beyond; bits are gone links from their sources."""
        words = F.array(*[c for c in bits.columns if c not in ("x", "block")])
        set_ = F.getbit(F.element_at(words, (F.floor(F.col("at") / 64) + 1).cast("int")), F.pmod("at", F.lit(64)).cast("int")) == 1
        whole = hops < min(most, 3)
        there = written(_spread(bits, links)) if whole else written(reach(bits, rest.select(F.col("t").alias("x")).distinct(), hops - gone))
        hit = written(rest.join(there.withColumnRenamed("x", "t"), ["t", "block"]).filter(set_).select("s", "t"))
        found.append(hit.select(F.col("s").alias(s), F.col("t").alias(t), F.lit(hops).alias("hops")))
        left = written(rest.join(hit, ["s", "t"], "left_anti"))
        if not whole:
            discard(there)
        if hops < most and not left.isEmpty():
            if not whole:
                follow(bits, gone, left, hops + 1)
            elif ends[s] <= block:
                follow(there, hops, left, hops + 1)
            else:
                asked = there.join(left.select("block").distinct(), "block", "left_semi")
                for blocks in _together(asked, degree, n_links):
                    of = F.col("block").isin(blocks)
                    follow(there.filter(of), hops, left.filter(of), hops + 1)
        if whole:
            discard(there)
        discard(left)

    if ends[s]:
        follow(sources.select(F.col("s").alias("x"), "block", *_bit_words(F.col("at"), 0, min(block, ends[s]))), 0, apart, 1)
    discard(links, degree, sources, apart)
    return every.join(reduce(DataFrame.unionByName, found), ["u", "v"], "left")


def distances_between(sources: DataFrame, targets: DataFrame, adj: DataFrame, block: int = BLOCK) -> DataFrame:
    """(s, x, hops) of the distinct sources (s) that distinct targets (x) reach, at whatever distance.

    Sources are bits that go back along the links, block of them together; only what arrives at a target becomes rows."""
    links = written(adj.select(F.col("b").alias("x"), F.col("a").alias("y")))  # repeated links change nothing
    ends = written(targets.select("x").distinct())
    named = written(cumulative(sources.select("s").filter("s IS NOT NULL").distinct().withColumn("one", F.lit(1)), [], ["s"], ["one"]).select("s", F.col("before_one").alias("no")))
    n, found = named.count(), None
    for first in range(0, n, block):
        part = named.filter((F.col("no") >= first) & (F.col("no") < first + block))
        bits = seen = written(part.select(F.col("s").alias("x"), *_bit_words(F.col("no"), first, min(block, n - first))))
        words, hop = [c for c in bits.columns if c != "x"], 0
        while not bits.isEmpty():
            here = bits.join(ends, "x", "left_semi").select("x", F.lit(hop).alias("hops"), F.lit(first).alias("first"), F.posexplode(F.array(*words)).alias("place", "word")).filter("word <> 0")
            found = here if found is None else found.unionByName(here)
            old = seen.select("x", *[F.col(w).alias(f"old_{w}") for w in words])
            fresh = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"old_{w}", F.lit(0).cast("bigint")))).alias(w) for w in words]
            some = F.array_max(F.transform(F.array(*words), lambda w: (w != 0).cast("int"))) == 1
            bits, hop = written(_spread(bits, links).join(old, "x", "left").select("x", *fresh).filter(some)), hop + 1
            seen = written(seen.unionByName(bits).groupBy("x").agg(*[F.bit_or(w).alias(w) for w in words]))
    if found is None:
        return ends.limit(0).select(F.col("x").alias("s"), "x", F.lit(0).alias("hops"))
    bit = found.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter(F.getbit("word", F.col("bit")) == 1)
    return bit.select("x", "hops", (F.col("first") + F.col("place") * 64 + F.col("bit")).cast("bigint").alias("no")).join(named, "no").select("s", "x", "hops")


def distances_from(sources: DataFrame, adj: DataFrame) -> DataFrame:
    """(s, x, hops) of all nodes that distinct sources (s) reach, at whatever distance."""
    links = written(adj.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct())
    frontier = written(sources.select("s", F.col("s").alias("x")).distinct())
    seen, hop = written(frontier.withColumn("hops", F.lit(0))), 0
    while not frontier.isEmpty():
        hop += 1
        step = frontier.join(links, "x").select("s", F.col("y").alias("x")).distinct()
        frontier = written(step.join(seen.select("s", "x"), ["s", "x"], "left_anti"))
        seen = written(seen.unionByName(frontier.withColumn("hops", F.lit(hop))))
    return seen


def proximity(pairs: DataFrame, diseases: DataFrame, adj: DataFrame, order: Column, most: int = 1000, least: int = 100) -> DataFrame:
    """(u, v, observed, n_random, random_mean, low, high, p, bonferroni) of distinct connected pairs with at least least other diseases (d) that u reaches.

    The observed distance beside that of most of those at most, least order first (may use u, v and d): mean, 2.5 and 97.5
    percentiles, share not above it, and that share times the pairs tested."""
    pairs = pairs.select("u", "v").distinct()
    diseases = diseases.select("d").distinct()
    asked = diseases.select(F.col("d").alias("s")).unionByName(pairs.select(F.col("v").alias("s")))
    reached = written(distances_between(asked, pairs.select(F.col("u").alias("x")), adj).select(F.col("x").alias("u"), F.col("s").alias("d"), "hops"))
    observed = pairs.join(reached.select("u", F.col("d").alias("v"), F.col("hops").alias("observed")), ["u", "v"])
    pool = reached.join(diseases, "d").select("u", "d", "hops")
    drawn = observed.join(pool, "u").filter("d <> v").withColumn("rank", F.row_number().over(Window.partitionBy("u", "v").orderBy(order, "d"))).filter(F.col("rank") <= most)
    q = lambda x: F.percentile("hops", x)
    at = F.avg((F.col("hops") <= F.col("observed")).cast("double"))
    tested = written(drawn.groupBy("u", "v", "observed").agg(F.count(F.lit(1)).alias("n_random"), F.avg("hops").alias("random_mean"), q(0.025).alias("low"), q(0.975).alias("high"), at.alias("p")).filter(F.col("n_random") >= least))
    return tested.withColumn("bonferroni", F.least(F.col("p") * tested.count(), F.lit(1.0)))


def within_two(pairs: DataFrame, adj: DataFrame, by: list[str] = ()) -> DataFrame:
    """pairs (by.., u, v) with reached: whether v is u, a neighbour of u, or a neighbour of one; adj may carry by too."""
    links = adj.select(*by, "a", "b").distinct()
    one = pairs.join(links.select(*by, F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1).alias("one")), [*by, "u", "v"], "left")
    far = pairs.join(links.select(*by, F.col("a").alias("u"), F.col("b").alias("w")), [*by, "u"]).join(links.select(*by, F.col("b").alias("v"), F.col("a").alias("w")), [*by, "v", "w"]).select(*by, "u", "v").distinct().withColumn("two", F.lit(1))
    reached = (F.col("u") == F.col("v")) | F.col("one").isNotNull() | F.col("two").isNotNull()
    return one.join(far, [*by, "u", "v"], "left").withColumn("reached", reached).select(*pairs.columns, "reached")


def path_counts(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    """(u, v, p1, p2, p3): simple paths of one, two and three links between the ends of distinct pairs."""
    pairs, adj = pairs.select("u", "v").distinct(), adj.filter("a <> b")
    hop = lambda x, y: adj.select(F.col("a").alias(x), F.col("b").alias(y))
    p1 = pairs.join(hop("u", "v"), ["u", "v"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("p1"))
    first = pairs.join(hop("u", "w"), "u").filter("w <> v")
    p2 = first.join(hop("w", "v"), ["w", "v"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("p2"))
    second = first.join(hop("w", "z"), "w").filter("z <> u AND z <> v")
    p3 = second.join(hop("z", "v"), ["z", "v"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("p3"))
    out = pairs
    for p in (p1, p2, p3):
        out = out.join(p, ["u", "v"], "left")
    return out.na.fill(0, ["p1", "p2", "p3"])


def components(und: DataFrame) -> DataFrame:
    """(idx, component) of every linked node, named by its smallest node; by large-star and small-star contraction."""
    links = written(und.select(F.greatest("u", "v").alias("p"), F.least("u", "v").alias("q")).distinct())
    everything = written(links.select(F.explode(F.array("p", "q")).alias("idx")).distinct())
    links, before = links.filter("p <> q"), None
    while True:
        both = links.unionByName(links.select(F.col("q").alias("p"), F.col("p").alias("q")))
        least = both.groupBy("p").agg(F.least(F.min("q"), F.first("p")).alias("m"))
        large = both.filter("q > p").join(least, "p").select(F.col("q").alias("p"), F.col("m").alias("q")).distinct()
        low = large.groupBy("p").agg(F.min("q").alias("m"))
        small = large.join(low, "p").select(F.explode(F.array(F.struct(F.col("p").alias("p"), F.col("m").alias("q")), F.struct(F.col("q").alias("p"), F.col("m").alias("q")))).alias("x")).select("x.*").filter("p <> q").distinct()
        links = written(small)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("p", "q").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return everything.join(links.select(F.col("p").alias("idx"), F.col("q").alias("m")), "idx", "left").select("idx", F.coalesce("m", "idx").alias("component"))


def connectivity(nodes: DataFrame, und: DataFrame) -> DataFrame:
    """(n_nodes, n_components, largest, isolated) of nodes (idx) and the ends of links; a node without a link is a component of its own."""
    c = written(components(und))
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("linked"), F.max("n").alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("ends"))
    isolated = nodes.select("idx").distinct().join(c, "idx", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    one = sizes.join(F.broadcast(isolated))  # single rows
    largest = F.coalesce("most", F.when(F.col("isolated") > 0, 1).otherwise(0))
    return one.select((F.col("ends") + F.col("isolated")).alias("n_nodes"), (F.col("linked") + F.col("isolated")).alias("n_components"), largest.cast("bigint").alias("largest"), "isolated")


def label_propagation(und: DataFrame, rounds: int = 5) -> DataFrame:
    """(idx, community) after so many synchronous rounds in which each node takes its neighbours' most frequent label, ties to the smallest."""
    adj = written(und.filter("u <> v").select("u", "v").unionByName(und.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = written(adj.select(F.col("u").alias("idx")).distinct().withColumn("community", F.col("idx")))
    for _ in range(rounds):
        votes = adj.join(labels.select(F.col("idx").alias("v"), "community"), "v").groupBy("u", "community").agg(F.count(F.lit(1)).alias("n"))
        labels = written(votes.groupBy(F.col("u").alias("idx")).agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community")))
    return labels


def _moving_rounds(edges: DataFrame, rounds: int, resolution: float) -> DataFrame:
    """(idx, community) of weighted edges (u, v, w), u <= v, by rounds in which nodes move to the neighbouring community of greatest gain.

    Half of the nodes, by hash, move in each round, so that two nodes do not swap places for ever. Rounds end when few move."""
    adj = written(edges.filter("u <> v").select("u", "v", "w").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    deg = written(edges.select(F.explode(F.array("u", "v")).alias("idx"), "w").groupBy("idx").agg(F.sum("w").alias("deg")))
    twice = float(max(deg.agg(F.sum("deg")).first()[0] or 1, 1))
    labels, n = written(deg.select("idx", F.col("idx").alias("community"))), deg.count()
    for r in range(rounds):
        volume = deg.join(labels, "idx").groupBy("community").agg(F.sum("deg").alias("vol"))
        links = adj.join(labels.select(F.col("idx").alias("v"), "community"), "v").groupBy(F.col("u").alias("idx"), "community").agg(F.sum("w").alias("l"))
        own = labels.select("idx", "community").join(deg, "idx")
        options = links.unionByName(own.select("idx", "community", F.lit(0).cast("bigint").alias("l"))).groupBy("idx", "community").agg(F.sum("l").alias("l"))
        scored = options.join(own.select("idx", "deg", F.col("community").alias("now")), "idx").join(volume, "community")
        rest = F.col("vol") - F.when(F.col("community") == F.col("now"), F.col("deg")).otherwise(0)
        gain = F.col("l") - resolution * F.col("deg") * rest / twice
        best = scored.withColumn("gain", gain).groupBy("idx", "now").agg(F.max_by("community", F.struct("gain", (F.col("community") == F.col("now")).cast("int"), -F.col("community"))).alias("best"))
        moves = (F.pmod(F.xxhash64("idx", F.lit(r)), F.lit(2)) == 0) & (F.col("best") != F.col("now"))
        moved = written(best.select("idx", F.when(moves, F.col("best")).otherwise(F.col("now")).alias("community"), moves.alias("moved")))
        labels = moved.select("idx", "community")
        if moved.filter("moved").count() < n / 200:
            break
    return labels


def louvain_local(u, v, w, n: int, resolution: float = 1.0):
    """Community of each node 0 .. n - 1 of weighted edges (arrays, each pair once, loops allowed), by Louvain's levels."""
    import numpy as np

    whole = np.arange(n)
    while True:
        loop = u == v
        deg = np.bincount(u, w, n) + np.bincount(v, w, n)
        total = deg.sum()
        if not total:
            return whole
        a, b, c = np.concatenate([u[~loop], v[~loop]]), np.concatenate([v[~loop], u[~loop]]), np.concatenate([w[~loop], w[~loop]])
        order = np.argsort(a, kind="stable")
        start = np.searchsorted(a[order], np.arange(n + 1)).tolist()
        near, weight, degree = b[order].tolist(), c[order].tolist(), deg.tolist()
        label, volume, moved_any = list(range(n)), deg.tolist(), False
        for _ in range(50):
            moved = 0
            for i in range(n):
                begin, end = start[i], start[i + 1]
                if begin == end:
                    continue
                mine, links = label[i], {}
                for k in range(begin, end):
                    x = label[near[k]]
                    links[x] = links.get(x, 0.0) + weight[k]
                volume[mine] -= degree[i]
                scale = resolution * degree[i] / total
                best, gain = mine, links.get(mine, 0.0) - scale * volume[mine]
                for x, l in links.items():
                    g = l - scale * volume[x]
                    if g > gain + 1e-12:
                        best, gain = x, g
                volume[best] += degree[i]
                if best != mine:
                    label[i] = best
                    moved += 1
            moved_any |= moved > 0
            if moved <= n // 1000:
                break
        if not moved_any:
            return whole
        _, label = np.unique(label, return_inverse=True)
        whole = label[whole]
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        n = int(label.max()) + 1
        key, back = np.unique(low.astype(np.int64) * n + high, return_inverse=True)
        u, v, w = key // n, key % n, np.bincount(back, w)


def louvain(und: DataFrame, resolution: float = 1.0, rounds: int = 8, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(idx, community) of every linked node by Louvain's method: local moving, contraction of communities, and so on.

    While the graph has more than local_links links, nodes move in rounds of joins; below that fixed size the levels that are
    left run in one task, node by node. A community is named by its smallest node. Order and ties are fixed, so results repeat."""
    import numpy as np
    import pandas as pd

    edges = written(und.filter("u <> v").select("u", "v", F.lit(1).cast("bigint").alias("w")))
    composed, n = written(degrees(edges).select("idx", F.col("idx").alias("c"))), edges.count()

    def local(batches):
        parts = list(batches)
        if parts:
            e = pd.concat(parts).sort_values(["u", "v"])
            names = np.unique(np.concatenate([e["u"].to_numpy(), e["v"].to_numpy()]))
            found = louvain_local(np.searchsorted(names, e["u"]), np.searchsorted(names, e["v"]), e["w"].to_numpy(float), len(names), resolution)
            yield pd.DataFrame({"c": names, "next": found})

    compose = lambda step: written(composed.join(step, "c").select("idx", F.col("next").alias("c")))
    while n > local_links:
        step = _moving_rounds(edges, rounds, resolution).select(F.col("idx").alias("c"), F.col("community").alias("next"))
        composed = compose(step)
        end = lambda c: step.select(F.col("c").alias(c), F.col("next").alias(f"n_{c}"))  # noqa: E731, B023
        j = edges.join(end("u"), "u").join(end("v"), "v")
        edges = written(j.groupBy(F.least("n_u", "n_v").alias("u"), F.greatest("n_u", "n_v").alias("v")).agg(F.sum("w").alias("w")))
        before, n = n, edges.count()
        if n > 0.9 * before:  # no level shrinks it further
            local_links = n
    if n:
        composed = compose(edges.coalesce(1).mapInPandas(local, "c bigint, next bigint"))
    return composed.join(composed.groupBy("c").agg(F.min("idx").alias("community")), "c").select("idx", "community")


def largest_component(und: DataFrame) -> DataFrame:
    """(idx) of the largest component of the linked nodes; of equal ones that with the smallest node."""
    c = written(components(und))
    top = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(top), "component").select("idx")


def outside_types(nodes: DataFrame, inside: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent types of nodes (idx, type) that are not inside (idx), with rank (a report)."""
    out = nodes.join(inside, "idx", "left_anti").groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(k)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "type")))


def modularity(und: DataFrame, labels: DataFrame) -> DataFrame:
    """(n_communities, modularity) of a partition (idx, community)."""
    und = und.filter("u <> v")
    end = lambda c: labels.select(F.col("idx").alias(c), F.col("community").alias(f"c_{c}"))
    inside = und.join(end("u"), "u").join(end("v"), "v").filter("c_u = c_v").groupBy(F.col("c_u").alias("community")).agg(F.count(F.lit(1)).alias("l"))
    volume = degrees(und).join(labels, "idx").groupBy("community").agg(F.sum("deg").alias("d"))
    m = und.agg(F.count(F.lit(1)).alias("m"))  # one row
    j = volume.join(inside, "community", "left").join(F.broadcast(m))
    term = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2.0 * F.col("m")), 2)
    return j.agg(F.count(F.lit(1)).alias("n_communities"), F.round(F.sum(term), 6).alias("modularity"))


def purity(labels: DataFrame, types: DataFrame) -> DataFrame:
    """(community, size, dominant, purity): the most frequent type in each community and its share."""
    counts = labels.join(types.select("idx", "type"), "idx").groupBy("community", "type").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("community").agg(F.sum("n").alias("size"), F.max_by("type", F.struct("n", "type")).alias("dominant"), F.max("n").alias("most"))
    return out.select("community", "size", "dominant", F.round(F.col("most") / F.col("size"), 6).alias("purity"))


def agreement(pairs: DataFrame) -> DataFrame:
    """(nmi, ari) of two labellings (x, y) of the same rows, from their contingency table."""
    cell = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    choose = lambda c: c * (c - 1) / 2
    total = pairs.agg(F.count(F.lit(1)).cast("double").alias("t"))  # one row
    h = lambda df, name: df.join(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t")))).alias(f"h_{name}"), F.sum(choose(F.col("n"))).alias(f"s_{name}"))
    margin = lambda c: cell.groupBy(c).agg(F.sum("n").alias("n"))
    one = h(cell, "xy").join(h(margin("x"), "x")).join(h(margin("y"), "y")).join(total)  # single rows
    expected = F.col("s_x") * F.col("s_y") / choose(F.col("t"))
    mutual = F.col("h_x") + F.col("h_y") - F.col("h_xy")
    return one.select(F.round(mutual / ((F.col("h_x") + F.col("h_y")) / 2), 6).alias("nmi"), F.round((F.col("s_xy") - expected) / ((F.col("s_x") + F.col("s_y")) / 2 - expected), 6).alias("ari"))


def kept_after_dropout(und: DataFrame, trials: DataFrame, order: Column) -> DataFrame:
    """(rate, trial, u, v) of the links left in each trial (rate, trial). round(rate * links) links are dropped, lowest order first.

    order: an integer column, may use u, v and trial. The cut is found in the counts of its values; only the links at
    the cut itself are ranked, by (u, v)."""
    total = und.count()
    draws = written(und.join(F.broadcast(trials)).select("rate", "trial", "u", "v", order.alias("o")))
    counts = draws.groupBy("rate", "trial", "o").agg(F.count(F.lit(1)).alias("n"))
    before = cumulative(counts, ["rate", "trial"], ["o"], ["n"])
    drop = F.round(F.col("rate") * total)
    cut = before.filter((F.col("before_n") <= drop) & (F.col("before_n") + F.col("n") > drop)).select("rate", "trial", F.col("o").alias("cut"), (drop - F.col("before_n")).alias("rest"))
    j = draws.join(F.broadcast(cut), ["rate", "trial"])
    tied = j.filter("o = cut").withColumn("rank", F.row_number().over(Window.partitionBy("rate", "trial").orderBy("u", "v"))).filter("rank > rest")
    return j.filter("o > cut").select("rate", "trial", "u", "v").unionByName(tied.select("rate", "trial", "u", "v"))


def dropout_marks(und: DataFrame, trials: list[tuple[float, int]], order) -> DataFrame:
    """(u, v, kept) of all links: bit i of kept is set where kept_after_dropout() leaves the link in trials[i], of which there may be 63.

    order: the integer column of a trial's number. Trials of one number are cuts of one order, so a link is one row for all."""
    if len(trials) > 63:
        raise ValueError("at most 63 trials are marked at once")
    numbers = sorted({t for _, t in trials})
    rows = written(und.select("u", "v", *[order(t).cast("bigint").alias(f"o{t}") for t in numbers]))
    total = rows.count()
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(t).alias("trial"), F.col(f"o{t}").alias("o")) for t in numbers])).alias("e")).select("e.*")
    before = cumulative(each.groupBy("trial", "o").agg(F.count(F.lit(1)).alias("n")), ["trial"], ["o"], ["n"])
    listed = und.sparkSession.createDataFrame([(i, r, t) for i, (r, t) in enumerate(trials)], "i int, rate double, trial int")
    drop = F.round(F.col("rate") * total)
    cuts = before.join(F.broadcast(listed), "trial").filter((F.col("before_n") <= drop) & (F.col("before_n") + F.col("n") > drop)).select("i", "trial", F.col("o").alias("cut"), (drop - F.col("before_n")).alias("rest")).collect()  # a row a trial
    none, bit = F.lit(0).cast("bigint"), lambda c: F.lit(1 << c.i).cast("bigint")
    above = reduce(Column.bitwiseOR, [F.when(F.col(f"o{c.trial}") > c.cut, bit(c)).otherwise(none) for c in cuts], none)
    at_cut = F.filter(F.array(*[F.when(F.col(f"o{c.trial}") == c.cut, F.struct(bit(c).alias("bit"), F.lit(float(c.rest)).alias("rest"))) for c in cuts]), lambda x: x.isNotNull())
    if not cuts:
        return rows.select("u", "v", none.alias("kept"))
    tied = rows.select("u", "v", F.explode(at_cut).alias("c")).select("u", "v", "c.*").withColumn("rank", F.row_number().over(Window.partitionBy("bit").orderBy("u", "v"))).filter("rank > rest")
    return rows.select("u", "v", above.alias("above")).join(tied.groupBy("u", "v").agg(F.bit_or("bit").alias("tied")), ["u", "v"], "left").select("u", "v", F.col("above").bitwiseOR(F.coalesce("tied", none)).alias("kept"))


def within_two_marked(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    """(u, v, marks) of distinct pairs: the bits of adj (a, b, kept) whose links alone bring u to v in one or two; v = u needs none."""
    near = adj.select(F.col("a").alias("u"), F.col("b").alias("w"), F.col("kept").alias("first"))
    last = adj.select(F.col("b").alias("v"), F.col("a").alias("w"), F.col("kept").alias("second"))
    two = pairs.join(near, "u").join(last, ["v", "w"]).groupBy("u", "v").agg(F.bit_or(F.col("first").bitwiseAND(F.col("second"))).alias("two"))
    one = pairs.join(adj.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("kept").alias("one")), ["u", "v"], "left")
    none = F.lit(0).cast("bigint")
    return one.join(two, ["u", "v"], "left").select("u", "v", F.coalesce("one", none).bitwiseOR(F.coalesce("two", none)).alias("marks"))


def resilience(curve: DataFrame, x: str = "rate", y: str = "recovery") -> DataFrame:
    """(resilience): trapezoid area under a curve over its range, 4 places; the curve has one row a rate."""
    w = Window.partitionBy().orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.select(x, area.alias("a")).agg(F.round(F.sum("a") / (F.max(x) - F.min(x)), 4).alias("resilience"))


def ego_network(centres: DataFrame, adj: DataFrame, first: int = 40, second: int = 30) -> DataFrame:
    """(centre, hop, idx): at most first neighbours of each centre and second neighbours of those, smallest first (a capped drawing)."""
    rank = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("b"))
    one = centres.select(F.col("idx").alias("centre")).join(adj.filter("a <> b").select(F.col("a").alias("centre"), "b"), "centre").withColumn("r", rank(["centre"])).filter(F.col("r") <= first).select("centre", F.col("b").alias("m"))
    two = one.join(adj.filter("a <> b").select(F.col("a").alias("m"), "b"), "m").filter("b <> centre").withColumn("r", rank(["centre", "m"])).filter(F.col("r") <= second).select("centre", F.col("b").alias("idx")).distinct()
    hop1 = one.select("centre", F.col("m").alias("idx"))
    return hop1.withColumn("hop", F.lit(1)).unionByName(two.join(hop1, ["centre", "idx"], "left_anti").withColumn("hop", F.lit(2))).select("centre", "hop", "idx")


def ancestors(parents: DataFrame, rounds: int = 15) -> DataFrame:
    """(child, ancestor, depth): closure of (child, parent), shortest depth, up to so many rounds; cycles end by themselves."""
    frontier = written(parents.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    closure = frontier
    for depth in range(2, rounds + 1):
        step = frontier.select("child", F.col("ancestor").alias("m")).join(parents.select(F.col("child").alias("m"), F.col("parent").alias("ancestor")), "m").select("child", "ancestor", F.lit(depth).alias("depth")).distinct()
        frontier = written(step.join(closure.select("child", "ancestor"), ["child", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
        closure = written(closure.unionByName(frontier))
    return closure


def classify_domain(nodes: DataFrame, closure: DataFrame, roots: list[tuple[int, str]], terms: list[tuple[str, str]]) -> DataFrame:
    """nodes (idx, name) with domain and method: by the first root among the ancestors, else the first term in the name."""
    spark = nodes.sparkSession
    listed = F.broadcast(spark.createDataFrame([(i, r, d) for i, (r, d) in enumerate(roots)], "priority int, ancestor bigint, root_domain string"))
    by_root = closure.join(listed, "ancestor").groupBy(F.col("child").alias("idx")).agg(F.min_by("root_domain", "priority").alias("root_domain"))
    term = F.lit(None).cast("string")
    for word, domain in reversed(terms):
        term = F.when(F.lower("name").contains(word), F.lit(domain)).otherwise(term)
    j = nodes.join(by_root, "idx", "left").withColumn("term_domain", term)
    method = F.when(F.col("root_domain").isNotNull(), "ontology").when(F.col("term_domain").isNotNull(), "terms").otherwise("unclassified")
    return j.select("idx", F.coalesce("root_domain", "term_domain", F.lit("unclassified")).alias("domain"), method.alias("method"))


def _log_factorial(n):
    """ln n! of an array, by Stirling's series beyond a short table."""
    import numpy as np

    n = np.asarray(n, float)
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 33)))])
    x = np.maximum(n, 1) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n <= 32, small[np.minimum(n, 32).astype(int)], series)


def adjusted_mutual_information(pairs: DataFrame) -> float:
    """AMI of two labellings (x, y). The driver sees the distinct sizes of labels and how many have each, not the labels:
    of n rows there can be no more than the root of 2 n distinct sizes."""
    import numpy as np

    cells = written(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    total = cells.agg(F.sum("n")).first()[0] or 0
    if not total:
        return float("nan")
    spread = lambda df: tuple(np.array(x, float) for x in zip(*[(r.n, r["count"]) for r in df.groupBy("n").count().collect()]))
    margin = lambda c: spread(cells.groupBy(c).agg(F.sum("n").alias("n")))
    (a, ka), (b, kb), (c, kc) = margin("x"), margin("y"), spread(cells.select("n"))
    h = lambda n, k: -float((k * n / total * np.log(n / total)).sum())
    mutual = h(a, ka) + h(b, kb) - h(c, kc)
    f, expected = _log_factorial, 0.0
    for i, ki in zip(a, ka):
        for j, kj in zip(b, kb):
            n = np.arange(max(1, i + j - total), min(i, j) + 1)
            if len(n):
                log = f(i) + f(j) + f(total - i) + f(total - j) - f(total) - f(n) - f(i - n) - f(j - n) - f(total - i - j + n)
                expected += ki * kj * float((n / total * np.log(total * n / (i * j)) * np.exp(log)).sum())
    return float((mutual - expected) / max((h(a, ka) + h(b, kb)) / 2 - expected, 1e-12))
