"""Matching entities across sources that share no key, with a confidence for each match.

Nodes of different graphs are compared by all their names (name, synonym, and ids that are made of words), taken apart as
in names.py. What kinds of things there are is learned: the shapes of ids of different graphs whose names agree most are
one kind. Pairs of a kind with the same number and with stems within an edit budget (nearby.py, no such pair is lost)
are candidates; their similarity vectors are fitted, without labels and beside pairs that chance brought together, by a
mixture of two regularised Gaussians (matched and unmatched).

Transitivity holds within every expectation step: where a-b and b-c match, a-c may not be less likely than both together.
Third sides that are no candidates join the pairs with the similarity they have. The posteriors of a step are corrected,
triangle by triangle, until none is broken; only then the next maximisation takes them. The result is the posterior of
each pair. The driver sees counts over a fixed grid of similarity vectors, whatever the number of pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.groups import connected_groups
from lattiq.llm.names import learn_lexicon, parse_names
from lattiq.llm.nearby import near_pairs
from lattiq.operators.skew import join_groups, salted_join
from lattiq.plans.lineage import written

#: Stems shorter than this, and stems with digits, say something only as a whole and together with the number.
LEAST_STEM = 4
#: Steps of the grid of similarities, and the regularisation of the covariances.
GRID, RIDGE = 20, 4e-3
#: Rounds of expectation and maximisation under transitivity at most, the change of posteriors at which they end, and
#: corrections of one step at most.
ROUNDS, SETTLED, SWEEPS = 6, 0.01, 8
#: A triangle is broken by more than this; a third side below DOUBTFUL is surely no match, sides from SURE on surely one.
SLACK, DOUBTFUL, SURE = 0.02, 0.02, 0.95
MATCH = 0.5

_FEATURES = ("stem", "words", "support")
_CELLS = np.array([(s, w, u) for s in range(GRID + 1) for w in range(GRID + 1) for u in (GRID // 2, GRID)], float)


def _cell() -> Column:
    """The place of a similarity vector in _CELLS."""
    return ((F.col("stem") * (GRID + 1) + F.col("words")) * 2 + (F.col("support") == GRID).cast("int")).cast("int")


def _shape(nodes: DataFrame) -> Column:
    """What the ids of one kind in one graph have in common: prefix, leading letters or number of digits; without an id the type."""
    id_, local = F.col("id"), F.regexp_replace("id", r"[0-9].*$", "")
    digits = F.concat(F.lit("#"), F.length(F.regexp_extract("id", r"^([0-9]*)", 1)).cast("string"))
    shape = F.when(id_.contains(":"), F.regexp_extract("id", r"^([^:]*:+)", 1)).when(F.length(local) > 0, local).otherwise(digits)
    return F.concat_ws("\x01", "kg", F.coalesce(shape, F.concat(F.lit("type "), F.lower("type")), F.lit("?")))


def learned_kinds(mentions: DataFrame) -> DataFrame:
    """(shape, kind) of mentions (kg, shape, stem, number): shapes of different graphs that name the same things are one kind.

    Two shapes are one kind if each is, of all shapes of the other's graph, the one with which it has most stems in common;
    a shape that is nobody's first choice goes with its own. Shapes are as many as the kinds of ids in use."""
    named = mentions.filter(F.length("stem") >= LEAST_STEM).select("kg", "shape", "stem", "number").distinct()
    other = named.select(F.col("kg").alias("kg_b"), F.col("shape").alias("shape_b"), "stem", "number")
    shared = written(named.join(other, ["stem", "number"]).filter("kg <> kg_b").groupBy("kg", "shape", "kg_b", "shape_b").agg(F.count(F.lit(1)).alias("n")))
    first = shared.groupBy("shape", "kg_b").agg(F.max_by("shape_b", F.struct("n", "shape_b")).alias("choice"), F.max("n").alias("n"))
    mutual = first.join(first.select(F.col("choice").alias("shape"), F.col("shape").alias("choice")), ["shape", "choice"]).select("shape", "choice")
    lone = first.join(mutual.select("shape").distinct(), "shape", "left_anti").groupBy("shape").agg(F.max_by("choice", F.struct("n", "choice")).alias("choice"))
    everyone = mentions.select("shape", F.col("shape").alias("choice")).distinct()
    groups = connected_groups(mutual.unionByName(lone).unionByName(everyone), "shape", "choice")
    return groups.select(F.col("member").alias("shape"), F.col("group_id").alias("kind"))


def _mentions(nodes: DataFrame) -> DataFrame:
    """(node_key, kg, kind, stem, words, number) of every name of every node."""
    tail = F.regexp_extract("id", r"^[^:]*:+(.*)$", 1)
    worded = F.when(tail.rlike(r"^[^0-9]*\p{L}{5}[^0-9]*$"), tail)
    named = nodes.select("node_key", "kg", _shape(nodes).alias("shape"), F.explode(F.array_distinct(F.array("name", "synonym", worded))).alias("name")).filter("name IS NOT NULL")
    lex = learn_lexicon(named.select("name"), least=0.002)
    whole = F.when((F.length("stem") < LEAST_STEM) & (F.length("stem") > 0), F.concat("stem", F.col("number").cast("string"))).otherwise(F.col("stem"))
    distinct = parse_names(named.select("name").distinct(), lex).withColumn("stem", whole).filter("stem <> ''")
    mentions = written(named.join(distinct, "name").select("node_key", "kg", "shape", "stem", "words", "number").distinct())
    return mentions.join(learned_kinds(mentions), "shape").drop("shape")


def _similarities(both: DataFrame) -> DataFrame:
    """both (a, b, stem_a, stem_b, words_a, words_b, edits) as (a, b, stem, words) on the grid."""
    known = lambda s: F.filter(F.split(f"words_{s}", " "), lambda w: w != "")
    a, b = known("a"), known("b")
    words = F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.6).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))
    stem = 1 - F.col("edits") / F.greatest(F.length("stem_a"), F.length("stem_b"))
    step = lambda c: F.round(c * GRID).cast("int")
    return both.select("a", "b", step(stem).alias("stem"), step(words).alias("words"))


def _side(mentions: DataFrame, s: str, *more: str) -> DataFrame:
    return mentions.select(*more, F.col("kg").alias(f"kg_{s}"), F.col("profile").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("stem", "words")])


def _best(scored: DataFrame) -> DataFrame:
    """(a, b, stem, words, support) of pairs of profiles: their best pair of names; more than one that agrees is support of its own."""
    best = scored.groupBy("a", "b").agg(F.max(F.struct(F.col("stem") + F.col("words"), "stem", "words")).alias("s"), F.count(F.lit(1)).alias("n"))
    return best.select("a", "b", "s.stem", "s.words", F.when(F.col("n") > 1, GRID).otherwise(GRID // 2).alias("support"))


def background_pairs(mentions: DataFrame) -> DataFrame:
    """As candidate_pairs, for pairs of the same kind that only chance brings together: what unmatched pairs look like.

    Profiles meet in hashed buckets, of which there are half as many as profiles, so pairs grow in proportion to them."""
    one = mentions.groupBy("profile", "kg", "kind").agg(F.min(F.struct("stem", "words")).alias("m")).select("profile", "kg", "kind", "m.*")
    bucketed = one.withColumn("bucket", F.pmod(F.xxhash64("profile"), F.lit(max(1, one.count() // 2))))
    met = _side(bucketed, "a", "kind", "bucket").join(_side(bucketed, "b", "kind", "bucket"), ["kind", "bucket"]).filter("kg_a < kg_b")
    return _similarities(met.withColumn("edits", F.levenshtein("stem_a", "stem_b"))).withColumn("support", F.lit(GRID // 2))


def candidate_pairs(mentions: DataFrame) -> DataFrame:
    """(a, b, stem, words, support) of pairs of profiles in different graphs; similarities on the grid of 0 .. GRID.

    mentions: (profile, kg, kind, stem, words, number)."""
    block = F.concat_ws("\x01", "kind", "number")
    blocked = mentions.withColumn("block", block)
    near = near_pairs(blocked.select("block", F.col("kg").alias("side"), F.col("stem").alias("text")).distinct())
    near = near.select("block", F.col("side_a").alias("kg_a"), F.col("a").alias("stem_a"), F.col("side_b").alias("kg_b"), F.col("b").alias("stem_b"), "edits")
    both = near.join(_side(blocked, "a", "block"), ["block", "kg_a", "stem_a"]).join(_side(blocked, "b", "block"), ["block", "kg_b", "stem_b"])
    return _best(_similarities(both))


class Mixture:
    """Two Gaussians with full, regularised covariances over grid vectors with weights."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        self.x, self.n = cells / GRID, counts.astype(float)
        close = (self.x[:, 0] >= 0.9) & (self.x[:, 1] >= 0.5)
        self.posterior = np.where(close, 0.95, 0.05)

    def maximise(self, posterior: np.ndarray) -> None:
        self.parts = []
        for g in (posterior, 1 - posterior):
            w = g * self.n
            total = w.sum() + 1e-9
            mean = (w[:, None] * self.x).sum(0) / total
            centred = self.x - mean
            self.parts.append((total / (self.n.sum() + 2e-9), mean, (w[:, None] * centred).T @ centred / total + RIDGE * np.eye(self.x.shape[1])))

    def expect(self) -> np.ndarray:
        logs = []
        for share, mean, cov in self.parts:
            d = self.x - mean
            logs.append(math.log(max(share, 1e-9)) - 0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
        odds = np.clip(logs[0] - logs[1], -50, 50)
        self.posterior = 1 / (1 + np.exp(-odds))
        return self.posterior

    def run(self, posterior: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
        p = self.posterior if posterior is None else posterior
        for _ in range(rounds):
            self.maximise(p)
            q = self.expect()
            if np.abs(q - p).max() < 1e-4:
                return q
            p = q
        return p


def _edge(x: str, y: str) -> Column:
    return F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _triangles(pairs: DataFrame, own: DataFrame, posterior: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(pairs with the third sides that were missing, triangles (e1, e2, e3, c1, c2, c3, known) of likely pairs e1, e2 and their third side e3).

    c: the cells of the sides; known: whether the third side is a candidate by its names."""
    likely = [i for i in range(len(posterior)) if posterior[i] > DOUBTFUL]
    strong = pairs.filter(F.col("cell").isin(likely)).select("a", "b", "cell")
    either = strong.unionByName(strong.select(F.col("b").alias("a"), F.col("a").alias("b"), "cell"))
    via = either.select(F.col("a").alias("x"), F.col("b").alias("m"), F.col("cell").alias("c1")).join(either.select(F.col("a").alias("m"), F.col("b").alias("y"), F.col("cell").alias("c2")), "m").filter("x < y")
    graphs = own.select("profile", "kg").distinct()
    end = lambda c: graphs.select(F.col("profile").alias(c), F.col("kg").alias(f"kg_{c}"))
    via = via.join(end("x"), "x").join(end("y"), "y").filter("kg_x <> kg_y")
    keyed = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("cell").alias("c3"))
    sides = written(via.join(keyed, ["x", "y"], "left").select("x", "m", "y", "c1", "c2", "c3"))
    missing = sides.filter("c3 IS NULL").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    compared = missing.join(_side(own, "a"), "a").join(_side(own, "b"), "b").withColumn("edits", F.levenshtein("stem_a", "stem_b"))
    added = written(_best(_similarities(compared)).withColumn("cell", _cell()).select("a", "b", "cell"))
    thirds = added.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("cell").alias("c4"))
    full = sides.join(thirds, ["x", "y"], "left").select(_edge("x", "m").alias("e1"), _edge("m", "y").alias("e2"), _edge("x", "y").alias("e3"), "c1", "c2", F.coalesce("c3", "c4").alias("c3"), F.col("c3").isNotNull().alias("known"))
    return pairs.unionByName(added), written(full)


def _corrected(triangles: DataFrame, posterior: np.ndarray) -> DataFrame:
    """(e, cell, p) of the pairs whose posterior transitivity changes, after corrections until no triangle is broken.

    In a broken triangle a doubtful third side is raised to the product of the others; a third side that is surely no match
    lowers the weaker of the others, unless both are sure and the third side is no candidate by its names, so that nothing
    speaks against it. Pairs are raised and lowered at most once each, so corrections end."""
    spark = triangles.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, float(p)) for i, p in enumerate(posterior)], "cell int, p double"))  # the grid
    of = lambda i: table.select(F.col("cell").alias(f"c{i}"), F.col("p").alias(f"p{i}"))
    first = triangles.join(of(1), "c1").join(of(2), "c2").join(of(3), "c3")
    changed = None
    for _ in range(SWEEPS):
        now = first
        if changed is not None:
            for i in (1, 2, 3):
                over = changed.select(F.col("e").alias(f"e{i}"), F.col("p").alias("over"))
                now = now.join(over, f"e{i}", "left").withColumn(f"p{i}", F.coalesce("over", f"p{i}")).drop("over")
        broken = now.filter(f"p1 * p2 > p3 + {SLACK}")
        weaker = F.when(F.col("p1") <= F.col("p2"), F.struct(F.col("e1").alias("e"), F.col("c1").alias("cell"))).otherwise(F.struct(F.col("e2").alias("e"), F.col("c2").alias("cell")))
        raise_ = (F.col("p3") >= DOUBTFUL) | (~F.col("known") & (F.least("p1", "p2") >= SURE))
        third = F.struct(F.col("e3").alias("e"), F.col("c3").alias("cell"))
        moved = broken.select(F.when(raise_, third).otherwise(weaker).alias("k"), F.when(raise_, F.col("p1") * F.col("p2")).alias("up"), F.when(~raise_, F.col("p3") / F.greatest("p1", "p2")).alias("down"))
        new = moved.groupBy("k.e", "k.cell").agg(F.max("up").alias("up"), F.min("down").alias("down")).select("e", "cell", F.coalesce("up", "down").alias("p"))
        if changed is not None:
            new = new.join(changed.select("e"), "e", "left_anti")
        new = written(new)
        if new.isEmpty():
            break
        changed = new if changed is None else changed.unionByName(new)
    return new if changed is None else changed


def _counts(pairs: DataFrame) -> np.ndarray:
    """Pairs in each cell."""
    rows = pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the size of the grid
    return np.bincount(np.array([r.cell for r in rows], int), [r.n for r in rows], len(_CELLS))


def match_entities(nodes: DataFrame) -> DataFrame:
    """(node_key_a, node_key_b, confidence) of nodes of different graphs that are the same thing, smaller key first.

    nodes: (node_key, kg, id, type, name, synonym), node_key unique. A node without any usable name, or whose kind is that
    of no other graph, matches nothing; nulls in any column are missing evidence. Nodes with equal names in one graph are
    compared once and share the outcome, so repeated rows each form their own pairs. Empty input gives no rows.
    """
    mentions = written(_mentions(nodes.select("node_key", "kg", "id", "type", "name", "synonym")))
    profile = written(mentions.groupBy("node_key", "kg", "kind").agg(F.array_sort(F.collect_set(F.struct("stem", "words", "number"))).alias("names")))
    heads = profile.groupBy("kg", "kind", "names").agg(F.min("node_key").alias("profile"), F.count(F.lit(1)).alias("n"))
    # one name may be that of a third of all nodes
    members = written(join_groups(profile, heads, ["kg", "kind", "names"], "n", max(profile.count(), 1)).select("profile", "node_key", "kg"))
    own = written(mentions.join(heads.select(F.col("profile").alias("node_key")), "node_key").withColumnRenamed("node_key", "profile"))
    pairs = written(candidate_pairs(own).withColumn("cell", _cell()).select("a", "b", "cell"))
    n, chance = _counts(pairs), _counts(background_pairs(own).withColumn("cell", _cell()))
    if not n.any():
        return members.select(F.col("node_key").alias("node_key_a"), F.col("node_key").alias("node_key_b"), F.lit(0.0).alias("confidence")).limit(0)
    posterior = Mixture(_CELLS, n + chance).run()
    pairs, triangles = _triangles(pairs, own, posterior)
    n = _counts(pairs)
    mixture = Mixture(_CELLS, n + chance)
    corrected = _corrected(triangles, posterior)
    for _ in range(ROUNDS):
        sums = {r.cell: (r.n, r.p) for r in corrected.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")).collect()}  # at most the size of the grid
        total = (n + chance) * posterior
        for cell, (k, p) in sums.items():
            total[cell] += p - k * posterior[cell]
        mixture.maximise(np.divide(total, n + chance, out=posterior.copy(), where=n + chance > 0))
        before, posterior = posterior, mixture.expect()
        corrected = _corrected(triangles, posterior)
        if np.abs(posterior - before)[n + chance > 0].max() < SETTLED:
            break
    spark = nodes.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, float(p)) for i, p in enumerate(posterior)], "cell int, p double"))
    held = corrected.select("e.a", "e.b", F.col("p").alias("q"))
    final = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cell").join(table, "cell").join(held, ["a", "b"], "left").withColumn("p", F.coalesce("q", "p")).filter(F.col("p") >= MATCH).select("a", "b", "p")
    side = lambda s: members.select(F.col("profile").alias(s), F.col("node_key").alias(f"key_{s}"))
    rows = salted_join(side("b"), salted_join(side("a"), final, ["a"]), ["b"])
    return rows.select(F.least("key_a", "key_b").alias("node_key_a"), F.greatest("key_a", "key_b").alias("node_key_b"), F.col("p").alias("confidence"))
