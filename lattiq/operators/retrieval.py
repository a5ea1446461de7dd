"""Ranking a pool of candidates by shared neighbours: leave-one-out retrieval and paths over an intermediate node.

Only candidates that share a neighbour are ever made; those with score 0 all tie, so their rank is a matter of counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scores import hashed
from lattiq.operators.skew import salted_join
from lattiq.plans.lineage import written

RANK_KS = (10, 50, 100)


def inverse_log_degree(deg: DataFrame) -> DataFrame:
    """(w, inv) of deg (idx, deg): 1 / ln degree, 0 for a degree of one."""
    return deg.select(F.col("idx").alias("w"), F.when(F.col("deg") > 1, 1 / F.ln("deg")).otherwise(0.0).alias("inv"))


def _scores(queries: DataFrame, start: str, without: str, adj: DataFrame, deg: DataFrame, pool: DataFrame) -> DataFrame:
    """(q, g, s): for each query the Adamic-Adar score of every pool member g that shares a neighbour of start other than without."""
    from_start = salted_join(adj.select(F.col("a").alias("start"), F.col("b").alias("w")), queries.select("q", F.col(start).alias("start"), F.col(without).alias("without")), ["start"])
    near = from_start.filter("w <> without").join(inverse_log_degree(deg).filter("inv > 0"), "w").select("q", "w", "inv")
    onward = salted_join(adj.select(F.col("a").alias("w"), F.col("b").alias("g")), near, ["w"])
    return onward.join(pool.select("g"), "g").groupBy("q", "g").agg(F.sum("inv").alias("s"))


def _rank(scores: DataFrame, known: DataFrame, size: DataFrame) -> DataFrame:
    """known (q, g) with rank: how many of the size (q, n) candidates score no less; scores: (q, g, s), s > 0, rounded to 9 places."""
    s = scores.withColumn("s", F.round("s", 9))
    own = known.join(s.select("q", "g", F.col("s").alias("own")), ["q", "g"], "left").select("q", "g", F.coalesce("own", F.lit(0.0)).alias("own"))
    above = own.filter("own > 0").join(s.select("q", "s"), "q").filter("s >= own").groupBy("q", "g").agg(F.count(F.lit(1)).alias("r"))
    return own.join(above, ["q", "g"], "left").join(size, "q").select("q", "g", F.coalesce("r", "n").alias("rank"))


def held_out_targets(targets: DataFrame, least: int = 5, most: int = 300, seed: int = 42) -> DataFrame:
    """(d, g) of at most most sources d with at least least targets, one hashed target g held out of each; targets: (d, g).

    Sources are taken in order of a hash (a sample of fixed size by definition)."""
    t = targets.select("d", "g").distinct()
    h = t.withColumn("h", hashed(F.col("d"), F.col("g"), seed=seed))
    one = h.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min_by("g", F.struct("h", "g")).alias("g")).filter(F.col("n") >= least)
    return one.orderBy(hashed(F.col("d"), seed=seed + 1), "d").limit(most).select("d", "g")


def leave_one_out_ranks(held: DataFrame, targets: DataFrame, adj: DataFrame, deg: DataFrame, pool: DataFrame) -> DataFrame:
    """(d, g, rank) of each held-out target among the pool (g) without the other targets of its source.

    The link d - g is left out of the graph for its own query only; degrees are those before. Ties count against g."""
    queries = written(held.select(F.col("d").alias("q"), "d", "g"))
    other = targets.select(F.col("d").alias("q"), "g").distinct().join(queries.select("q", "g"), ["q", "g"], "left_anti")
    s = _scores(queries.select("q", "d", F.col("g").alias("held")), "d", "held", adj, deg, pool).join(other, ["q", "g"], "left_anti")
    members = pool.select("g").distinct()
    taken = other.join(members, "g").groupBy("q").agg(F.count(F.lit(1)).alias("taken"))
    total = members.agg(F.count(F.lit(1)).alias("all"))  # one row
    size = queries.select("q").join(taken, "q", "left").join(F.broadcast(total)).select("q", (F.col("all") - F.coalesce("taken", F.lit(0))).alias("n"))
    in_pool = queries.select("q", "g").join(members, "g").select("q", "g")
    return _rank(s, in_pool, size).select(F.col("q").alias("d"), "g", "rank")


def path_ranks(triplets: DataFrame, adj: DataFrame, deg: DataFrame, pool: DataFrame) -> DataFrame:
    """(u, g, v, rank) of the middle node of each distinct triplet among the pool, by the product of its scores with both ends.

    A link between the ends themselves plays no part in its own query."""
    t = written(triplets.select("u", "g", "v").distinct().withColumn("q", F.struct("u", "v")))
    ends = t.select("q", "u", "v").distinct()
    first, second = _scores(ends, "u", "v", adj, deg, pool), _scores(ends, "v", "u", adj, deg, pool)
    s = first.join(second.select("q", "g", F.col("s").alias("s2")), ["q", "g"]).select("q", "g", (F.col("s") * F.col("s2")).alias("s"))
    total = pool.select("g").distinct().agg(F.count(F.lit(1)).alias("n"))  # one row
    ranked = _rank(s, t.select("q", "g").join(pool.select("g").distinct(), "g").select("q", "g"), ends.select("q").join(F.broadcast(total)))
    return ranked.select("q.u", "g", "q.v", "rank")


def rank_summary(ranks: DataFrame, by: list[str] = (), ks: tuple[int, ...] = RANK_KS) -> DataFrame:
    """(by.., n, hits@k.., mrr, mean_rank, median_rank) of ranks, to 6 places."""
    r = lambda c: F.round(c, 6)
    hits = [r(F.avg((F.col("rank") <= k).cast("double"))).alias(f"hits{k}") for k in ks]
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *hits, r(F.avg(1 / F.col("rank"))).alias("mrr"), r(F.avg("rank")).alias("mean_rank"), r(F.median("rank")).alias("median_rank"))


def resolve_triplets(triplets: DataFrame, nodes: DataFrame, mesh: DataFrame) -> DataFrame:
    """Distinct (u, g, v) of triplets (chem_name, chem_id, gene_id, gene_symbol, disease_name, disease_id) over the nodes of a graph.

    nodes: (idx, kind, id, name), kind drug, gene or disease, id with or without its type. A gene is found by its number in
    the id, else in the name, else by its symbol; a drug by its name, else by MESH: and its id; a disease by its name, else
    by the number that mesh (mesh, doid; with prefixes) gives its id. A triplet of which one part is not found is left out.
    Of several nodes with one key the one of the largest idx is taken."""
    bare = F.regexp_replace("id", "^.*?::", "")
    of = lambda kind: nodes.filter(F.col("kind") == kind)
    table = lambda df, key, name: df.select(key.alias(name), "idx").filter(F.col(name).isNotNull()).groupBy(name).agg(F.max("idx").alias(f"by_{name}"))
    t = triplets.withColumns({"gk": F.col("gene_id").cast("bigint"), "gn": F.col("gene_id").cast("bigint"), "gs": F.upper("gene_symbol"), "un": F.lower("chem_name"), "ui": F.concat(F.lit("MESH:"), F.col("chem_id").cast("string")), "vn": F.lower("disease_name"), "mesh": F.col("disease_id")})
    number = lambda c: F.when(c.rlike(r"^\d{1,18}$"), c.cast("bigint"))
    t = t.join(table(of("gene"), number(bare), "gk"), "gk", "left").join(table(of("gene"), number(F.col("name")), "gn"), "gn", "left").join(table(of("gene"), F.upper("name"), "gs"), "gs", "left")
    drug_ids = of("drug").select(F.explode(F.array_distinct(F.array(F.col("name"), F.regexp_replace("name", "^.*?::", "")))).alias("k"), "idx")
    t = t.join(table(of("drug"), F.lower("name"), "un"), "un", "left").join(table(drug_ids, F.col("k"), "ui"), "ui", "left")
    t = t.join(table(of("disease"), F.lower("name"), "vn"), "vn", "left").join(mesh.groupBy("mesh").agg(F.min("doid").alias("vd")), "mesh", "left")
    disease_ids = of("disease").select(F.explode(F.array_distinct(F.array(bare, F.col("name")))).alias("k"), "idx")
    t = t.join(table(disease_ids, F.col("k"), "vd"), "vd", "left")
    found = t.select(F.coalesce("by_un", "by_ui").alias("u"), F.coalesce("by_gk", "by_gn", "by_gs").alias("g"), F.coalesce("by_vn", "by_vd").alias("v"))
    return found.dropna().distinct()


def capped_per_group(rows: DataFrame, group: str, order: list[str], most_each: int = 5, most: int = 500) -> DataFrame:
    """At most most_each rows of each group, then at most most overall, first in order (samples of fixed size by definition).

    order must be unique. The limits are applied before each shuffle, so no task sees a whole large group."""
    from pyspark.sql.window import Window

    each = rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= most_each).drop("__r")
    return each.orderBy(*order).limit(most)
