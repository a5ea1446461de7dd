"""Coverage, annotation accuracy and provenance of typed graphs. Every function is lazy and plans one pass or one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coverage(gold: DataFrame, found: DataFrame, key: list[str], by: list[str] = ()) -> DataFrame:
    """(by.., n_gold, n_found, n_overlap, pct) of distinct keys; pct is null where gold is empty."""
    on = [*by, *key]
    both = gold.select(*on).distinct().withColumn("g", F.lit(1)).join(found.select(*on).distinct().withColumn("f", F.lit(1)), on, "full")
    count = lambda c: F.count(F.when(c, 1))
    g, f = F.col("g").isNotNull(), F.col("f").isNotNull()
    out = both.groupBy(*by).agg(count(g).alias("n_gold"), count(f).alias("n_found"), count(g & f).alias("n_overlap"))
    return out.withColumn("pct", F.when(F.col("n_gold") > 0, F.round(F.col("n_overlap") * 100.0 / F.col("n_gold"), 2)))


def overlap_histogram(gold: DataFrame, members: DataFrame, key: str, source: str, sources: int) -> DataFrame:
    """(n_sources, n_keys): how many gold keys are covered by 0, 1 .. sources sources; empty bins are 0."""
    per = gold.select(key).distinct().join(members.select(key, source).distinct(), key, "left").groupBy(key).agg(F.count(source).alias("n_sources"))
    bins = gold.sparkSession.range(sources + 1).select(F.col("id").alias("n_sources"))
    return bins.join(per.groupBy("n_sources").agg(F.count(F.lit(1)).alias("n_keys")), "n_sources", "left").select("n_sources", F.coalesce("n_keys", F.lit(0)).alias("n_keys"))


def pair_gaps(gold: DataFrame, und: DataFrame, nodes: DataFrame) -> DataFrame:
    """(reason, n): gold pairs (u, v) that are linked, or why not: both ends absent, one absent, or both there but unlinked."""
    pairs = gold.select("u", "v").distinct().withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")})
    linked = pairs.join(und.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(True).alias("linked")), ["a", "b"], "left")
    end = lambda c: nodes.select(F.col("idx").alias(c), F.lit(1).alias(f"has_{c}")).distinct()
    there = linked.join(end("u"), "u", "left").join(end("v"), "v", "left").withColumn("n_there", F.coalesce("has_u", F.lit(0)) + F.coalesce("has_v", F.lit(0)))
    reason = F.when(F.col("linked"), "linked").when(F.col("n_there") == 0, "both_absent").when(F.col("n_there") == 1, "one_absent").otherwise("not_curated")
    return there.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def shared_type_mean(scores: DataFrame, graphs: int) -> DataFrame:
    """(kg, score): mean over the types that have a score in all graphs; scores: (kg, type, score)."""
    shared = scores.filter("score IS NOT NULL").groupBy("type").agg(F.count_distinct("kg").alias("n")).filter(F.col("n") == graphs).select("type")
    return scores.join(F.broadcast(shared), "type").groupBy("kg").agg(F.round(F.avg("score"), 6).alias("score"))


def validity(nodes: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """(kg, type, n, n_valid, pct), with totals by graph and over all (nulls). A pattern with ^ is a regular expression, else a prefix."""
    match = lambda p: F.col("id").rlike(p) if p.startswith("^") else F.col("id").startswith(p)
    ok = reduce(lambda a, b: a | b, [(F.col("type") == t) & reduce(lambda x, y: x | y, map(match, ps)) for t, ps in patterns.items()])
    flagged = nodes.filter(F.col("type").isin(list(patterns))).withColumn("ok", F.coalesce(ok, F.lit(False)).cast("int"))
    return flagged.rollup("kg", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("n_valid")).withColumn("pct", F.round(F.col("n_valid") * 100.0 / F.col("n"), 1))


def top_prefixes(rows: DataFrame, by: list[str], prefix: Column, example: str, k: int = 5, examples: int = 3) -> DataFrame:
    """The k most frequent prefixes of each group, with their first examples in order."""
    keyed = rows.select(*by, prefix.alias("prefix"), F.col(example).alias("example"))
    counted = keyed.groupBy(*by, "prefix").agg(F.count(F.lit(1)).alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "prefix"))).filter(F.col("rank") <= k)
    # the limit on the rank is applied before the shuffle, so no task sees all ids of a prefix
    first = keyed.distinct().withColumn("at", F.row_number().over(Window.partitionBy(*by, "prefix").orderBy("example"))).filter(F.col("at") <= examples)
    joined = first.groupBy(*by, "prefix").agg(F.array_join(F.array_sort(F.collect_list("example")), " ").alias("examples"))
    return ranked.join(joined, [*by, "prefix"]).select(*by, "rank", "prefix", "n", "examples")


def conformance(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """(rel, n, n_ok, pct, strict_pct). allowed: (rel, x_type, y_type). An unlisted relation conforms, but not strictly."""
    listed = allowed.select("rel").distinct().withColumn("listed", F.lit(True))
    fits = allowed.distinct().withColumn("fits", F.lit(True))
    counted = edges.groupBy("rel", "x_type", "y_type").agg(F.count(F.lit(1)).alias("n"))
    j = counted.join(F.broadcast(fits), ["rel", "x_type", "y_type"], "left").join(F.broadcast(listed), "rel", "left")
    ok = F.when(F.coalesce("fits", F.lit(False)) | F.col("listed").isNull(), F.col("n")).otherwise(0)
    strict = F.when(F.coalesce("fits", F.lit(False)), F.col("n")).otherwise(0)
    out = j.groupBy("rel").agg(F.sum("n").alias("n"), F.sum(ok).alias("n_ok"), F.sum(strict).alias("n_strict"))
    return out.select("rel", "n", "n_ok", F.round(F.col("n_ok") * 100.0 / F.col("n"), 3).alias("pct"), F.round(F.col("n_strict") * 100.0 / F.col("n"), 3).alias("strict_pct"))


def conflicts(edges: DataFrame, exclusive: list[tuple[str, str]]) -> DataFrame:
    """(conflict, a, b): unordered pairs stated under both relations of an exclusive pair."""
    names = sorted({r for pair in exclusive for r in pair})
    pairs = edges.filter(F.col("rel").isin(names)).select("rel", F.least("x_index", "y_index").alias("a"), F.greatest("x_index", "y_index").alias("b")).groupBy("a", "b").agg(F.collect_set("rel").alias("rels"))
    labels = F.array(*[F.struct(F.lit(f"{p}/{q}").alias("conflict"), (F.array_contains("rels", p) & F.array_contains("rels", q)).alias("both"), (F.array_contains("rels", p) | F.array_contains("rels", q)).alias("any")) for p, q in exclusive])
    return pairs.select("a", "b", F.explode(labels).alias("l")).select("a", "b", "l.conflict", "l.both", "l.any")


def conflict_rates(labelled: DataFrame) -> DataFrame:
    """(conflict, n_both, n_any, pct) of conflicts(); pct is 0 where neither relation occurs."""
    out = labelled.groupBy("conflict").agg(F.count(F.when(F.col("both"), 1)).alias("n_both"), F.count(F.when(F.col("any"), 1)).alias("n_any"))
    return out.withColumn("pct", F.when(F.col("n_any") > 0, F.round(F.col("n_both") * 100.0 / F.col("n_any"), 3)).otherwise(0.0))


def conflict_details(labelled: DataFrame, names: DataFrame, k: int = 20) -> DataFrame:
    """The first k conflicting pairs of each label, with the names of both ends; names: (idx, name)."""
    first = labelled.filter("both").withColumn("rank", F.row_number().over(Window.partitionBy("conflict").orderBy("a", "b"))).filter(F.col("rank") <= k)
    end = lambda c: names.select(F.col("idx").alias(c), F.col("name").alias(f"name_{c}"))
    return first.join(end("a"), "a", "left").join(end("b"), "b", "left").select("conflict", "rank", "a", "b", "name_a", "name_b")


def source_counts(edges: DataFrame, columns: list[str]) -> DataFrame:
    """(source, n): uses of a source over several columns, halved (n // columns) as both ends name it; null is "none"."""
    long = edges.select(F.explode(F.array(*[F.coalesce(c, F.lit("none")) for c in columns])).alias("source"))
    return long.groupBy("source").agg(F.floor(F.count(F.lit(1)) / len(columns)).alias("n"))


def granularity(edges: DataFrame) -> DataFrame:
    """(n, pct_attributed, pct_cross): edges with a source at either end, and of those, with two different ones."""
    attributed = F.col("x_source").isNotNull() | F.col("y_source").isNotNull()
    cross = F.col("x_source").isNotNull() & F.col("y_source").isNotNull() & (F.col("x_source") != F.col("y_source"))
    out = edges.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(attributed, 1)).alias("na"), F.count(F.when(cross, 1)).alias("nc"))
    return out.select("n", F.when(F.col("n") > 0, F.round(F.col("na") * 100.0 / F.col("n"), 4)).alias("pct_attributed"), F.when(F.col("na") > 0, F.round(F.col("nc") * 100.0 / F.col("na"), 4)).alias("pct_cross"))


def diversity(counts: DataFrame) -> DataFrame:
    """(kg, n_sources, diversity): ln n over ln of the largest n, 4 places; counts: (kg, n_sources)."""
    return counts.withColumn("diversity", F.round(F.ln("n_sources") / F.ln(F.max("n_sources").over(Window.partitionBy())), 4))


def uncertainty(rows: DataFrame, keywords: tuple[str, ...] = ("score", "confidence", "weight", "prob", "evidence", "support")) -> DataFrame:
    """(n, n_columns, share): share of rows with any value in the columns whose name holds a keyword; 0 without such columns."""
    columns = [c for c in rows.columns if any(k in c.lower() for k in keywords)]
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in columns], F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.lit(len(columns)).cast("bigint").alias("n_columns"), F.round(F.avg(some.cast("double")), 6).alias("share"))


def level_distribution(rows: DataFrame, levels: list[str], trusted: list[str]) -> DataFrame:
    """(level, n, trusted_share): counts over a fixed list of levels, missing ones as 0."""
    listed = rows.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    counted = F.broadcast(listed).join(rows.groupBy("level").agg(F.count(F.lit(1)).alias("n")), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))
    everything = Window.partitionBy()
    share = F.sum(F.when(F.col("level").isin(trusted), F.col("n")).otherwise(0)).over(everything) / F.sum("n").over(everything)
    return counted.withColumn("trusted_share", F.round(share, 6))


def merge_approvals(rows: DataFrame, drug: str, disease: str, date: str, agency: str) -> DataFrame:
    """One row for each (drug, disease): earliest date, sorted distinct agencies, their number."""
    return rows.filter(F.col(drug).isNotNull() & F.col(disease).isNotNull()).groupBy(drug, disease).agg(
        F.min(date).alias("first_date"), F.array_join(F.array_sort(F.collect_set(agency)), ";").alias("agencies"), F.count_distinct(agency).alias("n_agencies"))


def roll_up(scores: DataFrame) -> DataFrame:
    """(kg, dimension, score): means by dimension and, with dimension "overall", their mean; scores: (kg, dimension, metric, score), nulls left out."""
    dims = scores.filter("score IS NOT NULL").groupBy("kg", "dimension").agg(F.avg("score").alias("score"))
    total = dims.groupBy("kg").agg(F.avg("score").alias("score")).select("kg", F.lit("overall").alias("dimension"), "score")
    return dims.unionByName(total).withColumn("score", F.round("score", 6))


# The sub-metrics of a summary, with the dimension each belongs to.
SUB_METRICS = [
    ("Entity Coverage", "coverage"), ("Relation Coverage", "coverage"),
    ("Entity Validity", "annotation_accuracy"), ("Relational Consistency", "annotation_accuracy"),
    ("Source Diversity", "trustworthiness"), ("Edge Traceability", "trustworthiness"), ("Uncertainty Quantification", "trustworthiness"),
    ("Graph Cohesion", "topology"), ("Clustering Coefficient", "topology"), ("Graph Reachability", "topology"), ("Community Purity", "topology"),
    ("Random Dropout", "stability"), ("Periph. Dropout", "stability"),
    ("Link Prediction", "task_performance"), ("Neighborhood Retrieval", "task_performance"), ("Multi-hop Reasoning", "task_performance"),
    ("Data-Sparse Gen.", "generalisation"), ("Cross-Domain Gen.", "generalisation"), ("Prospective Gen.", "generalisation"),
]


def summary_table(scores: DataFrame) -> DataFrame:
    """(kg, dimension, metric, score): every sub-metric of every graph (null where scores has none), the mean of each dimension
    (metric "all") and the mean of the dimensions ("overall", "all"); scores: (kg, metric, score), one row each, nulls left out."""
    spark = scores.sparkSession
    listed = F.broadcast(spark.createDataFrame(SUB_METRICS, "metric string, dimension string"))
    every = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(d).alias("dimension")) for m, d in SUB_METRICS]))
    full = scores.select("kg").distinct().select("kg", every.alias("m")).select("kg", "m.*").join(scores, ["kg", "metric"], "left").select("kg", "dimension", "metric", F.round("score", 6).alias("score"))
    known = scores.join(listed, "metric")
    return full.unionByName(roll_up(known.select("kg", "dimension", "metric", "score")).select("kg", "dimension", F.lit("all").alias("metric"), "score"))


def source_modes(edges: DataFrame, mode: str, columns: list[str] = ()) -> DataFrame:
    """(source, n) of edges by mode: "columns" (uses over the columns, divided by their number; nulls left out), "relation_prefix" (what
    stands before :: in relation, else "other"), "relation_values"."""
    if mode == "columns":
        long = edges.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("source")).filter("source IS NOT NULL")
        return long.groupBy("source").agg(F.floor(F.count(F.lit(1)) / len(columns)).alias("n"))
    if mode == "relation_prefix":
        prefix = F.coalesce(F.nullif(F.regexp_extract("relation", "^([^:]+)::", 1), F.lit("")), F.lit("other"))
        return edges.groupBy(prefix.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if mode == "relation_values":
        return edges.filter("relation IS NOT NULL").groupBy(F.col("relation").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    raise ValueError(f"unknown mode {mode!r}; known: columns, relation_prefix, relation_values")


def granularity_row(edges: DataFrame, name: str, mode: str, tier: int, documented: int, columns: list[str] = ()) -> DataFrame:
    """(kg, tier, n, pct_attributed, n_sources, pct_cross, traceability): how edges tell where they come from, to one place.

    With two columns pct_cross is the share of attributed edges whose ends name different sources; other modes have none
    (0 where the relation names the one source). n_sources is the documented number, not the one found."""
    from lattiq.functions.scores import traceability

    attributed, cross = F.lit(True), F.lit(None).cast("double")
    if mode == "columns":
        attributed = F.coalesce(F.col(columns[0]) != "", F.lit(False)) if len(columns) == 1 else F.col(columns[0]).isNotNull()
    elif mode == "relation_prefix":
        attributed = F.coalesce(F.col("relation").contains("::"), F.lit(False))
    elif mode != "relation_values":
        raise ValueError(f"unknown mode {mode!r}; known: columns, relation_prefix, relation_values")
    a = F.count(F.when(attributed, 1))
    if mode == "columns" and len(columns) == 2:
        x, y = columns
        cross = F.when(a > 0, F.round(F.count(F.when(attributed & F.col(y).isNotNull() & (F.col(x) != F.col(y)), 1)) * 100.0 / a, 1)).otherwise(0.0)
    elif mode == "relation_prefix":
        cross = F.lit(0.0)
    n = F.count(F.lit(1))
    return edges.agg(F.lit(name).alias("kg"), F.lit(tier).alias("tier"), n.alias("n"), F.when(n > 0, F.round(a * 100.0 / n, 1)).alias("pct_attributed"), F.lit(documented).alias("n_sources"), cross.alias("pct_cross"), traceability(F.lit(tier)).alias("traceability"))


def pair_audit(gold: DataFrame, nodes: DataFrame, links: DataFrame, predicates: list[str]) -> DataFrame:
    """(key, value) scalars of an audit of gold pairs (a, b) against links (a, b, predicate) between mapped nodes.

    nodes: (id, mapped), mapped null where an id has no counterpart; links with an unmapped end (null) do not count. Pairs
    are unordered; predicates are those that count as the relation audited."""
    ordered = lambda df, *c: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *c)
    g = ordered(gold).distinct().withColumn("g", F.lit(1))
    mapped = links.filter("a IS NOT NULL AND b IS NOT NULL")
    f = ordered(mapped, "predicate").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("predicate").isin(list(predicates)).cast("int")).alias("d"))
    count = lambda x: F.count(F.when(x, 1))
    found, stated, meant = F.col("g") == 1, F.col("n").isNotNull(), F.col("d") == 1
    j = g.join(f, ["a", "b"], "full").agg(
        count(found).alias("gold_pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges_mapped"), count(stated).alias("pairs_any"), count(meant).alias("pairs_meant"), count(found & stated).alias("overlap_any"),
        count(found & meant).alias("overlap_meant"), count(found & ~stated).alias("missing"))
    v = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count("mapped").alias("nodes_mapped"), F.count_distinct("mapped").alias("distinct_mapped"))
    one = j.join(F.broadcast(v))  # single rows
    pct = lambda c: F.when(F.col("gold_pairs") > 0, F.round(100.0 * F.col(c) / F.col("gold_pairs"), 2))
    one = one.select(*[F.col(c).cast("double").alias(c) for c in one.columns], pct("overlap_any").alias("coverage_any_pct"), pct("overlap_meant").alias("coverage_meant_pct"))
    return one.unpivot([], one.columns, "key", "value")


def approval_lists(rows: DataFrame) -> DataFrame:
    """(drug_id, drug_name, approvals) of rows (drug_id, drug_name, disease, date, agency): for each drug its diseases in order of date.

    approvals: array of (date, disease, agencies): earliest date and sorted distinct agencies of the pair."""
    pairs = rows.filter("drug_id IS NOT NULL AND disease IS NOT NULL").groupBy("drug_id", "disease").agg(F.min("date").alias("date"), F.array_join(F.array_sort(F.collect_set("agency")), ";").alias("agencies"), F.min("drug_name").alias("drug_name"))
    # a drug has at most one entry for each disease there is
    return pairs.groupBy("drug_id").agg(F.min("drug_name").alias("drug_name"), F.array_sort(F.collect_list(F.struct("date", "disease", "agencies"))).alias("approvals"))


def pairs_beyond(rows: DataFrame, agency: str) -> DataFrame:
    """Rows of other agencies whose (drug_id, disease) the agency itself does not have."""
    own = rows.filter(F.col("agency") == agency).select("drug_id", "disease").distinct()
    return rows.filter(F.col("agency").isNull() | (F.col("agency") != agency)).join(own, ["drug_id", "disease"], "left_anti")
