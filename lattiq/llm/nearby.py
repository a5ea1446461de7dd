"""Pairs of strings within an edit budget, by partitions that pigeonhole: no pair within the budget is lost.

A string is cut into one segment more than its budget of edits; of two strings within the budget, one segment of the one
stands unchanged in the other, near its own place (the places are those of multi-match-aware selection). Both meet
under the segment. A segment that too many strings share is refined: the rest of the string is cut again, as the edits
that are left must spare one of its segments too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators.skew import salted_join
from lattiq.plans.lineage import written

#: Most edits, and characters of the shorter string for each.
MOST_EDITS, CHARACTERS_AN_EDIT = 2, 3.5
#: Strings that may share an indexed segment; one that more share is refined. So no string meets more than that many under a segment.
MOST_SHARING = 500

# where the i-th of k + 1 segments of a text of la characters begins, and its size
_START = "cast(i * (la div (k + 1)) + greatest(0, i - (k + 1 - la % (k + 1))) AS int)"
_SIZE = "cast((la div (k + 1)) + IF(i >= k + 1 - la % (k + 1), 1, 0) AS int)"


def budget(length: Column) -> Column:
    """Edits allowed to a string of so many characters."""
    return F.least(F.lit(MOST_EDITS), F.floor(length / CHARACTERS_AN_EDIT)).cast("int")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (.., i, start, size) with key grown by the segment."""
    return rows.withColumn("key", F.xxhash64("key", "la", "i", F.expr("substring(rest, start + 1, size)")))


def _without(rows: DataFrame) -> DataFrame:
    """rows with the segment taken out of rest, and its size off la."""
    rest = F.expr("concat(substring(rest, 1, start), substring(rest, start + size + 1))")
    return rows.select("block", "side", "text", "key", rest.alias("rest"), (F.col("la") - F.col("size")).alias("la"), "k")


def _segments(rows: DataFrame) -> DataFrame:
    # exploded column by column, which stays in generated code where nested array functions do not
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumns({"start": F.expr(_START), "size": F.expr(_SIZE)})


def _index(rows: DataFrame) -> DataFrame:
    return _keyed(_segments(rows))


def _probe(rows: DataFrame) -> DataFrame:
    d = "(length(rest) - la)"
    low, high = F.expr(f"greatest(start - i, start + {d} - (k - i), 0)"), F.expr(f"least(start + i, start + {d} + (k - i), length(rest) - size)")
    ranged = _segments(rows).withColumns({"low": low, "high": high}).filter("low <= high")
    return _keyed(ranged.withColumn("start", F.explode(F.sequence("low", "high"))))


def near_pairs(strings: DataFrame) -> DataFrame:
    """(block, side_a, a, side_b, b, edits) of strings (block, side, text; distinct) of one block and different sides, side_a < side_b.

    Strings pair if their edit distance is within budget(the shorter length); those with digits only if they are equal.
    Empty and null strings pair with nothing."""
    given = strings.select("block", "side", "text").filter("text <> ''").withColumn("k", F.when(F.col("text").rlike("[0-9]"), 0).otherwise(budget(F.length("text"))))
    first = F.xxhash64("block")
    a = _index(given.withColumns({"key": first, "rest": F.col("text"), "la": F.length("text")}))
    lengths = F.explode(F.sequence(F.greatest(F.length("text") - F.col("k"), F.lit(1)), F.length("text") + F.when(F.col("text").rlike("[0-9]"), 0).otherwise(MOST_EDITS)))
    b = given.withColumn("la", lengths).withColumn("k", F.when(F.col("text").rlike("[0-9]"), 0).otherwise(budget(F.col("la")))).filter("abs(length(text) - la) <= k")
    b = _probe(b.withColumns({"key": first, "rest": F.col("text"), "la": F.col("la").cast("int")}))
    a = written(a.select("block", "side", "text", "key", "rest", "la", "k", "i", "start", "size"))
    hot = written(a.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_SHARING).select("key"))
    left = lambda df: df.select("key", "block", F.col("side").alias("side_a"), F.col("text").alias("a"))
    right = lambda df: df.select("key", F.col("block").alias("block_b"), F.col("side").alias("side_b"), F.col("text").alias("b"))
    if hot.isEmpty():
        met = left(a).join(right(b), "key")
    else:
        # hashed, not broadcast: hot keys grow in number with the strings, and the joins below need the same partitions
        far = lambda df: _without(df.join(hot, "key", "left_semi"))
        cold = lambda df: df.join(hot, "key", "left_anti")
        met = left(cold(a)).join(right(cold(b)), "key").unionByName(salted_join(right(_probe(far(b))), left(_index(far(a))), ["key"]))
    met = met.filter("block = block_b")
    shorter = F.least(F.length("a"), F.length("b"))
    near = met.filter("side_a < side_b").withColumn("edits", F.levenshtein("a", "b", MOST_EDITS)).filter((F.col("edits") >= 0) & (F.col("edits") <= budget(shorter)))
    return near.select("block", "side_a", "a", "side_b", "b", "edits").distinct()
