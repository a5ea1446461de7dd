"""Same or nearly same records across splits, by shared spans of their mentions.

Each record states a relation between two things, and mentions each of them by an index, an id and a name, any of which
may be missing or written in another way. The texts of all distinct mentions of both splits (indexes, canonical ids, and
the stems of names) are concatenated, in effect, into one text whose suffix array is built in range partitions: every
suffix is a row, sorted, and the evaluation suffixes next to a training suffix, above and below it, are those with the
longest common prefixes. Each partition is passed once in either order, and remembers one suffix. Spans from all suffixes
of a mention are merged into its coverage, but only beside mentions within the edit distance, and not for endings that could
not cover enough; one that is covered enough is verified by the least distance and the number.
Records overlap if both mentions and the relation agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattiq.llm.copies import canonical_id, canonical_word
from lattiq.llm.names import learn_lexicon, parse_names
from lattiq.operators.skew import join_groups, salted_join
from lattiq.plans.lineage import written

#: Shortest common prefix that counts as a shared span.
LEAST_SPAN = 4
#: Share of a mention that its shared spans must cover before it is verified.
LEAST_COVERAGE = 0.35
#: Characters of a text whose coverage fits one number.
BITS = 60
#: Edits allowed in a stem, and characters of a stem for each edit.
MOST_EDITS, CHARACTERS_AN_EDIT = 4, 3

_LINKS = "kind string, train string, at int, n int, part int, suffix string"


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def _adjacent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of each training suffix of a sorted partition to the evaluation suffix last passed: its common prefix n.

    Training suffixes before the first evaluation suffix of their kind come out with their own suffix and n = -1. Rows
    without a training text state the last evaluation suffix of each kind."""
    part, columns = TaskContext.get().partitionId(), ["kind", "train", "at", "n", "part", "suffix"]
    passed: dict[str, str] = {}
    for batch in batches:
        out = []
        for kind, suffix, is_test, text, at in zip(batch["kind"], batch["suffix"], batch["is_test"], batch["text"], batch["at"]):
            if is_test:
                passed[kind] = suffix
            elif (near := passed.get(kind)) is None:
                out.append((kind, text, at, -1, part, suffix))
            elif (n := _common(suffix, near)) >= LEAST_SPAN:
                out.append((kind, text, at, n, part, near))
        if out:
            yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame([(kind, None, 0, 0, part, suffix) for kind, suffix in passed.items()], columns=columns)


def _passed(suffixes: DataFrame, order: list) -> DataFrame:
    """(kind, train, at, n, suffix): every training suffix with the evaluation suffix before it in order, of n equal characters."""
    partitions = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = written(suffixes.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInPandas(_adjacent, _LINKS))
    inner = scanned.filter("train IS NOT NULL AND n >= 0").select("kind", "train", "at", "n", "suffix")
    # a partition's first training suffixes go by the last evaluation suffix of the partitions before; one row each
    parts = scanned.groupBy("kind", "part").agg(F.max(F.when(F.col("train").isNull(), F.col("suffix"))).alias("last"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    near = parts.select("kind", "part", F.last("last", True).over(before).alias("other"))
    opened = scanned.filter("n = -1").join(F.broadcast(near), ["kind", "part"]).filter("other IS NOT NULL")
    shared = F.expr("aggregate(sequence(1, least(length(suffix), length(other))), 0, (n, i) -> IF(n = i - 1 AND substring(suffix, i, 1) = substring(other, i, 1), i, n))")
    outer = opened.withColumn("n", shared).filter(F.col("n") >= LEAST_SPAN).select("kind", "train", "at", "n", F.col("other").alias("suffix"))
    return inner.unionByName(outer)


def _links(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, train, at, n, suffix): places of train texts, each with the suffixes of test texts next to it, of n equal characters; and
    (kind, suffix, test): the test texts that end so. Of the kind "index" only whole texts are compared."""
    texts = train.select("kind", "text", F.lit(0).alias("is_test")).unionByName(test.select("kind", "text", F.lit(1).alias("is_test")))
    offsets = F.when(F.col("kind") == "index", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length("text") - LEAST_SPAN))
    suffixes = texts.filter(F.length("text") >= LEAST_SPAN).select("kind", "text", "is_test", F.explode(offsets).alias("at")).withColumn("suffix", F.expr("substring(text, at + 1)"))
    up, down = ["kind", "suffix", F.col("is_test").desc(), "text"], [F.col("kind").desc(), F.col("suffix").desc(), F.col("is_test").desc(), "text"]
    links = written(_passed(suffixes, up).unionByName(_passed(suffixes, down)).distinct())  # read again and again
    return links, suffixes.filter("is_test = 1").select("kind", "suffix", F.col("text").alias("test")).distinct()


def shared_spans(train: DataFrame, test: DataFrame, keep: Column | None = None) -> DataFrame:
    """(kind, train, test, at, n): spans of n characters from at in a train text that a test text shares; texts are (kind, text).

    Of the kind "index" only whole texts are compared. keep: a condition on the spans; others are dropped as they are found,
    since texts with a common ending are as many as those on one side times those on the other."""
    links, holders = _links(train, test)
    spans = salted_join(links, holders, ["kind", "suffix"])
    return (spans if keep is None else spans.filter(keep)).select("kind", "train", "test", "at", "n")


def _near_names(links: DataFrame, holders: DataFrame) -> DataFrame:
    """(kind, train, test, edits): the nearest test texts of each train text whose spans cover enough of it.

    Texts with a common ending are as many as those on one side times those on the other, so not every span makes a pair:
    endings shorter than what must be covered can't do alone, and beside a longer one that covers enough with them a pair
    is made by that. Only a train text that such endings cover enough together, as a repeated one may, keeps them."""
    least, narrow = LEAST_COVERAGE * F.length("train"), F.length("train") <= BITS
    # places of short texts are bits of a number; those of longer ones are gathered
    bits = F.bit_count(F.bit_or(F.expr("shiftleft(shiftleft(1L, n) - 1L, at)"))).cast("int")
    places = F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(at, at + n - 1)")))))
    counted = lambda df, *by: df.filter(narrow).groupBy(*by).agg(bits.alias("covered")).unionByName(df.filter(~narrow).groupBy(*by).agg(places.alias("covered"))).filter(F.col("covered") >= least)
    endings = links.filter(F.length("suffix") < least)
    making = links.filter(F.length("suffix") >= least).unionByName(endings.join(counted(endings, "train"), "train", "left_semi"))
    edits = F.levenshtein("train", "test", MOST_EDITS)
    few = (F.abs(F.length("train") - F.length("test")) <= MOST_EDITS) & (edits >= 0) & (edits * CHARACTERS_AN_EDIT <= F.length("test"))
    pairs = salted_join(making.select("kind", "train", "suffix").distinct(), holders, ["kind", "suffix"]).filter(few).select("kind", "train", "test").distinct()
    own = links.groupBy("kind", "train").agg(F.collect_list(F.struct("at", "n", "suffix")).alias("own"))
    spans = written(pairs.join(own, ["kind", "train"]).select("kind", "train", "test", F.expr("inline(filter(own, x -> endswith(test, x.suffix)))")).drop("suffix"))  # read for either length
    names = counted(spans, "kind", "train", "test").withColumn("edits", edits)
    return names.withColumn("least", F.min("edits").over(Window.partitionBy("kind", "train"))).filter("edits = least").select("kind", "train", "test", "edits")


def match_texts(train: DataFrame, test: DataFrame) -> DataFrame:
    """(kind, train, test, edits) of distinct texts that are the same in all but writing.

    Kind "index": the texts are equal. Kind "id": the test text is the end of the train text (after a namespace). Kind "name": spans cover enough of the
    train text and the edit distance is small; the nearest test texts are kept. Empty texts match nothing.
    """
    links, holders = _links(train, test)
    # whole texts, and the ends of ids, are test texts themselves; a name that is one needs no search for nearer ones
    whole = links.filter("n = length(suffix) AND at + n = length(train) AND (kind = 'id' OR at = 0)").select("kind", "train", F.col("suffix").alias("text"))
    same = written(whole.join(test, ["kind", "text"]).select("kind", "train", F.col("text").alias("test"), F.lit(0).alias("edits")).distinct())
    rest = links.filter("kind = 'name'").join(same.select("kind", "train"), ["kind", "train"], "left_anti")
    # texts too short for a span are compared whole
    short = train.filter(F.length("text").between(1, LEAST_SPAN - 1)).join(test.withColumnRenamed("text", "other"), (F.col("text") == F.col("other")) & (train["kind"] == test["kind"])).select(train["kind"], F.col("text").alias("train"), F.col("other").alias("test"), F.lit(0).alias("edits"))
    return same.unionByName(_near_names(rest, holders.filter("kind = 'name'"))).unionByName(short)


def _mention(index: str, id_: str, name: str) -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x02"))
    return F.concat_ws("\x01", text(index), text(id_), text(name))


def record_overlaps(train: DataFrame, test: DataFrame) -> DataFrame:
    """(test_id, triple_id) of every train record that states what a test record does, in either direction.

    train: triple_id, relation and index, id, name of head and tail; test: test_id, relation and those of a and b, e.g.
    a_index, head_id. A trailing "inv" of the relation is only its direction. An index decides where a mention has one,
    else its id, else its name; a mention with none matches nothing, nor does a null relation. Repeated records each come
    out. Extra columns play no part.
    """
    relation = lambda c: canonical_word(F.regexp_replace(F.lower(c), r"[\s_\p{P}]+inv[\s\p{P}]*$", ""))
    ends = lambda df, sides: df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_index").cast("bigint").alias("i"), canonical_id(F.col(f"{s}_id")).alias("cid"), F.col(f"{s}_id").cast("string").alias("id"), F.col(f"{s}_name").cast("string").alias("name")) for s in sides])).alias("e")).select("e.*")
    things = ends(test, ["a", "b"])
    mentions = written(ends(train, ["head", "tail"]).groupBy("i", "cid", "id", "name").agg(F.count(F.lit(1)).alias("n")))
    lex = learn_lexicon(things.select("name"), typed=mentions.select("name"))
    things = written(parse_names(things.dropDuplicates(["side", "i", "cid", "name"]), lex).withColumn("thing", F.concat_ws("\x01", "side", F.coalesce(F.col("i").cast("string"), "cid", "name"))))
    mentions = written(parse_names(mentions, lex).withColumn("mention", _mention("i", "id", "name")))
    number = F.lpad(F.col("i").cast("string"), 20, "0")
    mentions, things = mentions.withColumn("number_text", number), things.withColumn("number_text", number)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in (("index", F.col("number_text")), ("id", F.col("cid")), ("name", F.col("stem")))])
    texts = lambda df: written(df.select(F.explode(kinds).alias("t"), "i").filter(F.col("t.text") != "").select("t.*", "i"))
    # where a mention has an index, that decides
    matches = written(match_texts(texts(mentions).filter("i IS NULL OR kind = 'index'").select("kind", "text").distinct(), texts(things).select("kind", "text").distinct()))
    same = matches.filter("kind = 'index'").select(F.col("train").alias("number_text"))
    by_index = mentions.join(same, "number_text").join(things.filter("i IS NOT NULL").select("number_text", "thing").distinct(), "number_text").select("mention", "n", "thing")
    rest = mentions.filter("i IS NULL")
    ids, names = matches.filter("kind = 'id'").select("train", "test"), matches.filter("kind = 'name'").select("train", "test")
    by_id = rest.join(ids, rest["cid"] == ids["train"]).join(things.select(F.col("cid").alias("test"), "thing").distinct(), "test").select("mention", "n", "thing")
    nameless = rest.join(by_id.select("mention").distinct(), "mention", "left_anti")
    named = nameless.join(names, nameless["stem"] == names["train"]).join(things.select(F.col("stem").alias("test"), "number", F.col("words").alias("thing_words"), "thing").distinct(), ["test", "number"])
    by_name = named.select("mention", "n", "thing")
    resolved = written(by_index.unionByName(by_id).unionByName(by_name).distinct())
    total = max(2 * train.count(), 1)
    rows = train.select("triple_id", relation(F.col("relation")).alias("r"), _mention("head_index", "head_id", "head_name").alias("h"), _mention("tail_index", "tail_id", "tail_name").alias("t")).filter("r <> ''")
    head = join_groups(rows, resolved.select(F.col("mention").alias("h"), "n", F.col("thing").alias("x")), ["h"], "n", total).select("triple_id", "r", "t", "x")
    both = written(join_groups(head, resolved.select(F.col("mention").alias("t"), "n", F.col("thing").alias("y")), ["t"], "n", total).select("triple_id", "r", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    thing = lambda s: F.concat_ws("\x01", F.lit(s), F.coalesce(F.col(f"{s}_index").cast("bigint").cast("string"), canonical_id(F.col(f"{s}_id")), F.col(f"{s}_name").cast("string")))
    pairs = test.select("test_id", relation(F.col("relation")).alias("r"), thing("a").alias("p"), thing("b").alias("q")).select("test_id", "r", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"))
    sizes = both.groupBy("r", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.join(sizes, ["r", "x", "y"])
    return join_groups(both, groups, ["r", "x", "y"], "n", total).select("test_id", "triple_id").distinct()
