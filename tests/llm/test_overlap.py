import random

from lattiq.llm import overlap
from lattiq.llm.overlap import match_texts, record_overlaps, shared_spans

TRAIN = "triple_id long, relation string, head_index long, head_id string, head_name string, tail_index long, tail_id string, tail_name string, extra string"
TEST = "test_id long, relation string, a_index long, a_id string, a_name string, b_index long, b_id string, b_name string"


def test_spans_equal_brute_force_for_any_partitioning(spark, rows):
    words = ["brabomuloid", "stigretav", "kuplinoric", "brabimuloid", "retavkup", "zzzz", "abc"]
    train = spark.createDataFrame([("name", w) for w in words[::2]], "kind string, text string")
    test = spark.createDataFrame([("name", w) for w in words[1::2]], "kind string, text string")
    want = None
    for n in (1, 2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {(r.train, r.test): r.n for r in shared_spans(train, test).groupBy("train", "test").max("n").withColumnRenamed("max(n)", "n").collect()}
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert want["brabomuloid", "brabimuloid"] == 6 and want["retavkup", "stigretav"] == 5 if ("retavkup", "stigretav") in want else True


def test_spans_of_texts_too_far_apart_are_not_listed(spark, rows, monkeypatch):
    """Sixty names with one ending on either side: of their 3,600 pairs only those within the edits are rows; matches are those of brute force."""
    rng = random.Random(5)
    heads = ["".join(rng.choice("abcdefghijk") for _ in range(8)) for _ in range(60)]
    train = [("name", f"{h}itrosis") for h in heads]
    test = [("name", f"{h[:3]}x{h[4:]}itrosis") for h in heads] + [("name", "itrosis")]
    listed, written = [], overlap.written
    monkeypatch.setattr(overlap, "written", lambda df: listed.append(written(df)) or listed[-1])
    kind = "kind string, text string"
    got = rows(match_texts(spark.createDataFrame(train, kind), spark.createDataFrame(test, kind)).select("train", "test", "edits"))
    assert got == sorted((a[1], b[1], 1) for a, b in zip(train, test))
    assert next(t for t in listed if t.columns == ["kind", "train", "test", "at", "n"]).select("train", "test").distinct().count() < 200


def test_names_with_an_ending_alone_are_no_pairs(spark, rows, monkeypatch):
    """A hundred names on either side end alike: none is compared with all; an ending repeated in a name still covers it."""
    rng = random.Random(8)
    heads = ["".join(rng.choice("abcdefghijk") for _ in range(10)) for _ in range(100)]
    train = [("name", f"{h}tide") for h in heads] + [("name", "tidextidetide"), ("name", f"{heads[0][:9]}x" + "mnopqrst" * 8 + "tide")]
    test = [("name", f"{h[:3]}x{h[4:]}tide") for h in heads] + [("name", "bcdetidextide"), ("name", f"{heads[0][:9]}y" + "mnopqrst" * 8 + "tide"), *train[:10]]
    compared, join = [], overlap.salted_join
    monkeypatch.setattr(overlap, "salted_join", lambda *a: compared.append(join(*a)) or compared[-1])
    kind = "kind string, text string"
    links, holders = overlap._links(spark.createDataFrame(train, kind), spark.createDataFrame(test, kind))
    tested = {}
    for r in holders.collect():
        tested.setdefault(r.suffix, set()).add(r.test)
    covered = {}
    for r in links.collect():
        for t in tested[r.suffix]:
            covered.setdefault((r.train, t), set()).update(range(r.at, r.at + r.n))
    near = lambda a, b: overlap_edits(a, b) <= min(overlap.MOST_EDITS, len(b) // overlap.CHARACTERS_AN_EDIT)
    close = [(overlap_edits(a, b), a, b) for (a, b), places in covered.items() if len(places) >= overlap.LEAST_COVERAGE * len(a) and near(a, b)]
    least = {a: min(e for e, x, _ in close if x == a) for _, a, _ in close}
    got = rows(match_texts(spark.createDataFrame(train, kind), spark.createDataFrame(test, kind)).select("train", "test", "edits"))
    assert got == sorted((a, b, e) for e, a, b in close if e == least[a])
    assert "tidextidetide" in least and train[-1][1] in least and least[train[0][1]] == 0
    assert sum(df.count() for df in compared) < 3000


def overlap_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_ids_need_their_whole_text(spark, rows):
    train = spark.createDataFrame([("id", "drugbankdb00000717"), ("id", "db00000718"), ("name", "db00000717")], "kind string, text string")
    test = spark.createDataFrame([("id", "db00000717")], "kind string, text string")
    assert rows(match_texts(train, test).select("train", "test")) == [("drugbankdb00000717", "db00000717")]


def test_overlaps(spark, rows):
    test = spark.createDataFrame([
        (1, "indication", 10, "DB00000001", "Brabomulinib", 20, "7000001_7000002", "chronic stigretavoid leukemia type 2"),
        (2, "indication", 11, "DB00000002", "Kuplinoramab", 21, "7000003", "chronic stigretavoid leukemia type 1"),
        (3, "indication", 12, None, None, 22, None, None)], TEST)
    name = "chronic stigretavoid leukemia type"
    train = [
        (1, "indication", 10, "DB00000001", "x", 20, None, None, ""),  # by index
        (2, " INDICATION ", None, "Compound::db00000001", None, None, "[7000002_7000001]", None, ""),  # by id
        (3, "Indication_inv", None, None, f"{name} II", None, None, "Brabomlinib (compound)", ""),  # by name, other direction
        (4, "contraindication", 10, None, None, 20, None, None, ""),  # another relation
        (5, "indication", None, None, "Brabomulinib", None, None, f"{name} 1", ""),  # another number
        (6, "indication", None, None, "Brabomulinib", None, None, None, ""),
        (7, None, 10, None, None, 20, None, None, ""),
        (8, "indication", 10, None, None, 20, None, "y" * 20_000, ""),  # long text
        (8, "indication", 10, None, None, 20, None, "y" * 20_000, ""),
        (9, "indication", 10, "DB00000002", "Kuplinoramab", 21, None, None, ""),  # the index decides
        (10, "indication", 22, None, None, 12, None, None, ""),
        # names in which a word that wraps others is learned as such
        *[(20 + i, "indication", None, None, f"{n} (compound)", None, None, "unlisted disease", "") for i, n in enumerate(("Pazolimumab", "Vikoretinib", "Sudamegant", "Wobexarin"))],
    ]
    df = spark.createDataFrame(train, TRAIN)
    assert rows(record_overlaps(df, test)) == [(1, 1), (1, 2), (1, 3), (1, 8), (3, 10)]
    assert rows(record_overlaps(df.limit(0), test)) == [] == rows(record_overlaps(df, test.limit(0)))
