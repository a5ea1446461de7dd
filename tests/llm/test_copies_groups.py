import random

from pyspark.sql import functions as F

from lattiq.llm.copies import canonical_id, canonical_word, copy_groups
from lattiq.llm.groups import connected_groups, shared_value_links


def test_canonical(spark, rows):
    df = spark.createDataFrame([(" DB 00-1. ",), ("7290892_7804572",), ("[7804572_7290892 ]",), (None,), ("39,001,111",), ("719087 1",)], "x string")
    assert [r[0] for r in df.select(canonical_word(F.col("x"))).collect()] == ["db001", "72908927804572", "78045727290892", None, "39001111", "7190871"]
    assert [r[0] for r in df.select(canonical_id(F.col("x"))).collect()][1:3] == ["72908927804572"] * 2


def brute(data):
    groups = {}
    for i, *key in data:
        groups.setdefault(tuple(key) if None not in key else ("row", i), []).append(i)
    return sorted(((min(g), len(g)) for g in groups.values()), key=repr), sorted(((min(g), i) for g in groups.values() for i in g if i != min(g)), key=repr)


def check(spark, rows, data, **options):
    df = spark.createDataFrame(data, "id long, a string, b string")
    records, copies = copy_groups(df, "id", [F.col("a"), F.col("b")], **options)
    want = brute(data)
    assert (rows(records), rows(copies)) == want


def test_copies_equal_brute_force(spark, rows):
    rng = random.Random(1)
    data = [(i, f"k{rng.randrange(900)}", rng.choice(["p", "q", None])) for i in range(1500)]
    data += [(2000 + i, "hot", "p") for i in range(900)] + [(4000, "", ""), (4001, "", ""), (4002, "x" * 50_000, "y"), (4003, "x" * 50_000, "y")]
    check(spark, rows, data)
    check(spark, rows, data, max_filter_bytes=16)  # a filter that is full changes nothing


def test_filters_merge_in_two_rounds(spark, rows, monkeypatch):
    """Many partitions, dense and sparse segments: the repeated bits are those of all rows together."""
    import lattiq.llm.copies as copies

    rng = random.Random(3)
    data = [(i, f"k{rng.randrange(600)}", "p") for i in range(1200)] + [(3000 + i, "hot", "p") for i in range(300)]
    df = spark.createDataFrame(data, "id long, a string, b string").repartition(9)
    want = brute(data)
    for bits in (1 << 20, 256):
        monkeypatch.setattr(copies, "SEGMENT_BITS", bits)
        for one_round in (256, 2):
            monkeypatch.setattr(copies, "ONE_ROUND", one_round)
            records, found = copy_groups(df, "id", [F.col("a"), F.col("b")])
            assert (rows(records), rows(found)) == want


def test_copies_of_nothing(spark, rows):
    check(spark, rows, [])
    check(spark, rows, [(1, None, None), (2, None, None)])


def test_ids_clash_with_columns(spark, rows):
    df = spark.createDataFrame([(1, "h"), (2, "h"), (3, "z")], "hash long, first_id string")
    records, copies = copy_groups(df, "hash", [F.col("first_id")])
    assert (rows(records), rows(copies)) == ([(1, 2), (3, 1)], [(1, 2)])


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                root(x)
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return sorted((x, root(x)) for x in parent)


def test_groups_equal_union_find(spark, rows):
    rng = random.Random(2)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    star = [("s000", f"s{i:03}") for i in range(200)]
    noise = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(50)]
    pairs = chain + star + noise + noise + [("alone", "alone"), ("left", None), (None, None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert rows(connected_groups(df)) == union_find(pairs)
    assert rows(connected_groups(df, local_edges=100)) == union_find(pairs)  # joins first, then one task
    assert rows(connected_groups(df.limit(0))) == []
    numbers = spark.createDataFrame([(5, 3), (3, 9), (1, 2)], "a long, b long")
    assert rows(connected_groups(numbers)) == [(1, 1), (2, 1), (3, 3), (5, 3), (9, 3)]


def test_links_by_shared_values(spark, rows):
    df = spark.createDataFrame([("d2", " CAS ", "1-2"), ("d1", "cas", "1-2 "), ("d3", "UNII", "1-2"), ("d4", None, "1-2"), ("d5", "cas", "  "), (None, "cas", "1-2"), ("d1", "cas", "1-2")], "id string, n string, e string")
    assert rows(shared_value_links(df, "id", ["n", "e"])) == [("d1", "d1"), ("d2", "d1"), ("d2", "d2"), ("d3", "d3"), ("d4", "d4"), ("d5", "d5")]
