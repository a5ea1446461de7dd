from collections import defaultdict

from lattiq.operators.skew import heavy_keys, join_groups, per_key_states


def brute(data):
    n, near = defaultdict(int), defaultdict(set)
    for _, x, r, y in data:
        for f, k in (("x", x), ("r", r)):
            if k is not None:
                n[f, k] += 1
                if y is not None:
                    near[f, k].add(y)
    return sorted((f, k, c, len(near[f, k])) for (f, k), c in n.items())


def test_states_equal_brute_force_with_hot_keys_and_pairs(spark, rows):
    data = [(i, "hot" if i % 3 else f"k{i % 50}", ["a", "b", None][i % 3], None if i % 11 == 0 else f"n{i % 7 if i % 2 else 0}") for i in range(3000)]
    data += [(5000 + i, "hot", "a", "same") for i in range(2000)]
    df = spark.createDataFrame(data, "id long, x string, r string, y string")
    for partitions in (1, 3, 8):
        assert rows(per_key_states(df, {"x": "y", "r": "y"}, "id", partitions)) == brute(data)
    clash = df.withColumnRenamed("x", "key_value").withColumnRenamed("r", "neighbour")
    assert len(rows(per_key_states(clash, {"key_value": "y"}, "id"))) == len({d[1] for d in data})


def test_work_is_spread(spark):
    df = spark.range(20000).selectExpr("id", "'hot' AS x", "cast(id % 2 AS string) AS y")
    parts = df.repartitionByRange(8, "x", "y", "id").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 2 * 20000 / 8


def test_heavy_and_empty(spark, rows):
    df = spark.createDataFrame([(i, "a" if i < 90 else f"b{i}", "r", "y") for i in range(100)], "id long, x string, r string, y string")
    assert rows(heavy_keys(per_key_states(df, {"x": "y"}, "id"), 100, 0.01)) == [("x", "a")]
    assert rows(per_key_states(df.limit(0), {"x": "y"}, "id")) == []


def test_join_groups_keeps_every_row(spark, rows):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(100)], "id long, k string")
    groups = left.groupBy("k").count()
    for most in (1, 10, 1000):
        assert join_groups(left, groups, ["k"], "count", 100, most).count() == 100


def test_salted_join_is_a_join(spark, rows):
    from lattiq.operators.skew import salted_join

    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 1), ("hot", 2), ("hot", 2)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(20)] + [(f"k{i}", i) for i in range(50)] + [(None, 3)], "k string, b int")
    want = rows(left.join(right, "k"))
    for rows_a_task in (7, 100_000):
        assert rows(salted_join(left, right, ["k"], rows_a_task)) == want
    assert rows(salted_join(left.limit(0), right, ["k"])) == []


def test_states_fold_over_small_batches(spark, rows):
    data = [(i, "hot" if i % 4 else f"k{i % 9}", "r", f"n{i % 13}" if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(data, "id long, x string, r string, y string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(per_key_states(df, {"x": "y", "r": "y"}, "id", 3)) == brute(data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
