"""Operators that must not list what grows as a product of their inputs."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattiq.operators import graph as g
from lattiq.operators import resample as rs
from tests.test_evaluation import auroc


def test_bootstrap_lists_no_draws(spark, monkeypatch):
    """The resamples of a large class are counted in place: no table of draws is made."""
    monkeypatch.setattr(rs, "_draws", lambda *a: pytest.fail("draws listed"))
    data = [(i, float(i % 7), i % 2) for i in range(40)]
    assert rs.bootstrap(spark.createDataFrame(data, "k long, score double, label int"), [], ["k"], resamples=20).first().n_valid == 20


@pytest.mark.parametrize("n", [40, 99, 250])
def test_resamples_beyond_the_hashes_and_odd_scores(monkeypatch, n):
    """More draws than there are hashes repeat them; a null score comes before all others, NaN after them."""
    from lattiq.functions import scores

    rng = random.Random(n)
    score = [rng.choice([None, float("nan"), 0.0, -0.0, 1.0, float("inf"), -2.5]) for _ in range(2 * n)]
    label = [0] * n + [1] * n
    for module in (scores, rs):
        monkeypatch.setattr(module, "HASHES", 101)
    at = lambda boot, d, x: scores.hashed_array(boot, d, x) % n
    value = lambda s: 9e9 if s is None else -9e9 if np.isnan(s) else 8e9 if s == np.inf else s
    rows = pd.DataFrame({"label": label, "no": [*range(n)] * 2, "n": n, "score": [np.nan if s is None else s for s in score], "nan": [s is not None and np.isnan(s) for s in score]})
    got = rs._resampled(rows[rows["no"] < 101], range(6), True, 42)
    for boot in range(6):
        drawn = [[value(score[x * n + at(boot, d % 101, x)]) for d in range(n)] for x in (1, 0)]
        assert got["auroc"][boot] == pytest.approx(auroc(drawn[0] + drawn[1], [1] * n + [0] * n), abs=1e-9)


def test_bootstrap_of_a_group_equals_that_of_its_rows_alone(spark, monkeypatch):
    """Groups named by several columns are resampled apart, and no table of draws is made."""
    monkeypatch.setattr(rs, "_draws", lambda *a: pytest.fail("draws listed"))
    rng = random.Random(3)
    data = [(grp, x, i, round(rng.random(), 1), int(rng.random() < 0.4)) for grp in ("a", "b") for x in (1, 2) for i in range(30)]
    df = spark.createDataFrame(data, "grp string, x int, k long, score double, label int")
    got = {(r.grp, r.x): tuple(r)[2:] for r in rs.bootstrap(df, ["grp", "x"], ["k"], resamples=40).collect()}
    assert len(got) == 4 and got["b", 2] == tuple(rs.bootstrap(df.filter("grp = 'b' AND x = 2"), [], ["k"], resamples=40).first())


def test_bootstrap_interval_draws_from_all_rows(spark, monkeypatch):
    """Classes larger than the number of hashes: rows beyond it, which alone tell the classes apart, are drawn as often as others."""
    from lattiq.functions import scores
    from lattiq.plans import graph_queries

    for module in (scores, rs):
        monkeypatch.setattr(module, "HASHES", 101)
    data = [(1, i, label, float(label and i >= 101)) for i in range(404) for label in (0, 1)]
    monkeypatch.setattr(graph_queries, "_scored", lambda *a: spark.createDataFrame(data, "u long, v long, label int, score double"))
    got = graph_queries.bootstrap_interval(spark, "").first()
    assert got.n_valid == 1000 and got.auroc == pytest.approx(0.875, abs=0.003) and got.auroc_low < 0.865 < 0.885 < got.auroc_high


def test_wide_draws_are_those_of_sql_and_leave_no_row_out():
    import duckdb

    from lattiq.functions.scores import wide_array
    from lattiq.sources.kg_view import SQL_WIDE

    draws, n = np.array([0, 1, 5, 1_000_003, 2_999_999, 2**31 - 1, 2**31]), 3_000_017
    listed = f"SELECT label AS stratum, boot, draw, {n} AS n FROM (SELECT unnest({draws.tolist()}) AS draw), range(998, 1000) b(boot), range(2) l(label)"
    got = {tuple(r[:3]): r[3] for r in duckdb.sql(SQL_WIDE(listed, "boot, draw, stratum")).fetchall()}
    assert got == {(b, int(d), x): int(no) for b in (998, 999) for x in (0, 1) for d, no in zip(draws, wide_array(b, draws, x) % n)}
    size = 1_000_003  # of which half is never drawn by the hashes
    times = sum(np.bincount(wide_array(boot, np.arange(size), 1) % size, minlength=size) for boot in range(20))
    assert times.min() > 0 or (times == 0).mean() < 1e-6


def test_resamples_of_the_whole_hold_every_row():
    """Two classes of 1,100,000 rows in one resample: the counted rows are as many as there are, and those beyond 1,000,003 count."""
    n = 1_100_000
    rows = pd.DataFrame({"label": np.repeat([0, 1], n), "no": np.tile(np.arange(n), 2), "n": n, "score": np.concatenate([np.zeros(n), np.arange(n) >= 1_000_003]), "nan": False})
    got = rs._resampled(rows, range(2), True, 42, True)
    assert got["auroc"].tolist() == pytest.approx([0.5 + (n - 1_000_003) / n / 2] * 2, abs=0.001)


def test_hops_in_blocks_from_the_rarer_end(spark):
    """Two hubs of 300 links: their 90,000 pairs of neighbours are no rows, and sources in several blocks are found alike."""
    links = [(0, i) for i in range(10, 310)] + [(1, i) for i in range(1010, 1310)] + [(10, 1010), (2, 1011), (2, 3), (3, 4), (4, 5), (7, 7)]
    want = {(0, 1): 3, (1, 0): 3, (0, 2): 5, (0, 3): None, (10, 1011): 3, (5, 2): 3, (5, 1): 5, (7, 7): 0, (7, 1): None, (0, 99): 1, (11, 1): 4}
    adj = spark.createDataFrame([x for u, v in links for x in ((u, v), (v, u))], "a long, b long")
    pairs = spark.createDataFrame(list(want), "u long, v long")
    for block in (3, 64):
        got = {(r.u, r.v): r.hops for r in g.hop_distances(pairs, adj, block=block).collect()}
        assert got == want


def test_hops_are_the_same_either_way(spark):
    """Whichever end is rarer is the source; both ways give the same distances, in blocks as in one."""
    links = [(0, i) for i in range(10, 40)] + [(i, i + 100) for i in range(10, 40)] + [(110, 200), (200, 201)]
    adj = spark.createDataFrame([x for u, v in links for x in ((u, v), (v, u))], "a long, b long")
    pairs = spark.createDataFrame([(0, i) for i in (11, 111, 200, 201)] + [(1, 201)], "u long, v long")
    want = {(0, 11): 1, (0, 111): 2, (0, 200): 3, (0, 201): 4, (1, 201): None}
    assert {(r.u, r.v): r.hops for r in g.hop_distances(pairs, adj, block=1).collect()} == want
    assert {(r.v, r.u): r.hops for r in g.hop_distances(pairs.select("v", "u").toDF("u", "v"), adj, block=1).collect()} == want


def test_hops_of_parts_that_do_not_meet_go_together_and_leave_nothing(spark, monkeypatch):
    """Twelve lines of five links, a source a block: blocks share passes over the links, and what rounds read is deleted."""
    links = [(10 * k + i, 10 * k + i + 1) for k in range(12) for i in range(5)]
    adj = spark.createDataFrame([x for u, v in links for x in ((u, v), (v, u))], "a long, b long")
    pairs = spark.createDataFrame([(10 * k, 10 * k + 1 + k % 5) for k in range(12)] + [(0, 15)], "u long, v long")
    passes, spread, tables, written = [], g._spread, [], g.written
    monkeypatch.setattr(g, "_spread", lambda *a: passes.append(1) or spread(*a))
    monkeypatch.setattr(g, "written", lambda df: tables.append(written(df)) or tables[-1])
    got = {(r.u, r.v): r.hops for r in g.hop_distances(pairs, adj, block=1).collect()}
    assert got == {(10 * k, 10 * k + 1 + k % 5): 1 + k % 5 for k in range(12)} | {(0, 15): None}
    kept = [t for t in tables if os.path.exists(t.inputFiles()[0].removeprefix("file://"))]
    assert len(passes) <= 20 and len(kept) < len(tables) - 5 and all(t.columns in (["u", "v"], ["s", "t"]) for t in kept)


@pytest.mark.parametrize("block", [2, 64])
def test_distances_between_equal_those_from_each_source(spark, monkeypatch, block):
    """Distances at whatever hops, in blocks of bits; a source that is a target is at 0; proximity lists no whole reach."""
    links = [(i, i + 1) for i in range(7)] + [(3, 20), (20, 21), (30, 31), (31, 30), (5, 5)]
    adj = spark.createDataFrame([x for u, v in links for x in ((u, v), (v, u))], "a long, b long")
    sources, targets = [0, 4, 21, 30, 99], [7, 4, 31, 0, 99, 98]
    df = lambda x, c: spark.createDataFrame([(i,) for i in x], f"{c} long")
    want = {tuple(r) for r in g.distances_from(df(sources, "s"), adj).collect() if r.x in targets}
    assert {tuple(r) for r in g.distances_between(df(sources, "s"), df(targets, "x"), adj, block).collect()} == want and (0, 7, 7) in want
    monkeypatch.setattr(g, "distances_from", lambda *a: pytest.fail("whole reach listed"))
    g.proximity(df([0], "u").withColumn("v", F.lit(7)), df(sources, "d"), adj, F.col("d"))


@pytest.mark.parametrize("order", [lambda t: F.pmod(F.col("u") * 7 + F.col("v") * (t + 3), F.lit(5)), lambda t: F.lit(7)])
def test_marks_of_dropout_are_those_of_each_trial(spark, order):
    """A link is one row for all trials, with ties at the cuts; its bits are the trials that keep it."""
    und = spark.createDataFrame([(i, i + d) for i in range(12) for d in (0, 1, 3)], "u long, v long")
    trials = [(r, t) for r in (0.0, 0.3, 0.55, 1.0) for t in (0, 1)]
    marked = g.dropout_marks(und, trials, order).collect()
    got = {(*trials[i], r.u, r.v) for r in marked for i in range(len(trials)) if r.kept >> i & 1}
    by_trial = F.when(F.col("trial") == 0, order(0)).otherwise(order(1))
    kept = g.kept_after_dropout(und, spark.createDataFrame(trials, "rate double, trial int"), by_trial).collect()
    assert len(marked) == 36 and got == {tuple(r) for r in kept} and got
