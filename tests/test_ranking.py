import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattiq.operators import linkpred as lp
from lattiq.operators import ranking as rk


def brute_auroc(data):
    pos, neg = [s for s, l in data if l], [s for s, l in data if not l]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "score double, label int")
    m = rk.ranking_metrics(df, [], (1, 3)).first()
    assert (m.auroc, m.hits1, m.hits3) == (0.875, 0.5, 1.0) and math.isclose(m.mrr, (1 + 1 / 3) / 2, abs_tol=1e-6)


def test_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.randint(0, 30) / 10, int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(data, "score double, label int")
    assert math.isclose(rk.ranking_metrics(df, []).first().auroc, brute_auroc(data), abs_tol=1e-6)
    one = spark.createDataFrame([(1.0, 1)], "score double, label int")
    assert rk.ranking_metrics(one, []).first().auroc is None


def test_cumulative(spark, rows):
    df = spark.createDataFrame([("a" if i % 4 else "b", i, 1) for i in range(200)], "g string, o long, v long")
    out = rk.cumulative(df, ["g"], ["o"], ["v"])
    for group in "ab":
        assert [r.before_v for r in out.filter(f"g = '{group}'").orderBy("o").collect()] == list(range(150 if group == "a" else 50))


def test_tiers_collapse(spark, rows):
    df = spark.createDataFrame([(d,) for d in (1, 1, 1, 1, 1, 9)], "deg long")
    assert {r.tier for r in rk.quantile_tiers(df, "deg").collect()} == {"Q1"}


def test_split_is_exact(spark):
    df = spark.range(37).selectExpr("id", "id % 5 AS h")
    assert rk.exact_split(df, "h", "id").filter("part = 'train'").count() == 33


def test_negatives(spark):
    pos = spark.createDataFrame([(i, i + 100) for i in range(10)], "u long, v long")
    neg = lp.negatives("random", pos, pos, pos, pos, 20)
    assert neg.count() == 20 == neg.distinct().count() and neg.join(pos, ["u", "v"]).count() == 0
    targets = spark.createDataFrame([(0, 7), (1, 7), (2, 7)], "drug long, target long")
    assert all(r.u in (0, 1, 2) for r in lp.negatives("shared_target", pos, pos, pos, targets, 0).collect())
    with pytest.raises(ValueError):
        lp.negatives("other", pos, pos, pos, pos, 1)


@settings(max_examples=1, deadline=None)
@given(st.just(0))
def test_embeddings_separate_true_triples(spark, _):
    import numpy as np
    import pandas as pd

    pdf = pd.DataFrame([(i, 0, (i + 1) % 12) for i in range(12)], columns=["h", "r", "t"])
    ent, rel = lp.train_translation(pdf, dim=8, epochs=200)
    good = np.linalg.norm(ent[pdf.h] + rel[pdf.r] - ent[pdf.t], axis=1).mean()
    bad = np.linalg.norm(ent[pdf.h] + rel[pdf.r] - ent[(pdf.t + 5) % 12], axis=1).mean()
    assert good < bad
    ent, phase = lp.train_rotation(pdf, dim=4, epochs=100)
    turn = np.exp(1j * phase[pdf.r])
    assert np.abs(ent[pdf.h] * turn - ent[pdf.t]).mean() < np.abs(ent[pdf.h] * turn - ent[(pdf.t + 5) % 12]).mean()
