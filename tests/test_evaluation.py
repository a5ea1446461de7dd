"""Resampling, retrieval, negatives, communities and distances beside brute force."""

import random
from collections import defaultdict, deque
from itertools import combinations
from math import erfc, exp, log, pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.operators import graph as g
from lattiq.operators import linkpred as lp
from lattiq.operators import quality as q
from lattiq.operators import resample as rs
from lattiq.operators import retrieval as rt


def auroc(scores, labels):
    pos, neg = [s for s, x in zip(scores, labels) if x], [s for s, x in zip(scores, labels) if not x]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def hashed(*terms, seed=42):
    h = (seed * 1299709 + sum(t * f for t, f in zip(terms, (7919, 104729, 15485863)))) % 1000003
    return (h * h + h * 31 + seed) % 1000003


def graph_of(links):
    near = defaultdict(set)
    for u, v in links:
        near[u].add(v)
        near[v].add(u)
    return near


def random_links(seed, n=40, m=70):
    rng = random.Random(seed)
    links = {tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(m)} | {(0, i) for i in range(1, 15)}
    return sorted(x for x in links if x[0] != x[1])


def frames(spark, links):
    und = spark.createDataFrame(links, "u long, v long")
    adj = und.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(und.select(F.col("v").alias("a"), F.col("u").alias("b")))
    return und, adj, g.degrees(und)


def test_bootstrap_repeats_its_draws(spark):
    rng = random.Random(1)
    data = [(i, round(rng.random() + (i % 3 == 0) * 0.3, 2), int(i % 3 == 0)) for i in range(60)]
    got = rs.bootstrap(spark.createDataFrame(data, "k long, score double, label int"), [], ["k"], resamples=50).first()
    classes = {x: [s for _, s, label in data if label == x] for x in (0, 1)}
    values = []
    for boot in range(50):
        drawn = {x: [c[hashed(boot, d, x) % len(c)] for d in range(len(c))] for x, c in classes.items()}
        values.append(round(auroc(drawn[1] + drawn[0], [1] * len(drawn[1]) + [0] * len(drawn[0])), 6))
    assert got.n_valid == 50 and got.auroc == pytest.approx(np.mean(values), abs=2e-6)
    assert (got.auroc_low, got.auroc_high) == (pytest.approx(np.percentile(values, 2.5), abs=2e-6), pytest.approx(np.percentile(values, 97.5), abs=2e-6))
    full = rs.bootstrap(spark.createDataFrame(data, "k long, score double, label int"), [], ["k"], resamples=50, point="full").first()
    assert full.auroc == pytest.approx(auroc([s for _, s, _ in data], [x for *_, x in data]), abs=1e-6)
    assert rs.bootstrap(spark.createDataFrame(data[:4], "k long, score double, label int").filter("label = 0"), [], ["k"]).count() == 0
    with pytest.raises(ValueError):
        rs.bootstrap(spark.createDataFrame(data, "k long, score double, label int"), [], ["k"], point="no")


def test_bootstrap_by_group_and_unstratified(spark):
    data = [(grp, i, float(i % 7), i % 2) for grp in ("a", "b") for i in range(30)] + [("c", 1, 1.0, 1), ("c", 2, 2.0, 0)]
    got = {r.grp: r for r in rs.bootstrap(spark.createDataFrame(data, "grp string, k long, score double, label int"), ["grp"], ["k"], resamples=40, stratified=False).collect()}
    assert set(got) == {"a", "b"} and got["a"].auroc == got["b"].auroc and got["a"].auroc_low <= got["a"].auroc <= got["a"].auroc_high


def test_rank_bootstrap_and_variation(spark):
    ranks = spark.createDataFrame([(i, 1 + 13 * i) for i in range(20)], "k long, rank long")
    got = rs.rank_bootstrap(ranks, [], ["k"], k=100, resamples=60).first()
    hits = [1 + 13 * i <= 100 for i in range(20)]
    means = [np.mean([hits[hashed(b, d, 0) % 20] for d in range(20)]) for b in range(60)]
    assert (got.n, got.hits) == (20, np.mean(hits)) and got.low == pytest.approx(np.percentile(means, 2.5), abs=1e-6)
    assert rs.rank_bootstrap(ranks.limit(5), [], ["k"]).first().low is None
    v = rs.variation(spark.createDataFrame([(0.5,), (0.7,), (None,)], "a double"), "a").first()
    assert (v.n, v.mean, v.sd, v.cv, v.spread) == (2, 0.6, 0.1, 16.67, 0.2)


def test_permutations(spark):
    a, b = [(i, float(i), int(i > 9)) for i in range(20)], [(i, float((i * 7) % 20), int(i > 9)) for i in range(20)]
    df = lambda x: spark.createDataFrame(x, "k long, score double, label int")
    r = rs.permutation_test(df(a), df(b), ["k"], permutations=60, comparisons=3).first()
    assert r.observed == pytest.approx(auroc([s for _, s, _ in a], [x for *_, x in a]) - auroc([s for _, s, _ in b], [x for *_, x in b]), abs=1e-6)
    pooled, p = a + b, 0
    for perm in range(1, 61):
        order = sorted(range(40), key=lambda i: (hashed(i, perm), i))
        sides = [[pooled[i] for i in order[:20]], [pooled[i] for i in order[20:]]]
        d = [auroc([s for _, s, _ in x], [y for *_, y in x]) for x in sides]
        p += abs(round(d[0], 6) - round(d[1], 6)) >= abs(r.observed)
    assert r.p == pytest.approx(p / 60, abs=1e-6) and r.bonferroni == pytest.approx(min(1, 3 * p / 60), abs=1e-6)


@pytest.mark.parametrize("most", [2, 4, 5])
def test_hops_equal_brute_force(spark, most):
    links = random_links(4) + [(100 + i, 101 + i) for i in range(9)] + [(5, 100)]
    near = graph_of(links)
    nodes = sorted(near) + [999]
    pairs = [(u, v) for u in nodes for v in nodes if (u * 31 + v) % 5 == 0]
    want = {}
    for u, v in pairs:
        seen, todo = {u: 0}, deque([u])
        while todo:
            x = todo.popleft()
            for y in near.get(x, ()):
                if y not in seen:
                    seen[y] = seen[x] + 1
                    todo.append(y)
        want[u, v] = seen[v] if v in seen and seen[v] <= most else None
    _, adj, _ = frames(spark, links)
    got = {(r.u, r.v): r.hops for r in g.hop_distances(spark.createDataFrame(pairs, "u long, v long"), adj, most).collect()}
    assert got == want


def test_retrieval_equals_brute_force(spark):
    links = random_links(7)
    near = graph_of(links)
    _, adj, deg = frames(spark, links)
    inv = {x: 1 / log(len(n)) if len(n) > 1 else 0.0 for x, n in near.items()}
    pool = [x for x in near if x % 2] + [501, 503]
    targets = [(d, x) for d in (0, 2, 4, 6) for x in near[d] if x % 2]
    held = rt.held_out_targets(spark.createDataFrame(targets, "d long, g long"), least=2)
    got = {(r.d, r.g): r.rank for r in rt.leave_one_out_ranks(held, spark.createDataFrame(targets, "d long, g long"), adj, deg, spark.createDataFrame([(x,) for x in pool], "g long")).collect()}
    assert len(got) >= 2
    for (d, out), rank in got.items():
        others = {x for e, x in targets if e == d} - {out}
        score = lambda x: round(sum(inv[w] for w in (near[d] - {out}) & (near.get(x, set()) - ({d} if x == out else set()))), 9)  # noqa: B023, E731
        assert rank == sum(score(x) >= score(out) for x in pool if x not in others)
    triplets = [(u, x, v) for u, x, v in ((0, 3, 2), (2, 1, 4), (4, 501, 6), (0, 5, 6))]
    ranks = {(r.u, r.g, r.v): r.rank for r in rt.path_ranks(spark.createDataFrame(triplets, "u long, g long, v long"), adj, deg, spark.createDataFrame([(x,) for x in pool], "g long")).collect()}
    for u, x, v in triplets:
        s = lambda y: round(sum(inv[w] for w in (near[u] - {v}) & near.get(y, set())) * sum(inv[w] for w in (near[v] - {u}) & near.get(y, set())), 9)  # noqa: B023, E731
        assert ranks[u, x, v] == sum(s(y) >= s(x) for y in pool)
    summary = rt.rank_summary(spark.createDataFrame([(1,), (20,), (60,)], "rank long")).first()
    assert (summary.n, summary.hits10, summary.hits50, summary.median_rank) == (3, pytest.approx(1 / 3, abs=1e-6), pytest.approx(2 / 3, abs=1e-6), 20)


def test_triplets_resolve_in_order(spark, rows):
    nodes = spark.createDataFrame([(1, "gene", "Gene::12", "ABC"), (2, "gene", "x", "13"), (3, "gene", "y", "Sym"), (4, "drug", "d", "Aspirin"), (5, "drug", "e", "MESH:C9"), (6, "disease", "Disease::DOID:7", "Flu"), (7, "disease", "z", "DOID:8")], "idx long, kind string, id string, name string")
    t = spark.createDataFrame([("aspirin", "C1", 12, "q", "flu", "MESH:D0"), ("other", "C9", 13, "q", "x", "MESH:D1"), ("aspirin", "C1", 99, "SYM", "x", "MESH:D2"), ("aspirin", "C1", 98, "none", "flu", "MESH:D0")], "chem_name string, chem_id string, gene_id long, gene_symbol string, disease_name string, disease_id string")
    mesh = spark.createDataFrame([("MESH:D1", "DOID:7"), ("MESH:D2", "DOID:8")], "mesh string, doid string")
    assert rows(rt.resolve_triplets(t, nodes, mesh)) == [(4, 1, 6), (4, 3, 7), (5, 2, 6)]


def test_grouped_and_shared_target_negatives(spark, rows):
    pos = [("a", u, 100 + u) for u in range(6)] + [("b", u, 200 + u) for u in range(3)]
    tails = [("a", 100 + i) for i in range(20)] + [("b", 200 + i) for i in range(4)]
    d = lambda x, s: spark.createDataFrame(x, s)
    known, heads = d([(u, v) for _, u, v in pos], "u long, v long"), d([(u,) for u in range(12)], "u long")
    got = rows(lp.grouped_negatives(d(pos, "grp string, u long, v long"), known, heads, d(tails, "grp string, v long")))
    assert len(got) == len(set(got)) == 5 * 9 and all((k, v) in set(tails) and (u, v) not in {(a, b) for _, a, b in pos} for k, u, v in got)
    targets = d([(u, t) for u in range(8) for t in range(3) if (u + t) % 3], "drug long, target long")
    near = defaultdict(set)
    for r in targets.collect():
        near[r.target].add(r.drug)
    neg = rows(lp.negatives("shared_target", known, heads, known, targets, 15))
    assert 0 < len(neg) <= 15 and all(u in set().union(*near.values()) and (u, v) not in {(a, b) for _, a, b in pos} for u, v in neg)
    assert lp.negatives("shared_target", known, heads, known, targets.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        lp.score_pairs("none", known, known, known)


def test_louvain_finds_cliques_on_either_path(spark):
    cliques = [range(10 * k, 10 * k + 6) for k in range(5)]
    links = [p for c in cliques for p in combinations(c, 2)] + [(10 * k, 10 * k + 10) for k in range(4)]
    und, _, _ = frames(spark, links)
    for local in (2_000_000, 20):
        labels = {r.idx: r.community for r in g.louvain(und, local_links=local).collect()}
        assert len({labels[x] for c in cliques for x in c}) == 5 or local == 20
        assert all(len({labels[x] for x in c}) == 1 for c in cliques)
        assert g.modularity(und, spark.createDataFrame(list(labels.items()), "idx long, community long")).first().modularity > 0.6
    assert g.louvain(und.limit(0)).count() == 0


def test_ami_equals_brute_force(spark):
    from math import comb

    x, y = [i % 3 for i in range(30)], [(i // 7) % 4 for i in range(30)]
    n = 30
    a, b = [x.count(i) for i in set(x)], [y.count(i) for i in set(y)]
    cells = [sum(p == i and r == j for p, r in zip(x, y)) for i in set(x) for j in set(y)]
    h = lambda c: -sum(k / n * log(k / n) for k in c if k)
    expected = sum(k / n * log(n * k / (i * j)) * comb(i, k) * comb(n - i, j - k) / comb(n, j) for i in a for j in b for k in range(max(1, i + j - n), min(i, j) + 1))
    mi = h(a) + h(b) - h(cells)
    got = g.adjusted_mutual_information(spark.createDataFrame(list(zip(x, y)), "x int, y int"))
    assert got == pytest.approx((mi - expected) / ((h(a) + h(b)) / 2 - expected), abs=1e-9)


def test_reruns_and_resumed_fits(spark, tmp_path):
    import pandas as pd

    rng = random.Random(3)
    triples = [(run, rng.randrange(20), rng.randrange(3), rng.randrange(20)) for run in (0, 1) for _ in range(80)]
    pairs = [(run, "s", u, v, int(u < 5), 1, 2) for run in (0, 1) for u in range(10) for v in (11, 12)] + [(0, "s", 999, 1, 0, 1, 2)]
    got = lp.score_reruns(spark.createDataFrame(triples, "rerun int, h long, r long, t long"), spark.createDataFrame(pairs, "rerun int, strategy string, u long, v long, label int, r long, r_inv long"), {"translation": {"epochs": 2}, "rotation": {"epochs": 2}}).collect()
    assert len(got) == 2 * len(pairs) and all(r.score == -1e9 for r in got if r.u == 999) and all(-100 < r.score < 0 for r in got if r.u != 999)
    t = pd.DataFrame([x[1:] for x in triples if x[0] == 0], columns=["h", "r", "t"])
    whole = lp.train_translation(t, epochs=6)
    lp.fit_resumable(t, str(tmp_path / "v.npz"), epochs=3, every=2)
    resumed = lp.fit_resumable(t, str(tmp_path / "v.npz"), epochs=6, every=2)
    assert np.allclose(whole[0], resumed[0]) and np.allclose(whole[1], resumed[1])
    with pytest.raises(ValueError):
        lp.fit_resumable(t.assign(h=t["h"] + 50), str(tmp_path / "v.npz"), epochs=9)


def test_summary_has_every_metric(spark):
    scores = spark.createDataFrame([("k", m, 0.5) for m, _ in q.SUB_METRICS[:5]] + [("j", "Link Prediction", 0.25)], "kg string, metric string, score double")
    got = {(r.kg, r.dimension, r.metric): r.score for r in q.summary_table(scores).collect()}
    assert len(q.SUB_METRICS) == 19 and sum(k == "k" and m != "all" for k, _, m in got) == 19
    assert got["k", "overall", "all"] == 0.5 and got["j", "task_performance", "all"] == 0.25 and got["j", "coverage", "Entity Coverage"] is None


def test_tails():
    from lattiq.functions import scores as sc

    for x, k, p in ((3.841459, 1, 0.05), (18.307038, 10, 0.05), (0.5, 3, 0.918891), (40.0, 5, erfc(20**0.5) + (80 / pi) ** 0.5 * exp(-20) * (1 + 40 / 3))):
        assert sc.chi_square_tail(x, k) == pytest.approx(p, rel=1e-4)
    for t, k, p in ((2.228139, 10, 0.05), (12.7062, 1, 0.05), (0.0, 7, 1.0), (-3.0, 20, 0.007076)):
        assert sc.t_tails(t, k) == pytest.approx(p, rel=1e-3)
    assert sc.kruskal_p(5.0, 1) is None and sc.correlation_p(0.5, 2) is None and sc.correlation_p(1.0, 9) == 0.0
    assert sc.correlation_p(0.5, 27) == pytest.approx(0.00790, rel=1e-2)


def _plain_translation(x, dim, epochs, rate=0.05, margin=1.0, seed=42):
    """The steps of train_translation, written row by row of vectors."""
    rng, n, m = np.random.default_rng(seed), x[:, [0, 2]].max() + 1, x[:, 1].max() + 1
    bound = 6 / np.sqrt(dim)
    ent, rel = rng.uniform(-bound, bound, (n, dim)), rng.uniform(-bound, bound, (m, dim))
    for epoch in range(epochs):
        rng = np.random.default_rng([seed, epoch])
        order = rng.permutation(len(x))
        for part in np.array_split(order, max(1, len(order) // 512)):
            h, r, t = x[part].T
            swap, drawn = rng.random(len(part)) < 0.5, rng.integers(0, n, len(part))
            ch, ct = np.where(swap, drawn, h), np.where(swap, t, drawn)
            good, bad = ent[h] + rel[r] - ent[t], ent[ch] + rel[r] - ent[ct]
            lg, lb = np.linalg.norm(good, axis=1) + 1e-9, np.linalg.norm(bad, axis=1) + 1e-9
            act = (margin + lg - lb > 0)[:, None]
            g, b = act * good / lg[:, None] * rate, act * bad / lb[:, None] * rate
            for to, at, by in ((ent, h, -g), (ent, t, g), (ent, ch, b), (ent, ct, -b), (rel, r, b - g)):
                np.add.at(to, at, by)
        ent /= np.maximum(np.linalg.norm(ent, axis=1, keepdims=True), 1e-9)
    return ent, rel


def _plain_rotation(x, dim, epochs, rate=0.05, margin=6.0, seed=42):
    rng, n, m = np.random.default_rng(seed), x[:, [0, 2]].max() + 1, x[:, 1].max() + 1
    ent, phase = rng.normal(0, 0.5, (n, dim)) + 1j * rng.normal(0, 0.5, (n, dim)), rng.uniform(-np.pi, np.pi, (m, dim))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for part in np.array_split(order, max(1, len(order) // 512)):
            h, r, t = x[part].T
            swap, drawn = rng.random(len(part)) < 0.5, rng.integers(0, n, len(part))
            turn, ends = np.exp(1j * phase[r]), ((h, t), (np.where(swap, drawn, h), np.where(swap, t, drawn)))
            d = [ent[a] * turn - ent[b] for a, b in ends]
            length = [np.sqrt((np.abs(v) ** 2).sum(1) + 1e-12) for v in d]
            act = (margin + length[0] - length[1] > 0)[:, None]
            for s, v, ll, (p, q) in zip((1, -1), d, length, ends):
                g, source = act * v / ll[:, None] * rate * s, ent[p]
                np.add.at(ent, p, -(g * np.conj(turn)))
                np.add.at(ent, q, g)
                np.add.at(phase, r, -np.real(np.conj(g) * (1j * source * turn)))
    return ent, phase


def test_fits_take_the_plain_steps():
    import time

    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 300, 3000), rng.integers(0, 4, 3000), rng.integers(0, 40, 3000)], axis=1)
    x[:900, 2] = 299  # a frequent end
    for fit, plain in ((lp.train_translation, _plain_translation), (lp.train_rotation, _plain_rotation)):
        for dim, margin in ((16, 1.0), (8, 0.2), (12, 0.2), (5, 6.0), (3, 0.2)):
            for got, want in zip(fit(x.astype(np.int32), dim=dim, epochs=3, margin=margin), plain(x, dim, 3, margin=margin)):
                assert np.allclose(got, want, rtol=0, atol=1e-12)
    x = np.stack([rng.integers(0, 5000, 20_000), rng.integers(0, 4, 20_000), rng.integers(0, 5000, 20_000)], axis=1)
    for fit, plain in ((lp.train_translation, _plain_translation), (lp.train_rotation, _plain_rotation)):
        took = []
        for f in (fit, plain) * 3:
            began = time.thread_time()
            f(x, 16, 1)
            took.append(time.thread_time() - began)
        assert min(took[::2]) < 0.75 * min(took[1::2])  # the second was the fit


def test_each_fit_has_its_task_and_inverses_may_be_left_to_it(spark):
    rng = random.Random(4)
    forward = list({(run, rng.randrange(20) + (2**40) * (run == 2), rng.randrange(3), rng.randrange(20)) for run in (0, 1, 2) for _ in range(60)})
    both = forward + [(run, t, r + 3, h) for run, h, r, t in forward]
    pairs = [(run, "s", u, v, int(u < 5), 1, 4) for run in (0, 1, 2) for u in range(10) for v in (11, 12)]
    frame = lambda rows: spark.createDataFrame(rows, "rerun int, h long, r long, t long")
    p = spark.createDataFrame(pairs, "rerun int, strategy string, u long, v long, label int, r long, r_inv long")
    options = {"translation": {"epochs": 2}, "rotation": {"epochs": 2}}
    got = lp.score_reruns(frame(forward), p, options, inverse=3)
    assert sorted(got.collect()) == sorted(lp.score_reruns(frame(both), p, options).collect())
    at = got.select(F.spark_partition_id().alias("task"), "rerun", "model").distinct().collect()
    assert len(at) == 6 == len({r.task for r in at})
    with pytest.raises(Exception, match="overlap"):
        lp.score_reruns(frame(forward), p, options, inverse=2).collect()
    many = [(run, h, r, t) for run in (0, 3) for k, h, r, t in both if k == 0]  # more reruns than seeds share tasks
    more = lp.score_reruns(frame(many), p.filter("rerun = 0").unionByName(p.filter("rerun = 0").withColumn("rerun", F.lit(3))), options).collect()
    assert len(more) == 80 and {tuple(r)[1:] for r in more if r.rerun == 3} == {tuple(r)[1:] for r in got.collect() if r.rerun == 0}
