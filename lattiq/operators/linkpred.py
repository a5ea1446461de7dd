"""Negative sampling, resampling and evaluation of link prediction, with draws that any engine repeats."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.functions.scores import hashed
from lattiq.operators import graph as g
from lattiq.operators.ranking import cumulative
from lattiq.operators.resample import numbered_within

STRATEGIES = ("random", "type_constrained", "shared_target")


#: Scorers of pairs by name: the column of graph.pair_scores() that holds each.
SCORERS = {"common_neighbors": "cn", "jaccard": "jaccard", "adamic_adar": "aa"}


def score_pairs(scorer: str, pairs: DataFrame, adj: DataFrame, deg: DataFrame) -> DataFrame:
    """(u, v, score) of distinct pairs by a scorer of SCORERS."""
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}; known: {sorted(SCORERS)}")
    return g.pair_scores(pairs, adj, deg).select("u", "v", F.col(SCORERS[scorer]).cast("double").alias("score"))


def numbered(pool: DataFrame, key: str) -> DataFrame:
    """(key, no) with no from 0 in order of key, without a window over all rows."""
    distinct = pool.select(key).distinct().withColumn("__one", F.lit(1))
    return cumulative(distinct, [], [key], ["__one"]).select(key, F.col("before___one").alias("no"))


def random_negatives(positives: DataFrame, heads: DataFrame, tails: DataFrame, n: int, attempts: int = 30, seed: int = 42) -> DataFrame:
    """(u, v) of n pairs at most, hashed from all head x tail pairs, without positives (u, v); attempts * n draws are made."""
    spark = positives.sparkSession
    h, t = numbered(heads, "u"), numbered(tails, "v")
    nh, nt = heads.select("u").distinct().count(), tails.select("v").distinct().count()
    if not nh or not nt or n <= 0:
        return positives.select("u", "v").limit(0)
    draws = spark.range(attempts * n).select("id", (hashed(F.col("id"), seed=seed) % nh).alias("hn"), (hashed(F.col("id"), seed=seed + 1) % nt).alias("tn"))
    first = draws.groupBy("hn", "tn").agg(F.min("id").alias("id"))
    pairs = first.join(h.withColumnRenamed("no", "hn"), "hn").join(t.withColumnRenamed("no", "tn"), "tn")
    free = pairs.join(positives.select("u", "v").distinct(), ["u", "v"], "left_anti")
    ranked = cumulative(free.select("u", "v", "id").withColumn("__one", F.lit(1)), [], ["id"], ["__one"])
    return ranked.filter(F.col("before___one") < n).select("u", "v")


def grouped_negatives(positives: DataFrame, known: DataFrame, heads: DataFrame, tails: DataFrame, ratio: int = 5, attempts: int = 30, seed: int = 42) -> DataFrame:
    """(grp, u, v): for each group of positives (grp, u, v) ratio times as many distinct hashed pairs of heads (u) and the group's tails (grp, v).

    Pairs in known (u, v) are left out; attempts times as many draws are made as pairs are wanted, so small pools give fewer."""
    h, nh = numbered(heads, "u"), heads.select("u").distinct().count()
    pool = tails.select("grp", "v").distinct()
    t = numbered_within(pool, ["grp"], ["v"], "tn")
    sizes = positives.groupBy("grp").agg((F.count(F.lit(1)) * ratio).alias("want")).join(pool.groupBy("grp").agg(F.count(F.lit(1)).alias("nt")), "grp")
    draws = sizes.select("grp", "nt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("want") * attempts - 1)).alias("id"))
    drawn = draws.select("grp", "id", (hashed(F.col("id"), seed=seed) % max(nh, 1)).alias("hn"), (hashed(F.col("id"), seed=seed + 1) % F.col("nt")).alias("tn"))
    first = drawn.groupBy("grp", "hn", "tn").agg(F.min("id").alias("id"))
    pairs = first.join(h.withColumnRenamed("no", "hn"), "hn").join(t, ["grp", "tn"]).join(known.select("u", "v").distinct(), ["u", "v"], "left_anti")
    ranked = numbered_within(pairs.select("grp", "u", "v", "id"), ["grp"], ["id"])
    return ranked.join(sizes, "grp").filter(F.col("no") < F.col("want")).select("grp", "u", "v")


def shared_target_negatives(positives: DataFrame, targets: DataFrame, tails: DataFrame, n: int, attempts: int = 30, seed: int = 42) -> DataFrame:
    """(u, v) of n pairs at most: each draw takes a positive (u, v), a target of u, another drug of that target, and a tail, all by hash.

    Distinct, without positives; attempts * n draws are made. targets: (drug, target). A drug without targets, or whose
    target has no other drug, gives nothing. Targets of a drug and drugs of a target are numbered by range partitions, so a
    target with a third of all links is no problem."""
    spark, t = positives.sparkSession, targets.select("drug", "target").distinct()
    pos = numbered_within(positives.select("u", "v").distinct(), [], ["u", "v"], "pn")
    n_pos, tail, nt = pos.count(), numbered(tails, "v"), tails.select("v").distinct().count()
    if not n_pos or not nt or n <= 0:
        return positives.select("u", "v").limit(0)
    of_drug = numbered_within(t, ["drug"], ["target"], "k").select(F.col("drug").alias("u"), "k", "target")
    of_target = numbered_within(t, ["target"], ["drug"], "k2").select("target", "k2", F.col("drug").alias("w"))
    count = lambda c, name: t.groupBy(c).agg(F.count(F.lit(1)).alias(name))
    draw = lambda i: hashed(F.col("id"), seed=seed + i)
    d = spark.range(attempts * n).select("id", (draw(0) % n_pos).alias("pn"), (draw(3) % nt).alias("no")).join(pos.select("pn", "u"), "pn")
    d = d.join(count("drug", "nd").withColumnRenamed("drug", "u"), "u").withColumn("k", draw(1) % F.col("nd")).join(of_drug, ["u", "k"])
    # the other drugs of the target: one place less, those from u's own place on move up
    own = of_target.select("target", F.col("w").alias("u"), F.col("k2").alias("mine"))
    d = d.join(count("target", "nw"), "target").filter("nw > 1").join(own, ["target", "u"])
    place = draw(2) % (F.col("nw") - 1)
    d = d.withColumn("k2", place + (place >= F.col("mine")).cast("bigint")).join(of_target, ["target", "k2"]).join(tail, "no")
    first = d.groupBy(F.col("w").alias("u"), "v").agg(F.min("id").alias("id")).join(positives.select("u", "v").distinct(), ["u", "v"], "left_anti")
    return numbered_within(first, [], ["id"]).filter(F.col("no") < n).select("u", "v")


def negatives(strategy: str, positives: DataFrame, heads: DataFrame, tails: DataFrame, targets: DataFrame, n: int, seed: int = 42) -> DataFrame:
    if strategy in ("random", "type_constrained"):
        return random_negatives(positives, heads, tails, n, seed=seed)
    if strategy == "shared_target":
        return shared_target_negatives(positives, targets, tails, n, seed=seed)
    raise ValueError(f"unknown strategy {strategy!r}; known: {STRATEGIES}")


def _triples(pdf: pd.DataFrame | np.ndarray) -> np.ndarray:
    return pdf if isinstance(pdf, np.ndarray) else pdf[["h", "r", "t"]].to_numpy()


def _batches(x: np.ndarray, n: int, rng: np.random.Generator):
    """(ends, r) of batches of triples in random order: rows of heads, drawn heads, tails and drawn tails; one end of each triple is drawn."""
    order = rng.permutation(len(x))
    for part in np.array_split(order, max(1, len(order) // 512)):
        h, r, t = x.take(part, axis=0).T.astype(np.intp)
        swap, drawn = rng.random(len(part)) < 0.5, rng.integers(0, n, len(part))
        yield np.stack([h, np.where(swap, drawn, h), t, np.where(swap, t, drawn)]), r


def _columns(vectors: np.ndarray, k: int) -> np.ndarray:
    """Vectors, k at a time, as contiguous columns."""
    return np.ascontiguousarray(vectors.reshape(-1, k, vectors.shape[-1]).transpose(0, 2, 1))


def _places(rows: np.ndarray, dim: int) -> np.ndarray:
    """Where the columns of vectors stand in the flat array of all: ufunc.at is several times as fast with flat places."""
    return (rows[:, None] * dim + np.arange(dim)[:, None]).reshape(len(rows), -1)


def _sums(a: np.ndarray, wide: int) -> np.ndarray:
    """Sums of the columns of each block, of which each holds wide numbers in a row, in NumPy's order for a contiguous row of as many."""
    n = a.shape[1] * wide
    if n % 8 or n > 128:
        rows = a.reshape(*a.shape[:2], -1, wide).transpose(0, 2, 1, 3)
        return np.add.reduce(np.ascontiguousarray(rows).reshape(len(a), -1, n), axis=2)
    step = 8 // wide
    s = a[:, :step]
    for i in range(step, a.shape[1], step):
        s = s + a[:, i : i + step]
    if wide == 2:
        s = s[:, :, ::2] + s[:, :, 1::2]
    while s.shape[1] > 1:
        s = s[:, ::2] + s[:, 1::2]
    return s[:, 0]


def train_translation(pdf: pd.DataFrame | np.ndarray, dim: int = 16, epochs: int = 30, rate: float = 0.05, margin: float = 1.0, seed: int = 42, start: tuple[np.ndarray, np.ndarray] | None = None, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Entity and relation vectors of a translation model by margin-ranking gradient steps, for one graph (h, r, t from 0).

    Entities are scaled to unit length after each epoch; a corrupted end is drawn from all entities. start: the vectors after
    the first so many epochs, to go on from; an epoch's draws depend on its number alone, so a resumed fit is the same.
    Triples of a batch act one after the other; vectors of even length are added two numbers at a time (as complex)."""
    rng, x = np.random.default_rng(seed), _triples(pdf)
    n, m = int(x[:, [0, 2]].max()) + 1, int(x[:, 1].max()) + 1
    bound = 6 / np.sqrt(dim)
    ent, rel = rng.uniform(-bound, bound, (n, dim)), rng.uniform(-bound, bound, (m, dim))
    if start is not None:
        if start[0].shape != ent.shape or start[1].shape != rel.shape:
            raise ValueError(f"vectors of {start[0].shape} and {start[1].shape} do not fit a graph of {ent.shape} and {rel.shape}")
        ent, rel = start[0].copy(), start[1].copy()
    wide = 2 - dim % 2
    e, l = (ent.view(complex), rel.view(complex)) if wide == 2 else (ent, rel)
    flat, flat_rel, half = e.reshape(-1), l.reshape(-1), dim // wide
    for epoch in range(first, epochs):
        for ends, r in _batches(x, n, np.random.default_rng([seed, epoch])):
            d = e.take(ends[:2].reshape(-1), axis=0).reshape(2, len(r), half)
            d += l.take(r, axis=0)
            d -= e.take(ends[2:].reshape(-1), axis=0).reshape(d.shape)
            d = _columns(d, len(r))
            numbers = d.view(float)
            length = np.sqrt(_sums(numbers * numbers, wide)) + 1e-9
            length[:, ~(margin + length[0] - length[1] > 0)] = np.inf  # no step
            numbers /= np.repeat(length, wide, axis=1)[:, None]
            numbers *= rate
            (g, b), at = d.reshape(2, -1), _places(ends, half)
            np.subtract.at(flat, at[0], g)
            np.add.at(flat, at[2], g)
            np.add.at(flat, at[1], b)
            np.subtract.at(flat, at[3], b)
            b -= g
            np.add.at(flat_rel, _places(r[None], half)[0], b)
        ent /= np.maximum(np.linalg.norm(ent, axis=1, keepdims=True), 1e-9)
    return ent, rel


def train_rotation(pdf: pd.DataFrame | np.ndarray, dim: int = 8, epochs: int = 20, rate: float = 0.05, margin: float = 6.0, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Complex entity vectors and relation phases of a rotation model, as train_translation but without scaling."""
    rng, x = np.random.default_rng(seed), _triples(pdf)
    n, m = int(x[:, [0, 2]].max()) + 1, int(x[:, 1].max()) + 1
    ent, phase = rng.normal(0, 0.5, (n, dim)) + 1j * rng.normal(0, 0.5, (n, dim)), rng.uniform(-np.pi, np.pi, (m, dim))
    flat, flat_phase = ent.reshape(-1), phase.reshape(-1)
    for _ in range(epochs):
        for ends, r in _batches(x, n, rng):
            turn = np.exp(1j * phase.T).take(r, axis=1)
            source = _columns(ent.take(ends[:2].reshape(-1), axis=0), len(r))
            g = source * turn
            g -= ent.take(ends[2:].reshape(-1), axis=0).reshape(2, len(r), dim).transpose(0, 2, 1)
            squares = np.abs(g)
            squares *= squares
            length = np.sqrt(_sums(squares, 1) + 1e-12)
            length[:, ~(margin + length[0] - length[1] > 0)] = np.inf  # no step
            numbers = g.view(float)
            numbers *= np.repeat(1 / length, 2, axis=1)[:, None]
            numbers *= rate
            np.negative(g[1], out=g[1])
            back, at, of = g * np.conj(turn), _places(ends, dim), _places(r[None], dim)[0]
            for i in (0, 1):
                w = source[0] if i == 0 else _columns(ent.take(ends[1], axis=0), len(r))[0]  # the true triples have moved it
                np.subtract.at(flat, at[i], back[i].reshape(-1))
                np.add.at(flat, at[2 + i], g[i].reshape(-1))
                w *= 1j
                w *= turn
                w *= np.conj(g[i])
                np.subtract.at(flat_phase, of, w.real.reshape(-1))
    return ent, phase


def fit_resumable(pdf: pd.DataFrame, path: str, epochs: int = 30, every: int = 10, **options) -> tuple[np.ndarray, np.ndarray]:
    """As train_translation, kept at path (.npz) after every so many epochs and taken up from there; vectors of another shape are refused.

    The file is written beside its name and moved there, so that a reader never sees half of it."""
    import os

    done, start = 0, None
    if os.path.exists(path):
        with np.load(path) as kept:
            done, start = int(kept["epoch"]), (kept["ent"], kept["rel"])
    while True:
        upto = min(epochs, done + every)
        start = train_translation(pdf, epochs=upto, start=start, first=done, **options)
        done = max(done, upto)
        with open(f"{path}.part", "wb") as f:
            np.savez(f, epoch=done, ent=start[0], rel=start[1])
        os.replace(f"{path}.part", path)
        if done >= epochs:
            return start


MODELS = {"translation": train_translation, "rotation": train_rotation}


def _numbered_parts(h: np.ndarray, r: np.ndarray, t: np.ndarray, inverse: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, relations, triples) of numbered triples in order. inverse: each stands for (t, r + inverse, h) as well; no r may be one of these."""
    names, kinds = np.unique(np.concatenate([np.unique(h), np.unique(t)])), np.unique(r)
    x = np.empty((len(h) * (1 if inverse is None else 2), 3), dtype=np.int32 if len(names) < 2**31 else np.int64)
    x[: len(h), 0], x[: len(h), 2] = np.searchsorted(names, h), np.searchsorted(names, t)
    if inverse is None:
        x[:, 1] = np.searchsorted(kinds, r)
    else:
        kinds, given = np.concatenate([kinds, kinds + inverse]), kinds
        if len(np.unique(kinds)) < len(kinds):
            raise ValueError(f"relations {given} and those plus {inverse} overlap")
        ranked = np.argsort(kinds)
        place, kinds = np.argsort(ranked), kinds[ranked]
        of = np.searchsorted(given, r)
        x[: len(h), 1], x[len(h) :, 1] = place[of], place[of + len(given)]
        x[len(h) :, 0], x[len(h) :, 2] = x[: len(h), 2], x[: len(h), 0]
    n, m = len(names), len(kinds)
    if n * n * m < 2**63:  # one sort in place
        key = x[:, 0].astype(np.int64)
        for factor, c in ((m, 1), (n, 2)):
            key *= factor
            key += x[:, c]
        key.sort()
        for factor, c in ((n, 2), (m, 1)):
            x[:, c] = key % factor
            key //= factor
        x[:, 0] = key
    else:
        x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
    return names, kinds, x


def _narrow(a: np.ndarray) -> np.ndarray:
    """A copy of integers, in half the bytes where they fit."""
    return a.astype(np.int32 if not len(a) or -(2**31) <= a.min() and a.max() < 2**31 else np.int64)


#: Pairs that score_reruns scores at a time.
SCORED = 100_000


def score_reruns(triples: DataFrame, pairs: DataFrame, options: dict[str, dict] | None = None, seeds: tuple[int, ...] = (42, 1042, 2042), inverse: int | None = None) -> DataFrame:
    """(rerun, model, strategy, u, v, label, score): a model fitted to the triples of every rerun, and its scores of the rerun's pairs.

    triples: (rerun, h, r, t); with inverse, each stands for (t, r + inverse, h) as well. pairs: (rerun, strategy, u, v, label, r,
    r_inv), r and r_inv the relation to score by and its inverse, of which the better score counts; the ends are not swapped
    for the inverse. Each fit of a rerun and model has a task of its own (as many reruns as seeds), which takes its rows as they come and
    holds that rerun's triples in 12 bytes each where numbers are below 2^31; an end without vector scores least of all."""
    options = options or {m: {} for m in MODELS}
    models, long = list(options), [F.col(c).cast("bigint").alias(c) for c in ("u", "v", "r")]
    fits = F.explode(F.array(*[F.lit(i) for i in range(len(models))])).alias("model")
    left = triples.select("rerun", fits, F.col("h").alias("u"), F.col("t").alias("v"), "r").select("rerun", "model", *long, F.lit(None).cast("struct<strategy: string, label: int, r_inv: bigint>").alias("pair"))
    right = pairs.select("*", fits).select("rerun", "model", *long, F.struct("strategy", F.col("label").cast("int").alias("label"), F.col("r_inv").cast("bigint").alias("r_inv")).alias("pair"))
    own = F.pmod(F.col("rerun") * len(models) + F.col("model"), F.lit(len(seeds) * len(models))).cast("int")
    columns = ["rerun", "model", "strategy", "u", "v", "label", "score"]

    def score(rerun: int, model: str, t: list[list[np.ndarray]], p: pa.Table):
        h, tail, r = (np.concatenate([part.pop(0) for part in t]) for _ in range(3))
        names, kinds, x = _numbered_parts(h, r, tail, inverse)
        del h, tail, r
        ent, rel = MODELS[model](x, seed=seeds[rerun % len(seeds)], **options[model])
        place = lambda values, known: np.clip(np.searchsorted(known, values), 0, len(known) - 1)
        for b in p.to_batches(max_chunksize=SCORED):
            one = {c: b[c].to_numpy() for c in ("u", "v", "r")} | {"r_inv": b["pair"].field("r_inv").to_numpy()}
            hu, hv, best = place(one["u"], names), place(one["v"], names), np.full(b.num_rows, -np.inf)
            for c in ("r", "r_inv"):
                r = place(one[c], kinds)
                d = ent[hu] + rel[r] - ent[hv] if model == "translation" else ent[hu] * np.exp(1j * rel[r]) - ent[hv]
                s = -np.sqrt((np.abs(d) ** 2).sum(1) + (1e-12 if model == "rotation" else 0.0))
                best = np.where(kinds[r] == one[c], np.maximum(best, s), best)
            known = (names[hu] == one["u"]) & (names[hv] == one["v"]) & np.isfinite(best)
            fixed = pa.array([rerun] * b.num_rows, pa.int32()), pa.array([model] * b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*fixed, b["pair"].field("strategy"), b["u"], b["v"], b["pair"].field("label"), pa.array(np.where(known, best, -1e9))], columns)

    def run(batches):
        found: dict[tuple[int, int], tuple[list, list]] = {}
        for batch in batches:
            ids = np.unique(np.stack([batch["rerun"].to_numpy(), batch["model"].to_numpy()], axis=1), axis=0)
            for rerun, model in ids.tolist():
                b = batch if len(ids) == 1 else batch.filter(pc.and_(pc.equal(batch["rerun"], rerun), pc.equal(batch["model"], model)))
                t, p = found.setdefault((rerun, model), ([], []))
                is_pair = b["pair"].is_valid()
                if pc.any(is_pair).as_py():
                    p.append(b.filter(is_pair))
                    b = b.filter(pc.invert(is_pair))
                if b.num_rows:
                    t.append([_narrow(b[c].to_numpy()) for c in ("u", "v", "r")])
        for rerun, model in list(found):
            t, p = found.pop((rerun, model))
            if t and p:
                yield from score(rerun, models[model], t, pa.Table.from_batches(p))

    rows = left.unionByName(right).repartitionById(len(seeds) * len(models), own)
    return rows.mapInArrow(run, "rerun int, model string, strategy string, u bigint, v bigint, label int, score double")


def embed_graphs(triples: DataFrame, model: str = "translation", **options) -> DataFrame:
    """(kg, idx, vec) of entity vectors, one model fitted for each graph (h, r, t as any integers).

    One graph is fitted in one task, which holds its triples: this is for graphs that fit there; graphs run side by side."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, _, x = _numbered_parts(*(pdf[c].to_numpy() for c in "hrt"))
        ent, _ = MODELS[model](x, **options)
        vec = ent if model == "translation" else np.concatenate([ent.real, ent.imag], axis=1)
        return pd.DataFrame({"kg": pdf["kg"].iloc[0], "idx": names, "vec": [v.astype("float32").tolist() for v in vec]})

    return triples.select("kg", "h", "r", "t").groupBy("kg").applyInPandas(fit, "kg string, idx bigint, vec array<float>")
