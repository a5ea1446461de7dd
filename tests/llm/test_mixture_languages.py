import random

import numpy as np
import pytest

from lattiq.llm.languages import Machines, fit, fit_on_sample, language_segments, likeliest_path, sentences_of
from lattiq.llm.mixture import mix_sources, plan_shares, token_counts

TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, data, targets, **options):
    sizes = spark.createDataFrame(data, "doc_id long, source string, n_tokens long")
    mix, shares = mix_sources(sizes, spark.createDataFrame(targets, TARGETS), **options)
    return [r.asDict() for r in mix.collect()], {r.source: r.asDict() for r in shares.collect()}


def test_shares_and_caps_hold(spark):
    rng = random.Random(3)
    data = [(i, s, rng.randint(20, 400)) for i, s in enumerate(rng.choices(["a", "b", "c"], [70, 25, 5], k=3000))]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 6)]
    mix, shares = mixed(spark, data, targets)
    whole = sum(r["n_tokens"] * r["copies"] for r in mix)
    totals = {s: sum(n for _, x, n in data if x == s) for s in "abc"}
    assert whole == pytest.approx(min(m * totals[s] / w for s, w, m in targets), rel=0.005)
    for s, w, m in targets:
        mine = [r for r in mix if r["source"] == s]
        assert shares[s]["reached_share"] == pytest.approx(w, abs=400 / whole + 1e-6)
        assert max(r["copies"] for r in mine) == shares[s]["most_copies"] <= m
        assert sum(r["n_tokens"] * r["copies"] for r in mine) == shares[s]["n_tokens"]
    assert len({r["doc_id"] for r in mix}) == len(mix)


def test_inclusion_grows_with_size(spark):
    data = [(i, "a", 10 if i % 2 else 100) for i in range(2000)] + [(5000, "b", 20_000)]
    mix, _ = mixed(spark, data, [("a", 0.5, 1), ("b", 0.5, 1)])
    taken = [r["n_tokens"] for r in mix if r["source"] == "a"]
    assert taken.count(100) > 3 * taken.count(10) > 0


def test_certain_documents_are_taken_without_ties(spark):
    """Documents larger than their share would let them be are as good as certain, and may not all fall at once."""
    data = [(i, "a", 1000) for i in range(40)] + [(100 + i, "a", 1) for i in range(4000)] + [(9000, "b", 20_000)]
    mix, shares = mixed(spark, data, [("a", 0.5, 1), ("b", 0.5, 1)])
    got = sum(r["n_tokens"] for r in mix if r["source"] == "a")
    assert abs(got - 20_000) <= 1000 and shares["a"]["most_copies"] == 1


def test_odd_inputs(spark):
    data = [(1, None, 5), (2, "x", 9), (3, "a", 0), (4, "a", 7), (4, "a", 7), (5, "huge", 10**9)]
    mix, shares = mixed(spark, data, [("a", 0.5, 2), ("empty", 0.5, 2), ("none", None, None)])
    assert sorted(r["doc_id"] for r in mix) == [4, 4] and shares["empty"]["n_tokens"] == 0 and shares["a"]["reached_share"] == 1.0
    mix, shares = mixed(spark, [], [("a", 1.0, 1)])
    assert mix == [] and shares["a"]["reached_share"] == 0.0
    assert plan_shares({"a": 10}, []) == {}


def test_tokens(spark, rows):
    df = spark.createDataFrame([(1, "s", "two words"), (2, None, ""), (3, "s", None), (4, "s", "a " * 50_000)], "doc_id long, source string, text string")
    got = {r[0]: r[2] for r in rows(token_counts(df, "/opt/tokenizers/byte_bpe_50k.tiktoken"))}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 40_000


WORDS = {
    "en": "the of and to in that was with for which patients although because treatment".split(),
    "de": "der die und das nicht mit von wurde bei einer obwohl weil behandlung kranken".split(),
    "nl": "het een van niet met werd bij omdat hoewel de zieken behandeling door voor".split(),
    "fr": "le la les des une est dans avec pour que malades parce traitement chez".split(),
    "es": "el los las una en con por que del enfermos porque tratamiento aunque fue".split(),
    "pt": "o os as uma em com por que da doentes porque tratamento embora foi".split(),
    "it": "il gli le una nel con per che della malati perché trattamento sebbene è".split(),
    "pl": "nie w na z do że jest był przez chorych ponieważ leczenie chociaż po".split(),
}


def sentence(rng, lang, n=14):
    names = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(3)]
    return " ".join(rng.choice(WORDS[lang] * 2 + names) for _ in range(n)).capitalize() + "."


def text(rng, *langs):
    return " ".join(sentence(rng, x) for x in langs)


@pytest.fixture(scope="module")
def machines():
    rng = random.Random(8)
    data = [(s, x if rng.random() < 0.94 else rng.choice(list(WORDS))) for x in WORDS for _ in range(120) for s in sentences_of(text(rng, x))]
    return fit([s for s, _ in data], [x for _, x in data])


def test_held_out_accuracy(machines):
    rng = random.Random(9)
    data = [(s, x) for x in WORDS for _ in range(40) for s in sentences_of(text(rng, x))]
    best = machines.predict(machines.scores([s for s, _ in data]))
    assert np.mean([machines.languages[b] == x for b, (_, x) in zip(best, data)]) > 0.97


def test_path_ignores_a_short_stranger():
    logp = np.log(np.array([[0.9, 0.1], [0.2, 0.8], [0.9, 0.1]]))
    assert likeliest_path(logp) == [0, 0, 0]
    assert likeliest_path(np.maximum(np.log(np.array([[1, 0], [1e-9, 1], [1e-9, 1]]) + 1e-12), -30)) == [0, 1, 1]


def test_family_comes_first():
    """A large margin within a losing family decides nothing."""
    from lattiq.llm.languages import BUCKETS, FAMILIES

    m = Machines(FAMILIES, np.zeros((BUCKETS, 12), np.float32))
    pairs = np.zeros((1, len(m.pairs)), np.float32)
    for i, (a, b) in enumerate(m.pairs):
        pairs[0, i] = 1.0 if a == "fr" else -1.0 if b == "fr" else 0.0
    scores = (np.array([[0.2, -0.1, -1.0]], np.float32), pairs @ m.votes)
    assert m.languages[m.predict(scores)[0]] in FAMILIES["germanic"]
    families, within = m.log_probabilities(scores, np.array([20.0]))
    assert m.languages[m.path(families, within)[0]] in FAMILIES["germanic"]
    total = sum(np.exp(families[0, f] + within[0, members]).sum() for f, members in enumerate(m.members))
    assert abs(total - 1) < 1e-6 and within[0, m.languages.index("pl")] == 0


def test_segments(spark, machines):
    rng = random.Random(10)
    docs = [(1, text(rng, "de", "de", "de"), "de"), (2, text(rng, "en", "en", "fr", "fr", "en"), "en"), (3, text(rng, "pt", "pt").upper().replace(" ", "  "), None), (4, None, "en"), (5, "", "en"), (6, "12 34!", ""), (7, text(rng, *["nl"] * 300), "und"), (7, text(rng, "pl", "pl"), "xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.seg_no, r.lang) for r in language_segments(df, machines).collect())
    assert got == [(1, 1, "de"), (2, 1, "en"), (2, 2, "fr"), (2, 3, "en"), (3, 1, "pt"), (7, 1, "nl"), (7, 1, "pl")]
    assert all(0 < r.confidence <= 1 for r in language_segments(df, machines).collect())
    assert language_segments(df.limit(0), machines).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "some words here", None)], "doc_id long, text string, lang string")
    assert isinstance(fit_on_sample(df), Machines) and language_segments(df).count() == 1
