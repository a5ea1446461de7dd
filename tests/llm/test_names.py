import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lattiq.llm.canonical import map_to_list
from lattiq.llm.names import Lexicon, learn_lexicon
from lattiq.llm.strings import BKTree, Strings, _plain, distances

short = st.text("abcde", max_size=9)


@settings(max_examples=60, deadline=None)
@given(st.lists(short, min_size=1, max_size=12), st.lists(short, min_size=1, max_size=12))
def test_distances_equal_the_plain_table(xs, ys):
    a = Strings(xs)
    b = Strings(ys, a.alphabet)
    ia, ib = (m.ravel() for m in np.meshgrid(np.arange(len(xs)), np.arange(len(ys))))
    assert distances(a, ia, b, ib).tolist() == [_plain(xs[i], ys[j]) for i, j in zip(ia, ib)]


def test_long_strings():
    a = Strings(["x" * 100, "x" * 64, ""])
    b = Strings(["x" * 99 + "y", "x" * 63, "abc"], a.alphabet)
    assert distances(a, np.arange(3), b, np.arange(3)).tolist() == [1, 1, 3]


@settings(max_examples=40, deadline=None)
@given(st.lists(short, min_size=1, max_size=30), st.lists(short, min_size=1, max_size=6), st.integers(0, 3))
def test_tree_returns_every_entry_within_threshold(entries, queries, threshold):
    tree = BKTree(entries)
    q, v, d = tree.within(queries, threshold)
    got = sorted((int(i), tree.nodes.texts[j], int(k)) for i, j, k in zip(q, v, d))
    assert got == sorted((i, e, _plain(x, e)) for i, x in enumerate(queries) for e in set(entries) if _plain(x, e) <= threshold)


LISTED = [f"{p} {s}{e} {c} type {n}" for p, e, c in (("chronic", "oid", "leukemia"), ("hereditary", "", "tumor"), ("congenital", "", "esophagitis")) for s in ("brabomul", "stigretav", "kuplinor", "wezodrat") for n in (1, 2)]
LEX = Lexicon(Lexicon.learn(LISTED, least=0.01).words, frozenset("hx of confirmed nos pt with".split()), (("ar", ("autosomal", "recessive")),))


def test_parse():
    p = LEX.parse("chronic brabomuloid leukemia type 2")
    assert (p.stem, set(p.words), p.number) == ("brabomuloid", {"chronic", "leukemia"}, 2)
    for way in ("CHRONIC BRÁBOMULOID LEUKEMIA TYPE II", "leuk., chronic brabomuloid t2", '"chronic/brabomuloid_leukaemia (type 2)".', "hx of chronicbrabomuloidleukemia type 2 - confirmed", "type 2 brabomuloid leukemia, NOS"):
        q = LEX.parse(way)
        assert (q.stem, q.number) == ("brabomuloid", 2) and q.words <= p.words, way
    assert LEX.parse(None) == LEX.parse("") and LEX.parse("?").stem == ""


def test_frames_are_learned(spark):
    """Words that wrap typed names, or without which names are names still, are told from stems and class words."""
    stems = ["".join(random.Random(f"{i}").choices(["ba", "ri", "lo", "mu", "ke", "to"], k=5)) for i in range(60)]
    listed = spark.createDataFrame([(f"autosomal recessive {s} ataxia",) for s in stems], "name string")
    wraps = ["suspected {}", "pt with {}", "{} nos", "{} (disorder)", "{}"]
    typed = spark.createDataFrame([(wraps[(i + j) % 5].format(f"ar {s} ataksia" if j else f"autosomal recessive {s} ataxia"),) for i, s in enumerate(stems) for j in range(5)], "name string")
    lex = learn_lexicon(listed, typed=typed)
    assert lex.words == {"autosomal", "recessive", "ataxia"} and lex.frames == {"suspected", "pt", "with", "nos", "disorder"}
    assert dict(lex.acronyms)["ar"] == ("autosomal", "recessive") and "ataksia" in lex.variants
    p = lex.parse(f"ptwith ar {stems[3]}ataksia nos")
    assert (p.stem, p.words) == (stems[3], {"autosomal", "recessive", "ataxia"})
    alone = learn_lexicon(spark.createDataFrame([(f"{w}{s} kinase",) for s in stems for w in ("", "human ")], "name string"))
    assert alone.words == {"kinase"} and alone.frames == {"human"}


def test_map(spark, rows):
    entries = spark.createDataFrame([(f"M{i:02}", n) for i, n in enumerate(LISTED)] + [("M99", None)], "entry_id string, name string")
    typed = {"chronic brabomuloid leukemia type 2": "M01", "Chronic barbomuloid leukemia II": "M01", "chronic brabomuloid leukemia type 3": "UNMATCHED", "chronic brabomuloid leukemia": "UNMATCHED",
             "stigretva tumor type 1": "M10", "n/a": "UNMATCHED", "": "UNMATCHED", "chronic pazolinoid leukemia type 1": "UNMATCHED", "z" * 10_000: "UNMATCHED"}
    names = spark.createDataFrame([(n,) for n in typed] + [(None,)], "name string")
    for shard_rows in (50_000, 5):
        assert dict(rows(map_to_list(names, entries, shard_rows=shard_rows))) == typed
    assert {r.entry_id for r in map_to_list(names, entries.limit(0)).collect()} == {"UNMATCHED"}
    assert rows(map_to_list(names.limit(0), entries)) == []


def test_accuracy_on_made_typos(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("bcdfgklmnprstvwz") + rng.choice("aeiou") for _ in range(6)) for _ in range(60)]
    listed = [f"hereditary {s} tumor type {n}" for s in stems for n in (1, 2)]
    entries = spark.createDataFrame([(str(i), n) for i, n in enumerate(listed)], "entry_id string, name string")
    typed = {}
    for i, name in enumerate(listed):
        at = rng.randrange(12, 20)
        typed[name[:at] + rng.choice(["", name[at] * 2, "q"]) + name[at + 1 :]] = str(i)
    got = {r.name: r.entry_id for r in map_to_list(spark.createDataFrame([(n,) for n in typed], "name string"), entries).collect()}
    assert sum(got[n] == i for n, i in typed.items()) >= 0.97 * len(typed)
