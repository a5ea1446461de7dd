import random

import numpy as np

from lattiq.llm import entities, nearby
from lattiq.llm.entities import match_entities

SCHEMA = "node_key long, kg string, idx long, id string, type string, name string, synonym string, upstream_pipeline string, extra string"
CLASSES = ["kinase", "ligase", "receptor", "channel"]


def build(seed=1, n=150):
    rng = random.Random(seed)
    stems = sorted({"".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(6)) for _ in range(3 * n)})
    rng.shuffle(stems)
    nodes, truth, key = [], {}, 0

    def add(kg, id_, type_, name, synonym, thing):
        nonlocal key
        key += 1
        nodes.append((key, kg, key, id_, type_, name, synonym, None, "x"))
        truth.setdefault(thing, []).append((key, kg))

    for i, s in enumerate(stems[:n]):
        c = CLASSES[i % 4]
        add("alder", f"4{i:07}", "gene/protein", f"{s} {c}", None, s)
        if i % 2:
            at = rng.randrange(4, 9)
            add("birch", f"Gene::G{i}", "Gene", [f"{s} {c}", f"{c}, {s}", f"human {s.upper()} {c[:4]}.", f"{s[:at]}{s[at]}{s[at:]} {c}"][i // 2 % 4], None, s)
        if i % 3 == 0:
            add("cedar", f"GN:{s}-{c}" if i % 2 else f"GN:{i}9", "biolink:Gene" if i % 5 else None, None if i % 2 else f"GN {i}", f"{s} {c}" if not i % 2 else None, s)
        if i % 30 == 0:
            add("alder", f"4{i:07}", "gene/protein", f"{s} {c}", None, s)
    for i, s in enumerate(stems[n : n + 40]):
        add("birch", f"Gene::G9{i}", "Gene", f"{s} kinase", None, "b" + s)
    s = stems[1]
    add("birch", "Compound::C1", "Compound", s, None, "drug with the name of a gene")
    add("birch", None, None, None, None, "nothing known")
    add("cedar", "GN:77", "biolink:Gene", "", "z" * 30_000, "long name")
    pairs = {(min(a, b), max(a, b)) for v in truth.values() for a, ga in v for b, gb in v if ga < gb}
    return nodes, pairs


def test_matches(spark, rows):
    nodes, pairs = build()
    df = spark.createDataFrame(nodes, SCHEMA)
    found = match_entities(df).collect()
    got = {(r.node_key_a, r.node_key_b) for r in found}
    assert len(got) == len(found) and all(0.5 <= r.confidence <= 1 for r in found)
    assert len(got & pairs) >= 0.97 * len(pairs) and len(got & pairs) >= 0.97 * len(got)
    assert rows(match_entities(df.limit(0))) == []


def test_frequent_grams_lose_no_pair(spark, rows, monkeypatch):
    """Blocking gives all pairs of stems within the budget, however many stems share a segment."""
    rng = random.Random(5)
    stems = sorted({"".join(rng.choice("bdfgk") + rng.choice("ae") for _ in range(rng.choice((2, 3)))) + "".join(rng.choice(x) for x in ("l", "i", "z", "u", "mn", "a", "b")) for _ in range(60)})
    stems += [s[:-1] for s in stems[:20]] + [s[:-6] + "o" + s[-6:] for s in stems[20:40]]
    df = spark.createDataFrame([(rng.choice("ab"), "gene", s) for s in sorted(set(stems))], "side string, block string, text string")
    found = []
    for frequent in (10**9, 3):
        monkeypatch.setattr(nearby, "MOST_SHARING", frequent)
        found.append(rows(nearby.near_pairs(df)))
    assert len(found[0]) > 30 and found[0] == found[1]


def test_kinds_are_learned(spark):
    data = [(f"g{g}", f"{g}-{k}", f"{k}stem{i:03}"[: 5 + i % 3] + f"{i:03}x", 0) for g in "abc" for k in ("gene", "drug") for i in range(20 if g != "c" or k == "gene" else 5)]
    kinds = {r.shape: r.kind for r in entities.learned_kinds(spark.createDataFrame(data + [("gc", "c-odd", "nothingshared", 0)], "kg string, shape string, stem string, number long")).collect()}
    assert kinds["a-gene"] == kinds["b-gene"] == kinds["c-gene"] != kinds["a-drug"] == kinds["b-drug"] == kinds["c-drug"]
    assert kinds["c-odd"] == "c-odd"


def test_transitivity_is_enforced_until_it_holds(spark):
    posterior = np.zeros(len(entities._CELLS))
    posterior[:4] = [0.99, 0.9, 0.1, 0.001]  # sure, likely, doubtful, none
    pair = lambda a, b: {"a": a, "b": b}
    data = [
        (pair(1, 2), pair(2, 3), pair(1, 3), 0, 0, 2, True),  # a doubtful third side is raised
        (pair(1, 3), pair(3, 4), pair(1, 4), 2, 0, 2, True),  # which breaks the next triangle
        (pair(5, 6), pair(6, 7), pair(5, 7), 0, 1, 3, True),  # a third side that is none lowers the weaker
        (pair(8, 9), pair(9, 10), pair(8, 10), 0, 0, 3, False),  # nothing speaks against a side that was never compared
    ]
    side = "struct<a: long, b: long>"
    df = spark.createDataFrame(data, f"e1 {side}, e2 {side}, e3 {side}, c1 int, c2 int, c3 int, known boolean")
    got = {(r.e.a, r.e.b): r.p for r in entities._corrected(df, posterior).collect()}
    assert abs(got[1, 3] - 0.9801) < 1e-9 and abs(got[1, 4] - 0.9801 * 0.99) < 1e-9
    assert got[6, 7] < 0.01 and (5, 6) not in got and abs(got[8, 10] - 0.9801) < 1e-9
