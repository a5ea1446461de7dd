import itertools
import math
import random

import lattiq.llm.nearby as nearby
from lattiq.llm.strings import _plain


def test_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = []
    for _ in range(300):
        text = [rng.choice("ab") if rng.random() < 0.7 else rng.choice("cde") for _ in range(rng.randint(1, 16))]
        texts.append("".join(text))
        for _ in range(rng.randint(1, 2)):
            i, how = rng.randrange(len(text) + 1), rng.random()
            if how < 0.4 and i < len(text):
                text[i] = rng.choice("abc")
            elif how < 0.7:
                text.insert(i, rng.choice("abc"))
            elif i < len(text):
                del text[i]
        texts.append("".join(text))
    rows = sorted({("x", rng.choice("pq"), t) for t in texts if t} | {("x", "p", "ab1"), ("x", "q", "ab1"), ("x", "q", "ab2"), ("y", "q", "ab1")})
    want = set()
    for (k, s, t), (j, u, v) in itertools.product(rows, rows):
        if k == j and s < u:
            edits = _plain(t, v)
            digits = any(c.isdigit() for c in t + v)
            if t == v if digits else edits <= min(2, math.floor(min(len(t), len(v)) / 3.5)):
                want.add((k, s, t, u, v, edits))
    df = spark.createDataFrame([*rows, ("x", "p", None), ("x", "q", "")], "block string, side string, text string")
    for most in (250_000, 2):  # without and with refined segments
        monkeypatch.setattr(nearby, "MOST_SHARING", most)
        assert {tuple(r) for r in nearby.near_pairs(df).collect()} == want
    assert nearby.near_pairs(df.limit(0)).count() == 0
