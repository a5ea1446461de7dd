import pytest
from hypothesis import given
from hypothesis import strategies as st

from lattiq.operators.packed import explode_packed, split_packed

CASES = [
    (None, []),
    ("", []),
    ("  \t ", []),
    ("[]", []),
    ("{}", []),
    ('[""]', []),
    ("A:1", ["A:1"]),
    ("A:1,B:2;C:3|D:4||E:5\tF:6\nG:7 H:8", ["A:1", "B:2", "C:3", "D:4", "E:5", "F:6", "G:7", "H:8"]),
    ('["A:1", "S:x, y"]', ["A:1", "S:x, y"]),
    ("['S:5\\'-x', 'S:so-called \"x\"']", ["S:5'-x", 'S:so-called "x"']),
    ('"S:so-called ""x""", A:1', ['S:so-called "x"', "A:1"]),
    ('["S:so-called \\"x\\""]', ['S:so-called "x"']),
    ("{A:1; \"S:1,5-x\"; B:2}", ["A:1", "S:1,5-x", "B:2"]),
    (", A:1, , A:1,", ["A:1", "A:1"]),
    ("a(b,c),d", ["a(b,c)", "d"]),
    ("a(b,c", ["a(b", "c"]),
    ('"never closed, x', ['"never', "closed", "x"]),
    ("'it's', x", ["it's", "x"]),
    ('" A:1 "|B:2', ["A:1", "B:2"]),
    ("A:1\xa0B:2", ["A:1", "B:2"]),
]


@pytest.mark.parametrize("text, values", CASES)
def test_split(text, values):
    assert split_packed(text) == values


value = st.text(st.characters(codec="utf-8", exclude_characters="\x00"), min_size=1, max_size=12).map(str.strip).filter(bool)


@given(st.lists(value, max_size=6))
def test_round_trip_of_json(values):
    import json

    assert split_packed(json.dumps(values)) == values


@given(st.text(max_size=40))
def test_any_text_is_split_without_loss_of_letters(text):
    out = "".join(split_packed(text))
    assert all(not c.isalpha() or c in out or "\\" in text for c in text)


def test_explode(spark, rows):
    df = spark.createDataFrame([(1, "A:1,B:2", "p"), (2, None, "q"), (3, "C:3 C:3", None), (4, "x" * 100_000 + ",y", None)], "row_id long, f string, other string")
    out = explode_packed(df, "f")
    assert out.columns == ["row_id", "f", "other", "pos", "value"]
    assert [(r.row_id, r.pos, r.value[:3]) for r in out.orderBy("row_id", "pos").collect()] == [(1, 1, "A:1"), (1, 2, "B:2"), (3, 1, "C:3"), (3, 2, "C:3"), (4, 1, "xxx"), (4, 2, "y")]
    assert explode_packed(df.limit(0), "f").count() == 0
    with pytest.raises(ValueError):
        explode_packed(df.withColumnRenamed("other", "pos"), "f")


def test_time_is_linear_where_nothing_closes():
    import time

    from lattiq.operators.packed import split_packed

    for text in ("(a, " * 60_000, "'a, " * 60_000, '"b(c ' * 60_000):
        began = time.time()
        assert len(split_packed(text)) >= 60_000
        assert time.time() - began < 5
