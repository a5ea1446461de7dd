import random

from lattiq.llm.leaks import Unit, find_leaks, words_of

TEMPLATES = ["the assay for {g} lowered the attack rate of {d} disease by {n} percent in people older than {m}.", "withdrawal of {g} made {d} anemia worse in {n} patients although only {m} samples were left.", "our cohort treated with {g} delayed the onset of {d} ataxia by {n} months before visit {m}."]


def corpus(seed=4, docs=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    names = [word() for _ in range(20_000)]
    sentence = lambda: rng.choice(TEMPLATES).format(g=rng.choice(names), d=rng.choice(names), n=f"{rng.randrange(10, 999)}.{rng.randrange(10, 99)}", m=rng.randrange(10, 99))
    items = [(i, " ".join(sentence() for _ in range(3))) for i in range(30)]
    return rng, items, [(i, " ".join(sentence() for _ in range(5))) for i in range(docs)], names


def test_words():
    assert words_of("A *bold* Wo-\nrd, 43.21 mg; x_y") == ["a", "bold", "word", "43.21", "mg", "x", "y"]


def test_search_equals_plain_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = [rng.choice("abc") for _ in range(rng.randrange(1, 9))], [rng.choice("abc") for _ in range(rng.randrange(0, 15))]
        row = list(range(len(p) + 1))
        best = row[-1]
        for w in t:
            new = [0]
            for i, x in enumerate(p, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != w)))
            row, best = new, min(best, new[-1])
        assert Unit(p, set()).search(t)[0] == best


def test_leaks(spark, rows):
    rng, items, docs, names = corpus(docs=4500)  # an item leaks into fewer than RARE_PAIR_SHARE of them
    planted = set()

    def plant(text, item):
        docs.append((len(docs), text))
        planted.add((len(docs) - 1, item))

    for k in range(10):
        item = items[k][1]
        plant(item, k)  # whole
        plant("  " + item.upper().replace(" ", "\n") + docs[k][1], k)  # other writing
        words = item.split()
        for at in rng.sample([i for i in range(len(words)) if words[i].islower() and len(words[i]) < 8], 4):
            words[at] = "other"
        plant(docs[k][1] + " " + " ".join(words), k)  # changed words
        s = [x for x in item.split(".  ")]
        plant(docs[k][1] + " " + " ".join(item.split()[5:29]) + " " + docs[k + 1][1], k)  # an excerpt
    near = items[20][1]
    for n in set(near.split()) & set(names):
        near = near.replace(n, rng.choice(names))
    docs.append((len(docs), near))  # other names
    docs.append((len(docs), " ".join(items[21][1].split()[:7])))  # a few words
    df = spark.createDataFrame(docs + [(9000, None), (9001, ""), (9002, "x " * 100_000)], "doc_id long, text string")
    q = spark.createDataFrame(items + [(90, None), (91, ""), (92, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, q).collect()}
    assert got == planted
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, q, items_a_block=15).collect()} >= {p for p in planted}
    assert rows(find_leaks(df.limit(0), q)) == [] == rows(find_leaks(df, q.limit(0)))


def test_item_in_a_third_of_the_corpus(spark):
    _, items, docs, _ = corpus(seed=6, docs=300)
    df = spark.createDataFrame(docs + [(1000 + i, items[0][1]) for i in range(150)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1000 + i, 0) for i in range(150)}


def test_excerpt_in_a_third_of_the_corpus(spark):
    """The other words of the item stay rare, so that the item as a whole has enough of them."""
    rng, items, docs, _ = corpus(seed=8, docs=300)
    part = " ".join(items[0][1].split()[:24])
    spread = [(1000 + i, part + " " + docs[i][1]) for i in range(150)]
    whole = [(2000, docs[200][1] + " " + items[0][1])]
    df = spark.createDataFrame(docs + spread + whole, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, 0) for d, _ in spread + whole}
