import random

import pyarrow as pa
import pytest

from sheaf.llm import leakage as L


def words(rnd, n, pool):
    return [rnd.choice(pool) for _ in range(n)]


def test_planted_passages(spark):
    rnd = random.Random(7)
    pool = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    items = [(i, "Read aloud.\n" + " ".join(words(rnd, rnd.randint(30, 120), pool))) for i in range(40)]
    items += [(900, None), (901, ""), (902, "two words"), (903, items[3][1])]
    docs, want = [], set()
    for k in range(300):
        body = words(rnd, rnd.choice([5, 60, 400, 2000]), pool)
        kind = k % 6
        i = k % 40
        p = items[i][1].split("\n")[1].split()
        cut = rnd.randrange(len(body))
        if kind == 0:  # whole, in other spelling
            body[cut:cut] = [w.upper() + "," for w in p]
        elif kind == 1:  # half of it
            body[cut:cut] = p[: int(len(p) * 0.55)]
        elif kind == 2:  # whole with every ninth word changed
            body[cut:cut] = [w if j % 9 else "other" for j, w in enumerate(p)]
        elif kind == 3:  # too little
            body[cut:cut] = p[: int(len(p) * 0.25)]
        elif kind == 4:  # the same words in another order
            body[cut:cut] = rnd.sample(p, len(p))
        if kind in (0, 1, 2):
            want.add((k, i))
            if i == 3:
                want.add((k, 903))
        docs.append((k, "Read aloud. " + " ".join(body), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, "w " * 200_000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in L.leaked(d, q).collect()}
    assert got == want
    assert L.leaked(d.limit(0), q).count() == 0 and L.leaked(d.limit(5), q.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rnd = random.Random(8)
    pool = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(200)]
    items = [(i, " ".join(words(rnd, 50, pool))) for i in range(9)]
    docs = [(k, " ".join(words(rnd, 100, pool)) + " " + items[k][1]) for k in range(9)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(L, "BLOCK", 4)
    assert {tuple(r) for r in L.leaked(d, q).collect()} == {(k, k) for k in range(9)}


def planted(rnd, pool, n, change, docs=60):
    """Items of n words, and documents of 1,000 words that hold them with some words changed."""
    items = [words(rnd, n, pool) for _ in range(docs)]
    texts = []
    for item in items:
        body, at = words(rnd, 1000, pool), rnd.randrange(1000)
        body[at:at] = [rnd.choice(pool) if change(j) else w for j, w in enumerate(item)]
        texts.append(" ".join(body))
    return L.Items(list(range(docs)), [" ".join(x) for x in items]), pa.array(texts)


@pytest.mark.parametrize("exact", [False, True])
def test_scattered_changes(exact):
    rnd = random.Random(9)
    pool = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    for n, share, least in ((30, 0.25, 0.9), (60, 0.25, 0.9), (200, 0.25, 0.95)):
        items, texts = planted(rnd, pool, n, lambda j, s=share: rnd.random() < s)
        got = L.search(texts, items, exact)
        assert all(a == b for a, b in got) and len(got) >= least * 60
    for n in (30, 60, 200):  # every fifth word
        items, texts = planted(rnd, pool, n, lambda j: j % 5 == 4)
        assert L.search(texts, items, exact) == [(k, k) for k in range(60)]


def test_short_and_long_passages(spark):
    rnd = random.Random(10)
    pool = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    long = words(rnd, 40_000, pool)
    items = [(1, "solitary"), (2, "rare pair"), (3, "one two three"), (4, "one two three four"), (5, " ".join(long)), (6, None)]
    docs = [(1, "a solitary word"), (2, "a pair of rare things"), (3, "the rare pair stood"), (4, "said one two three times"), (5, " ".join(long[17_000:])), (6, "one two"), (7, None)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1), (3, 2), (4, 3), (4, 4), (5, 5)}
    assert {tuple(r) for r in L.leaked(d, q).collect()} == want == {tuple(r) for r in L.leaked(d, q, exact=True).collect()}
