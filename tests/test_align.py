"""Sentence assignment: windows against the uncut run, pieces of a sentence, and its cases without data."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.operators import align, timeline

WORDS = "the a dog cat house river ran slept under over old green door stone never always".split()


def sentences(rnd, n):
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 9))) + "." for _ in range(n)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=5), st.text("abc", min_size=1, max_size=8))
def test_best_place_is_the_best_part(piece, text):
    begin, end, like = align.best_place(piece, text)
    part = text[begin:end]
    least = min(edits(piece, text[i:j]) for j in [end] for i in range(j + 1))
    assert abs(like - (1 - edits(piece, part) / max(len(piece), len(part), 1))) < 1e-9 and edits(piece, part) == least


def test_pieces_of_a_sentence():
    left = ["he went home", "and slept well there", "nothing"]
    assert [x[:2] + x[3:] for x in align.placed(left, ["he went home and slept well there", "other words at all"])][:2] == [(0, 0, 0, 12), (1, 0, 13, 33)]
    assert align.placed([], ["a"]) == align.placed(["a"], []) == []
    assert align.placed(["a"], ["a"]) == [(0, 0, 1.0, 0, 1)]


def test_windows_lose_no_pair(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(3):
        a = sentences(rnd, 40)
        b = [s for s in a if rnd.random() > 0.1]  # some are left out
        b = [" ".join(w if rnd.random() > 0.15 else "x" for w in s.split()) if rnd.random() < 0.7 else s for s in b]
        rows += [(k, i, s, None) for i, s in enumerate(a)] + [(k, i, None, s) for i, s in enumerate(b)]
    rows += [(9, 0, None, None), (None, 0, "a b c.", "a b c.")]
    df = spark.createDataFrame(rows, "k int, o long, a string, b string")
    side = lambda c: df.select("k", "o", df[c].alias("t"))
    whole = {tuple(r)[:3] for r in align.assign_sentences(side("a"), side("b"), "k", "o", "t").collect() if r.likeness > 0.6}
    cut = {tuple(r)[:3] for r in align.assign_sentences(side("a"), side("b"), "k", "o", "t", most=8).collect() if r.likeness > 0.6}
    assert len(whole) > 80 and len(whole & cut) >= 0.97 * len(whole)
    assert align.assign_sentences(side("a").limit(0), side("b"), "k", "o", "t").count() == 0


def test_lengths_of_paths(spark):
    df = spark.createDataFrame([([0, 0, 2, 2], 3), ([0, 0], 3), (None, 1), ([0, 3, 3, 3, 3], 4)], "p array<int>, n int")
    assert [r[0] for r in df.select(timeline.unit_lengths("p", "n")).collect()] == [[1, 1, 2], None, None, [1, 1, 1, 2]]
