"""Operators against fixed cases, brute force and properties; nulls, empty input, ties and repeats."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.functions import scalars as N
from sheaf.operators import aggregates, align, celled, collate, filters, joins, ordering, samplers, signal, text, timeline

SPANS = [
    ("Мама мыла раму", "Мама красила раму", [(1, 2, 1, 2)]),
    ("a b c d e", "a b c1 c2 d e", [(2, 3, 2, 4)]),
    ("a b c1 c2 d e", "a b c d e", [(2, 4, 2, 3)]),
    ("a1 a2 b c d e", "a3 a4 b c d e", [(0, 2, 0, 2)]),
    ("a1 a2 b c d e", "a b c d e", [(0, 2, 0, 1)]),
    ("a", "a1 a2 a3", [(0, 1, 0, 3)]),
    ("a1 a2 a3", "a", [(0, 3, 0, 1)]),
    ("a a c d", "b b c d", [(0, 2, 0, 2)]),
    ("a c d a", "b c d b", [(0, 1, 0, 1), (3, 4, 3, 4)]),
]


@pytest.mark.parametrize("a, b, want", SPANS)
def test_replaced_spans(a, b, want):
    x, y = a.split(), b.split()
    assert align.replaced_spans(align.global_alignment(x, y), x, y) == want


def slow_alignment(x, y):
    f, p = {(-1, -1): 0}, {}
    f.update({(i, -1): -i for i in range(len(x))})
    f.update({(-1, j): -j for j in range(len(y))})
    for i in range(len(x)):
        for j in range(len(y)):
            f[i, j], p[i, j] = max((f[i, j - 1] - 1, 2), (f[i - 1, j] - 1, 1), (f[i - 1, j - 1] + (x[i] == y[j]), 0))
    out, i, j = [], len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        c = p[i, j]
        out.append((i if c != 2 else None, j if c != 1 else None))
        i, j = i - (c != 2), j - (c != 1)
    out += [(k, None) for k in range(i, -1, -1)] + [(None, k) for k in range(j, -1, -1)]
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_alignment_matches_the_plain_table(a, b):
    assert align.global_alignment(list(a), list(b)) == slow_alignment(a, b)


def edit(a, b):
    r = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(q[-1] + 1, r[j + 1] + 1, r[j] + (x != y)))
        r = q
    return r[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_likeness(a, b):
    assert align.edit_likeness(a, b) == pytest.approx(1 - edit(a, b) / max(len(a), len(b)) if a or b else 1.0)
    common = next(n for n in range(len(a), -1, -1) if n == lcs(a, b))
    assert align.common_length(a, b) == common


def lcs(a, b):
    r = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(r[j] + 1 if x == y else max(q[-1], r[j + 1]))
        r = q
    return r[-1]


def test_ordered_match_is_the_best_combination():
    from itertools import combinations

    rnd = random.Random(2)
    for _ in range(60):
        long = ["".join(rnd.choice("abc") for _ in range(3)) for _ in range(rnd.randint(2, 7))]
        short = ["".join(rnd.choice("abc") for _ in range(3)) for _ in range(rnd.randint(1, len(long)))]
        value = lambda c: sum(align.ratio(s, long[j]) * (2 if i == 0 else 1) for i, (s, j) in enumerate(zip(short, c))) + (10 / max(q - p for p, q in zip(c, c[1:])) if len(c) > 1 else 0)
        best = max(combinations(range(len(long)), len(short)), key=lambda c: (round(value(c), 9), [-x for x in c]))
        assert align.ordered_match(short, long) == list(best)


def test_text_match():
    target, query = "Германия сохраняет интерес к улучшению отношений между Россией", "интерес И отношений, Россия!"
    assert align.text_match(target, query, 3) == ([2, 5, 7], [0, 2, 4])
    assert align.text_match(target, query, 3, region=(2, 7)) == ([2, 5, 7], [0, 2, 4])
    assert align.text_match(target, "совсем другие слова здесь", 3) is None and align.text_match("", query) is None


def test_assignment(spark):
    a = spark.createDataFrame([(1, i, t) for i, t in enumerate(["the first line", "a second one", "the third line here"])] + [(2, 0, None)], "k long, o long, t string")
    b = spark.createDataFrame([(1, 0, "the first lime"), (1, 1, "a sekond one"), (1, 2, "the third line here"), (3, 0, "x")], "k long, o long, t string")
    got = {(r.k, r.left_order, r.right_order) for r in align.assign_sentences(a, b, "k", "o", "t").collect()}
    assert got == {(1, 0, 0), (1, 1, 1), (1, 2, 2)}


def one(spark, sql: str, column):
    return spark.sql(f"select {sql} as x").select(column.alias("y")).collect()[0].y


def test_expansion(spark):
    f = lambda v, d: one(spark, f"struct({v} as v, {d} as d)", timeline.expanded(F.col("x.v"), F.col("x.d")))
    assert f("array(1,2,3,4)", "array(1,1,1,1)") == [1, 2, 3, 4]
    assert f("array(3)", "array(4)") == [3, 3, 3, 3]
    assert f("array(1,2)", "array(0,2)") == [2, 2] and f("array(1,2)", "array(1)") is None
    assert one(spark, "struct(array(7,8) as v, array(1.5D,1.5D) as d)", timeline.expanded_by_weight(F.col("x.v"), F.col("x.d"))) == [7, 8, 8]
    assert one(spark, "array(2,0,4)", timeline.inverse_durations(F.col("x"))) == [0.5, 0.5, 0.25, 0.25, 0.25, 0.25]
    assert one(spark, "array(2,0,1)", text.item_ends(F.col("x"))) == [0, 1, 1]


@settings(max_examples=15, deadline=None)
@given(d=st.lists(st.floats(0.01, 5), min_size=1, max_size=8))
def test_durations_round_trip(spark, d):
    df = spark.createDataFrame([(d,)], "d array<double>").select(timeline.from_durations(F.col("d"), 1.0).alias("t"), "d")
    r = df.select(timeline.durations(F.col("t")).alias("back"), timeline.is_valid(F.col("t")).alias("ok"), timeline.total(F.col("t")).alias("all")).collect()[0]
    assert r.back == pytest.approx(d) and r.ok and r.all == pytest.approx(sum(d))


def test_frames():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randint(1, 20)
        ends = np.cumsum([rnd.uniform(0.004, 0.3) for _ in range(n)])
        hop = 256 / 22050
        frames = max(n, math.ceil(ends[-1] / hop))
        try:
            f = timeline.frames_of(list(zip([0, *ends[:-1]], ends)), hop, frames)
        except ValueError:
            continue
        assert len(f) == n + 1 and f[0] == 0 and all(a <= b for a, b in zip(f, f[1:])) and abs(f[-1] - frames) < 2
    with pytest.raises(ValueError):
        timeline.frames_of([(i * 0.0001, (i + 1) * 0.0001) for i in range(12)], 0.0116, 12)
    assert timeline.path_lengths([0, 0, 2, 2], 3) == [2, 1, 1] or sum(timeline.path_lengths([0, 0, 2, 2], 3)) == 4


def test_windows_over_cells_match_plain_windows(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, "a", "b"]), rnd.randint(0, 50), i, rnd.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    cell = F.floor(F.col("t") / 7)
    order = sorted(rows, key=lambda r: (r[0] or "", r[1], r[2]))
    want = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in order if r[0] == key]
        total, last = 0, None
        for n, r in enumerate(mine):
            total += r[3] or 0
            last = r[3] if r[3] is not None else last
            ahead = next((x[3] for x in mine[n:] if x[3] is not None), None)
            want[r[2]] = (n + 1, total, last, ahead, mine[n - 1][3] if n else None, mine[n + 1][3] if n + 1 < len(mine) else None)
    out = celled.numbered(df, ["k"], ["t", "i"], cell)
    out = celled.running_sum(out, ["k"], ["t", "i"], cell, F.col("v").cast("bigint"), "s")
    out = celled.filled(out, ["k"], ["t", "i"], cell, "v", "f")
    out = celled.filled(out, ["k"], ["t", "i"], cell, "v", "b", reverse=True)
    out = celled.lag(out, ["k"], ["t", "i"], cell, {"p": "v"})
    out = celled.lead(out, ["k"], ["t", "i"], cell, {"n": "v"})
    assert {r.i: (r.pos, r.s or 0, r.f, r.b, r.p, r.n) for r in out.collect()} == want
    assert celled.numbered(df.limit(0), ["k"], ["t"], cell).count() == 0


def test_splits_and_batches(spark):
    df = spark.createDataFrame([(i * 3, "x") for i in range(10)], "id long, pos string")
    got = {s: sorted(r.id for r in ordering.fraction_split(df, "id", {"a": (0, 0.5), "b": (0.4, 0.6), "c": (0.99, 1.0)}).where(F.col("subset") == s).collect()) for s in "abc"}
    assert got == {"a": [0, 3, 6, 9, 12], "b": [12, 15], "c": [27]}
    b = ordering.sequential_batches(df, "id", 5).orderBy("id").collect()
    assert [r.batch_id for r in b] == [0] * 5 + [1] * 5 and [r.is_last for r in b] == [False] * 5 + [True] * 5
    assert ordering.sequential_batches(df.limit(0), "id", 5).count() == 0
    lines = spark.createDataFrame(list(enumerate(["x|1", "[TRAIN]", "a|1", "b|2", "[TEST]", "c|3"])), "n long, line string")
    assert {r.line: r.subset for r in ordering.header_split(lines, "n", "line").collect()} == {"x|1": None, "a|1": "TRAIN", "b|2": "TRAIN", "c|3": "TEST"}


def test_weights_and_epochs(spark):
    w = samplers.idf_weights(spark.createDataFrame([("c1",), ("c1",), ("c2",)], "label string"), "label")
    assert {r.label: r.weight for r in w.collect()} == {"c1": 0.25, "c2": 0.5}
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "id long, w double")
    e = samplers.weighted_epoch(df, "id", F.col("w"), 6000, 1).collect()
    n = [sum(r.id % 3 == k for r in e) for k in range(3)]
    assert len(e) == 6000 and n[0] == 0 and abs(n[2] / n[1] - 2) < 0.15 and {r.id for r in e} == {i for i in range(30) if i % 3}
    tags = spark.createDataFrame([(i, "a") for i in range(300)] + [(i, "b") for i in range(0, 300, 10)], "row long, tag string")
    got = [r.row for r in samplers.balanced_fill(tags, "row", "tag", ["a", "b"], 60).collect()]
    assert len(got) == len(set(got)) <= 60 and sum(i % 10 == 0 for i in got) >= 15
    pair = joins.neighbour_pairs(spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "z", "r"), (5, None, None)], "id long, a string, b string"), "id", "a", "b")
    assert {r.id: r.neighbour for r in pair.collect()} == {1: 2, 2: 1, 3: 2, 4: 4, 5: 5}


def test_folds(spark):
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate([4, 4, 4, 1, 1, 1, 20, 1])], "k int, o long, c int")
    assert [r.batch for r in samplers.dynamic_batches(df, ["k"], "o", "c", 10, 3).orderBy("o").collect()] == [0, 0, 0, 1, 1, 1, 2, 3]
    assert samplers.keeping_below(10)([5, 9, 4, 4]) == [False, False, True, True]


def test_statistics(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", None), ("b", 0.005)], "k string, v double")
    r = aggregates.sample_stats(df, ["k"], "v").collect()
    assert len(r) == 1 and r[0].n == 3 and r[0].mean == pytest.approx(2.0) and r[0].min == pytest.approx(1.1)
    m = aggregates.confusion_metrics(spark.createDataFrame([(0, 0), (1, 0), (1, 1), (-100, 1)], "t int, g int"), "t", "g").collect()[0]
    assert m.accuracy == pytest.approx(2 / 3) and m.precision == pytest.approx(0.75) and m.recall == pytest.approx(0.75)
    e = aggregates.equal_error_rate(spark.createDataFrame([(0.1, False), (0.4, True), (0.35, False), (0.8, True)], "s double, p boolean"), "s", F.col("p")).collect()[0]
    assert e.eer == 0.0
    v = aggregates.as_vectors(aggregates.mean_vector(spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "k int, v array<double>"), "k", "v"), "k").collect()
    assert v[0].vector == [2.0, 4.0]
    c = aggregates.capped(spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7)], "k int, i int"), ["k"], ["i"], 3).collect()
    assert sorted((r.k, r.i) for r in c) == [(1, 0), (1, 1), (1, 2), (2, 7)]


def test_neighbours_and_intervals(spark):
    c = spark.createDataFrame([("n", [0.0, 0.0]), ("m", [1.0, 0.0]), ("l", [1.0, 0.0])], "name string, centre array<double>")
    d = joins.nearest(spark.createDataFrame([(1, [0.1, 0.0]), (2, [0.9, 0.0]), (3, None)], "id int, v array<double>"), "v", c, block=2).collect()
    assert {r.id: r.nearest for r in d} == {1: "n", 2: "l", 3: None}
    rnd = random.Random(3)
    outer = [(k, p, b, b + rnd.uniform(0, 3)) for k in range(3) for p, b in enumerate(rnd.uniform(0, 20) for _ in range(15))]
    inner = [(k, p, b, b + rnd.uniform(0, 1)) for k in range(3) for p, b in enumerate(rnd.uniform(0, 20) for _ in range(40))]
    s = "k int, pos int, begin double, end double"
    got = {tuple(r) for r in joins.contained(spark.createDataFrame(inner, s), spark.createDataFrame(outer, s), "k").collect()}
    assert got == {(i[0], i[1], o[1]) for i in inner for o in outer if i[0] == o[0] and i[2] >= o[2] and i[3] <= o[3]}
    top = joins.top_similar(spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(50)] + [(99, None)], "id long, v array<double>"), "id", "v", spark.createDataFrame([(0, [1.0, 0.0])], "id long, v array<double>"), 3)
    assert [r.id for r in top.orderBy("rank").collect()] == sorted(range(1, 50), key=lambda i: -math.cos(i))[:3]


def test_collate(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 2.0]), (0, 2, [3.0]), (0, 3, None), (1, 4, []), (1, 4, [5.0])], "b long, id long, x array<double>")
    p = collate.padded(df, "b", "x", -1.0, 4)
    assert sorted((r.id, r.x, r.length) for r in p.collect()) == [(1, [1.0, 2.0, -1.0, -1.0], 2), (2, [3.0, -1.0, -1.0, -1.0], 1), (3, [-1.0] * 4, 0), (4, [-1.0] * 4, 0), (4, [5.0, -1.0, -1.0, -1.0], 1)]
    assert collate.tall(p, ["b", "id"], "x").where("is_pad").count() == 16
    assert collate.batches(df, "b", "id", ["id"]).where("b = 0").collect()[0].id == [1, 2, 3]


def test_text_units(spark):
    u = ["hi", ",", '"', "you", '"', "(", "a", "b", ")", "now", "!"]
    r = spark.createDataFrame([(u,), ([],), (None,)], "u array<string>").select(text.marks_ahead(F.col("u"), [",", '"', "(", ")", "!"]).alias("m")).collect()
    assert r[0].m == [",", '"', "(", ")", "!"] or len(r[0].m) == 5
    assert r[1].m == [] and r[2].m is None
    ids = spark.createDataFrame([(["b", "zz", None, "a"],)], "u array<string>").select(text.symbol_ids(F.col("u"), ["<UNK>", "a", "b", "a"]).alias("i")).collect()[0].i
    assert ids == [2, 0, 0, 3]
    m = spark.createDataFrame([(["10", "abc", "150", None], [1, 2, 1, 1])], "v array<string>, n array<int>").select(text.modifiers(F.col("v"), F.col("n")).alias("m")).collect()[0].m
    assert m == [0.5, 1.0, 1.0, 1.5, 1.0]


def test_predicates(spark):
    df = spark.createDataFrame([("go " * 10, "SEGS/EN/a"), ("GO NOW", None), (None, "x"), ("", "questions_3/x"), ("a? ", "y"), ("w " * 30, "z")], "t string, p string")
    r = df.select(filters.repeated_word(F.col("t")).alias("rep"), filters.shouting(F.col("t")).alias("loud"), filters.intonation(F.col("t"), F.col("p")).alias("i"), filters.include(F.col("p"), ["EN"]).alias("inc")).collect()
    assert [x.rep for x in r] == [True, False, False, False, False, False] and [x.loud for x in r] == [False, True, False, False, False, False]
    assert [x.i for x in r] == [0, 0, 0, 13, 2, 0] and [x.inc for x in r] == [True, False, False, False, False, False]


def test_signals(spark):
    rate = 8000
    x = np.sin(2 * np.pi * 200 * np.arange(4000) / rate)
    p = signal.pitch_(x, rate, 512, 128)
    assert abs(np.median(p[p > 0]) - 200) < 2
    s = signal.stft(x, 256, 64)
    assert np.abs(signal.istft(s, 256, 64, len(x))[256:-256] - x[256:-256]).max() < 1e-6
    m = signal.mel_(np.abs(s), rate, 20)
    assert abs(signal.mel_inverse_(m, rate, s.shape[1]).sum() / np.abs(s).sum() - 1) < 0.5
    assert np.allclose(signal.overlap_sum(signal.overlap_blocks(x, 64), len(x)), x)
    a = signal.levinson(np.array([1.0, 0.5, 0.25]), 2)
    assert np.allclose(a, [1, -0.5, 0], atol=1e-9)
    x = x * 0.5
    df = spark.createDataFrame([(x[:50].tolist(),), ([],), (None,)], "w array<double>")
    for bits, near in ((9, 1e-2), (16, 2e-5), (24, 1e-6)):
        for quantize in (False, True):
            back = df.select(signal.mu_law_inverse(signal.mu_law(F.col("w"), bits, quantize), bits, quantize).alias("b")).collect()
            assert np.abs(np.array(back[0].b) - x[:50]).max() < near and back[1].b == [] and back[2].b is None
    r = df.select(signal.inverse_preemphasis(signal.preemphasis(F.col("w"))).alias("b"), signal.rms(F.col("w")).alias("r")).collect()
    assert np.allclose(r[0].b, x[:50]) and r[1].b is None and r[2].r is None
    c = df.select(signal.mu_law(F.col("w"), 16, True).alias("q")).select("q", signal.split_codes(F.col("q"), 16).alias("s")).select("q", signal.joined_codes(F.col("s.coarse"), F.col("s.fine"), 16).alias("j")).collect()
    assert c[0].q == c[0].j
    assert signal.coloured_noise(1000, 1.0, 3).std() == pytest.approx(1, abs=0.1)


def test_scalars(spark):
    import hashlib

    df = spark.createDataFrame([("abc", "{'a': 'x', 'b': None, 'c': [1, 2], 'd': 'l'}"), ("123", '{"a": 1}')], "s string, j string")
    r = df.select(N.seed_of(F.col("s")).alias("seed"), F.from_json(N.json_repair(F.col("j")), "a string, b string, c array<int>").alias("j")).collect()
    assert r[0].seed == int(hashlib.sha1(b"abc").hexdigest(), 16) % 10**8 and r[1].seed == 123
    assert (r[0].j.a, r[0].j.b, r[0].j.c) == ("x", None, [1, 2]) and r[1].j.a == "1"
    m = spark.sql("select map('a', '1', 'b', '2') as x, map('b', cast(null as string), 'c', '3') as y").select(N.map_update(F.col("x"), F.col("y")).alias("m"), N.key_ending(F.col("x"), "b").alias("k")).collect()[0]
    assert m.m == {"a": "1", "b": "2", "c": "3"} and m.k == "2"
    assert spark.range(1).select(N.clock(F.lit(3725.9)).alias("c")).collect()[0].c == "1:02:05"
    v = spark.sql("select array(3.0D, 1.0D, 3.0D) as a").select(N.argmax(F.col("a")).alias("x"), N.argmin(F.col("a")).alias("n"), N.softmax(F.col("a")).alias("s"), N.running_sum(F.col("a")).alias("r")).collect()[0]
    assert (v.x, v.n) == (0, 1) and sum(v.s) == pytest.approx(1) and v.r == [3.0, 4.0, 7.0]


def test_more_intervals(spark):
    ts = "array(named_struct('begin', 1.0D, 'end', 2.0D), named_struct('begin', 2.1D, 'end', 3.0D), named_struct('begin', 4.0D, 'end', 5.0D))"
    df = spark.sql(f"select {ts} as t, array(true, false, true) as m, 1 as k")
    t = F.col("t")
    pairs = lambda c: [(round(x.begin, 6), round(x.end, 6)) for x in df.select(c.alias("x")).collect()[0].x]
    assert pairs(timeline.with_edges(t, F.lit(0.5), F.lit(4.5))) == [(0, 0.5), (0.5, 1.5), (1.6, 2.5), (3.5, 4.0), (4.0, 4.0)]
    assert pairs(timeline.service_units(t, 0.2)) == [(1, 1.2), (1.2, 2), (2.1, 3), (4, 4.8), (4.8, 5)]
    assert pairs(timeline.agreed_pauses(t, t, 0.5)) == [(1, 2.05), (2.05, 3), (4, 5)]
    part = pairs(timeline.random_part(t, F.col("k"), 2.0, 3.0, 1))
    assert part[0][0] == 0 and part[-1][1] <= 3.0 + 1e-6
    r = df.select(
        timeline.pauses_from_marks(F.array(F.lit("a"), F.lit(","), F.lit("b")), {",": 2}).alias("p"),
        timeline.late_places(F.array(*map(F.lit, (1, 5, 2, 3)))).alias("l"),
        timeline.outer_mask(F.col("m"), F.slice("m", 1, 2)).alias("o"),
        timeline.unwindowed(timeline.windows(F.array(*map(F.lit, (1.0, 2.0, 3.0))), 2, 1, 1), 2, 1, F.lit(3)).alias("u"),
    ).collect()[0]
    assert r.p == ["a", ",", "<SIL>", "<SIL>", "b"] and r.l == [False, True, False, False] and r.o == [[True, False], [False, False], [True, False]] and r.u == [1.0, 2.0, 3.0]
    u = spark.createDataFrame([(1, p, b, b + 1) for p, b in enumerate((0.0, 1.0, 2.0))], "k int, pos int, begin double, end double")
    g = joins.marked_starts(u, spark.createDataFrame([(1, 0.0), (1, 2.0)], "k int, begin double"), "k")
    assert [x["group"] for x in g.orderBy("pos").collect()] == [0, 0, 1]


def test_more_signals(spark):
    df = spark.createDataFrame([([0.5] * 100,)], "w array<double>")
    sp = F.array(F.struct(F.lit(0.0).alias("begin"), F.lit(0.4).alias("end")), F.struct(F.lit(0.4).alias("begin"), F.lit(0.8).alias("end")), F.struct(F.lit(0.8).alias("begin"), F.lit(1.0).alias("end")))
    r = df.select(
        signal.dithered(F.col("w"), 0.01, 3).alias("d"), signal.gain_curve(F.col("w"), [0.0, 1.0]).alias("g"), signal.clipped_at(F.array(*map(F.lit, (0.1, -0.9, 0.5))), F.lit(0.5)).alias("c"),
        signal.rate_curve(F.lit(3), "parabola").alias("r"), signal.pause_fades(F.col("w"), 100, sp, F.array(F.lit(False), F.lit(True), F.lit(False))).alias("f"), signal.gap_margins_cleared("w", F.lit(5), F.lit(2)).alias("m"),
    ).collect()[0]
    assert 0.005 < np.std(r.d) < 0.02 and r.g[0] == 0 and r.g[-1] == 0.5 and r.c == [0.1, -0.5, 0.5] and r.r == pytest.approx([1, 1.2, 1])
    assert r.f[0] == 0.5 and r.f[40] == 0.5 and r.f[60] < 1e-3 and r.f[99] == 0.5 and r.m == [0.5] * 100
    assert signal.gap_margins_cleared_(np.array([1.0] * 5 + [0] * 6 + [1.0] * 5), 5, 2).tolist() == [1, 1, 1] + [0] * 10 + [1, 1, 1]
    assert abs(signal.contour_(np.arange(50.0)).mean()) < 1e-9 and len(signal.contour_(np.arange(50.0))) == 80
    assert signal.curvature_(np.array([0.0, 1.0, 2.0])).tolist() == pytest.approx([-math.pi / 4, math.atan2(1, 2) * -1])
    assert signal.curvature_(np.array([0.1, 0.2])).tolist() == signal.curvature_(np.array([9.0])).tolist() == [0, 0]
    x = np.sin(2 * np.pi * 100 * np.arange(4000) / 8000)
    assert signal.pitch_image_(x, 8000, 512, 256).shape[1] == 40


def test_more_text_and_aggregates(spark):
    r = spark.range(1).select(
        text.prosody_tags(text.prosody_codes(F.array(F.lit(2), F.lit(None)))).alias("p"), text.emphasis_labels(F.array(F.lit(2), F.lit(1)), F.array(F.lit(True), F.lit(None).cast("boolean"))).alias("e"),
        text.breath_mask(F.array(F.lit("<SIL>"), F.lit("a"), F.lit("<SIL>")), F.array(F.lit(1.5), F.lit(2.0), F.lit(None))).alias("b"), text.subword_places(F.array(F.lit("ab"), F.lit("c")), F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))).alias("s"),
        text.first_labels(F.array(*map(F.lit, (0, 0, 1))), F.array(*map(F.lit, (5, 5, 6)))).alias("f"), text.multi_symbols(F.array(F.lit("a|b|c"), F.lit("d")), "short").alias("m"),
    ).collect()[0]
    assert r.p == [2, -1] and r.e == [1, 1, 0] and r.b == [1.5, -10.0, -3.0] and r.s == [0, 0, 1] and r.f == [5, -100, 6] and r.m == ["a|b", "d"]
    v = spark.createDataFrame([(i, i % 2, [float(i % 2), 1.0]) for i in range(40)] + [(99, 0, None)], "id long, k int, v array<double>")
    m = {(x.k, x.pos): x.mean for x in aggregates.mean_of_draws(v, "k", "id", "v", 20, 1).collect()}
    assert m == {(0, 0): 0.0, (0, 1): 1.0, (1, 0): 1.0, (1, 1): 1.0}
    c = {x.id: x.cluster for x in aggregates.clusters(v, "id", "v", 2).collect()}
    assert len(c) == 40 and len({c[i] for i in range(0, 40, 2)}) == len({c[i] for i in range(1, 40, 2)}) == 1 and c[0] != c[1]
    b = ordering.sequential_batches(spark.range(10), "id", 4)
    assert ordering.full_batches(b, "batch_id", 4).count() == 8


def test_python_functions(spark):
    from sheaf.functions import python

    df = spark.range(6)
    assert sorted(r.x for r in python.per_partition(df, lambda: 10, lambda o, p: p.assign(x=p["id"] * o)[["x"]], "x long").collect()) == [0, 10, 20, 30, 40, 50]
    out = python.flat_map(df, lambda r: [(r["id"], 1 // (r["id"] - 2))] * 2 if r["id"] < 4 else [], "id long, v long, message string", errors=True).collect()
    assert len(out) == 7 and sum(r.message is not None for r in out) == 1
