"""Metrics, clusters, padding, normalisation, pauses and large keys against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import aggregates, celled, collate, filters, joins, ordering, signal, text, timeline


def test_quantiles_of_large_keys(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", None, "b"]), round(rnd.gauss(0, 5), 1)) for _ in range(700)] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.05, 0.33, 0.5, 0.95, 1.0]
    want = {r.k: r.q for r in aggregates.quantiles(df, ["k"], "v", qs).collect()}
    got = {r.k: r.q for r in aggregates.quantiles(df, ["k"], "v", qs, hot=10).collect()}
    assert set(got) == set(want) == {"a", "b", None, "d"} and all(got[k] == pytest.approx(want[k]) for k in want)
    assert aggregates.quantiles(df.limit(0), ["k"], "v", qs).count() == 0


def test_rates(spark):
    rnd = random.Random(3)
    rows = [(rnd.random() < 0.4, rnd.choice([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) for _ in range(60)]
    r = aggregates.ranked_rates(spark.createDataFrame(rows, "p boolean, s double"), [], "s", F.col("p")).collect()[0]
    pos, neg = [s for p, s in rows if p], [s for p, s in rows if not p]
    assert r.auc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    far = {t: (np.mean([s < t for s in pos]), np.mean([s >= t for s in neg])) for _, t in rows}
    best = min(far, key=lambda t: (round(abs(far[t][0] - far[t][1]), 12), -t))
    assert r.threshold == best and r.eer == pytest.approx(sum(far[best]) / 2)
    three = [(rnd.randrange(3), [rnd.random() for _ in range(3)]) for _ in range(40)] + [(-100, [0.1, 0.2, 0.7])]
    m = aggregates.pairwise_rates(spark.createDataFrame(three, "t int, s array<double>"), "t", "s", 3).collect()[0]
    area = lambda a, b: np.mean([(x[a] > y[a]) + (x[a] == y[a]) / 2 for t, x in three if t == a for u, y in three if u == b])
    assert m.auc == pytest.approx(np.mean([area(a, b) for a in range(3) for b in range(3) if a != b])) and 0 <= m.eer <= 1


def test_complete_linkage(spark):
    x = np.array([[0.0], [0.1], [0.25], [5.0], [5.3], [9.0]])
    assert len(set(aggregates.linked(x, 3))) == 3 and aggregates.linked(x, 3)[0] == aggregates.linked(x, 3)[2] != aggregates.linked(x, 3)[3]
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(30, 2))
    groups = [{i} for i in range(30)]
    while len(groups) > 4:
        far = lambda a, b: max(np.linalg.norm(x[i] - x[j]) for i in a for j in b)
        a, b = min(((a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]), key=lambda p: far(*p))
        groups = [g for g in groups if g is not a and g is not b] + [a | b]
    labels = aggregates.linked(x, 4)
    assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in range(4)} == {frozenset(g) for g in groups}
    df = spark.createDataFrame([(i, [float(i % 3) * 10]) for i in range(30)] + [(99, None)], "id long, v array<double>")
    got = {r.id: r.cluster for r in aggregates.linkage_clusters(df, "id", "v", 3).collect()}
    assert len(got) == 30 and len({got[0], got[1], got[2]}) == 3 and all(got[i] == got[i % 3] for i in range(30))


def test_frames_and_bands(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]]), (1, [[3.0, 4.0]] * 3), (2, None)], "b int, x array<array<double>>")
    got = sorted((r.b, len(r.x), r.length, r.x[-1] if r.x else None) for r in collate.padded_frames(df, "b", "x", (2,), -1.0, 2).collect())
    assert got == [(1, 4, 1, [-1.0, -1.0]), (1, 4, 3, [-1.0, -1.0]), (2, 0, 0, None)]
    v = spark.createDataFrame([(-5.0,), (2e9,), (None,), (3.0,)], "v double")
    assert filters.band(v, F.col("v")).count() == 3 and filters.band(v, F.col("v"), high=3.0).count() == 2 and filters.band(v, F.col("v"), low=0).count() == 2
    t = spark.createDataFrame([("go " * 10,), ("Go " + "go " * 9,), ("a " * 30,), (None,)], "t string")
    assert [r[0] for r in t.select(filters.repeated_word(F.col("t"))).collect()] == [True, False, False, False]


def test_normalisation_and_levels(spark):
    x = [1.0, 5.0, 6.0, 7.0, 90.0]
    df = spark.createDataFrame([(x,), ([1.0, 1.2],), ([],), (None,)], "v array<double>")
    v = F.col("v")
    r = [list(row) for row in df.select(signal.sample_normalized(v), signal.sample_normalized(v, outliers=False), signal.sample_normalized(v, "quantile"), signal.sample_normalized(v, "z-norm"), signal.sample_normalized(v, "minmax", low=0.0, high=100.0)).collect()]
    a = np.array(x)
    near = a[abs(a - a.mean()) < 2 * a.std()]
    low, high = np.quantile(a, 0.05), np.quantile(a, 0.95)
    for got, want in zip(r[0], [(a - 1) / 89, (a - near.min()) / (near.max() - near.min()), (a - low) / (high - low), (a - a.mean()) / (4 * a.std()), a / 100]):
        assert got == pytest.approx(want.tolist())
    assert r[1] == r[2] == r[3] == [None] * 5
    w = np.sin(2 * np.pi * 3000 * np.arange(4096) / 22050)
    assert signal.level(np.zeros(9)) == -100 and signal.level(w, "log_peak") == pytest.approx(0, abs=0.01) and signal.level(w, "log_magnitude") == pytest.approx(-3.01, abs=0.02)
    assert signal.level(w, "log_energy") == pytest.approx(10 * math.log10((w**2).sum())) and signal.level(w, "win_max_magnitude") == pytest.approx(-3, abs=0.1) and signal.level(w) > 40
    assert signal.pitch_(np.sin(2 * np.pi * 200 * np.arange(4000) / 8000), 8000.0)[5] == pytest.approx(200, rel=0.03)


def test_pauses_at_edges_and_on_demand(spark):
    spans = [(0.2, 0.5), (0.52, 0.9), (0.91, 1.2)]
    df = spark.createDataFrame([(spans, [False, False, True], 1.205)], "ts array<struct<begin:double,end:double>>, asked array<boolean>, stop double")
    u = lambda **k: [(round(x.begin, 4), round(x.end, 4), x.unit) for x in df.select(timeline.silence_units(F.col("ts"), 0.1, None, 0.0, **k)).collect()[0][0]]
    assert u(stop=F.col("stop")) == [(0.0, 0.2, None), (0.2, 0.51, 0), (0.51, 0.905, 1), (0.905, 1.2, 2), (1.2, 1.205, None)]
    assert u(asked=F.col("asked")) == [(0.0, 0.2, None), (0.2, 0.51, 0), (0.51, 0.9, 1), (0.9, 0.91, None), (0.91, 1.2, 2)]
    r = spark.range(1).select(text.rate_modifiers(F.array(F.lit("200"), F.lit("100")), F.array(F.lit("50"), F.lit("50")), F.array(F.lit(2), F.lit(1)), F.array(F.lit("R"), F.lit("A"), F.lit("A"))).alias("f")).collect()[0].f
    assert r == pytest.approx([1.0, 0.5, 1.0])


def test_two_levels_and_blocks(spark):
    df = spark.createDataFrame([(i * 60_000, i % 7) for i in range(200)] + [(None, 1)], "id long, n int")
    assert sorted(r.pos for r in ordering.positions(df, "id").collect()) == list(range(1, 202))
    got = ordering.positions(df.where("id is not null"), "id", ["n"]).collect()
    assert [(r.n, r.id) for r in sorted(got, key=lambda r: r.pos)] == sorted((r.n, r.id) for r in got)
    s = df.where("id is not null").withColumn("x", F.when(F.col("n") == 3, F.col("id")))
    f = {r.id: r.y for r in celled.filled(s, [], ["id"], F.floor(F.col("id") / 50_000), "x", "y", upper=celled.thousands).collect()}
    assert all(f[i * 60_000] == max((j * 60_000 for j in range(i + 1) if j % 7 == 3), default=None) for i in range(200))
    iv = [("k", i, b, b + w) for i, (b, w) in enumerate([(0.0, 1.0), (0.2, 0.1), (0.0, 5000.0), (7.0, 0.0), (3.0, 2.0)])]
    t = spark.createDataFrame(iv, "key string, pos int, begin double, end double")
    want = {(a, b) for _, a, p, q in iv for _, b, x, y in iv if x <= p and q <= y}
    assert {(r.inner_pos, r.outer_pos) for r in joins.contained(t, t, "key").collect()} == want
