import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sheaf.llm import packing as P


def plain(sizes, capacity):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b, room in enumerate(bins):
            if room >= sizes[i]:
                break
        else:
            b = len(bins)
            bins.append(capacity)
        bins[b] -= sizes[i]
        out[i] = b
    return [out[i] for i in range(len(sizes))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_first_fit_decreasing(sizes):
    assert P.first_fit_decreasing(np.array(sizes, np.int64), 100).tolist() == plain(sizes, 100)


def test_containers(spark):
    rows = [(i, "ж" * (i % 90), "x") for i in range(500)] + [(1000, "a" * 1000, "x"), (1000, "a" * 1000, "x"), (1001, None, "x"), (1002, "", "x"), (1003, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = P.containers(df, 200, group=100).collect()
    load = {}
    for r in got:
        load[r.group, r.number] = load.get((r.group, r.number), 0) + r.tokens
    assert max(load.values()) <= 200 and len(load) < 1.05 * sum(load.values()) / 200 + 6
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
    assert total == {**{i: 2 * (i % 90) + 1 for i in range(500) if i % 90}, 1000: 2 * 1001, 1003: 2}
    assert {r.doc_id for r in got if r.pieces > 1} == {1000}
    assert sorted(r.doc_id for r in P.oversized(P.containers(df, 200, group=100)).collect()) == [1000, 1000]
    assert P.containers(df.limit(0), 200).count() == 0


def test_same_containers_in_any_layout(spark):
    rows = [(i % 200, "a" * (i % 200 % 37)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = sorted(map(tuple, P.containers(df.repartition(7), 100, group=100).collect()))
    assert a == sorted(map(tuple, P.containers(df.orderBy(F.desc("doc_id")).coalesce(1), 100, group=100).collect()))
