"""Results must not depend on how large groups are cut into parts."""

import os
import random

import oracle
import pytest

from sheaf.operators import samplers
from sheaf.plans import catalogue

SF = "/root/testdata/sf0.001"


def batches(costs, limit, rows):
    out, batch, total, n = [], 0, 0.0, 0
    for c in costs:
        out.append(batch)
        total, n = total + c, n + 1
        if total > limit or n >= rows:
            batch, total, n = batch + 1, 0.0, 0
    return out


@pytest.mark.parametrize("name", ["batch_dynamic", "pack_text_100"])
@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_batches_cross_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(samplers, "BLOCK", 5)
    assert oracle.compare(catalogue.queries()[name](spark, SF), oracle.connect(SF), catalogue.oracle_sql()[name]) is None


@pytest.mark.parametrize("block", [1, 7])
def test_batches_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(samplers, "BLOCK", block)
    rnd = random.Random(block)
    rows = [(k, i, rnd.choice([None, 0.0, 0.1, 0.7, 3.3, 9.0, 40.0])) for k in (None, 1, 2) for i in range(60)] + [(3, i, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, o long, c double")
    for limit, most in ((10.0, 4), (10.0, 1 << 60)):
        got = {(r.k, r.o): r.batch for r in samplers.dynamic_batches(df, ["k"], "o", "c", limit, most).collect()}
        want = {}
        for k in (None, 1, 2, 3):
            mine = [r for r in rows if r[0] == k]
            want |= {(k, r[1]): b for r, b in zip(mine, batches([r[2] or 0.0 for r in mine], limit, most))}
        assert got == want
