import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import chunking as C

LIMIT = C.Limit(300, 20, None)


def valid(found, spans, limit):
    assert found[0][0] == spans[0][0] and found[-1][1] == spans[-1][1]
    ends = {e for _, e in spans}
    begins = dict(map(reversed, spans))
    for (a, b, _), (c, d, hard) in zip(found, found[1:]):
        assert a < c < d
        # the exact overlap, unless the unit at the end of the next piece needs the room, or the piece before is short
        if b - c != limit.overlap:
            assert c == a + 1 or not hard and d - c == limit.max_size and d in ends and all(e <= b or e >= d for e in ends)
            assert b - c >= 0 or c <= begins.get(d, 0)
    for a, b, h in found:
        assert 0 < b - a <= limit.max_size and (h or b in ends)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 700), min_size=1, max_size=30))
def test_pieces(lengths):
    at, spans = 0, []
    for n in lengths:
        spans.append((at, at + n))
        at += n + 1
    found = C.pieces(spans, np.arange(0, at, 37), LIMIT)
    valid(found, spans, LIMIT)
    assert any(h for _, _, h in found) == (max(lengths) > LIMIT.max_size)


def test_edits_move_only_near_cuts():
    rnd = random.Random(3)
    units = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(20, 60))) + "." for _ in range(400)]

    def cuts(parts):
        at, spans = 0, []
        for u in parts:
            spans.append((at, at + len(u)))
            at += len(u)
        text = "".join(parts)
        marks = C.landmarks(np.frombuffer(text.encode("utf-32-le"), np.uint32), 6)
        return {text[max(0, e - 30) : e] for _, e, _ in C.pieces(spans, marks, LIMIT)}

    a, b = cuts(units), cuts(units[:100] + ["new words here."] + units[100:])
    assert len(a & b) > 0.9 * len(a)


def test_tables(spark):
    entry = lambda n, gap: [("w", i * (1 + gap), i * (1 + gap) + 1.0) for i in range(n)]
    rows = [(1, "One two. " * 60, (entry(50, 0.0),)), (2, "x" * 1000, (entry(50, 0.5),)), (3, None, None), (4, "", ([],)), (5, "short", (None,)), (2, "x" * 1000, (entry(50, 0.5),))]
    df = spark.createDataFrame(rows, "source_id long, text string, transcription struct<timestamps:array<struct<word:string,begin:double,end:double>>>")
    t = C.cuts(C.text_pieces(df, C.Limit(300, 20, None)), "text")
    e = C.cuts(C.entry_pieces(df, C.Limit(20, 2, 0.35)), "transcription")
    assert sorted(tuple(r) for r in t.unionByName(e).collect()) == [(1, "text", "soft"), (1, "transcription", "hard"), (2, "text", "hard"), (2, "transcription", "soft")]
    assert C.text_pieces(df.limit(0), LIMIT).count() == 0


def test_overlap_is_exact():
    # units of 50 signs with blank lines between them
    spans = [(i * 52, i * 52 + 50) for i in range(60)]
    found = C.pieces(spans, np.arange(0, 3000, 41), C.Limit(300, 20, None))
    assert len(found) > 5 and all(b - c == 20 for (_, b, _), (c, _, _) in zip(found, found[1:]))
    found = C.pieces([(0, 5000)], np.arange(0, 5000, 41), C.Limit(300, 20, None))  # one unit, cut inside
    assert all(b - c == 20 and b - a <= 300 for (a, b, _), (c, _, _) in zip(found, found[1:])) and {b % 41 for _, b, _ in found[:-1]} == {0}
    found = C.pieces([(0, 200), (202, 502), (504, 600)], np.arange(0, 600, 41), C.Limit(300, 20, None))  # no room for the overlap
    assert found == [(0, 200, False), (202, 502, False), (482, 600, False)]


def test_limits(spark):
    kind = "item string, unit string, max_size long, overlap int, min_pause double"
    assert C.limits(spark.createDataFrame([("a", "u", 3, 1, None)], kind)) == {"a": C.Limit(3, 1, None)}
    with pytest.raises(ValueError):
        C.limits(spark.range(C.KINDS + 1).selectExpr("string(id) item", "'u' unit", "3L max_size", "1 overlap", "double(null) min_pause"))
