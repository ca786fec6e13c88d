"""Every core query against its SQL, on the smallest test data."""

import os

import numpy as np
import oracle
import pytest

from sheaf.operators import signal
from sheaf.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


def segments(duck):
    return {r[0]: r[1:] for r in duck.execute("select distinct seg_id, orig, text from audioseg where orig is not null and text is not null").fetchall()}


def alignments(rows, duck):
    """Every word of both sides once and in order; the score is that of the plain table."""
    seg = segments(duck)
    by = {}
    for r in sorted(rows, key=lambda r: (r.seg_id, r.pos)):
        by.setdefault(r.seg_id, []).append((r.a, r.b))
    for k, pairs in by.items():
        x, y = seg[k][0].lower().split(" "), seg[k][1].split(" ")
        assert [a for a, _ in pairs if a is not None] == list(range(len(x))) and [b for _, b in pairs if b is not None] == list(range(len(y)))
    return set(by) == set(seg)


def replaced(rows, duck):
    """What is outside the spans is the same on both sides."""
    seg, by = segments(duck), {}
    for r in rows:
        by.setdefault(r.seg_id, []).append(r)
    for k, (orig, text) in seg.items():
        x, y = orig.split(" "), text.split(" ")
        cut_x = {i for r in by.get(k, ()) for i in range(r.a_begin, r.a_end)}
        cut_y = {i for r in by.get(k, ()) for i in range(r.b_begin, r.b_end)}
        assert [w for i, w in enumerate(x) if i not in cut_x] == [w for i, w in enumerate(y) if i not in cut_y]
    return True


def edges(rows, duck):
    def like(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a):
            new = [i + 1]
            for j, q in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (p != q)))
            row = new
        return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0

    seg = segments(duck)
    want = {k: like(a.lower()[:15], b[:15]) >= 0.7 and like(a.lower()[-15:], b[-15:]) >= 0.7 for k, (a, b) in seg.items()}
    return {r.seg_id: r.alike for r in rows} == want


def assignment(rows, duck):
    """Each sentence once on the left; nearly all meet their own segment."""
    left = [r.left_order for r in rows]
    own = sum(r.left_order == r.right_order for r in rows)
    return len(left) == len(set(left)) and own > 0.9 * len(rows) > 0 and all(0 <= r.likeness <= 1 and r.begin <= r.end for r in rows)


def frames(rows, duck):
    n = dict(duck.execute("select distinct seg_id, len(ts_by_words) from audioseg").fetchall())
    return len(rows) > 0 and all((r.message is None and r.n == n[r.seg_id] + 1) or r.message for r in rows)


def vectors(duck):
    return {k: np.array(v, float) for k, v in duck.execute("select vec_id, embedding from embeddings").fetchall()}


def mel(rows, duck):
    """Against sums written out for some vectors."""
    got = {(r.vec_id, r.frame, r.band): r.value for r in rows}
    for k, v in list(vectors(duck).items())[:5]:
        x = np.concatenate([v[16:0:-1], v, v[-2:-18:-1]])
        for f in range(9):
            part = x[8 * f : 8 * f + 32] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32))
            power = np.array([abs(sum(part[t] * np.exp(-2j * np.pi * t * b / 32) for t in range(32))) for b in range(17)])
            for band, row in enumerate(signal.mel_basis(17, 22050.0, 8)):
                assert abs(got[k, f, band] - float(row @ power)) < 1e-9
    return len(got) == len(rows)


def pitch(rows, duck):
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.frame] = r.hertz
    for k, v in list(vectors(duck).items())[:20]:
        x = np.concatenate([np.zeros(17), v, np.zeros(17)])
        for f, a in enumerate(range(0, len(x) - 32, 16)):
            w = x[a : a + 32]
            d = [sum((w[j] - w[j + t]) ** 2 for j in range(32 - t)) for t in range(10)]
            c = [1.0] + [d[t] * t / sum(d[1 : t + 1]) if sum(d[1 : t + 1]) else np.nan for t in range(1, 10)]
            t = next((t for t in range(2, 10) if c[t] < 0.1), 0) if w.max() > 0 else 0
            while t and t + 1 < 10 and c[t + 1] < c[t]:
                t += 1
            assert abs(got[k][f] - (1000 / t if t else 0)) < 1e-6
    return True


#: Checks of the queries that SQL cannot express.
PROPERTIES = {
    "nw_align": alignments,
    "replacement_spans": replaced,
    "fuzzy_edges": edges,
    "sentence_assignment": assignment,
    "frame_bounds": frames,
    "text_align": lambda rows, duck: len(rows) == len(segments(duck)) and sum((r.n or 0) > 0 for r in rows) > len(rows) / 2,
    "balanced_fill": lambda rows, duck: 0 < len(rows) <= 2000 and len({r[0] for r in rows}) == len(rows),
    "mel_frames": mel,
    "pitch_track": pitch,
}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert PROPERTIES[name](df.collect(), duck)
    else:
        assert oracle.compare(df, duck, sql) is None
