"""Alignment of sequences and texts.

The kernels are plain functions on two short sequences (words of a sentence, sentences of a chapter); the columns over
them run in Arrow batches.  Work is per pair or per group of one source.

Defined results: an empty side aligns with gaps only; null sides give null; ties are broken as each function says.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
SPANS = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("a_begin", "a_end", "b_begin", "b_end")]))


def global_alignment(x: list, y: list) -> list[tuple[int | None, int | None]]:
    """Global alignment with match 1, mismatch 0, gap -1; the border starts 0, 0, -1, -2 and so on. Of equal scores a
    gap in x goes before a gap in y, and that before a pair."""
    n, m = len(x), len(y)
    codes = {v: k for k, v in enumerate(dict.fromkeys([*x, *y]))}
    cy = np.array([codes[v] for v in y], int)
    up_edge = -np.maximum(np.arange(-1, m), 0)
    score = up_edge.astype(int)
    choice = np.zeros((n, m), np.int8)
    ramp = np.arange(m)
    for i, v in enumerate(x):
        pair = score[:-1] + (cy == codes[v])
        drop = score[1:] - 1
        best = np.maximum(pair, drop)
        # a row of gaps in x: best of best[k] - (j - k) over k <= j, and of the border
        border = -i
        lift = np.maximum.accumulate(np.maximum(best + ramp, border - 1)) - ramp if m else best
        gap = np.concatenate([[border], lift[:-1]]) - 1 if m else lift
        choice[i] = np.where(gap >= lift, 2, np.where(drop >= lift, 1, 0))
        score = np.concatenate([[border], lift])
    out: list[tuple[int | None, int | None]] = []
    i, j = n - 1, m - 1
    while i >= 0 and j >= 0:
        c = choice[i, j]
        out.append((i if c != 2 else None, j if c != 1 else None))
        i, j = i - (c != 2), j - (c != 1)
    out += [(k, None) for k in range(i, -1, -1)] + [(None, k) for k in range(j, -1, -1)]
    return out[::-1]


def replaced_spans(pairs: list[tuple[int | None, int | None]], x: list, y: list) -> list[tuple[int, int, int, int]]:
    """Half-open spans of x and y that replace each other: runs of alignment places that do not match. A run that
    begins with a gap begins at 0 on that side."""
    out, run = [], []
    for a, b in [*pairs, (None, None)]:
        end = a is None and b is None
        if not end and not (a is not None and b is not None and x[a] == y[b]):
            run.append((a, b))
        elif run:
            a0, b0 = run[0][0] or 0, run[0][1] or 0
            out.append((a0, a0 + sum(p is not None for p, _ in run), b0, b0 + sum(q is not None for _, q in run)))
            run = []
    return out


def place_map(pairs: list[tuple[int | None, int | None]], n: int) -> list[list[int]]:
    """For each place of y the places of x that it stands for: its partner, else that of the last place before; where
    places of x were skipped, the place before the jump stands for them all."""
    partner = {b: a for a, b in pairs if a is not None and b is not None}
    out: list[list[int]] = []
    last = 0
    for k in range(n):
        now = partner.get(k, last)
        if now > last + 1:
            if out:
                out[-1] = list(range(last, now))
        out.append([now])
        last = now
    return out


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Likeness in percent: twice the longest common subsequence over the sum of lengths."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def ordered_match(short: list[str], long: list[str], farthest: int | None = None) -> list[int]:
    """Increasing places in the long list for all items of the short one, of largest sum of likeness, the first item
    counting twice, plus 10 over the largest step between places. Of equal sums the smallest places in order.

    Exact: for each bound on the steps the best sum under it is found from the end; no combinations are listed."""
    n, m = len(short), len(long)
    if n == 0 or n > m:
        return []
    score = np.array([[ratio(s, w) for w in long] for s in short]) * np.array([[2.0]] + [[1.0]] * (n - 1))
    best_total, best = -np.inf, []
    for step in range(1, min(m, farthest or m) + 1) if n > 1 else (1,):
        tails = [score[-1]]
        for i in range(n - 2, -1, -1):
            nxt = tails[0]
            reach = np.lib.stride_tricks.sliding_window_view(np.concatenate([nxt[1:], np.full(step, -np.inf)]), step).max(1)
            tails.insert(0, score[i] + reach)
        total = tails[0].max() + (10.0 / step if n > 1 else 0)
        if not np.isfinite(total) or total < best_total - 1e-9:
            continue
        at, places = -1, []
        for i in range(n):
            low, high = (0, m) if i == 0 else (at + 1, min(m, at + 1 + step))
            part = tails[i][low:high]
            at = low + int(np.flatnonzero(part >= part.max() - 1e-9)[0])
            places.append(at)
        if total > best_total + 1e-9 or places < best:
            best_total, best = max(total, best_total), places
    return best


def tokens(text: str) -> list[str]:
    """Words and single marks, lower-cased."""
    return re.findall(r"\w+(?:['’]\w+)*|[^\w\s]", text.lower())


def keywords(items: list[str], least: int = 1) -> list[int]:
    """Places of the words of at least so many letters; a word that reads like the first or the last one always counts.
    What stands between two keywords belongs to the one before."""
    words = [i for i, t in enumerate(items) if t[0].isalnum() or t[0] == "_"]
    edges = {items[i] for i in words[:1] + words[-1:]}
    return [i for i in words if len(items[i]) >= least or items[i] in edges]


#: Percentages from which a whole match and its two edges count, and of keywords that may be left out.
WHOLE, EDGE, MISSING = 90.0, 75.0, 30.0


def text_match(target: str, query: str, least: int = 1, whole: float = WHOLE, edge: float = EDGE, missing: float = MISSING, region: tuple[int, int] | None = None) -> tuple[list[int], list[int]] | None:
    """Token places in the target and in the query of the keywords that match, or None. region: first and last token of
    the target to look at.

    The query fits if all its keywords have increasing partners, the joined keywords of both sides are like enough, and
    so are the first two and the last two. Else one keyword is given up, and the rest is tried: the first one without a
    partner, or, if the texts are nearly alike, the first one that differs from its partner."""
    left, right = tokens(target), tokens(query)
    heads, mine = keywords(left), keywords(right, least)
    if not heads or not mine:
        return None
    if region is not None:
        first, last = (max(0, bisect_right(heads, place) - 1) for place in region)
        heads = heads[first : last + 1]
    for given_up in range(int(len(mine) * missing / 100) + 1):
        a, b = [left[i] for i in heads], [right[i] for i in mine]
        if len(b) <= len(a):
            pairs = list(zip(ordered_match(b, a), range(len(b))))
        else:
            pairs = list(zip(range(len(a)), ordered_match(a, b)))
        if not pairs:
            return None
        said, meant = [b[j] for _, j in pairs], [a[i] for i, _ in pairs]
        alike = ratio("".join(meant), "".join(said))
        lone = sorted(set(range(len(b))) - {j for _, j in pairs})
        if not lone and alike >= whole and all(ratio("".join(meant[s]), "".join(said[s])) >= edge for s in (slice(2), slice(-2, None))):
            return [heads[i] for i, _ in pairs], [mine[j] for _, j in pairs]
        odd = lone or ([j for i, j in pairs if ratio(a[i], b[j]) < edge] if alike >= 0.8 * whole else [])
        if not odd or len(mine) == 1:
            return None
        del mine[odd[0]]
    return None


def edit_likeness(a: str, b: str) -> float:
    """1 - edit distance over the longer length; the distance by columns of bits, one step a character of b."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for c in b:
        hit = where.get(c, 0)
        down = (((hit & plus) + plus) ^ plus) | hit | minus
        up, low = minus | (~(down | plus) & full), plus & down
        score += 1 if up & top else -1 if low & top else 0
        up = (up << 1 | 1) & full
        low = low << 1 & full
        plus, minus = low | (~(down | up) & full), up & down
    return 1 - score / max(len(a), len(b))


def best_place(piece: str, text: str) -> tuple[int, int, float]:
    """Begin and end in the text of the part that is most like the piece, and how like: 1 - edits over the length of the
    longer of the two. Of equal ones the shortest that ends first. One row of numbers a character of the piece."""
    n, m = len(piece), len(text)
    if not n or not m:
        return 0, 0, 0.0
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    step = m + 2  # a value is edits * step + how far the begin is from the end of the text
    ramp = np.arange(m + 1)
    row = m - ramp
    for c in piece:
        free = np.minimum(row[:-1] + step * (codes != ord(c)), row[1:] + step)
        head = np.concatenate([[row[0] + step], free])
        row = np.minimum.accumulate(head - step * ramp) + step * ramp
    edits, begin = row // step, m - row % step
    like = 1 - edits / np.maximum(np.maximum(n, ramp - begin), 1)
    end = int(np.argmax(like))
    return int(begin[end]), end, float(like[end])


#: Least length of a sentence that is looked at for several pieces, likeness to its one partner below which
#: it is, and least likeness of a piece to its part.
LONG, SINGLE, PART = 20, 0.9, 0.5


def pieced(pieces: list[str], text: str, least: list[float]) -> tuple[float, list[tuple[int, int, int, float]]]:
    """How like the text a chain of pieces is, and the chain: (piece, begin, end, likeness) in order of the text. Each
    piece stands where it fits best; the chain is the one that leaves the fewest characters wrong or uncovered, parts
    of pieces that overlap not being taken together. least: the likeness that each piece needs."""
    spans: dict[int, list[tuple[int, int, float]]] = {}
    for k, (p, enough) in enumerate(zip(pieces, least)):
        begin, end, like = best_place(p, text)
        if like >= enough and end > begin:
            spans.setdefault(end, []).append((begin, k, like))
    cost: list[float] = [0.0]
    via: list[tuple[int, int, float] | None] = [None]
    for place in range(1, len(text) + 1):
        best, by = cost[-1] + 1, None
        for begin, k, like in spans.get(place, ()):
            if (c := cost[begin] + (1 - like) * (place - begin)) < best:
                best, by = c, (begin, k, like)
        cost.append(best)
        via.append(by)
    chain, place = [], len(text)
    while place:
        if (by := via[place]) is None:
            place -= 1
        else:
            chain.append((by[1], by[0], place, by[2]))
            place = by[0]
    return 1 - cost[-1] / max(1, len(text)), chain[::-1]


def normal(text: str, patterns: list[tuple[str, str]]) -> str:
    """The text after replacements by regular expressions, in the composed compatibility form."""
    for pattern, new in patterns:
        text = re.sub(pattern, new, text)
    return unicodedata.normalize("NFKC", text)


def order_bonus(share: float) -> float:
    """Worth of keeping the order when such a share of the left side has a partner. At most 0.5, a
    logistic curve of steepness 5 around one half."""
    return 0.5 / (1 + math.exp(-5 * (share - 0.5)))


def assigned(left: list[str], right: list[str], cutoff: float = 0.0) -> list[tuple[int, int, float]]:
    """(place in left, place in right, likeness). Pairs are taken one by one: the one with the greatest product of the
    length of the right text and its likeness, the latter with order_bonus if the pair keeps the order, that is, if its
    right place lies between those of the nearest left neighbours that are taken."""
    n, m = len(left), len(right)
    like = np.array([[edit_likeness(x, y) for y in right] for x in left]).reshape(n, m)
    length, places, rows = np.array([len(y) for y in right], float), np.arange(m), np.arange(n)
    partner, open_left, open_right = np.full(n, -1), np.ones(n, bool), np.ones(m, bool)
    for done in range(min(n, m)):
        taken = partner >= 0
        before, after = np.maximum.accumulate(np.where(taken, rows, -1)), np.minimum.accumulate(np.where(taken, rows, n)[::-1])[::-1]
        low, high = np.append(partner, -1)[before], np.append(partner, m)[after]
        ordered = (places > low[:, None]) & (places < high[:, None])
        worth = np.where(open_left[:, None] & open_right, (like + order_bonus(done / n) * ordered) * length, -np.inf)
        i, j = divmod(int(worth.argmax()), m)
        if worth[i, j] == -np.inf or like[i, j] < cutoff:
            break
        partner[i], open_left[i], open_right[j] = j, False, False
    return [(int(i), int(partner[i]), float(like[i, partner[i]])) for i in np.flatnonzero(partner >= 0)]


def placed(left: list[str], right: list[str], cutoff: float = 0.0) -> list[tuple[int, int, float, int, int]]:
    """(place in left, place in right, likeness, begin, end): what assigned gives, each partner over the whole right
    text; but a right text that several left ones make up better than its one partner gets all of them, each with the
    characters that it stands for. A left text with another partner is used if it is more like its part here."""
    out = {i: (j, s, 0, len(right[j])) for i, j, s in assigned(left, right, cutoff)}
    for j, text in enumerate(right):
        like = max((s for k, s, _, _ in out.values() if k == j), default=0.0)
        if len(text) < LONG or like >= SINGLE:
            continue
        use = [i for i in range(len(left)) if left[i] and (i not in out or out[i][0] == j or out[i][1] < SINGLE)]
        score, chain = pieced([left[i] for i in use], text, [out[i][1] + 1e-9 if i in out and out[i][0] != j else PART for i in use])
        if len(chain) > 1 and score > like:
            out = {i: x for i, x in out.items() if x[0] != j}
            for k, begin, end, s in chain:
                out[use[k]] = (j, s, begin, end)
    return [(i, *x) for i, x in sorted(out.items())]


@F.pandas_udf(PAIRS)
def aligned(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Global alignment of two array columns as (a, b) places, null for a gap."""
    for x, y in parts:
        yield pd.Series([[{"a": i, "b": j} for i, j in global_alignment(list(a), list(b))] if a is not None and b is not None else None for a, b in zip(x, y)])


@F.pandas_udf(SPANS)
def replacements(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Replaced spans of two array columns."""
    names = ("a_begin", "a_end", "b_begin", "b_end")
    for x, y in parts:
        yield pd.Series([[dict(zip(names, s)) for s in replaced_spans(global_alignment(list(a), list(b)), list(a), list(b))] if a is not None and b is not None else None for a, b in zip(x, y)])


MATCH = T.StructType([T.StructField("target_places", T.ArrayType(T.IntegerType())), T.StructField("query_places", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(MATCH)
def matched(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """text_match of a target and a query column with keywords of three letters; null places where they do not match."""
    for x, y in parts:
        rows = [(text_match(a, b, 3) if a and b else None) or (None, None) for a, b in zip(x, y)]
        yield pd.DataFrame(rows, columns=["target_places", "query_places"])


#: Marks and runs of white space do not count when sentences are compared.
PLAIN = [(r"[^\w\s]+", ""), (r"\s+", " ")]


def assign_sentences(left: DataFrame, right: DataFrame, key: str, order: str, text: str, most: int = 2000, patterns: list[tuple[str, str]] = PLAIN) -> DataFrame:
    """(key, left_order, right_order, likeness, begin, end) for the sentences of two versions of each source.

    Sentences that come once on each side of a source, in the same words, are anchors; those whose rank among all
    anchors is the same on both sides keep the order, and cut the source into parts, which are matched by themselves.
    So a part is short wherever the versions agree, at any size of the source. A part of more than `most` sentences on a
    side, which has no anchor, is matched in windows of that many left sentences against the right ones of the same
    share and of the windows on both sides; of left sentences that choose the same right one the most like keeps it.
    begin and end are places in the right sentence as it is compared, that is, after the patterns and in lower case."""
    from . import celled, ordering

    @F.pandas_udf("string")
    def compared(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series([None if t is None else normal(t, patterns).casefold().strip() for t in x], dtype=object)

    def cell(c: str) -> Column:
        return F.floor(F.col(c) / ordering.WIDTH)

    def rows(df: DataFrame) -> DataFrame:
        some = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(order).alias("_o"), compared(text).alias("_t"))
        return celled.numbered(some.withColumn("_h", F.xxhash64("_t")), ["_k"], ["_o"], cell("_o"), "_i")

    def once(df: DataFrame, name: str) -> DataFrame:
        return df.where("_t <> ''").groupBy("_k", "_h").agg(F.count(F.lit(1)).alias("_n"), F.max("_i").alias(name)).where("_n = 1").drop("_n")

    a, b = rows(left), rows(right)
    both = once(a, "_x").join(once(b, "_y"), ["_k", "_h"]).drop("_h")
    ranked = celled.numbered(celled.numbered(both, ["_k"], ["_x"], cell("_x"), "_p"), ["_k"], ["_y"], cell("_y"), "_q")
    anchors = ranked.where("_p = _q").select("_k", "_x", "_y")

    def parts(df: DataFrame, at: str) -> DataFrame:
        marked = df.join(anchors.select("_k", F.col(at).alias("_i"), F.lit(1).cast("bigint").alias("_a")), ["_k", "_i"], "left")
        return celled.running_sum(marked, ["_k"], ["_i"], cell("_i"), F.coalesce("_a", F.lit(0).cast("bigint")), "_part").drop("_a", "_h")

    a, b = parts(a, "_x"), parts(b, "_y")
    size = lambda df, n: df.groupBy("_k", "_part").agg(F.count(F.lit(1)).alias(n), F.min("_i").alias(f"{n}_from"))
    sizes = size(a, "_n").join(size(b, "_m"), ["_k", "_part"]).withColumn("_w", F.ceil(F.greatest("_n", "_m") / most))
    share = lambda df, n: df.join(sizes.select("_k", "_part", "_w", n, f"{n}_from"), ["_k", "_part"]).withColumn("_g", F.floor((F.col("_i") - F.col(f"{n}_from")) * F.col("_w") / F.col(n)))
    x = share(a, "_n").select("_k", "_part", "_g", "_i", "_o", "_t")
    near = F.sequence(F.greatest(F.col("_g") - 1, F.lit(0)), F.least(F.col("_g") + 1, F.col("_w") - 1))
    y = share(b, "_m").withColumn("_g", F.explode(near)).select("_k", "_part", "_g", "_i", "_o", "_t")
    kinds = left.schema[key].dataType.simpleString(), left.schema[order].dataType.simpleString()

    def run(_, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        cols = [key, "left_order", "right_order", "likeness", "begin", "end"]
        if not len(p) or not len(q):
            return pd.DataFrame({c: [] for c in cols})
        p, q = p.sort_values("_i"), q.sort_values("_i")
        got = placed(p["_t"].tolist(), q["_t"].tolist())
        return pd.DataFrame([(p["_k"].iloc[0], p["_o"].iloc[i], q["_o"].iloc[j], s, u, v) for i, j, s, u, v in got], columns=cols)

    on = ["_k", "_part", "_g"]
    found = x.groupBy(*on).cogroup(y.groupBy(*on)).applyInPandas(run, f"`{key}` {kinds[0]}, left_order {kinds[1]}, right_order {kinds[1]}, likeness double, begin int, end int")
    # only windows can give a right sentence, or a stretch of it, to left ones that do not know of each other
    rival = Window.partitionBy(key, "right_order").orderBy(F.desc("likeness"), "left_order")
    reach = F.max("end").over(rival.rowsBetween(Window.unboundedPreceding, -1)), F.min("begin").over(rival.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumns({"_e": reach[0], "_b": reach[1]}).where("_e is null or begin >= _e or end <= _b").drop("_e", "_b")
