"""Evaluation passages inside training documents (problem 8).

Size-partitioned MinHash containment search: items fall into partitions by their number of words; for each partition the
documents are cut into overlapping windows of that size, so that the Jaccard similarity of a window and a contained item
stays high however long the document is; windows and items that share a MinHash value are candidates.  Each candidate is
then verified by exact containment: which words of the item stand in the document in shingles that both have, in order
and in one place, with the words around them that stand in their place and the single changed words between those.

Shingles have three words: scattered words may be changed, and where every fifth word is, no shingle of five is left.

Defined results: null, empty and blank documents or passages hold and are held by nothing; of a passage of one or two
words all must stand in the document side by side, of longer ones at least three words in a row; repeated rows of
documents give repeated findings; items that repeat a passage under another id are found under both ids; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes as K

SHINGLE = 3  # words of a shingle
PERMUTATIONS = 64
SHARE = 0.4  # least share of the passage
LEAST = 0.6 * SHARE  # the same of words in shingles that are left where single words are changed
#: Items held by a worker at once; more items are searched in blocks of this size, one pass over the documents each.
BLOCK = 20_000
LOW = np.uint64((1 << 22) - 1)
#: Cells of a table (block, item) up to which one is used; beyond it sorted lists do the same.
TABLE = 50_000_000
#: Places of the verification handled at once.
ROWS = 2_000_000


class Items:
    """Index of the passages: their words, shingles and, by size partition, their MinHash values."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        flat, bounds = K.points(pa.array(texts, pa.string()))
        h, at, _ = K.words(flat)
        own = K.owner(at, bounds)
        self.ids = np.array(ids)
        first = np.searchsorted(own, np.arange(len(ids) + 1))  # the words of an item stand together
        s3 = K.shingles(h, own, SHINGLE)
        self.size = np.diff(first)
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:])]
        #: passages too short for a shingle, by number of words: hashes, sorted, and their items
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, SHINGLE):
            tiny = np.flatnonzero(self.size == n)
            value = K.shingles(h, own, n)[first[tiny]]
            order = np.argsort(value, kind="stable")
            if len(tiny):
                self.short[n] = value[order], tiny[order]
        #: all shingles, and for each item those it has, sorted, with their places
        self.exact = []
        self.vocabulary = np.unique(s3[s3 != 0])
        for i in range(len(ids)):
            mine = s3[first[i] : first[i + 1]]
            places = np.flatnonzero(mine)
            known = np.searchsorted(self.vocabulary, mine[places])
            order = np.argsort(known, kind="stable")
            self.exact.append((known[order], places[order]))
        #: which low bits of hashes occur at all
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.vocabulary & LOW).astype(np.int64)] = True
        #: the same as one sorted list of (shingle, item)
        keys = np.concatenate([known * len(ids) + i for i, (known, _) in enumerate(self.exact)] or [np.empty(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.postings = np.r_[keys[order], -1]  # the last ends every search
        self.many = np.bincount(keys // max(1, len(ids)), minlength=len(self.vocabulary))  # postings of a shingle
        self.posting_place = np.concatenate([p for _, p in self.exact] or [np.empty(0, np.int64)])[order]
        self.grade = np.array([max(5, int(np.ceil(np.log2(max(1, n))))) for n in self.size])
        self.minima: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        some = np.flatnonzero(self.size)
        if not len(some):
            return
        lows = []
        for p in range(PERMUTATIONS):
            v = permuted(s3, p)
            v[s3 == 0] = NONE
            lows.append(np.minimum.reduceat(v, first[some]))
        full = lows[0] != NONE
        for g in np.unique(self.grade[some[full]]):
            members = full & (self.grade[some] == g)
            self.minima[int(g)] = []
            for low in lows:
                order = np.argsort(low[members], kind="stable")
                self.minima[int(g)].append((low[members][order], some[members][order]))


@lru_cache(2)
def index(ids: tuple, texts: tuple) -> Items:
    """The index of a block, made once a worker process."""
    return Items(list(ids), list(texts))


NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(20240817)
_A = _rng.integers(1, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, np.uint64)


def permuted(s: np.ndarray, p: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = s * _A[p] + _B[p]
        v ^= v >> np.uint64(33)
        return v


def windows(texts: np.ndarray, g: int) -> np.ndarray:
    """Where the blocks of half a window of grade g begin; a window is a block and the next of the same text."""
    change = np.r_[True, texts[1:] != texts[:-1]]
    within = np.arange(len(texts)) - np.flatnonzero(change)[np.cumsum(change) - 1]
    return np.flatnonzero(within % (1 << (g - 1)) == 0)


Candidates = dict[int, tuple[np.ndarray, np.ndarray]]  # by grade: begins of blocks; block x number of items + item


def candidates(s: np.ndarray, texts: np.ndarray, items: Items) -> Candidates:
    """Windows of documents and items that share a MinHash value with them."""
    count = len(items.ids)
    empty = s == 0
    hits: dict[int, list[np.ndarray]] = {g: [np.empty(0, np.int64)] for g in items.minima}
    cut = {g: windows(texts, g) for g in items.minima}
    tables = {g: np.zeros(len(starts) * count, bool) for g, starts in cut.items() if len(starts) * count <= TABLE}
    for p in range(PERMUTATIONS):
        v = permuted(s, p)
        v[empty] = NONE
        for g, starts in cut.items():
            low, members = items.minima[g][p]
            block = np.minimum.reduceat(v, starts)
            pair = block.copy()
            same = texts[starts[1:]] == texts[starts[:-1]]
            pair[:-1] = np.where(same, np.minimum(block[:-1], block[1:]), block[:-1])
            left, right = np.searchsorted(low, pair, "left"), np.searchsorted(low, pair, "right")
            w = np.flatnonzero(right > left)
            while len(w):  # as often as items share the value
                if g in tables:
                    tables[g][w * count + members[left[w]]] = True
                else:
                    hits[g].append(w * count + members[left[w]])
                left[w] += 1
                w = w[right[w] > left[w]]
    return {g: (cut[g], np.flatnonzero(tables[g]) if g in tables else np.unique(np.concatenate(found))) for g, found in hits.items()}


def dense(sid: np.ndarray, texts: np.ndarray, items: Items, near: Candidates | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Begin, end and item of the candidates (None: of all windows) that have enough shingles of their item in one place
    to come into question. A passage is at most as long as a window, and windows overlap by half, so that two fifths of
    it stand in one window. The items are taken in ranges of about ROWS places where a text and an item share a shingle."""
    count, n = len(items.ids), len(sid)
    hit = np.flatnonzero(sid >= 0)
    total = int(items.many[sid[hit]].sum())
    edges = np.unique(np.linspace(0, count, total // ROWS + 2).astype(int))
    longest = int(items.size.max())
    bits, span = longest.bit_length(), n + 2 * longest + 8  # so far apart that no line reaches into the next candidate's
    out = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        shingle = np.arange(len(items.vocabulary)) * count
        left = np.searchsorted(items.postings[:-1], shingle + lo)
        many = (np.searchsorted(items.postings[:-1], shingle + hi) - left)[sid[hit]]
        left = left[sid[hit]]
        word = np.repeat(hit, many)
        k = np.arange(len(word)) + np.repeat(left - np.cumsum(many) + many, many)
        item, place = items.postings[k] % count, items.posting_place[k]
        for g in items.minima:
            starts = near[g][0] if near is not None else windows(texts, g)
            block_of = np.zeros(n, np.int64)
            block_of[starts[1:]] = 1
            block_of = np.cumsum(block_of)
            mine = np.flatnonzero(items.grade[item] == g)
            block = block_of[word[mine]]
            back = np.flatnonzero((block > 0) & (texts[starts[np.maximum(block - 1, 0)]] == texts[starts[block]]))
            key = np.r_[block, block[back] - 1] * count + np.r_[item[mine], item[mine[back]]]
            mine = np.r_[mine, mine[back]]
            keys = near[g][1] if near is not None else np.unique(key)
            if not len(keys) or not len(key):
                continue
            if len(starts) * count <= TABLE:
                number = np.full(len(starts) * count, -1, np.int32)
                number[keys] = np.arange(len(keys))
                which = number[key].astype(np.int64)
                have = np.flatnonzero(which >= 0)
            else:
                which = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                have = np.flatnonzero(keys[which] == key)
            have = have[(np.bincount(which[have], minlength=len(keys)) * SHINGLE >= LEAST * items.size[keys % count])[which[have]]]
            if not len(have):
                continue
            line, at = which[have] * span + word[mine[have]] - place[mine[have]] + longest, place[mine[have]]
            if int(line.max()) < 1 << (62 - bits):  # one sort of one number is faster than one of two
                line = np.sort((line << bits) | at)
                line, at = line >> bits, line & ((1 << bits) - 1)
            else:
                order = np.lexsort((at, line))
                line, at = line[order], at[order]
            gain = np.full(len(line), SHINGLE)  # words that a shingle adds to those before it
            gain[1:] = np.where(line[1:] == line[:-1], np.minimum(np.diff(at), SHINGLE), SHINGLE)
            which = line // span
            size = items.size[keys % count]
            words = np.r_[0, np.cumsum(gain)]
            covered = words[np.searchsorted(line, line + np.maximum(4, size // 10)[which], "right")] - words[:-1]
            found = keys[np.unique(which[covered >= LEAST * size[which]])]
            stops = np.r_[starts, n, n]
            out.append((stops[found // count], stops[found // count + 2], found % count))
    return out


def coverage(item: tuple[np.ndarray, np.ndarray], words: np.ndarray, hit: np.ndarray, sid: np.ndarray, h: np.ndarray) -> float:
    """Share of the item's words that the document has in the same order and in one place: words in shingles that both
    have with nearly the same distance between place in the document and place in the item, and, between such shingles,
    words that stand where the distance of the shingle before or after them lets expect them. item: its shingles, sorted,
    and their places; words: its words; hit: places of the document; sid, h: shingles and words of the document."""
    known, places = item
    size = len(words)
    left, right = np.searchsorted(known, sid[hit], "left"), np.searchsorted(known, sid[hit], "right")
    at = np.flatnonzero(right > left)
    d, p = hit[at] - places[left[at]], places[left[at]]
    more = at[right[at] - left[at] > 1]
    if len(more):  # shingles that the item repeats
        j = np.repeat(hit[more], right[more] - left[more] - 1)
        k = np.concatenate([np.arange(left[x] + 1, right[x]) for x in more])
        d, p = np.r_[d, j - places[k]], np.r_[p, places[k]]
    order = np.argsort(d, kind="stable")
    d, p = d[order], p[order]
    last = np.searchsorted(d, d + max(4, size // 10), "right")
    n = last - np.arange(len(d))
    rich = np.flatnonzero(n * SHINGLE >= LEAST * size)
    rich = rich[np.r_[True, last[rich[1:]] > last[rich[:-1]]]] if len(rich) else rich
    best = 0
    for i in rich[np.argsort(-n[rich], kind="stable")].tolist():
        best = max(best, stretch(p[i : last[i]], d[i : last[i]], words, h))
        if best >= SHARE * size:
            break
    return best / size


#: Words in a row that a held stretch may lack, and words from which stretches of one place count together: the longest
#: phrase that texts share by chance is shorter.
LACK, PHRASE = 2, 10


def stretch(p: np.ndarray, d: np.ndarray, words: np.ndarray, h: np.ndarray) -> int:
    """Words of the stretches of an item that shingles at the places p, with the distances d, and the words around them
    make up: of the longest, or of all that are longer than a phrase. A stretch never lacks more than LACK words in a
    row; single words that it lacks count as held. Along it words may be left out, not added."""
    size = len(words)
    values, which, count = np.unique(d, return_inverse=True, return_counts=True)
    order = np.lexsort((-count[which], p))  # of several distances at a place the most frequent
    order = order[np.r_[True, p[order][1:] != p[order][:-1]]]
    q, shift = p[order], d[order]
    held = np.zeros(size, bool)
    for k in range(SHINGLE):
        held[q + k] = True
    free = np.flatnonzero(~held)
    if len(free):
        k = np.searchsorted(q, free)
        for one in (shift[np.maximum(k - 1, 0)], shift[np.minimum(k, len(q) - 1)]):
            to = free + one
            inside = (to >= 0) & (to < len(h))
            held[free[inside]] |= h[to[inside]] == words[free[inside]]
        held[1:-1] |= held[:-2] & held[2:]
    at = np.flatnonzero(held)
    step, gap = np.diff(shift), np.maximum(np.diff(q) - SHINGLE, 0)
    part = np.r_[0, np.cumsum((step > 0) | (step < -gap))]  # words may be left out where some are missing, none added
    part = part[np.maximum(np.searchsorted(q, at, "right") - 1, 0)]
    cut = np.flatnonzero((np.diff(at) > LACK + 1) | (np.diff(part) > 0))
    n = np.diff(np.r_[0, cut + 1, len(at)])
    return int(max(n.max(), n[n >= PHRASE].sum()))


def search(texts: pa.Array, items: Items, exact: bool = False) -> list[tuple[int, int]]:
    """Row of the text and index of the item of every finding."""
    flat, bounds = K.points(texts)
    h, at, _ = K.words(flat)
    if not len(h):
        return []
    own = K.owner(at, bounds)
    found: set[tuple[int, int]] = set()
    for n, (value, tiny) in items.short.items():
        s = K.shingles(h, own, n)
        left, right = np.searchsorted(value, s, "left"), np.searchsorted(value, s, "right")
        for j in np.flatnonzero((right > left) & (s != 0)).tolist():
            found.update((int(own[j]), int(i)) for i in tiny[left[j] : right[j]])
    s3 = K.shingles(h, own, SHINGLE)
    sid = np.full(len(s3), -1)
    if len(items.vocabulary):
        maybe = np.flatnonzero(items.seen[(s3 & LOW).astype(np.int64)])
        place = np.minimum(np.searchsorted(items.vocabulary, s3[maybe]), len(items.vocabulary) - 1)
        right_ = (items.vocabulary[place] == s3[maybe]) & (s3[maybe] != 0)
        sid[maybe[right_]] = place[right_]
    hit = np.flatnonzero(sid >= 0)
    if not len(hit):
        return sorted(found)
    begins = np.searchsorted(own, np.arange(len(bounds)), "left")
    for begin, end, item in dense(sid, own, items, None if exact else candidates(s3, own, items)):
        for a, b, i in zip(begin.tolist(), end.tolist(), item.tolist()):
            doc = int(own[a])
            if (doc, i) in found:
                continue
            size = int(items.size[i])
            low, high = np.searchsorted(hit, (max(a - size, begins[doc]), min(b + size, begins[doc + 1])))
            if coverage(items.exact[i], items.words[i], hit[low:high], sid, h) >= SHARE:
                found.add((doc, i))
    return sorted(found)


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", exact: bool = False) -> DataFrame:
    """One row (doc_id, item_id) per document that holds at least SHARE of an item's passage, the last line of its text.

    The items are a stated query set held against all documents in blocks of BLOCK items; a block is what a worker
    holds, so its size does not grow with the data. exact: every window that has a shingle of an item is a candidate,
    so nothing is left to the chance of the MinHash values."""
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).alias("i"), F.element_at(F.split(F.rtrim(F.regexp_replace(text, r"\s+$", "")), "\n"), -1).alias("t")).where("t is not null and i is not null").orderBy("i", "t")
    out = None
    block: list = []

    def scan(chunk: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((tuple(r["i"] for r in chunk), tuple(r["t"] for r in chunk)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = index(*shared.value)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for a, b in K.slices(texts):
                    got = search(texts.slice(a, b - a), known, exact)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + d for d, _ in got], pa.int64())), pa.array([known.ids[i].item() for _, i in got], item_type)], names=[doc_id, item_id])

        return docs.select(doc_id, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{doc_id}` {doc_sort}, `{item_id}` {item_sort}")

    sorts = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    doc_sort, item_sort = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_type = sorts[item_sort]
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            out = scan(block) if out is None else out.unionByName(scan(block))
            block = []
    if block or out is None:
        out = scan(block) if out is None else out.unionByName(scan(block))
    return out
