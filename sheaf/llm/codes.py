"""Vectorised text kernels on code points: whole Arrow batches of texts become one array, so that words, shingles and
line statistics of millions of characters cost a few array operations instead of Python work per word.

Every kernel takes a slice of texts of bounded total length (SLICE characters, or one text if that alone is longer).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled at once, a bound on the memory of a task; a longer single text is handled alone.
SLICE = 1_000_000
OTHER, LOWER, UPPER, LETTER, DIGIT, SPACE, LINE, STOP, PUNCT, MARK, FORMAT, CJK = range(12)
STOPS = ".!?…。！？｡．।॥"
PUNCTS = "[],;:'\"-()（）“”„‘’«»‹›「」『』，；：、—–¿¡·"
P1, P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _is_cjk(c: int) -> bool:
    return 0x3040 <= c <= 0x30FF or 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0xFF66 <= c <= 0xFF9F or 0x2F00 <= c <= 0x2FDF


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and folded form of each code point of the basic plane; folding drops case, accents, width and invisible
    signs (form 0: dropped)."""
    kind = np.zeros(0x10000, np.uint8)
    fold = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if 0xD800 <= c <= 0xDFFF or 0xE000 <= c <= 0xF8FF:
            continue
        x = chr(c)
        cat = unicodedata.category(x)
        if x == "\n":
            kind[c] = LINE
        elif x in STOPS:
            kind[c] = STOP
        elif x in PUNCTS:
            kind[c] = PUNCT
        elif cat[0] == "Z" or x in "\t\r\v\f":
            kind[c] = SPACE
        elif cat in ("Cf", "Cc"):
            kind[c] = FORMAT
            fold[c] = 0
        elif cat[0] == "M":
            kind[c] = MARK
        elif cat[0] == "N":
            kind[c] = DIGIT
        elif cat[0] == "L":
            kind[c] = CJK if _is_cjk(c) else LOWER if cat == "Ll" else UPPER if cat == "Lu" else LETTER
        if cat[0] in "LNM":
            parts = [y for y in unicodedata.normalize("NFKD", x).lower() if unicodedata.combining(y) == 0]
            fold[c] = ord(parts[0]) if parts and ord(parts[0]) < 0x10000 else 0
    return kind, fold


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most SLICE characters together."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > SLICE:
            yield at, i
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield at, len(sizes)


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, a line end after each, and where each text begins (and the end)."""
    parts = texts.to_pylist()
    flat = np.frombuffer("\n".join([t or "" for t in parts] + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t or "") + 1 for t in parts), np.int64, len(parts))
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def classes(flat: np.ndarray) -> np.ndarray:
    """Class of each code point; beyond the basic plane Han is CJK, all else OTHER."""
    kind, _ = tables()
    out = kind[np.minimum(flat, 0xFFFF)]
    big = flat > 0xFFFF
    if big.any():
        out[big] = np.where((flat[big] >= 0x20000) & (flat[big] < 0x40000), CJK, OTHER)
    return out


def words(flat: np.ndarray, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (Han and kana: characters) in folded form, with the place of their first character
    and how many letters or digits they have. Case, accents, width and invisible signs do not change a hash."""
    kinds = classes(flat) if kinds is None else kinds
    _, fold = tables()
    folded = np.where(flat <= 0xFFFF, fold[np.minimum(flat, 0xFFFF)], flat)
    inner = (kinds == LOWER) | (kinds == UPPER) | (kinds == LETTER) | (kinds == DIGIT) | (kinds == CJK) | (kinds == MARK)
    keep = ~((folded == 0) | (kinds == FORMAT))  # dropped signs neither join nor part words
    where = np.flatnonzero(keep)
    c, k, w = folded[where].astype(np.uint64), kinds[where], inner[where]
    if not len(where):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    cjk = k == CJK
    first = w.copy()
    first[1:] &= ~w[:-1] | cjk[1:] | cjk[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    within = np.arange(len(c)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    with np.errstate(over="ignore"):
        mixed = (c + np.uint64(1)) * P1
        mixed ^= mixed >> np.uint64(29)
        mixed *= _powers()[within & 1023]
        mixed[~w] = 0
        h = np.add.reduceat(mixed, starts)
        h ^= h >> np.uint64(31)
        h *= P2
    return h, where[starts], np.add.reduceat(w.astype(np.int64), starts)


@cache
def _powers() -> np.ndarray:
    out = np.empty(1024, np.uint64)
    x, p = 1, int(P2) | 1
    for i in range(1024):
        out[i] = x
        x = x * p & 0xFFFFFFFFFFFFFFFF
    return out


def owner(places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which text each place lies in."""
    return np.searchsorted(bounds, places, "right") - 1


def shingles(hashes: np.ndarray, texts: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; 0 where the text ends before."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    if n < k:
        return out
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = h * P1 + hashes[j : n - k + 1 + j]
            h ^= h >> np.uint64(32)
        h *= P2
    h[h == 0] = 1
    out[: n - k + 1] = np.where(texts[: n - k + 1] == texts[k - 1 :], h, np.uint64(0))
    return out
