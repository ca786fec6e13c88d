"""Splitting oversized items at natural boundaries (problem 3).

Method: content-defined chunking. Landmarks are places where a rolling hash of the content has some zero bits; each
piece ends at the natural boundary nearest to the first landmark beyond the least size, so that an edit moves only the
cuts near it. Natural boundaries are the ends of the sentence units of a text, and pauses of a transcription.

A piece never exceeds the maximal size, its overlap with the piece before included. Each piece begins the given overlap
before the end of the piece before. Only where the full overlap would force a cut inside a unit that fits alone, it
shrinks, to nothing at least, and at most to white space between the units that no piece has; only a unit that alone
exceeds the maximal size is cut inside ('hard'), at the last landmark that fits, so that these cuts too move with the
content.

Defined results: null and small items give no piece; texts without any boundary are cut hard; a null bound of an entry
is no pause; repeated rows give repeated pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sentences

WINDOW = 16  # elements that the rolling hash sees
LEAST = 1 / 3  # least size of new content, as a share of the maximal size
KINDS = 1000  # kinds of items that a limit table may have


@dataclass(frozen=True)
class Limit:
    max_size: int
    overlap: int
    min_pause: float | None


def limits(table: DataFrame) -> dict[str, Limit]:
    """The rows of the size_limit table; one row per kind of item, so a handful."""
    rows = table.limit(KINDS + 1).collect()
    if len(rows) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of items")
    return {r["item"]: Limit(r["max_size"], r["overlap"], r["min_pause"]) for r in rows}


def landmarks(content: np.ndarray, bits: int) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW elements has zero low bits."""
    with np.errstate(over="ignore"):
        x = (content.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        h = np.zeros(len(x), np.uint64)
        for k in range(WINDOW):
            h[k:] += x[: len(x) - k] * np.uint64((2 * pow(31, k) + 1) & 0xFFFFFFFFFFFFFFFF)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return np.flatnonzero((h >> np.uint64(64 - bits)) == 0) + 1


def pieces(spans: list[tuple[int, int]], marks: np.ndarray, limit: Limit) -> list[tuple[int, int, bool]]:
    """Begin, end and whether the end is inside a unit, of the pieces of an item with the given natural units."""
    ends = np.array([e for _, e in spans])
    least = max(1, int(limit.max_size * LEAST))
    first, last = int(spans[0][0]), int(ends[-1])
    out: list[tuple[int, int, bool]] = []
    done = first  # where the piece before ended
    while True:
        start = max(done - limit.overlap, out[-1][0] + 1) if out else first
        room = start + limit.max_size
        if last <= room:
            out.append((start, last, False))
            return out
        near = ends[np.searchsorted(ends, done, "right") : np.searchsorted(ends, room, "right")]
        fit = marks[np.searchsorted(marks, done + least) : np.searchsorted(marks, room, "right")]
        hard = False
        if len(near):
            wanted = near[near >= done + least]
            some = wanted if len(wanted) else near[-1:]
            aim = int(fit[0]) if len(fit) else room
            cut = int(some[np.abs(some - aim).argmin()])
        else:
            k = int(np.searchsorted(ends, done, "right"))
            cut = int(ends[k])
            if cut - spans[k][0] <= limit.max_size:
                start = max(start, cut - limit.max_size)
            else:
                cut, hard = int(fit[-1]) if len(fit) else room, True
        out.append((start, cut, hard))
        if cut >= last:
            return out
        done = cut


def text_pieces(df: DataFrame, limit: Limit, key: str = "source_id", text: str = "text", ev: sentences.Evidence | DataFrame | None = None) -> DataFrame:
    """Pieces (key, piece, begin, end, hard), in code points, of the texts over the limit."""
    bits = max(1, int(np.log2(max(2, limit.max_size / 3))))

    def one(t: str, known: sentences.Evidence) -> list[tuple[int, int, bool]]:
        spans = sentences.units(t, known) or [(0, len(t))]
        return pieces(spans, landmarks(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), bits), limit)

    def of(keys: pa.Array, texts: list[str], known: Iterator[sentences.Evidence]) -> pa.RecordBatch:
        return rows(key, keys, map(one, texts, known))

    over = df.select(key, text).where(F.char_length(text) > limit.max_size)
    return sentences.with_known(over, key, text, sentences.gather(df, text) if ev is None else ev, of, schema(df, key))


def entry_pieces(df: DataFrame, limit: Limit, key: str = "source_id", entries: str = "transcription.timestamps") -> DataFrame:
    """Pieces (key, piece, begin, end, hard), in entries, of the transcriptions over the limit."""
    bits = max(1, int(np.log2(max(2, limit.max_size / 3))))
    pause = round((limit.min_pause or 0.0) * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, b, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                begin, end = np.array(b, float), np.array(e, float)
                gap = np.round((begin[1:] - end[:-1]) * 1e6)
                cut = np.flatnonzero(gap >= pause) + 1  # a null bound makes the gap NaN, no pause
                edge = [0, *cut.tolist(), len(begin)]
                found.append(pieces(list(zip(edge[:-1], edge[1:])), landmarks(np.array(h, np.int64).view(np.uint64), bits), limit))
            yield rows(key, batch.column(0), found)

    at = F.col(entries)
    over = df.select(key, at.alias("x")).where(F.size("x") > limit.max_size)
    hashes = F.transform(F.col("x")["word"], lambda w: F.xxhash64(F.coalesce(w, F.lit(""))))
    return over.select(key, hashes.alias("h"), F.col("x")["begin"].alias("b"), F.col("x")["end"].alias("e")).mapInArrow(run, schema(df, key))


def schema(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, begin int, end int, hard boolean"


def rows(key: str, ids: pa.Array, found) -> pa.RecordBatch:
    which, piece, begin, end, hard = [], [], [], [], []
    for i, got in enumerate(found):
        for k, (b, e, h) in enumerate(got):
            which.append(i)
            piece.append(k)
            begin.append(b)
            end.append(e)
            hard.append(h)
    arrays = [ids.take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(hard, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, names=[key, "piece", "begin", "end", "hard"])


def cuts(found: DataFrame, field: str, key: str = "source_id") -> DataFrame:
    """One row per item: how it was cut. The pieces of an item lie in one task, so the grouping shuffles one row each."""
    return found.groupBy(key).agg(F.max("hard").alias("hard")).select(key, F.lit(field).alias("field"), F.when(F.col("hard"), "hard").otherwise("soft").alias("cut"))
