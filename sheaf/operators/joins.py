"""Look-ups, interval joins, nearest neighbours and pairings.

Defined results: null keys match nothing; unknown names get id 0 and is_known false; ties of a nearest search go to the
smaller name or id; empty sides give what the join type says; clashing extra columns are not taken from the right side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let
from .blocks import Blocks

#: Rows of a side up to which it is sent to all executors; beyond it is joined by shuffle or handled in blocks.
SMALL = 100_000


#: Bytes, as text, of the same.
SMALL_BYTES = 50_000_000


def small(df: DataFrame, bound: int = SMALL) -> DataFrame:
    """The table with a broadcast hint if, counted, it has at most so many rows and SMALL_BYTES bytes."""
    some = df.limit(bound + 1).select(F.octet_length(F.to_json(F.struct(*df.columns))).cast("bigint").alias("b"))
    n, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= bound and size <= SMALL_BYTES else df


def dense_ids(names: DataFrame, column: str, extra: list[str] | None = None) -> DataFrame:
    """Distinct names with ids from 0 in name order; extra names get ids too. The number of names is that of speakers
    or languages; ids come from one row per name."""
    found = names.select(F.col(column).alias("name")).where("name is not null")
    if extra:
        found = found.unionByName(names.sparkSession.createDataFrame([(x,) for x in extra], "name string"))
    w = Window.orderBy("name")
    return found.distinct().select("name", (F.row_number().over(w) - 1).alias("id"))


def with_ids(df: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """The id of the name in a column; unknown or null: 0, is_known false."""
    r = small(ids).alias("_r")
    out = df.alias("_l").join(r, F.col(f"_l.{column}") == F.col("_r.name"), "left")
    return out.select("_l.*", F.coalesce(F.col("_r.id"), F.lit(0)).alias(name), F.col("_r.id").isNotNull().alias("is_known"))


def look_up(df: DataFrame, dim: DataFrame, keys: list[str], values: list[str], how: str = "inner") -> DataFrame:
    """Values of a dimension by one or more keys."""
    return df.join(small(dim.select(*keys, *values)), keys, how)


def inside(inner: Column, outer: Column, tolerance: float = 0.0) -> Column:
    """Pairs (inner_pos, outer_pos) of two arrays of (begin, end), the inner interval within the outer one; all in the row."""

    def pairs(numbered: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            near = F.filter(numbered, lambda y: (x["begin"] >= y["begin"] - tolerance) & (x["end"] <= y["end"] + tolerance))
            return F.transform(near, lambda y: F.struct(i.alias("inner_pos"), y["pos"].alias("outer_pos")))

        return F.flatten(F.transform(inner, one))

    return let(F.transform(outer, lambda y, j: F.struct(j.alias("pos"), y["begin"].alias("begin"), y["end"].alias("end"))), pairs)


def contained(inner: DataFrame, outer: DataFrame, key: str, tolerance: float = 0.0) -> DataFrame:
    """Pairs of intervals (begin, end) of the same key, the inner one within the outer one, for intervals that are rows
    with columns key, pos, begin, end. An outer interval lies in the one or two cells of time of its own order of length
    (powers of two), and an inner one looks into the cells of the orders that its key has; so a key of many rows is
    spread, and one long interval does not make the cells of the others wide."""
    length = F.greatest(F.col("oe") - F.col("ob"), F.lit(1e-3))
    o = outer.select(key, F.col("pos").alias("outer_pos"), F.col("begin").alias("ob"), F.col("end").alias("oe")).where("ob <= oe")
    o = o.withColumn("_g", F.ceil(F.log2(length)).cast("int"))
    orders = o.groupBy(key).agg(F.collect_set("_g").alias("_orders"))  # some dozens at most
    cell = lambda t, g: F.floor(t / F.pow(F.lit(2.0), g))
    o = o.withColumn("_c", F.explode(F.sequence(cell(F.col("ob") - tolerance, F.col("_g")), cell(F.col("oe") + tolerance, F.col("_g")))))
    i = inner.select(key, F.col("pos").alias("inner_pos"), F.col("begin").alias("ib"), F.col("end").alias("ie")).join(orders, key)
    i = i.withColumn("_g", F.explode("_orders")).withColumn("_c", cell(F.col("ib"), F.col("_g"))).drop("_orders")
    near = (F.col("ib") >= F.col("ob") - tolerance) & (F.col("ie") <= F.col("oe") + tolerance)
    return i.join(o, [key, "_g", "_c"]).where(near).select(key, "inner_pos", "outer_pos").distinct()


def nearest(df: DataFrame, vector: str, centres: DataFrame, name: str = "name", centre: str = "centre", block: int = 4096) -> DataFrame:
    """The nearest centre of each vector, with the Euclidean distance, exactly. The centres are written to the shared
    folder and gone through in blocks; each is compared in matrix form and the best over the blocks is kept."""
    some = centres.select(F.col(name).alias("name"), F.col(centre).cast("array<double>").alias("centre")).where("name is not null and centre is not null")
    blocks = Blocks(some.repartitionByRange("name").sortWithinPartitions("name"), block)
    sort = some.schema["name"].dataType.simpleString()
    kind = pa.string() if sort == "string" else pa.int64()
    other = [c for c in df.columns if c not in ("nearest", "nearest_distance")]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(other.index(vector))
            live = [i for i, x in enumerate(v.to_pylist()) if x is not None]
            best = np.full(len(v), np.inf)
            who: list = [None] * len(v)
            if live:
                x = np.array(v.take(pa.array(live)).to_pylist(), np.float64)
                for b in blocks:
                    names, c = b.column(0).to_pylist(), matrix(b.column(1))
                    d = np.sqrt(np.maximum(((x[:, None, :] - c[None]) ** 2).sum(2), 0)) if len(c) * len(x) < 200_000 else np.stack([np.sqrt(((x - y) ** 2).sum(1)) for y in c], 1)
                    k = d.argmin(1)
                    for r, i in enumerate(live):
                        if (d[r, k[r]], names[k[r]]) < (best[i], names[k[r]] if who[i] is None else who[i]):
                            best[i], who[i] = d[r, k[r]], names[k[r]]
            mask = np.isinf(best)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(who, kind), pa.array(np.where(mask, 0, best), pa.float64(), mask=mask)], names=[*other, "nearest", "nearest_distance"])

    return df.select(*other).mapInArrow(run, f"{fields}, nearest {'string' if sort == 'string' else 'bigint'}, nearest_distance double")


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


#: Vectors that a task compares with each block of queries, and queries whose best rows it keeps to its end.
CHUNK, BEST = 50_000, 200_000


def top_similar(df: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """For each row of a stated query set, the k most similar other rows of the table by cosine, exactly: (query_id, key,
    similarity, rank). The queries are written to the shared folder; each task holds some rows of the table and goes
    through the queries block by block, in one pass over the table. Each task gives k rows a query, so only those are
    shuffled; with more than BEST queries it gives them for every CHUNK rows that it read."""
    some = lambda d: d.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    blocks = Blocks(some(queries), block)

    def unit(vectors: pa.Array) -> np.ndarray:
        x = matrix(vectors)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def best(s: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if s.shape[1] > 8 * k:  # all that reach the k-th value, ties included
            least = np.round(np.partition(s, -k, 1)[:, -k], 9)
            most = int((np.round(s, 9) >= least[:, None]).sum(1).max())
            part = np.argpartition(-np.round(s, 9), min(most, s.shape[1] - 1), 1)[:, :most]
            s, i = np.take_along_axis(s, part, 1), np.take_along_axis(i, part, 1)
        order = np.lexsort((i, -np.round(s, 9)))[:, :k]
        return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def given(own: np.ndarray, s: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        r, c = np.nonzero(np.isfinite(s))
        return pa.RecordBatch.from_arrays([pa.array(own[r], pa.int64()), pa.array(i[r, c], pa.int64()), pa.array(s[r, c], pa.float64())], names=["query_id", key, "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = blocks.rows() <= BEST
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def compared(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(part).combine_chunks()
            if not table.num_rows:
                return
            ids, x = table.column(0).to_numpy(), unit(table.column(1).combine_chunks())
            for b, q in enumerate(blocks):
                own = q.column(0).to_numpy()
                s = unit(q.column(1)) @ x.T
                s[own[:, None] == ids[None]] = -np.inf
                i = np.broadcast_to(ids, s.shape)
                if keep and b in kept:
                    s, i = np.hstack([kept[b][1], s]), np.hstack([kept[b][2], i])
                s, i = best(s, i)
                if keep:
                    kept[b] = own, s, i
                else:
                    yield given(own, s, i)

        part: list[pa.RecordBatch] = []
        for batch in batches:
            part.append(batch)
            if sum(p.num_rows for p in part) >= CHUNK:
                yield from compared(part)
                part = []
        if part:
            yield from compared(part)
        for own, s, i in kept.values():
            yield given(own, s, i)

    out = some(df).mapInArrow(run, f"query_id bigint, `{key}` bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbour_pairs(df: DataFrame, key: str, first: str, second: str, seed: int = 0) -> DataFrame:
    """For each row another row that shares the first index, else the second, else itself: (key, neighbour).

    The draw is repeatable: rows of an index value stand in a ring in hash order, and the neighbour is the next one. A
    value that many rows share is cut into rings by hash, so that no task holds a whole value."""
    from .samplers import uniform

    out = df.select(key, first, second)
    for n, k in (("_a", first), ("_b", second)):
        size = df.groupBy(k).agg(F.count(F.lit(1)).alias("_size"))
        rings = F.greatest(F.lit(1), F.floor(F.col("_size") / RING))
        ring = out.join(size, k, "left").withColumn("_ring", F.when(F.col(k).isNotNull(), F.floor(uniform(F.col(key), seed + 1) * rings)))
        w = Window.partitionBy(k, "_ring").orderBy(uniform(F.col(key), seed), key)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        next_ = F.coalesce(F.lead(key).over(w), F.first(key).over(whole))
        other = F.when(F.col(k).isNotNull() & (next_ != F.col(key)), next_)
        out = ring.withColumn(n, other).drop("_size", "_ring")
    return out.select(key, F.coalesce("_a", "_b", key).alias("neighbour"))


RING = 1000


def zipped(a: DataFrame, b: DataFrame, key: str, order_a: list[str], order_b: list[str], value: str, cell: Column) -> DataFrame:
    """Rows of a with the value of b at the same ordinal of the same key; missing ones null. cell: what the order of
    both sides is cut by, so that a key of many rows is numbered in parts."""
    from . import celled

    x = celled.numbered(a, [key], order_a, cell, "ordinal")
    y = celled.numbered(b, [key], order_b, cell, "ordinal").select(key, "ordinal", value)
    return x.join(y, [key, "ordinal"], "left")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, cell: Column, upper=None) -> DataFrame:
    """The last right value at or before the time of each left row (extension). Both sides are put in one order and the
    value is carried forward over cells of time; nothing is joined."""
    from . import celled

    l_cols = left.columns
    both = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(*keys, time, F.lit(0).alias("_side"), F.col(value).alias("_value")), allowMissingColumns=True
    )
    out = celled.filled(both, keys, [time, "_side"], cell, "_value", "_as_of", upper=upper)
    return out.where("_side = 1").select(*l_cols, F.col("_as_of").alias(f"as_of_{value}"))


def marked_starts(units: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Units (key, pos, begin, ..) with group, the number of the group that they stand in: a group begins with the unit
    that has the same begin, in microseconds."""
    us = F.round(F.col("begin") * 1e6).cast("bigint")
    starts = groups.select(key, us.alias("_us")).distinct().withColumn("_start", F.lit(1))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = units.withColumn("_us", us).join(starts, [key, "_us"], "left")
    return out.withColumn("group", F.coalesce(F.sum("_start").over(w), F.lit(0)) - 1).drop("_us", "_start")
