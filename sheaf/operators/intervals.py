"""Overlapping and gapped intervals: continuous periods and the gaps between them (problem 5).

Method: starts and ends are sorted independently per entity. Between the i-th smallest end and the (i+1)-th smallest
start lies a gap exactly if that start exceeds that end; the boundaries on both sides of the gaps give the periods.

Defined results: intervals with a null bound and intervals whose begin is not before their end are ignored; touching
intervals form one period; entities without a valid interval give no row; repeated intervals change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(intervals: Column, scale: float = 1000.0) -> tuple[Column, Column]:
    """Sorted starts and sorted ends, in whole units of 1/scale, of the valid elements of an array of (begin, end)."""
    whole = F.transform(intervals, lambda x: F.struct(F.round(x["begin"] * scale).cast("long").alias("b"), F.round(x["end"] * scale).cast("long").alias("e")))
    valid = F.filter(whole, lambda x: x["b"] < x["e"])
    return F.array_sort(valid["b"]), F.array_sort(valid["e"])


def array_gaps(starts: Column, ends: Column) -> Column:
    """Gaps, as an array of (begin, end), from sorted starts and sorted ends."""
    n = F.size(starts)
    pairs = F.zip_with(F.slice(ends, 1, F.greatest(n - 1, F.lit(0))), F.slice(starts, 2, F.greatest(n - 1, F.lit(0))), lambda e, s: F.struct(e.alias("begin"), s.alias("end")))
    return F.filter(pairs, lambda g: g["end"] > g["begin"])


def array_periods(starts: Column, ends: Column) -> Column:
    """Continuous periods, as an array of (begin, end): from the first start over the gaps to the last end."""
    gaps = array_gaps(starts, ends)
    first = F.concat(F.slice(starts, 1, 1), gaps["end"])
    last = F.concat(gaps["begin"], F.slice(ends, -1, 1))
    return F.when(F.size(starts) > 0, F.arrays_zip(first.alias("begin"), last.alias("end"))).otherwise(F.array().cast("array<struct<begin:bigint,end:bigint>>"))


def tier_gaps(df: DataFrame, key: str, tiers: dict[str, Column], scale: float = 1000.0) -> DataFrame:
    """One row (key, tier, begin_ms, end_ms) per gap of each array column; rows delivered again count once.

    The whole computation is within a row; only the gaps of rows that come more than once would repeat, so the only
    shuffle is that of the found gaps."""
    return _by_tier(df, key, tiers, scale, array_gaps)


def tier_periods(df: DataFrame, key: str, tiers: dict[str, Column], scale: float = 1000.0) -> DataFrame:
    """One row (key, tier, begin_ms, end_ms) per continuous period of each array column; computed as the gaps are."""
    return _by_tier(df, key, tiers, scale, array_periods)


def _by_tier(df: DataFrame, key: str, tiers: dict[str, Column], scale: float, spans) -> DataFrame:
    parts = []
    for name, arr in tiers.items():
        starts, ends = bounds(arr, scale)
        parts.append(F.struct(F.lit(name).alias("tier"), starts.alias("s"), ends.alias("e")))
    sorted_ = df.select(key, F.explode(F.array(*parts)).alias("t"))
    found = sorted_.select(key, F.col("t.tier").alias("tier"), F.explode(spans(F.col("t.s"), F.col("t.e"))).alias("g"))
    return found.select(key, "tier", F.col("g.begin").alias("begin_ms"), F.col("g.end").alias("end_ms")).distinct()


def tall_gaps(df: DataFrame, keys: list[str], begin: str, end: str, width: float) -> DataFrame:
    """Gaps of entities whose intervals are rows: (keys, begin, end).

    An entity may hold any share of all rows: its time axis is cut into cells of the given width, so that a task sorts
    one cell of one entity, never a whole entity. How far the earlier cells of an entity reach is a running maximum
    over one row per cell, found by a pre-aggregated maximum."""
    valid = df.select(*keys, F.col(begin).alias("b"), F.col(end).alias("e")).where("b < e").withColumn("cell", F.floor(F.col("b").cast("double") / width))
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = valid.groupBy(*keys, "cell").agg(F.max("e").alias("last")).withColumn("carry", F.max("last").over(before)).drop("last")
    on = [F.col(f"v.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys] + [F.col("v.cell") == F.col("c.cell")]
    rows = valid.alias("v").join(carry.alias("c"), on).select("v.*", "c.carry")
    in_cell = Window.partitionBy(*keys, "cell").orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max("e").over(in_cell), F.col("carry"))  # greatest skips nulls
    return rows.withColumn("reach", reach).where("b > reach").select(*keys, F.col("reach").alias("begin"), F.col("b").alias("end"))
