"""Batches as padded rows.

Tall form (batch, uid, idx, value, is_pad) is the canonical result; arrays are built at the edge.

Defined results: null arrays count as empty and become padding only; a batch of empty arrays has no values; ids that
repeat within a batch stay separate rows of the array form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded(df: DataFrame, batch: str, values: str, pad: float | Column = 0.0, multiple: int = 1) -> DataFrame:
    """The array column padded to the longest of its batch, up to a multiple; with columns length and relative_length.

    The longest is found by a group-by that combines on the map side and is joined back."""
    n = F.coalesce(F.size(values), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    longest = df.groupBy(batch).agg(F.max(n).alias("_m"))
    target = (F.ceil(F.col("_m") / multiple) * multiple).cast("int")
    kind = df.schema[values].dataType.elementType
    out = df.join(longest, batch).withColumn("length", n).withColumn("_t", target)
    fill = F.array_repeat((pad if isinstance(pad, Column) else F.lit(pad)).cast(kind), (F.col("_t") - F.col("length")).cast("int"))
    out = out.withColumn(values, F.concat(F.coalesce(F.col(values), F.array().cast(df.schema[values].dataType)), fill))
    return out.withColumn("relative_length", F.try_divide(F.col("length").cast("double"), F.col("_t"))).drop("_m", "_t")


def padded_frames(df: DataFrame, batch: str, values: str, shape: tuple[int, ...], pad: float = 0.0, multiple: int = 1) -> DataFrame:
    """An array of frames padded to the longest of its batch, as padded does: frames of the given shape, (channels) for
    two dimensions or (width, height) for three, full of the padding value."""
    kind = df.schema[values].dataType.elementType
    frame = F.lit(pad)
    for n in reversed(shape):
        frame = F.array_repeat(frame, n)
    return padded(df, batch, values, frame.cast(kind), multiple)


def tall(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """(keys, idx, value, is_pad) of a padded column."""
    return df.select(*keys, "length", F.posexplode(values).alias("idx", "value")).withColumn("is_pad", F.col("idx") >= F.col("length")).drop("length")


def batches(df: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """One row per batch, its columns as arrays in the order; a batch is bounded by its size."""
    rows = F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order))))
    return df.groupBy(batch).agg(rows.alias("_rows")).select(batch, *(F.col("_rows")[c].alias(c) for c in columns))


def none_if_first_missing(a: Column) -> Column:
    """A stacked column, null if its first row has no value."""
    return F.when(F.get(a, F.lit(0)).isNotNull(), a)


def split_pairs(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows doubled with neighbours as one row again: values of the row and prompt_ values of its neighbour."""
    own = df.where("neighbor_idx = 1").select(key, *values)
    other = df.where("neighbor_idx = 0").select(key, *(F.col(v).alias(f"prompt_{v}") for v in values))
    return own.join(other, key)


def same_lengths(columns: list[Column]) -> Column:
    """Whether arrays of a row are equally long; nulls are left out."""
    first = F.coalesce(*(F.when(c.isNotNull(), F.size(c)) for c in columns))
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.size(c) == first, F.lit(True))
    return out


def float_arrays(a: Column) -> Column:
    return a.cast("array<float>")
