"""Global order: numbering, head, shuffle, splits, sequential batches; none of them sorts all rows in one task.

A table is numbered over the key id: ids fall into cells of `width` ids; the cells are counted, their running counts
are found over one row per cell, in two levels, and each task orders one cell.

Defined results: ids should be unique, else equal rows come in any order; a null id comes first; an empty table gives
an empty table; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import celled

WIDTH = 50_000


def positions(df: DataFrame, key: str, lead: list[str] | None = None, name: str = "pos", width: int = WIDTH) -> DataFrame:
    """Number of each row, from 1, in the order of the lead columns (few values, or as many as cells may be) and key."""
    ids = F.floor(F.col(key) / width)
    if lead:  # cells of ids within each value of the lead columns
        return celled.numbered(df, [], [*lead, key], F.struct(*lead, ids.alias("_id")), name, upper=lambda c: F.struct(*(c[x].alias(x) for x in lead)))
    return celled.numbered(df, [], [key], ids, name, upper=celled.thousands)


def total(df: DataFrame) -> Column:
    """Number of rows of a table, as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def shuffle_key(key: str, seed: int) -> Column:
    """A column whose order is a repeatable shuffle."""
    return F.xxhash64(F.col(key), F.lit(seed))


def fraction_split(df: DataFrame, key: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with the subsets they fall in, by cut points of the order: from min(trunc(n a), n - 1) to trunc(n b). Bounds
    may overlap, then a row comes once per subset; the last subset of a table that is not empty is never empty."""
    rows = positions(df, key, name="_pos").withColumn("_n", total(df.select(key)))
    parts = F.array(*(F.when((F.col("_pos") - 1 >= F.least(F.floor(F.col("_n") * a), F.col("_n") - 1)) & (F.col("_pos") - 1 < F.floor(F.col("_n") * b)), F.lit(s)) for s, (a, b) in bounds.items()))
    return rows.withColumn("subset", F.explode(F.array_compact(parts))).drop("_pos", "_n")


def header_split(df: DataFrame, key: str, line: str) -> DataFrame:
    """Lines under [NAME] header lines: each line with the name of the header above it; lines before any have null."""
    head = F.regexp_extract(F.trim(F.col(line)), r"^\[([^\]|]+)\]$", 1)
    rows = df.withColumn("_head", F.when(head != "", head))
    return celled.filled(rows, [], [key], F.floor(F.col(key) / WIDTH), "_head", "subset", upper=celled.thousands).where("_head is null").drop("_head")


def sequential_batches(df: DataFrame, key: str, size: int, lead: list[str] | None = None) -> DataFrame:
    """batch_id from 0, row_in_batch from 0, is_last."""
    rows = positions(df, key, lead, "_pos")
    last = F.floor((total(df.select(key)) - 1) / size)
    out = rows.withColumn("batch_id", F.floor((F.col("_pos") - 1) / size)).withColumn("row_in_batch", F.pmod(F.col("_pos") - 1, F.lit(size)))
    return out.withColumn("is_last", F.col("batch_id") == last).drop("_pos")


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows in key order (a head is the feature here); only n rows a task are kept."""
    return df.orderBy(key).limit(n)


def full_batches(df: DataFrame, batch: str, size: int, least: int | None = None) -> DataFrame:
    """Rows of batches that have the full size, or at least so many rows."""
    n = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= (least or size)).select(batch)
    return df.join(n, batch, "left_semi")
