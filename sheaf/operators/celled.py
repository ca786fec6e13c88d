"""Ordered computations over entities of any size: lag, lead, running sums, filling and numbering.

A plain window over an entity sorts the whole entity in one task.  Here the order of an entity is cut into cells (for
example days of a time line); each task sorts one cell, and what a cell needs from the cells before it is found from a
pre-aggregated row per cell.

Defined results: null keys form an entity of their own; rows with a null order value come in cell null, first; ties in
the order are broken by the given tie columns; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = "_celled_cell"


def thousands(cell: Column) -> Column:
    """Coarser cells of numbered ones."""
    return F.floor(cell / 1000)


def carried(df: DataFrame, keys: list[str], summary: Column, kind: str, reverse: bool = False, upper: Callable[[Column], Column] | None = None) -> DataFrame:
    """df, which has the column CELL, with _celled_carry: the summaries of all earlier (later) cells folded into one.

    kind: sum; last, the nearest summary; known, the nearest that is not null. upper gives a coarser cell of a cell in
    the same order: the cells are then folded within the coarser ones, and these by one row each, so that neither step
    sees more rows than a task can have."""
    order = F.desc if reverse else F.asc
    fold = {"sum": F.sum, "last": F.last, "known": lambda c: F.last(c, ignorenulls=True)}[kind]
    cells = df.groupBy(*keys, CELL).agg(summary.alias("_s"))
    if upper is not None:
        cells = cells.withColumn("_u", upper(F.col(CELL)))
    within = Window.partitionBy(*keys, *(["_u"] if upper is not None else [])).orderBy(order(CELL)).rowsBetween(Window.unboundedPreceding, -1)
    folded = cells.withColumn("_celled_carry", fold("_s").over(within))

    def same(names: list[str]) -> Column:
        on = F.lit(True)
        for k in names:
            on = on & F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}"))
        return on

    if upper is not None:
        last = F.min_by if reverse else F.max_by
        whole = F.sum("_s") if kind == "sum" else last("_s", F.when(F.col("_s").isNotNull(), F.col(CELL)))
        over = Window.partitionBy(*keys).orderBy(order("_u")).rowsBetween(Window.unboundedPreceding, -1)
        tops = cells.groupBy(*keys, "_u").agg(whole.alias("_s")).withColumn("_above", (F.sum if kind == "sum" else lambda c: F.last(c, ignorenulls=True))("_s").over(over))
        both = F.coalesce(F.col("_l._celled_carry") + F.col("_r._above"), "_l._celled_carry", "_r._above") if kind == "sum" else F.coalesce("_l._celled_carry", "_r._above")
        folded = folded.alias("_l").join(tops.alias("_r"), same([*keys, "_u"])).select(*(F.col(f"_l.{k}") for k in [*keys, CELL]), both.alias("_celled_carry"))
    return df.alias("_l").join(folded.alias("_r"), same([*keys, CELL])).select("_l.*", "_r._celled_carry")


def even(df: DataFrame, keys: list[str], most: int) -> bool:
    """Whether no entity has more than so many rows."""
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return largest is None or largest <= most


def lag(df: DataFrame, keys: list[str], order: list[str], cell: Column, values: dict[str, str], reverse: bool = False, upper=None) -> DataFrame:
    """The values of the row before (reverse: after); values: new column -> old column."""
    whole = F.struct(*(F.col(v).alias(n) for n, v in values.items()))
    edge = (F.min_by if reverse else F.max_by)(whole, F.struct(*order))
    rows = carried(df.withColumn(CELL, cell), keys, edge, "last", reverse, upper)
    w = Window.partitionBy(*keys, CELL).orderBy(*order)
    near = (F.lead if reverse else F.lag)(whole).over(w)
    out = rows.withColumn("_celled_near", F.coalesce(near, F.col("_celled_carry")))
    return out.select(*df.columns, *(F.col(f"_celled_near.{n}").alias(n) for n in values))


def lead(df: DataFrame, keys: list[str], order: list[str], cell: Column, values: dict[str, str]) -> DataFrame:
    return lag(df, keys, order, cell, values, reverse=True)


def running_sum(df: DataFrame, keys: list[str], order: list[str], cell: Column, value: Column, name: str, upper=None, most: int = 0) -> DataFrame:
    """Sum of the value over all rows up to this one. most: entities of at most so many rows are not cut into cells; that
    all are is counted first."""
    if most and even(df, keys, most):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0).cast("bigint"))).select(*df.columns, name)
    rows = carried(df.withColumn("_celled_value", value).withColumn(CELL, cell), keys, F.sum("_celled_value"), "sum", upper=upper)
    w = Window.partitionBy(*keys, CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce(F.sum("_celled_value").over(w), F.lit(0).cast("bigint")) + F.coalesce(F.col("_celled_carry"), F.lit(0).cast("bigint"))
    return rows.withColumn(name, total).select(*df.columns, name)


def numbered(df: DataFrame, keys: list[str], order: list[str], cell: Column, name: str = "pos", upper=None) -> DataFrame:
    """Place of each row within its entity, from 1."""
    return running_sum(df, keys, order, cell, F.lit(1).cast("bigint"), name, upper)


def filled(df: DataFrame, keys: list[str], order: list[str], cell: Column, value: str, name: str, reverse: bool = False, upper=None) -> DataFrame:
    """The last value that is not null up to this row (reverse: the next)."""
    some = F.when(F.col(value).isNotNull(), F.struct(*order))
    edge = (F.min_by if reverse else F.max_by)(F.col(value), some)
    rows = carried(df.withColumn(CELL, cell), keys, edge, "known", reverse, upper)
    w = Window.partitionBy(*keys, CELL).orderBy(*order)
    near = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if reverse else F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(near, F.col("_celled_carry"))).select(*df.columns, name)
