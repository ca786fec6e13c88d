"""Filters, predicates and projections of sample metadata.

Defined results: a null path or value passes no include filter and no band; it passes an exclude filter (it contains
nothing); null keys are never members of a list; empty inputs give empty outputs; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let


def include(path: Column, parts: list[str]) -> Column:
    """Whether the path contains any of the parts."""
    return F.coalesce(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(path, p)), F.lit(False))


def exclude(path: Column, parts: list[str]) -> Column:
    """Whether the path contains none of the parts."""
    return ~include(path, parts)


def without_label(line: Column, separator: str = "|") -> Column:
    """The part of a manifest line before its label."""
    return F.trim(F.split_part(line, F.lit(separator), F.lit(1)))


def band(df: DataFrame, value: Column, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose value is in the closed band; a bound that is not given does not bind."""
    inside = value.isNotNull()
    if low is not None:
        inside = inside & (value >= low)
    return df.where(inside & (value <= high) if high is not None else inside)


def unit_outliers(units: Column, low: float | None, high: float | None, strict: bool = False) -> Column:
    """Whether the unit lengths of a sample are in bounds. By default the upper check replaces the lower one where both
    are given; strict demands both. No units: in bounds."""
    longest, shortest = F.coalesce(F.array_max(units) < F.lit(high), F.lit(True)), F.coalesce(F.array_min(units) > F.lit(low), F.lit(True))
    if low is not None and high is not None:
        return shortest & longest if strict else longest
    return longest if high is not None else shortest if low is not None else F.lit(True)


def neighbour_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of other rows that share a key value, over all keys together, as column neighbours. Counts are
    pre-aggregated, so a value that half of all rows have is one row of the joined side."""
    out = df
    for k in keys:
        n = df.groupBy(k).agg((F.count(F.lit(1)) - 1).alias(f"_n_{k}")).withColumnRenamed(k, f"_{k}")
        out = out.join(n, out[k].eqNullSafe(n[f"_{k}"]), "left").drop(f"_{k}")
    return out.withColumn("neighbours", sum((F.col(f"_n_{k}") for k in keys[1:]), F.col(f"_n_{keys[0]}"))).drop(*(f"_n_{k}" for k in keys))


def has_tag(tags: Column, none: int = -1) -> Column:
    """Whether any element is a tag (not null, not the sign for none)."""
    return F.coalesce(F.exists(tags, lambda t: t.isNotNull() & (t != none)), F.lit(False))


def members(df: DataFrame, key: str, allowed: DataFrame, column: str) -> DataFrame:
    """Rows whose key is in a column of another table."""
    return df.join(allowed.select(F.col(column).alias(key)).distinct(), key, "left_semi")


def strangers(df: DataFrame, key: str, blocked: DataFrame, column: str) -> DataFrame:
    """Rows whose key is not in a column of another table; rows with a null key stay."""
    return df.join(blocked.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def frequent(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys that have at least so many rows."""
    return members(df, key, df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), key)


def long_enough(df: DataFrame, key: str, seconds: Column, hours: float) -> DataFrame:
    """Rows of keys whose seconds add up to more than so many hours."""
    return members(df, key, df.groupBy(key).agg((F.sum(seconds.cast("decimal(38,6)")) / 3600).alias("h")).where(F.col("h") > hours), key)


def repeated_word(text: Column, times: int = 10) -> Column:
    """Whether a word of more than one character, as parted by white space, comes at least so often in the text of a
    segment, as in made-up transcripts. Works within the row; the words are sorted once, then runs are looked up, so long
    texts stay linear."""
    words = F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 1))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - times + 1, F.lit(1)))
    hit = let(words, lambda w: (F.size(w) >= times) & F.exists(starts(w), lambda i: F.get(w, i - 1) == F.get(w, i + times - 2)))
    return F.coalesce(hit, F.lit(False))


def kept_segments(segments: Column, times: int = 10) -> Column:
    """The segments of a transcript without those that repeat a word too often; null, a failed transcript, if the only
    segment does."""
    kept = F.filter(segments, lambda s: ~repeated_word(s, times))
    return F.when((F.size(segments) != 1) | (F.size(kept) == 1), kept)


def shouting(text: Column) -> Column:
    """Whether the text has letters and all are capitals."""
    return F.coalesce((text == F.upper(text)) & (text != F.lower(text)), F.lit(False))


def intonation(text: Column, path: Column) -> Column:
    """Question class from the path digit after question_, else by the last sign: 0 statement, 1 exclamation, 2 question."""
    digit = F.regexp_extract(path, r"questions?_(.)", 1)
    last = F.regexp_extract(F.rtrim(text), r"([?!])[\"”»’)]*$", 1)
    return F.when(digit.rlike("^[0-9]$"), digit.cast("int") + 10).when(last == "?", 2).when(last == "!", 1).otherwise(0)


def first_mark(text: Column, marks: list[str]) -> Column:
    """Place of the first mark of the list that the text contains, -1 if none."""
    out = None
    for i, m in enumerate(marks):
        out = F.when(F.contains(text, F.lit(m)), i) if out is None else out.when(F.contains(text, F.lit(m)), i)
    return F.coalesce(out, F.lit(-1))


def cast_label(label: Column, kind: str) -> Column:
    """The label as int, float or string; null where it cannot be read, never an error."""
    return label.try_cast({"int": "bigint", "float": "double", "str": "string"}[kind])


def component(path: Column, root: str, i: int = 0) -> Column:
    """A component of the path below the root."""
    return F.get(F.split(F.regexp_replace(F.replace(path, F.lit(root), F.lit("")), r"^/+", ""), "/"), F.lit(i))


def store_field(df: DataFrame, column: str, side: str) -> DataFrame:
    """Copies a column into the side map, under its name."""
    entry = F.create_map(F.lit(column), F.col(column).cast("string"))
    old = F.coalesce(F.col(side), F.create_map().cast("map<string,string>")) if side in df.columns else F.create_map().cast("map<string,string>")
    return df.withColumn(side, F.map_concat(F.map_filter(old, lambda k, v: k != column), entry))


def restore_field(df: DataFrame, column: str, side: str) -> DataFrame:
    """The column from the side map, with its own type; the column's value where the map lacks it."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.coalesce(F.element_at(side, F.lit(column)).try_cast(kind), F.col(column)))


def update(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """New values where they are not null."""
    return df.withColumns({k: F.coalesce(v, F.col(k)) if k in df.columns else v for k, v in new.items()})
