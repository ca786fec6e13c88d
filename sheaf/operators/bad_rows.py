"""Rows that fail to parse, set apart with the reason (problem 4).

Method: each line is cut into cells by the dialect; the cells are exploded into (line, column, value); a rule table is
joined by column, its rules are evaluated, the errors of a line are aggregated to the first reason, and the clean lines
are those that an anti-join with the failing ones leaves.

Defined results: null lines and lines that are blank (after one carriage return at the end) are skipped, they neither
fail nor load; a repeated line_id gets one row per reason order, repeated text under other ids fails under each id;
an empty table gives two empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTING, COLUMN_COUNT, VALUE = "quoting", "column_count", "value"


@dataclass(frozen=True)
class Layout:
    """Columns in order, the pattern that a whole value must match, and one that must not occur in it (or None)."""

    key: str
    line: str
    columns: tuple[str, ...]
    must: tuple[str | None, ...]
    never: tuple[str | None, ...]


#: The corpus lines: id, printed text, normalised text.
METADATA = Layout("line_id", "raw_line", ("c0", "c1", "c2"), (r"\A[A-Z]{2}[0-9]{3}-[0-9]{4}\z", r"(?s)\p{L}", None), (None, r"[\p{Cc}\x{FFFD}]", None))



#: A cell after its bar: quoted up to a double quote right before a bar or the end, or plain. Where neither fits, the
#: match fails and the cells found do not add up to the line.
CELL = r'(?s)\|("[^"]*+(?:""[^"]*+)*+"(?=\||\z)|[^|"][^|]*+|(?=\||\z))'


def cells(line: Column) -> Column:
    """The cells of a line with their quotes undone; null if the quoting of any of them is broken."""
    raw = F.regexp_extract_all(F.concat(F.lit("|"), line), F.lit(CELL), F.lit(1))
    plain = F.transform(raw, lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.array_join(raw, "|") == line, plain)


@dataclass(frozen=True)
class Split:
    valid: DataFrame
    failed: DataFrame


def rule_table(df: DataFrame, layout: Layout) -> DataFrame:
    """One row per column of the layout: its place and patterns; as many rows as the layout has columns."""
    rows = [(i, m, n) for i, (m, n) in enumerate(zip(layout.must, layout.never))]
    return df.sparkSession.createDataFrame(rows, "pos int, must string, never string")


def split_lines(df: DataFrame, layout: Layout) -> Split:
    """Valid lines as columns, failing lines with the first reason in the order quoting, column_count, value."""
    line = F.regexp_replace(F.col(layout.line), r"\r\z", "")
    lines = df.select(F.col(layout.key).alias("_id"), line.alias("_line")).where(F.regexp_like("_line", F.lit(r"[^\s\p{Z}]")))
    parsed = lines.select("_id", cells(F.col("_line")).alias("_cells"))
    tall = parsed.select("_id", F.size("_cells").alias("n"), F.posexplode_outer("_cells").alias("pos", "value"))
    checked = tall.join(F.broadcast(rule_table(df, layout)), "pos", "left")  # one row per column of the layout
    wrong = (F.col("must").isNotNull() & ~F.regexp_like("value", F.col("must"))) | (F.col("never").isNotNull() & F.regexp_like("value", F.col("never")))
    rank = F.when(F.col("value").isNull(), 0).when(F.col("n") != len(layout.columns), 1).when(wrong, 2)
    errors = checked.withColumn("rank", rank).where("rank is not null").groupBy("_id").agg(F.min("rank").alias("rank"))
    reason = F.element_at(F.array(*map(F.lit, (QUOTING, COLUMN_COUNT, VALUE))), F.col("rank") + 1)
    failed = errors.select(F.col("_id").alias(layout.key), reason.alias("reason"))
    clean = parsed.join(errors.select("_id"), "_id", "left_anti")
    valid = clean.select(F.col("_id").alias(layout.key), *(F.col("_cells")[i].alias(c) for i, c in enumerate(layout.columns)))
    return Split(valid, failed)
