"""Queries of the general data-preparation problems, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bad_rows, intervals


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/metadata.parquet")
    return bad_rows.split_lines(lines, bad_rows.METADATA).failed.select("line_id", "reason")


def p4_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/metadata.parquet")
    return bad_rows.split_lines(lines, bad_rows.METADATA).valid


def tiers() -> dict[str, Column]:
    """The intervals of a segment by tier."""
    return {"words": F.col("ts_by_words"), "phonemes": F.flatten(F.filter("ts_by_phonemes", lambda x: x.isNotNull()))}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = spark.read.parquet(f"{sf_dir}/audioseg.parquet")
    return intervals.tier_gaps(seg, "seg_id", tiers())


def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = spark.read.parquet(f"{sf_dir}/audioseg.parquet")
    return intervals.tier_periods(seg, "seg_id", tiers())


QUERIES = {f.__name__: f for f in (p4_found, p4_valid, p5_found, p5_periods)}


_LINES = r"""with l as (select line_id, regexp_replace(raw_line, '\r\z', '') as line from metadata), k as (select * from l where regexp_matches(line, '[^\s\p{Z}]')),
  c as (select line_id, regexp_full_match(line, '(?s)(?:"(?:[^"]|"")*"|[^|"][^|]*|)(?:\|(?:"(?:[^"]|"")*"|[^|"][^|]*|))*') as good, list_transform(regexp_extract_all('|' || line, '(?s)\|("(?:[^"]|"")*"|[^|"][^|]*|)', 1), lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) as v from k),
  r as (select *, case when not good then 'quoting' when len(v) <> 3 then 'column_count' when not regexp_full_match(v[1], '[A-Z]{2}[0-9]{3}-[0-9]{4}') or not regexp_matches(v[2], '\p{L}') or regexp_matches(v[2], '[\p{Cc}\x{FFFD}]') then 'value' end as reason from c) """

_TIERS = """with x as (select seg_id, 'words' as tier, unnest(ts_by_words) as x from audioseg union all select seg_id, 'phonemes', unnest(flatten(ts_by_phonemes)) from audioseg),
  u as (select distinct seg_id, tier, round(x."begin" * 1000)::bigint as b, round(x."end" * 1000)::bigint as e from x), v as (select * from u where b < e),
  g as (select *, max(e) over (partition by seg_id, tier order by b, e rows between unbounded preceding and 1 preceding) as reach from v) """

SQL = {
    "p4_found": _LINES + "select line_id, reason from r where reason is not null",
    "p4_valid": _LINES + "select line_id, v[1] as c0, v[2] as c1, v[3] as c2 from r where reason is null",
    "p5_found": _TIERS + "select seg_id, tier, reach as begin_ms, b as end_ms from g where b > reach",
    "p5_periods": _TIERS + """, n as (select *, sum(case when b <= reach then 0 else 1 end) over (partition by seg_id, tier order by b, e rows unbounded preceding) as k from g)
  select seg_id, tier, min(b) as begin_ms, max(e) as end_ms from n group by seg_id, tier, k""",
}
