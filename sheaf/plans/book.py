"""The book of queries: each query with the SQL that gives the same result, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neighbours_sql() -> str:
    """Rows in rings by a digest of the id; a row's neighbour is the next of its source, else of its language."""
    number = lambda seed: f"('0x' || left(md5('{seed}:' || doc_id), 13))::bigint"
    ring = lambda k: f"floor(u * greatest(1, count(*) over (partition by {k}) // 1000))"
    after = lambda k, r: f"coalesce(lead(doc_id) over (partition by {k}, {r} order by o, doc_id), first_value(doc_id) over (partition by {k}, {r} order by o, doc_id))"
    return f"""(with u as (select doc_id, source, lang, {number(0)} as o, {number(1)} / 4503599627370496::double as u from documents), r as (select *, {ring('source')} as ra, {ring('lang')} as rb from u),
  n as (select doc_id, source, lang, {after('source', 'ra')} as a, {after('lang', 'rb')} as b from r)
  select doc_id, coalesce(case when source is not null and a <> doc_id then a end, case when lang is not null and b <> doc_id then b end, doc_id) as neighbour from n)"""
