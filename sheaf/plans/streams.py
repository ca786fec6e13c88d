"""Queries that run a stream to the end of what is there and give what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import batches as B
from .book import query, table


def parted(spark, d, files: int = 8):
    """The events as so many files, so that a limit of files or bytes per trigger binds; and their schema."""
    events, (out, _) = table(spark, d, "events"), B.place(spark, "parts")
    events.repartition(files, "event_id").write.parquet(out)
    return out, events.schema


@query("select event_id, event_id // 32 as batch_id from events")
def stream_batches(spark, d):
    parts, schema = parted(spark, d)
    out, state = B.place(spark, "batches")
    s = B.source(spark, parts, schema, max_files=1)
    B.run_epoch(s.select("event_id", F.floor(F.col("event_id") / 32).alias("batch_id")), out, state, each=lambda part: part)
    return spark.read.parquet(out).select("event_id", "batch_id")


@query("select event_type, count(*) as n from events group by 1")
def stream_ratelimit(spark, d):
    parts, schema = parted(spark, d)
    out, state = B.place(spark, "limit")
    s = B.source(spark, parts, schema, max_bytes="65536")
    B.run_epoch(s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), out, state, each=lambda part: part, mode="complete")
    last = spark.read.parquet(out)
    return last.where(F.col("epoch_batch") == last.agg(F.max("epoch_batch")).scalar()).select("event_type", "n")


@query("select event_id from events")
def ext_watermark_dedup(spark, d):
    schema = table(spark, d, "events").schema
    out, state = B.place(spark, "dedup")
    twice = B.merged([B.source(spark, f"{d}/events[.]parquet", schema, 1), B.source(spark, f"{d}/events[.]parquet", schema, 1)])
    B.run_epoch(B.deduplicated(twice, "ts", "60 days", ["event_id"]).select("event_id"), out, state)
    return spark.read.parquet(out)
