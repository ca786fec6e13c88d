"""Streams of batches with bounded flow, and event-time queries over streams.

A stream of files is read with a bound on what is in flight per trigger; epochs end when all files that were there are
read.  Batch numbers come from the data, so that several readers with the same world size get disjoint batches.

Defined results: files without rows give no batch; rows late by more than the watermark are dropped; a run that is
stopped and started again with the same checkpoint goes on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import shared


def source(spark: SparkSession, path: str, schema, max_files: int | None = None, max_bytes: str | None = None, pattern: str | None = None) -> DataFrame:
    """Parquet files as a stream, so many files or bytes per trigger."""
    reader = spark.readStream.schema(schema).format("parquet")
    for k, v in (("maxFilesPerTrigger", max_files), ("maxBytesPerTrigger", max_bytes), ("pathGlobFilter", pattern)):
        if v is not None and not (k == "maxBytesPerTrigger" and max_files is not None):
            reader = reader.option(k, v)
    return reader.load(path)


def merged(streams: list[DataFrame]) -> DataFrame:
    """Streams of several servers as one."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def run_epoch(df: DataFrame, folder: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> StreamingQuery:
    """Writes all that is there now to parquet, trigger by trigger, and ends. each: what is done with a micro-batch; its
    folder is named by the batch number, so a batch that is run again replaces itself."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if each is None:
        q = writer.format("parquet").option("path", folder).start()
    else:
        q = writer.foreachBatch(lambda part, n: each(part).withColumn("epoch_batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/epoch_batch={n}")).start()
    q.awaitTermination()
    return q


def own_share(batches: DataFrame, rank: int, world: int) -> DataFrame:
    """The batches of one of several synchronised readers."""
    return batches.where(F.pmod(F.col("batch_id"), F.lit(world)) == rank)


def local_batches(batches: DataFrame, key: str = "batch_id", drop_incomplete: int | None = None) -> Iterator[list]:
    """Batches one after the other for a client, the next partition being fetched meanwhile. A client holds one batch at
    a time and one partition ahead."""
    rows, now = [], None
    for r in batches.repartitionByRange(key).sortWithinPartitions(key).toLocalIterator(prefetchPartitions=True):
        if r[key] != now and rows:
            if drop_incomplete is None or len(rows) == drop_incomplete:
                yield rows
            rows = []
        now = r[key]
        rows.append(r)
    if rows and (drop_incomplete is None or len(rows) == drop_incomplete):
        yield rows


def timed(df: DataFrame, time: str) -> DataFrame:
    """The time as an instant; times without zone are taken in that of the session."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, time: str, width: str, late: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Windowed aggregates of a stream with a watermark."""
    return timed(df, time).withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*aggs)


def deduplicated(df: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    return timed(df, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def progress(q: StreamingQuery) -> list[dict]:
    """Rows and rows per second of each trigger."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond")} for p in q.recentProgress]


def place(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh output folder and checkpoint folder in the shared folder of the session."""
    root = f"{shared(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/state"
