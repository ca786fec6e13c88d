"""Session for local use; on a cluster the given session is used as it is."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local(cores: str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings that the queries expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(2 * (os.cpu_count() or 4)) if cores == "*" else str(2 * int(cores)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared(spark)
    return spark


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session; a temporary one only where it is unset
    and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found
