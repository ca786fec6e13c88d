"""Manifests, transcripts, corpus tables, waves and the feature store.

Defined results: unreadable lines or files give rows with null values, kept apart by read_errors; an empty folder gives
an empty table; writing again replaces or skips, as asked, and is safe when tasks are repeated.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering
from ..operators.filters import exclude, include

AUDIO = ("wav", "flac", "opus", "ogg", "mp3")
TRANSCRIPT = "text string, timestamps array<array<string>>, lang string, model_name string, version string, api string, date string"


def scan(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files below a folder: path, folder, size, changed; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    path = F.regexp_replace("path", "^file:", "")
    return files.select(path.alias("path"), F.regexp_replace(path, "/[^/]*$", "").alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def by_folder(files: DataFrame) -> DataFrame:
    return files.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def manifest_lines(files: DataFrame, root: str, separator: str = "|") -> DataFrame:
    return files.select(F.concat_ws(separator, F.regexp_replace(F.replace("path", F.lit(root), F.lit("")), "^/+", ""), F.lit("0")).alias("value"))


def read_manifest(spark: SparkSession, path: str, include_parts: list[str] | None = None, exclude_parts: list[str] | None = None, separator: str = "|") -> DataFrame:
    """Manifest of path|label lines: (line_no, path, label, subset), subset from [NAME] lines above. One manifest is one
    file, whose lines are numbered by their place in it."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    lines = whole.select(F.col("line_no").cast("bigint").alias("line_no"), F.trim("value").alias("value")).where("value <> ''")
    rows = ordering.header_split(lines, "line_no", "value")
    part = F.split("value", "[" + separator + "]", 2)
    out = rows.select("line_no", F.trim(part[0]).alias("path"), F.get(part, F.lit(1)).alias("label"), "subset")
    if include_parts:
        out = out.where(include(F.col("path"), include_parts))
    return out.where(exclude(F.col("path"), exclude_parts)) if exclude_parts else out


def write_manifest(df: DataFrame, folder: str, path: str = "path", label: str = "label", subset: str = "subset") -> None:
    """One text folder per subset, each line path|label."""
    df.select(F.col(subset).alias("subset"), F.concat_ws("|", path, F.coalesce(F.col(label).cast("string"), F.lit("0"))).alias("value")).write.mode("overwrite").partitionBy("subset").text(folder)


def locate_audio(files: DataFrame) -> DataFrame:
    """The audio file of each stem, wav before flac, opus, ogg and mp3."""
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    rank = F.array_position(F.array(*map(F.lit, AUDIO)), ext)
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    return files.where(rank > 0).groupBy(stem.alias("stem")).agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript JSON files: path, text, timestamps (word, begin, end), lang and so on."""
    raw = spark.read.schema(TRANSCRIPT).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).withColumn("path", F.col("_metadata.file_path"))
    number = lambda x, i: F.get(x, F.lit(i)).try_cast("double")
    ts = F.transform("timestamps", lambda x: F.struct(F.get(x, F.lit(0)).alias("word"), number(x, 1).alias("begin"), number(x, 2).alias("end")))
    return raw.withColumn("timestamps", ts)


def transcript_json(df: DataFrame) -> DataFrame:
    """The same as JSON text, times as three-element arrays."""
    ts = F.transform("timestamps", lambda x: F.concat(F.lit("["), F.to_json(F.struct(x["word"].alias("w"))).substr(F.lit(6), F.length(F.to_json(F.struct(x["word"].alias("w")))) - 6), F.lit(","), x["begin"].cast("string"), F.lit(","), x["end"].cast("string"), F.lit("]")))
    head = F.to_json(F.struct("text", "lang", "model_name", "version", "api", "date"))
    return df.withColumn("value", F.concat(F.left(head, F.length(head) - 1), F.lit(',"timestamps":['), F.array_join(ts, ","), F.lit("]}")))


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """id|text|normalised text lines without quoting."""
    return spark.read.schema("id string, text_orig string, text_norm string").option("sep", "|").option("quote", "").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def profile(speakers: DataFrame) -> DataFrame:
    """Speakers with names that are unique over languages: a name that comes in several gets the language added."""
    n = speakers.groupBy("name").agg(F.count_distinct("lang").alias("_n"))
    name = F.when(F.col("_n") > 1, F.concat_ws("_", "name", "lang")).otherwise(F.col("name"))
    return speakers.join(n, "name").withColumn("name", name).drop("_n")


def read_errors(df: DataFrame, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have all needed values, and the others."""
    good = None
    for c in needed:
        good = F.col(c).isNotNull() if good is None else good & F.col(c).isNotNull()
    return df.where(good), df.where(~good)


def decode_waves(files: DataFrame) -> DataFrame:
    """PCM WAV files (path, content) as (path, rate, wave in -1 .. 1, message). Other codecs give a message."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        width, channels = w.getsampwidth(), w.getnchannels()
                        raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: np.int16, 4: np.int32}[width]).astype(float)
                        x = (raw - 128) / 128 if width == 1 else raw / float(2 ** (8 * width - 1))
                        rows.append((path, w.getframerate(), x.reshape(-1, channels).mean(1), None))
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    rows.append((path, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "rate", "wave", "message"])

    return files.select("path", "content").mapInPandas(run, "path string, rate int, wave array<double>, message string")


def encode_wave(samples: list[float], rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def plan_key(*parts: object) -> str:
    """Eight hex digits of what decides a result: names, parameters, versions of inputs."""
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:8]


class FeatureStore:
    """Computed features in parquet folders, one per step and parameter key, below a shared folder. A run computes only
    the samples that the store lacks, so it can be stopped and taken up again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def path(self, step: str, **parameters: object) -> str:
        return os.path.join(self.root, f"{step}-{plan_key(parameters)}")

    def load(self, step: str, **parameters: object) -> DataFrame | None:
        path = self.path(step, **parameters)
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs)
        return self.spark.read.parquet(path) if there else None

    def compute(self, df: DataFrame, key: str, step: str, f, blocked: DataFrame | None = None, **parameters: object) -> DataFrame:
        """Features of all samples: stored ones are read, the others are computed by f and added. Samples in the
        blocked table are left out."""
        if blocked is not None:
            df = df.join(blocked.select(key).distinct(), key, "left_anti")
        have = self.load(step, **parameters)
        todo = df if have is None else df.join(have.select(key), key, "left_anti")
        f(todo).write.mode("append").parquet(self.path(step, **parameters))
        return self.load(step, **parameters).join(df.select(key), key, "left_semi")


def roll_over(df: DataFrame, key: str, size: int = 2000) -> DataFrame:
    """A folder number for each row, size rows a folder."""
    return ordering.positions(df, key, name="_p").withColumn("folder", F.floor((F.col("_p") - 1) / size)).drop("_p")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images below a folder: origin, height, width, channels, data; files that are none are left out."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")


def read_settings(path: str) -> dict:
    """A JSON file, or a YAML file where a reader is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML reader is installed; use JSON") from e
        return yaml.safe_load(f)


def write_statistics(ranges: DataFrame, folder: str) -> None:
    """Ranges and other statistics as JSON lines."""
    ranges.write.mode("overwrite").json(folder)


def write_waves(df: DataFrame, folder: str) -> DataFrame:
    """Waves (path, rate, wave) as PCM WAV files below a shared folder; gives what was written. A task that is run again
    writes the same file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            done = []
            for path, rate, x in zip(p["path"], p["rate"], p["wave"]):
                if x is None:
                    continue
                to = os.path.join(folder, path)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(f"{to}.{os.getpid()}", "wb") as f:
                    f.write(encode_wave(x, int(rate)))
                os.replace(f"{to}.{os.getpid()}", to)
                done.append((path, len(x)))
            yield pd.DataFrame(done, columns=["path", "samples"])

    return df.select("path", "rate", "wave").mapInPandas(run, "path string, samples bigint")


def readable(df: DataFrame, most: int = 10_000) -> int:
    """Rows of a stored table that can be read back, of the first ones."""
    return df.limit(most).count()
