"""TextGrid files (short text form) as a data source of labelled intervals, and back.

Reading splits work by file; each file is parsed by lines.  `spark.dataSource.register(TextGridSource)`, then
`spark.read.format("textgrid").option("tiers", "orig,text").load(folder)`.

Defined results: files that do not parse give one row with tier null and the reason as label; empty labels are silence
and are kept unless `silence` is false; a missing tier gives no row.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file_path string, tier string, pos int, begin double, end double, label string"
HEAD = ['File type = "ooTextFile"', 'Object class = "TextGrid"', ""]
EDGES = ("BOS", "EOS")


def parse(text: str) -> list[tuple[str, int, float, float, str]]:
    """(tier, pos, begin, end, label) of a file; a label may run over several lines and doubles its quotes."""
    items = re.findall(r'"((?:[^"]|"")*)"|(<exists>)|(-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)', text.partition('"TextGrid"')[2])
    flat = [("s", s.replace('""', '"')) if not e and not n else ("e", e) if e else ("n", n) for s, e, n in items]
    at = next((i for i, (k, _) in enumerate(flat) if k == "e"), None)
    if at is None:
        raise ValueError("not a TextGrid")
    tiers, at, out = int(flat[at + 1][1]), at + 2, []
    for _ in range(tiers):
        if flat[at] != ("s", "IntervalTier"):
            raise ValueError("only interval tiers are known")
        name, n = flat[at + 1][1], int(flat[at + 4][1])
        at += 5
        for pos in range(n):
            out.append((name, pos, float(flat[at][1]), float(flat[at + 1][1]), flat[at + 2][1]))
            at += 3
    return out


def build(rows: list[tuple[str, int, float, float, str]]) -> str:
    """The file of such rows, tiers in the order of their first row."""
    names = list(dict.fromkeys(r[0] for r in rows))
    low, high = min((r[2] for r in rows), default=0.0), max((r[3] for r in rows), default=0.0)
    lines = [*HEAD, repr(low), repr(high), "<exists>", str(len(names))]
    for name in names:
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: r[1])
        lines += ['"IntervalTier"', f'"{name}"', repr(low), repr(high), str(len(mine))]
        for _, _, b, e, label in mine:
            lines += [repr(b), repr(e), '"' + (label or "").replace('"', '""') + '"']
    return "\n".join(lines) + "\n"


class Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.suffix = tuple(options.get("suffix", ".TextGrid").split(","))
        self.tiers = set(options["tiers"].split(",")) if options.get("tiers") else None
        self.silence = options.get("silence", "true").lower() == "true"
        self.parts = int(options.get("partitions", "64"))

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.root):
            return [Part([self.root])]
        paths = sorted(os.path.join(d, f) for d, _, files in os.walk(self.root) for f in files if f.endswith(self.suffix))
        n = max(1, min(self.parts, len(paths)))
        return [Part(paths[i::n]) for i in range(n)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, encoding="utf-8") as f:
                    rows = parse(f.read())
            except (ValueError, IndexError, OSError) as e:
                yield path, None, None, None, None, f"{type(e).__name__}: {e}"
                continue
            for tier, pos, b, e, label in rows:
                if (self.tiers is None or tier in self.tiers) and (self.silence or label):
                    yield path, tier, pos, b, e, label


class Message(WriterCommitMessage):
    pass


class Writer(DataSourceWriter):
    """Writes each file of the rows of a partition; all rows of a file must be in one partition, ordered by file."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from itertools import groupby

        for path, rows in groupby(iterator, key=lambda r: r.file_path):
            to = os.path.join(self.root, path)
            if os.path.exists(to) and not self.overwrite:
                continue
            os.makedirs(os.path.dirname(to), exist_ok=True)
            body = build([(r.tier, r.pos, r.begin, r.end, r.label) for r in rows])
            with open(f"{to}.{os.getpid()}", "w", encoding="utf-8") as f:  # a task that is run again writes the same
                f.write(body)
            os.replace(f"{to}.{os.getpid()}", to)
        return Message()


class TextGridSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textgrid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options), overwrite)


def write(df: DataFrame, folder: str, overwrite: bool = True) -> None:
    """Writes rows of SCHEMA, one file per file_path below the folder."""
    rows = df.select("file_path", "tier", "pos", "begin", "end", "label").repartition("file_path").sortWithinPartitions("file_path", "tier", "pos")
    rows.write.format("textgrid").mode("overwrite" if overwrite else "append").save(folder)


def preview(tiers: DataFrame) -> DataFrame:
    """Per file: printed text, words and units with their intervals, edges of the speech; without silence and edges."""
    kept = tiers.where(F.col("tier").isin("orig", "text", "phonemes") & (F.col("label") != ""))
    at = lambda t: F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct("pos", "begin", "end", "label"))))
    rows = kept.groupBy("file_path").agg(at("orig").alias("o"), at("text").alias("w"), at("phonemes").alias("p"))
    inner = lambda c: F.filter(c, lambda x: ~x["label"].isin(*EDGES))
    return rows.select(
        "file_path",
        F.array_join(F.transform(inner(F.col("o")), lambda x: x["label"]), " ").alias("orig"),
        inner(F.col("w")).alias("words"),
        inner(F.col("p")).alias("units"),
        F.get(F.filter("w", lambda x: x["label"] == "BOS"), F.lit(0))["end"].alias("ts_bos"),
        F.get(F.filter("w", lambda x: x["label"] == "EOS"), F.lit(0))["begin"].alias("ts_eos"),
    )


META = "lang string, speaker_name string, sent_position string, audio_path string, audio_chunk array<double>, orig_audio_path string, orig_audio_chunk array<double>, orig_audio_samplerate int, text_parser_version string, bos_label string, eos_label string"


def meta(label: Column) -> Column:
    """The meta label as a struct: JSON or a dictionary literal; null where it is cut."""
    from ..functions.scalars import json_repair

    return F.from_json(json_repair(label), META)
