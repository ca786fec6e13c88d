"""Python in plans: functions over files or rows, tables from rows, heavy objects made once a partition.

Built-in expressions are to be preferred; these are for what they cannot express. Data moves in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def per_partition(df: DataFrame, make: Callable[[], object], f: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f(object, batch) over all batches; the object, such as a model, is made when the first batch of a partition comes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for p in parts:
            held = held if held is not None else make()
            yield f(held, p)

    return df.mapInPandas(run, schema)


def flat_map(df: DataFrame, f: Callable[[dict], Iterable[tuple]], schema: str, errors: bool = False) -> DataFrame:
    """None, one or several rows for each row. A row on which f fails gives none; with errors, the schema has a last
    column message, and the failing row gives one row of nulls with the reason."""
    width = schema.count(",") + 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0].strip("`") for c in schema.split(",")]
        for p in parts:
            out: list[tuple] = []
            for row in p.to_dict("records"):
                try:
                    out += [(*x, None) if errors else x for x in f(row)]
                except Exception as e:  # one bad row must not end the job
                    if errors:
                        out.append((*[None] * (width - 1), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)


def each_file(files: DataFrame, f: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """f(path) over the files of a scan."""
    return flat_map(files.select("path"), lambda r: f(r["path"]), schema)
