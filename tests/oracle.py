"""Compares queries with their SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings audiobook audioseg metadata speakers languages eval_items size_limit common_words".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 12) + 0.0)
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "as_tuple"):
        return repr(round(float(x), 12) + 0.0)
    if isinstance(x, int):
        return repr(float(x))
    return str(x)


def compare(df, c, sql: str) -> str | None:
    """None if equal, else what differs."""
    cols = sorted(df.columns)
    rel = c.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    order = [names.index(k) for k in cols]
    want = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    got = Counter(tuple(plain(x) for x in r) for r in df.select(*[f"`{k}`" for k in cols]).collect())
    if got == want:
        return None
    return f"{sum(got.values())} rows against {sum(want.values())}; only in Spark {list((got - want).items())[:4]}; only in SQL {list((want - got).items())[:4]}"
