"""Filling containers of fixed capacity with texts (problem 7).

Method: first-fit decreasing with a tournament tree over the free room of the containers, run independently in
randomised groups of about GROUP items. The group is a hash of key, piece and, for repeated rows, the number of the
repetition, so the containers are the same however the files are laid out and however often a task runs. Only keys and sizes are shuffled, never texts. An item larger than a container
is cut into full containers and a rest; nothing else is cut.

Sizes are tokens of the public byte-level tokenizer: one per UTF-8 byte and one end token.

Defined results: null and empty texts have no tokens and are in no container; a blank text is a text; repeated rows are
separate items; a null key is a key; an empty table gives no container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a group: what one task packs. Each group leaves one container partly filled, at most 1 in some thousands.
GROUP = 20_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item: the first, in order of opening, that has room; items in order of decreasing size, ties
    in the given order."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)  # a node holds the most room below it
    out = np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out[i] = node - leaves
        tree[node] -= size
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            most = left if left > right else right
            if tree[node] == most:
                break
            tree[node] = most
            node >>= 1
    return out


def containers(df: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", group: int = GROUP, seed: int = 7) -> DataFrame:
    """One row per placed piece: container (group, number in the group), key, piece, pieces, begin_token, tokens."""
    sized = df.select(F.col(key), (F.octet_length(text).cast("long") + 1).alias("size")).where(F.col("size") > 1)
    pieces = F.ceil(F.col("size") / capacity).cast("int")
    cut = sized.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    begin = F.col("piece").cast("long") * capacity
    items = cut.select(key, "piece", "pieces", begin.alias("begin_token"), F.least(F.lit(capacity).cast("long"), F.col("size") - begin).alias("tokens"))
    groups = max(1, round(df.count() / group))
    alike = items.groupBy(*items.columns).agg(F.count(F.lit(1)).alias("_n"))  # repeated rows; spread again by their number
    each = alike.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_n")))
    salted = each.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), key, "piece", "_copy"), F.lit(groups)).cast("int"))
    sort = df.schema[key].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece"], kind="stable", na_position="first")
        pdf["number"] = first_fit_decreasing(pdf["tokens"].to_numpy(), capacity)
        return pdf[["group", "number", key, "piece", "pieces", "begin_token", "tokens"]]

    return salted.groupBy("group").applyInPandas(pack, f"group int, number long, `{key}` {sort}, piece int, pieces int, begin_token long, tokens long")


def oversized(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the items that had to be cut."""
    return placed.where("pieces > 1 and piece = 0").select(key)
