"""Samplers: batches, weights, epochs and balanced sets.

Order is a column, randomness a seed and a hash.  Greedy folds work on blocks of BLOCK consecutive rows of a key, which
bounds what a task holds.  Batches cross the blocks: the open batch at the start of a block follows from one row for
each earlier block of the key.

Defined results: null lengths count 0, negative ones are an error where they would reach over a block; an empty table gives no batch; labels that are null are a class; ties in the
order are broken by the id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import celled, joins, ordering

BLOCK = 20_000


def uniform(key: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) of a key: the first 52 bits of the digest of seed:key, which any engine can give."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("bigint") / F.lit(float(2**52))


def folded(df: DataFrame, keys: list[str], order: str, cost: str, step, columns: str) -> DataFrame:
    """Runs step(costs) -> list of values per block of the ordered rows of a key, and gives (keys, order, block, value)."""
    pos = celled.numbered(df.select(*keys, order, cost), keys, [order], F.floor(F.col(order) / ordering.WIDTH), "_pos")
    cut = pos.withColumn("block", F.floor((F.col("_pos") - 1) / BLOCK))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf["value"] = step(pdf[cost].fillna(0).tolist())
        return pdf[[*keys, order, "block", "value"]]

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, order])
    return cut.groupBy(*keys, "block").applyInPandas(run, f"{kinds}, block bigint, value {columns}")


def closing(costs: np.ndarray, start: int, total: float, n: int, limit: float, rows: int) -> tuple[int | None, float, int]:
    """Place of the item that closes a batch which has total and n before the place start, None if none does; and what
    the batch then has. Sums are taken one by one."""
    width = 64
    while start < len(costs):
        part = costs[start : start + width]
        sums = np.add.accumulate(np.r_[total, part])[1:]
        over = sums > limit
        k = min(int(over.argmax()) if over.any() else len(part), max(rows - n - 1, 0))
        if k < len(part):
            return start + k, float(sums[k]), n + k + 1
        start, total, n, width = start + len(part), float(sums[-1]), n + len(part), 2 * width
    return None, total, n


def summary(costs: np.ndarray, limit: float, rows: int) -> tuple[list[float], list[int], list[float], list[int]]:
    """What a block does to any batch that is open at its start: the costs up to the place where even an empty batch
    closes, and, for a batch that closes at each of these places, how many more batches close in the block, and the sum
    and the number of rows of the one open at its end."""
    first, _, _ = closing(costs, 0, 0.0, 0, limit, rows)
    head = costs[: len(costs) if first is None else first + 1]
    known: dict[int, tuple[int, float, int]] = {len(costs): (0, 0.0, 0)}
    for p in range(len(head)):
        at, path = p + 1, []
        while at not in known:
            end, total, n = closing(costs, at, 0.0, 0, limit, rows)
            if end is None:
                known[at] = (0, total, n)
            else:
                path.append(at)
                at = end + 1
        more, total, n = known[at]
        for x in reversed(path):
            more += 1
            known[x] = (more, total, n)
    exits = [known[p + 1] for p in range(len(head))]
    return head.tolist(), [x[0] for x in exits], [x[1] for x in exits], [x[2] for x in exits]


def overshot(df: DataFrame, keys: list[str], order: str, cost: str, limit: float, rows: int, name: str) -> DataFrame:
    """(keys, order, block, name): the number, within the key, of the batch of each row; a batch closes with the item that
    takes its sum over the limit, or with its last row."""
    pos = celled.numbered(df.select(*keys, order, cost), keys, [order], F.floor(F.col(order) / ordering.WIDTH), "_pos")
    cut = pos.withColumn("block", F.floor((F.col("_pos") - 1) / BLOCK))
    kinds = {c: f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, order]}
    key_kinds = "".join(f"{kinds[k]}, " for k in keys)

    def costs(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[cost].fillna(0).to_numpy(float)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        out = pdf[[*keys, "block"]].head(1).copy()
        for c, x in zip(("_n", "_head", "_more", "_sum", "_rows"), (len(pdf), *summary(costs(pdf), limit, rows))):
            out[c] = [x]
        return out

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        batch, total, n, got = 0, 0.0, 0, []
        for r in pdf.itertuples(index=False, name=None):
            size, head, more, sums, counts = r[-5:]
            got.append((batch, total, n))
            p, total, n = closing(np.asarray(head, float), 0, total, n, limit, rows)
            if p is not None:
                batch, total, n = batch + 1 + int(more[p]), float(sums[p]), int(counts[p])
            elif len(head) < size:
                raise ValueError("negative costs")
        out = pdf[[*keys, "block"]].copy()
        out["_batch"], out["_total"], out["_open"] = zip(*got)
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        batch, total, n = pdf[["_batch", "_total", "_open"]].iloc[0]
        batch, n, out = int(batch), int(n), []
        for c in costs(pdf).tolist():
            out.append(batch)
            total, n = total + c, n + 1
            if total > limit or n >= rows:
                batch, total, n = batch + 1, 0.0, 0
        pdf[name] = out
        return pdf[[*keys, order, "block", name]]

    def same(names: list[str]):
        on = F.lit(True)
        for k in names:
            on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        return on

    long = cut.groupBy(*keys).agg(F.max("block").alias("_last")).where("_last > 0")  # others have no block before
    blocks = cut.alias("l").join(long.alias("r"), same(keys), "left_semi").groupBy(*keys, "block").applyInPandas(summed, f"{key_kinds}block bigint, _n bigint, _head array<double>, _more array<bigint>, _sum array<double>, _rows array<bigint>")
    entries = blocks.groupBy(*keys).applyInPandas(entered, f"{key_kinds}block bigint, _batch bigint, _total double, _open bigint")
    whole = cut.alias("l").join(entries.alias("r"), same([*keys, "block"]), "left").select("l.*", *(F.coalesce(f"r.{c}", F.lit(0)).alias(c) for c in ("_batch", "_total", "_open")))
    return whole.groupBy(*keys, "block").applyInPandas(run, f"{key_kinds}{kinds[order]}, block bigint, `{name}` bigint")


def keeping_below(limit: float):
    """Whether an item stays, seen from the end: it does if the sum of those that stay remains strictly below the limit;
    an item that does not fit is skipped, later ones may still fit."""

    def step(costs: list[float]) -> list[bool]:
        out, total = [], 0.0
        for c in reversed(costs):
            fits = total + c < limit
            out.append(fits)
            total += c if fits else 0.0
        return out[::-1]

    return step


def dynamic_batches(df: DataFrame, keys: list[str], order: str, cost: str, limit: float, rows: int) -> DataFrame:
    """(keys, order, block, batch): rows up to the one that takes the sum of costs over the limit, at most so many."""
    return overshot(df, keys, order, cost, limit, rows, "batch")


def packed(df: DataFrame, keys: list[str], order: str, cost: str, limit: float) -> DataFrame:
    """(keys, order, block, pack): items are packed until a pack has more than the limit."""
    return overshot(df, keys, order, cost, limit, 1 << 60, "pack")


def recut(df: DataFrame, batch: str, order: str, cost: str, limit: float) -> DataFrame:
    """(batch, order, kept) for batches whose sum must stay below the limit, cut from their end."""
    return folded(df, [batch], order, cost, keeping_below(limit), "boolean").select(batch, order, F.col("value").alias("kept"))


def bucketed_batches(df: DataFrame, key: str, length: str, size: int, seed: int = 0) -> DataFrame:
    """Batches of rows of like length, in shuffled order: (key, batch_id, place). The longest rows come first within the
    sort; batches change places by a hash."""
    rows = df.select(key, (-F.coalesce(F.col(length), F.lit(0))).alias("_d"))
    b = ordering.sequential_batches(rows, key, size, ["_d"]).select(key, "batch_id")
    ids = b.select("batch_id").distinct().withColumn("_h", F.xxhash64("batch_id", F.lit(seed)))
    place = celled.numbered(ids, [], ["_h", "batch_id"], F.shiftright("_h", 44), "place", upper=celled.thousands)
    return b.join(place.select("batch_id", (F.col("place") - 1).alias("place")), "batch_id")


def doubled(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """Each row and its neighbour as two rows: (key, member, neighbor_idx), neighbour first with index 0."""
    both = F.posexplode(F.array("neighbour", key)).alias("neighbor_idx", "member")
    return df.select(key).join(pairs, key).select(key, both)


def idf_weights(df: DataFrame, label: str, digits: int = 10) -> DataFrame:
    """Weight of a row of each label: inverse frequency, normalised so that the weights of all rows add up to 1; that is
    1 / (rows of the label x number of labels), so one row per label is all that is needed."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    labels = df.select(F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("l")).agg(F.count_distinct("l")).scalar()
    return n.select(label, "n", F.round(1 / (F.col("n") * labels), digits).alias("weight"))


def tfidf_weights(tags: DataFrame, row: str, tag: str, ignore: list[str] | None = None) -> DataFrame:
    """Weight of rows that have many tags: softmax over all rows of the sum of tf x idf, tf being the share among the
    row's tags and idf ln((N + 1) / (df + 1)). Rows whose tags are all ignored have sum 0."""
    kept = tags.where(~F.coalesce(F.col(tag).isin(ignore or []), F.lit(False)))
    rows = tags.select(row).distinct()
    n = rows.agg(F.count(F.lit(1))).scalar()
    tf = kept.groupBy(row, tag).agg(F.count(F.lit(1)).alias("c"))
    size = kept.groupBy(row).agg(F.count(F.lit(1)).alias("t"))
    df_ = tf.groupBy(tag).agg(F.count(F.lit(1)).alias("d"))
    score = tf.join(joins.small(df_), tag).join(size, row).groupBy(row).agg(F.sum(F.col("c") / F.col("t") * F.ln((n + 1) / (F.col("d") + 1))).alias("s"))
    all_rows = rows.join(score, row, "left").select(row, F.coalesce("s", F.lit(0.0)).alias("s"))
    e = all_rows.withColumn("e", F.exp("s"))  # s is at most ln(N + 1), so this cannot overflow
    return e.select(row, (F.col("e") / e.agg(F.sum("e")).scalar()).alias("weight"))


def tag_matrix(tags: DataFrame, row: str, tag: str, values: list[str]) -> DataFrame:
    """Number of each tag in each row; the tags are given, so one aggregation does."""
    return tags.groupBy(row).agg(*(F.count_if(F.col(tag) == v).alias(f"n_{v}") for v in values))


def weighted_epoch(df: DataFrame, key: str, weight: Column, size: int, seed: int) -> DataFrame:
    """size draws with replacement, a row's chance being its share of the weights: (draw, key).

    Uniform numbers and the running sums of the weights are put in one order, and the row is carried to the draws; the
    numbers are cut into cells, so neither side is sorted in one task."""
    w = df.select(F.col(key).alias("_k"), weight.cast("decimal(38,18)").alias("_w")).where("_w > 0")
    total = w.agg(F.sum("_w").cast("double")).scalar()
    cells = F.greatest(F.lit(64), F.ceil((ordering.total(w) + size) / 20_000))
    run = celled.running_sum(w, [], ["_k"], F.floor(F.col("_k") / ordering.WIDTH), F.col("_w"), "_s", upper=celled.thousands)
    cdf = run.select(((F.col("_s") - F.col("_w")).cast("double") / total).alias("u"), F.col("_k").alias("id"))
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("u"))
    out = joins.as_of(draws, cdf, [], "u", "id", F.floor(F.col("u") * cells), upper=celled.thousands)
    return out.select("draw", F.col("as_of_id").alias(key))


def multi_criteria_epoch(df: DataFrame, key: str, criteria: dict[str, Column], size: int, ratios: list[float] | None = None, seed: int = 0) -> DataFrame:
    """An epoch of one chunk per criterion: (criterion, draw, key). Chunk sizes truncate, as a remainder is left out."""
    out = None
    for i, (name, w) in enumerate(criteria.items()):
        n = int(size * ratios[i]) if ratios else size // len(criteria)
        part = weighted_epoch(df, key, w, n, seed + i).withColumn("criterion", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def balanced_fill(tags: DataFrame, row: str, tag: str, values: list[str], size: int, seed: int = 0, spread: float = 0.1) -> DataFrame:
    """A set of at most size rows in which the shares of the tags differ little: a quarter is drawn at random, then the
    row that is richest in the rarest tag is added, until the shares differ by at most the spread or the set is full.

    Only rows that can be taken come to one task: for each tag the size richest, and the random quarter, which the size
    of the epoch bounds."""
    m = tag_matrix(tags, row, tag, values)
    u = F.xxhash64(F.col(row), F.lit(seed))
    parts = [m.orderBy(u, row).limit(max(1, size // 4)).withColumn("_first", F.lit(True))]
    parts += [m.orderBy(F.desc(f"n_{v}"), u, row).limit(size).withColumn("_first", F.lit(False)) for v in values]
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p)
    pool = pool.groupBy(row, *(f"n_{v}" for v in values)).agg(F.max("_first").alias("_first")).withColumn("_u", u)
    cols = [f"n_{v}" for v in values]
    sort = m.schema[row].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", row]).reset_index(drop=True)
        counts = pdf[cols].to_numpy(float)
        taken = pdf["_first"].to_numpy(bool).copy()
        order = {j: iter(np.argsort(-counts[:, j], kind="stable")) for j in range(len(cols))}
        total = counts[taken].sum(0)
        while taken.sum() < size and total.sum() > 0 and (total / total.sum()).max() - (total / total.sum()).min() > spread:
            j = int(total.argmin())
            k = next((i for i in order[j] if not taken[i] and counts[i, j] > 0), None)
            if k is None:
                break
            taken[k] = True
            total += counts[k]
        return pdf.loc[taken, [row]]

    return pool.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(fill, f"`{row}` {sort}")
