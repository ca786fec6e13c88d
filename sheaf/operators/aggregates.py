"""Aggregates of sample sets: histograms, totals, robust statistics, vector means, metrics.

All group-bys combine on the map side, so a key that a third of all rows have reaches its reducer as one row a task;
exact percentiles count by key and value first and find the ranks over cells of values where a key is large. Sums are in decimals where rows
must match to the last digit.

Defined results: null values are left out of statistics and counted in n only where said; a null key is a group; a
group without valid values has null statistics; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, label: str, digits: int = 8) -> DataFrame:
    """Count and share of each label; the total is a scalar."""
    counts = histogram(df, label)
    return counts.withColumn("share", F.round(F.col("n") / df.agg(F.count(F.lit(1))).scalar(), digits))


def hours(df: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """Rows and hours of each key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(seconds.cast("decimal(38,6)")).cast("double") / 3600, 8).alias("hours"))


def hours_by_level(df: DataFrame, speaker: str, sub: str, seconds: Column) -> DataFrame:
    """Hours per speaker and sub-speaker, rounded to 3 places before they are added up per speaker; sub null: the sum."""
    low = df.groupBy(speaker, sub).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(seconds.cast("decimal(38,6)")) / 3600, 3).alias("hours"))
    high = low.groupBy(speaker).agg(F.sum("n").alias("n"), F.sum("hours").alias("hours")).select(speaker, F.lit(None).cast("string").alias(sub), "n", "hours")
    return low.withColumn("is_total", F.lit(False)).unionByName(high.withColumn("is_total", F.lit(True))).withColumn("hours", F.col("hours").cast("double"))


#: Rows of a key up to which one reducer may hold all its distinct values.
HOT_KEY = 1_000_000


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], hot: int = HOT_KEY) -> DataFrame:
    """(keys, q): exact quantiles of each key, with linear interpolation, as an array in the order of qs; sent to all
    executors where the keys, which are counted, are few.

    Where a key has more than `hot` rows, its values are counted (key, value) by (key, value); the counts are summed up
    over cells of values, whose bounds are approximate quantiles of the key, and the values at the wanted ranks are
    picked. So no task holds all values of a key."""
    from . import celled, joins

    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    n, largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n")).first()
    hint = F.broadcast if n <= joins.SMALL else (lambda d: d)
    if (largest or 0) <= hot:
        return hint(rows.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, qs))).alias("q")))

    def looked_up(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        return a.alias("a").join(hint(b).alias("b"), on).select("a.*", *(f"b.{c}" for c in columns))

    of = rows.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*(F.lit(i / 64) for i in range(1, 64))), F.lit(1000)).alias("_e"), F.count(F.lit(1)).alias("_all"))
    counts = looked_up(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), of, ["_e", "_all"])
    cell = F.size(F.filter("_e", lambda e: e < F.col("_v")))
    summed = celled.running_sum(counts, keys, ["_v"], cell, F.col("_n"), "_c")
    picks = []
    for i, q in enumerate(qs):
        place = (F.col("_all") - 1) * F.lit(q)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            picks.append(F.max(F.when((F.col("_c") - F.col("_n") <= rank) & (rank < F.col("_c")), F.col("_v"))).alias(f"_{side}{i}"))
    found = summed.groupBy(*keys).agg(F.max("_all").alias("_all"), *picks)
    at = lambda q: (F.col("_all") - 1) * F.lit(q)
    mixed = [F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise((F.ceil(at(q)) - at(q)) * F.col(f"_low{i}") + (at(q) - F.floor(at(q))) * F.col(f"_high{i}")) for i, q in enumerate(qs)]
    return hint(found.select(*keys, F.array(*mixed).alias("q")))


def sample_stats(df: DataFrame, keys: list[str], value: str, q: float = 0.05, least: float = 0.01) -> DataFrame:
    """Per sample: values over the least one, clamped to their q and 1-q quantiles; min, max, mean, unbiased variance.

    Two aggregations over the same grouping: the quantiles are joined back by the sample key."""
    valid = df.where(F.col(value) > least).select(*keys, F.col(value).alias("_v"))
    bounds = quantiles(valid, keys, "_v", [q, 1 - q]).withColumnRenamed("q", "_q")
    clamped = valid.join(bounds, keys).withColumn("_v", F.least(F.greatest("_v", F.col("_q")[0]), F.col("_q")[1]))
    return clamped.groupBy(*keys).agg(F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"), F.var_samp("_v").alias("var"), F.count("_v").alias("n"))


def speaker_ranges(stats: DataFrame, keys: list[str], digits: int = 8) -> DataFrame:
    """Per speaker: least minimum, largest maximum, median of means and of variances; NaN and null left out."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return stats.groupBy(*keys).agg(
        F.round(F.min(clean("min")), digits).alias("min"),
        F.round(F.max(clean("max")), digits).alias("max"),
        F.round(F.median(clean("mean")), digits).alias("mean"),
        F.round(F.median(clean("var")), digits).alias("var"),
        F.sum("n").alias("n"),
    )


def quantile_band(df: DataFrame, keys: list[str], value: str, q: float = 0.95, digits: int = 8) -> DataFrame:
    return quantiles(df, keys, value, [1 - q, q]).select(*keys, F.round(F.col("q")[0], digits).alias("low"), F.round(F.col("q")[1], digits).alias("high"))


def mean_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean of the vectors of each key, in tall form (key, pos, mean)."""
    tall = df.select(key, F.posexplode(vector).alias("pos", "x"))
    return tall.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def as_vectors(tall: DataFrame, key: str, value: str = "mean") -> DataFrame:
    """Tall vectors as arrays (key, vector), in order of pos."""
    return tall.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value]).alias("vector"))


def average_or_default(df: DataFrame, key: str, value: str, default: float, digits: int = 8) -> DataFrame:
    """Mean of the value if its maximum is positive, else the default."""
    return df.groupBy(key).agg(F.round(F.when(F.max(value) > 0, F.avg(value)).otherwise(F.lit(default)), digits).alias("average"))


def segments(df: DataFrame, keys: list[str], value: str, order: list[str], digits: int = 8) -> DataFrame:
    """Aggregates of the frames of each segment: mean, median, max, min, span, and the means of first and second
    differences in the given order, which are 0 for segments of at most 2 and 3 frames. The means follow from the first
    two and the last two frames. A segment has the frames of one unit, so it is small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    edge = lambda f, n, k: F.max(F.when(F.col(n) == k, F.col(value))).alias(f)
    rows = df.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rows = rows.withColumn("_j", F.col("_n") - F.col("_i") + 1)
    s = rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"), F.min(value).alias("min"), F.max("_n").alias("_n"),
        edge("_a", "_i", 1), edge("_b", "_i", 2), edge("_y", "_j", 2), edge("_z", "_j", 1),
    )
    diff = F.when(F.col("_n") > 2, (F.col("_z") - F.col("_a")) / (F.col("_n") - 1)).otherwise(0.0)
    bend = F.when(F.col("_n") > 3, ((F.col("_z") - F.col("_y")) - (F.col("_b") - F.col("_a"))) / (F.col("_n") - 2)).otherwise(0.0)
    parts = {"mean": F.col("mean"), "median": F.col("median"), "max": F.col("max"), "min": F.col("min"), "span": F.col("max") - F.col("min"), "diff": diff, "bend": bend}
    return s.select(*keys, *(F.round(c, digits).alias(k) for k, c in parts.items()))


def robust_mean(df: DataFrame, keys: list[str], value: str, digits: int = 8) -> DataFrame:
    """Mean of the values nearer to the mean than two population deviations; values equal to the mean always count."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    near = df.join(stats, keys).where(F.abs(F.col(value) - F.col("_m")) <= 2 * F.col("_s") + 1e-9)
    return near.groupBy(*keys).agg(F.round(F.avg(value), digits).alias("mean"), F.count(F.lit(1)).alias("n"))


def clipped_mean(df: DataFrame, keys: list[str], value: str, q: float, digits: int = 8) -> DataFrame:
    """Mean of the values clipped to their q and 1-q quantiles."""
    bounds = quantiles(df, keys, value, [q, 1 - q]).withColumnRenamed("q", "_q")
    return df.join(bounds, keys).groupBy(*keys).agg(F.round(F.avg(F.least(F.greatest(value, F.col("_q")[0]), F.col("_q")[1])), digits).alias("mean"))


def capped(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The first rows of each key (a cap on collected examples is the feature). A ranking within salted parts goes
    before the final one, so that a large key is never sorted in one task."""
    salt = F.pmod(F.xxhash64(*order), F.lit(64))
    part = df.withColumn("_salt", salt)
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= cap)
    return part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= cap).drop("_salt", "_r")


def confusion_metrics(df: DataFrame, truth: str, guess: str, ignore: int = -100, digits: int = 8) -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the labels of the truth, from the confusion matrix; rows with
    the ignored label are left out. A class without predictions has precision 0."""
    cells = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull() & (F.col(truth) != ignore)).groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    support = cells.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("real"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("hit"))
    guessed = cells.groupBy(F.col("g").alias("c")).agg(F.sum("n").alias("said"))
    c = support.join(guessed, "c", "left").select("real", "hit", F.coalesce("said", F.lit(0)).alias("said"))
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.col("hit") / F.col("real")
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return c.agg(F.round(F.sum("hit") / F.sum("real"), digits).alias("accuracy"), F.round(F.avg(p), digits).alias("precision"), F.round(F.avg(r), digits).alias("recall"), F.round(F.avg(f), digits).alias("f1"))


def equal_error_rate(df: DataFrame, score: str, positive: Column, bins: int = 1000) -> DataFrame:
    """Error rate where false rejections and false acceptances balance, over thresholds at bin edges of the score in
    [0, 1]: (threshold, eer). The curve is built from one row per bin."""
    b = df.where(F.col(score).isNotNull() & positive.isNotNull()).select(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin"), positive.cast("int").alias("p"))
    h = b.groupBy("bin").agg(F.sum("p").alias("pos"), F.sum(1 - F.col("p")).alias("neg"))
    below, above = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy()
    fnr = F.coalesce(F.sum("pos").over(below), F.lit(0)) / F.sum("pos").over(total)
    fpr = F.sum("neg").over(above) / F.sum("neg").over(total)
    curve = h.select("bin", fnr.alias("fnr"), fpr.alias("fpr"))
    best = curve.agg(F.min_by(F.struct("bin", "fnr", "fpr"), F.struct(F.round(F.abs(F.col("fnr") - F.col("fpr")), 9), "bin")).alias("x"))
    return best.select((F.col("x.bin") / bins).alias("threshold"), F.round((F.col("x.fnr") + F.col("x.fpr")) / 2, 8).alias("eer"))


def ranked_rates(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """(keys, auc, eer, threshold) of a score in [0, 1], over all its values as thresholds: the area under the curve, ties
    counting half, and the error rate where false rejections and acceptances balance, at the highest such threshold.
    Counts per score are summed up over cells of the score. A key without both kinds has null rates."""
    from . import celled

    rows = df.where(F.col(score).isNotNull() & positive.isNotNull()).select(*keys, F.col(score).cast("double").alias("_s"), positive.cast("bigint").alias("_p"))
    n = rows.groupBy(*keys, "_s").agg(F.sum("_p").alias("_pos"), F.sum(1 - F.col("_p")).alias("_neg"))
    cell = F.floor(F.col("_s") * 64)
    c = celled.running_sum(celled.running_sum(n, keys, ["_s"], cell, F.col("_pos"), "_cp"), keys, ["_s"], cell, F.col("_neg"), "_cn")
    totals = n.groupBy(*keys).agg(F.sum("_pos").alias("_np"), F.sum("_neg").alias("_nn"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    x = c.alias("a").join(F.broadcast(totals).alias("b") if not keys else totals.alias("b"), on).select("a.*", "b._np", "b._nn")
    fnr, fpr = F.try_divide(F.col("_cp") - F.col("_pos"), F.col("_np")), F.try_divide(F.col("_nn") - F.col("_cn") + F.col("_neg"), F.col("_nn"))
    best = F.min_by(F.struct(((fnr + fpr) / 2).alias("eer"), F.col("_s").alias("threshold")), F.struct(F.round(F.abs(fnr - fpr), 12), -F.col("_s")))
    area = F.sum(F.col("_pos") * (F.col("_cn") - F.col("_neg") + F.col("_neg") / 2)) / F.first(F.col("_np") * F.col("_nn"))
    out = x.groupBy(*keys).agg(F.when((F.first("_np") > 0) & (F.first("_nn") > 0), area).alias("auc"), best.alias("_b"))
    return out.select(*keys, "auc", *(F.when(F.col("auc").isNotNull(), F.col(f"_b.{k}")).alias(k) for k in ("eer", "threshold")))


def pairwise_rates(df: DataFrame, truth: str, scores: str, classes: int) -> DataFrame:
    """Of an array of scores per class: (auc, eer), each the mean over all ordered pairs of classes that both occur, of the
    rows of the two classes, ranked by the score of the first."""
    rows = df.where(F.col(truth).between(0, classes - 1)).select(F.col(truth).cast("int").alias("t"), F.col(scores).alias("s"))
    rows = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))).where("c <> t")
    own = F.struct(F.col("t").alias("a"), F.col("c").alias("b"), F.get("s", F.col("t")).alias("score"), F.lit(True).alias("yes"))
    other = F.struct(F.col("c").alias("a"), F.col("t").alias("b"), F.get("s", F.col("c")).alias("score"), F.lit(False).alias("yes"))
    pairs = rows.select(F.inline(F.array(own, other)))
    return ranked_rates(pairs, ["a", "b"], "score", F.col("yes")).agg(F.avg("auc").alias("auc"), F.avg("eer").alias("eer"))


def profile(df: DataFrame, name: str, pid: str, time: str, digits: int = 8) -> DataFrame:
    """Calls and mean time by name and process."""
    return df.groupBy(name, pid).agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg(time), digits).alias("mean_time"), F.round(F.max(time), digits).alias("max_time"))


def merged_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of two sources as one: those of a stay, new names of b follow in the order of b's ids. Tables of (name, id)."""
    fresh = b.join(a.select("name"), "name", "left_anti").withColumn("_r", F.row_number().over(Window.orderBy("id")))
    top = a.agg(F.coalesce(F.max("id") + 1, F.lit(0))).scalar()
    return a.select("name", "id").unionByName(fresh.select("name", (top + F.col("_r") - 1).cast(a.schema["id"].dataType).alias("id")))


def id_pairs(text: Column, separator: str = ":") -> Column:
    """name:id strings as an array of (name, id)."""
    return F.transform(F.split(text, ","), lambda x: F.struct(F.trim(F.split_part(x, F.lit(separator), F.lit(1))).alias("name"), F.split_part(x, F.lit(separator), F.lit(2)).try_cast("int").alias("id")))


def mean_of_draws(df: DataFrame, key: str, uid: str, vector: str, k: int, seed: int) -> DataFrame:
    """Element-wise mean of k vectors a key, drawn with replacement and repeatably: (key, pos, mean). A draw is a place
    in the numbered vectors of the key."""
    from . import celled, ordering
    from .samplers import uniform

    rows = celled.numbered(df.where(F.col(vector).isNotNull()).select(key, uid, vector), [key], [uid], F.floor(F.col(uid) / ordering.WIDTH), "_pos")
    sizes = rows.groupBy(key).agg(F.max("_pos").alias("_n"))
    draws = sizes.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("_pos", F.floor(uniform(F.struct(key, "_draw"), seed) * F.col("_n")) + 1)
    return mean_vector(draws.select(key, "_draw", "_pos").join(rows, [key, "_pos"]), key, vector)


def linked(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters of few vectors by complete linkage: again and again the two clusters are joined whose farthest
    members are nearest. Each cluster follows its nearest one until two point at each other."""
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0)) if n < 500 else np.stack([np.sqrt(((x - y) ** 2).sum(1)) for y in x])
    np.fill_diagonal(d, np.inf)
    joins: list[tuple[float, int, int]] = []
    live, chain = np.ones(n, bool), []
    while len(joins) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        near = int(d[chain[-1]].argmin())
        if len(chain) > 1 and d[chain[-1], chain[-2]] <= d[chain[-1], near]:
            b, a = chain.pop(), chain.pop()
            joins.append((float(d[a, b]), a, b))
            d[a] = np.maximum(d[a], d[b])
            d[:, a] = d[a]
            d[a, a] = np.inf
            d[b] = d[:, b] = np.inf
            live[b] = False
        else:
            chain.append(near)
    of = np.arange(n)
    for _, a, b in sorted(joins, key=lambda j: j[0])[: max(0, n - k)]:
        of[of == of[b]] = of[a]
    return np.unique(of, return_inverse=True)[1]


def linkage_clusters(df: DataFrame, uid: str, vector: str, k: int, sample: int = 2000) -> DataFrame:
    """Cluster of each vector (uid, cluster): `sample` vectors, the first by a hash of the id, are put into k clusters by
    complete linkage, and every vector takes the cluster of the nearest of them. sample is a bound, not a share."""
    from . import joins

    some = df.where(F.col(vector).isNotNull()).select(uid, F.col(vector).cast("array<double>").alias("_v"))
    picked = some.withColumn("_h", F.xxhash64(uid)).orderBy("_h", uid).limit(sample).collect()
    labels = linked(np.array([r["_v"] for r in picked], float), k) if picked else []
    names = df.sparkSession.createDataFrame([(i, int(c), r["_v"]) for i, (c, r) in enumerate(zip(labels, picked))], "name bigint, cluster int, centre array<double>")
    found = joins.nearest(some, "_v", names.select("name", "centre"))
    return found.join(F.broadcast(names.select(F.col("name").alias("nearest"), "cluster")), "nearest").select(uid, "cluster")


def clusters(df: DataFrame, uid: str, vector: str, k: int, seed: int = 0, soft: bool = False) -> DataFrame:
    """Cluster of each vector (uid, cluster), by bisecting k-means or, soft, a Gaussian mixture; both are distributed."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
    from pyspark.ml.functions import array_to_vector

    x = df.where(F.col(vector).isNotNull()).select(uid, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = (GaussianMixture(k=k, seed=seed) if soft else BisectingKMeans(k=k, seed=seed)).fit(x)
    return model.transform(x).select(uid, F.col("prediction").alias("cluster"))
