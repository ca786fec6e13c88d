"""Column functions on numbers, arrays, maps, JSON and strings; all evaluate inside the JVM.

Defined results: a null argument gives null; empty arrays give empty arrays, or null where a value is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it, in lambdas too."""
    return F.transform(F.array(value), body)[0]


def log_floor(x: Column, floor: float = 1e-5) -> Column:
    """Natural logarithm of the value, or of the floor if that is larger."""
    return F.ln(F.greatest(x, F.lit(floor)))


def decibel(x: Column) -> Column:
    return 20 * F.log10(x)


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(low))
    out = x if high is None else F.least(x, F.lit(high))
    return F.when(x.isNotNull(), out)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a))


def norm(a: Column) -> Column:
    """Euclidean length of a vector."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector has length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_loss(a: Column, b: Column) -> Column:
    """1 - (1 + cos) / 2."""
    return 1 - (1 + cosine(a, b)) / 2


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def indices(n: Column) -> Column:
    """0 .. n-1; an empty array for n < 1 (a plain sequence would count down)."""
    return F.when(n >= 1, F.sequence(F.lit(0), n.cast("int") - 1)).when(n.isNotNull(), F.array().cast("array<int>"))


def running_sum(a: Column) -> Column:
    """Cumulative sums of an array, in one pass."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("sum"))
    step = lambda s, x: F.struct(F.array_append(s["out"], s["sum"] + x.cast("double")).alias("out"), (s["sum"] + x.cast("double")).alias("sum"))
    return F.aggregate(a, start, step, lambda s: s["out"])


def argmax(a: Column) -> Column:
    """Zero-based place of the first maximum."""
    return F.when(F.size(a) > 0, F.array_position(a, F.array_max(a)) - 1)


def argmin(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_position(a, F.array_min(a)) - 1)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / array_sum(e))


def lerp(a: Column, at: Column) -> Column:
    """Linear interpolation of an array at a fractional zero-based place, clamped to its ends."""
    low = F.least(F.greatest(F.floor(at).cast("int"), F.lit(0)), F.size(a) - 1)
    high = F.least(low + 1, F.size(a) - 1)
    x, y = F.get(a, low).cast("double"), F.get(a, high).cast("double")
    return x + (y - x) * F.least(F.greatest(at - low, F.lit(0.0)), F.lit(1.0))


def resample(a: Column, n: Column) -> Column:
    """The array stretched or shrunk to n elements by linear interpolation between its first and last."""
    scale = F.when(n > 1, (F.size(a) - 1) / (n - 1)).otherwise(F.lit(0.0))
    return F.transform(indices(n), lambda i: lerp(a, i * scale))


def smoothed(a: Column, reach: int = 2) -> Column:
    """Mean of each value and so many on both sides, around the ends."""
    at = lambda i: F.get(a, F.pmod(i, F.size(a)))
    return F.transform(indices(F.size(a)), lambda i: sum((at(i + k) for k in range(-reach + 1, reach + 1)), at(i - reach)) / (2 * reach + 1))


def fade_curve(n: Column) -> Column:
    """Log-spaced fade-in of n steps: 10^(4 (-1 + 2 i / (n-1))) / 10^4."""
    return F.transform(indices(n), lambda i: F.pow(F.lit(10.0), 4 * (-1 + F.when(n > 1, 2 * i / (n - 1)).otherwise(F.lit(2.0)))) / 1e4)


def finite(x: Column) -> Column:
    """The value, null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def json_repair(x: Column) -> Column:
    """A dictionary literal with single quotes, None, True and False as JSON; what is JSON already is kept."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?<=[:\[,]\s?)None\b", "null"), r"(?<=[:\[,]\s?)True\b", "true"), r"(?<=[:\[,]\s?)False\b", "false")
    swapped = F.regexp_replace(bare, r"(?<=[{,\[:]\s?)'|'(?=\s*[:,}\]])", '"')
    return F.when(F.ltrim(x).startswith('{"'), x).otherwise(swapped)


def seed_of(x: Column) -> Column:
    """Stable seed below 10^8 of a string: digits pass through, else the SHA-1 digest modulo 10^8."""
    part = lambda k: F.conv(F.substring(F.sha1(x), 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    acc = F.lit(0).cast("decimal(20,0)")
    for k in range(5):
        acc = (acc * 4294967296 + part(k)) % 100000000
        acc = acc.cast("decimal(20,0)")
    return F.when(F.regexp_like(x, F.lit("^[0-9]+$")), F.try_to_number(x, F.lit("9" * 18)).cast("long") % 100000000).otherwise(acc.cast("long"))


def path_key(path: Column, root: str = "") -> Column:
    """SHA-256 of the relative path without its suffix."""
    relative = F.regexp_replace(F.replace(path, F.lit(root), F.lit("")) if root else path, r"^/+", "")
    return F.sha2(F.regexp_replace(relative, r"\.[^./]*$", ""), 256)


def clock(seconds: Column) -> Column:
    """H:MM:SS of a number of seconds, fractions dropped."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.pmod(F.floor(s / 60).cast("long"), F.lit(60)), F.pmod(s, F.lit(60)))


def map_update(old: Column, new: Column) -> Column:
    """Entries of both maps, those of the new one first choice; null values of the new map change nothing."""
    given = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given)


def key_ending(m: Column, name: str) -> Column:
    """Value of the first key, in key order, that ends with the name."""
    hit = F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: k.endswith(name))))
    return F.get(hit, F.lit(0))["value"]
