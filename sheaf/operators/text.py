"""Symbols, tags and marks of the units of a text.

Defined results: null units count as unknown symbols; empty arrays give empty arrays; null arrays give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as N
from . import celled, joins

UNKNOWN = "<UNK>"


def symbol_table(symbols: list[str]) -> Column:
    """Symbol -> place in the alphabet; a symbol that comes twice keeps its last place."""
    last = {s: i for i, s in enumerate(symbols)}
    return F.create_map(*(F.lit(x) for s, i in last.items() for x in (s, i)))


def symbol_ids(units: Column, symbols: list[str]) -> Column:
    """Ids of an array of symbols; unknown, empty or null ones get that of UNKNOWN."""
    table = symbol_table(symbols)
    unknown = F.coalesce(F.element_at(table, F.lit(UNKNOWN)), F.lit(0))
    return F.transform(units, lambda u: F.coalesce(F.when(u.isNotNull() & (u != ""), F.element_at(table, u)), unknown))


def id_symbols(ids: Column, symbols: list[str]) -> Column:
    names = F.array(*map(F.lit, symbols))
    return F.transform(ids, lambda i: F.get(names, i))


def item_ends(lengths: Column, inside: int = 0, last: int = 1) -> Column:
    """For items of given lengths n - 1 times the inside sign and the last sign once."""
    return F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.concat(F.array_repeat(F.lit(inside), (n - 1).cast("int")), F.array(F.lit(last)))).otherwise(F.array().cast("array<int>"))))


def head_counts(df: DataFrame, sentence: str, token: str, head: str) -> DataFrame:
    """Number of dependants of each token, 0 for leaves."""
    n = df.where(F.col(head).isNotNull()).groupBy(F.col(sentence).alias("_s"), F.col(head).alias("_h")).agg(F.count(F.lit(1)).alias("dependants"))
    out = df.join(n, (F.col(sentence) == F.col("_s")) & (F.col(token) == F.col("_h")), "left")
    return out.withColumn("dependants", F.coalesce("dependants", F.lit(0).cast("bigint"))).drop("_s", "_h")


def mapped(units: Column, table: DataFrame, key: str, value: str) -> Column:
    """Units looked up in a small table, itself where it lacks them; the table is bounded by joins.SMALL rows."""
    rows = table.select(key, value).where(F.col(key).isNotNull()).limit(joins.SMALL + 1).collect()
    if len(rows) > joins.SMALL:
        raise ValueError("too many rows for a map")
    m = F.create_map(*(F.lit(x) for r in {r[0]: r[1] for r in rows}.items() for x in r)) if rows else F.create_map().cast("map<string,string>")
    return F.transform(units, lambda u: F.coalesce(F.element_at(m, u), u))


def first_labels(word: Column, label: Column, ignore: int = -100) -> Column:
    """Labels of sub-words: the first of a word keeps the label of the word, others are ignored."""
    pairs = F.arrays_zip(word.alias("w"), label.alias("l"))
    return F.transform(pairs, lambda x, i: F.when((i == 0) | (F.get(word, F.greatest(i - 1, F.lit(0))) != x["w"]), x["l"]).otherwise(ignore))


def marks_ahead(units: Column, marks: list[str], none: str = "") -> Column:
    """For every unit that is no mark the mark that governs it: the next one in the text. An opening bracket ends at its
    first unit; a quotation mark, met from the end, governs up to its partner, where the mark before it takes over."""
    known = F.array(*map(F.lit, marks))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(none).alias("now"), F.lit(none).alias("before"), F.lit(False).alias("quoted"))

    def step(s: Column, u: Column) -> Column:
        is_mark = F.array_contains(known, u)
        quote, bracket = u == '"', u == "("
        out = F.when(is_mark, s["out"]).otherwise(F.array_append(s["out"], s["now"]))
        now = F.when(~is_mark, F.when(s["now"] == "(", none).otherwise(s["now"])).when(quote & s["quoted"], s["before"]).otherwise(u)
        before = F.when(is_mark & ~bracket & ~(quote & s["quoted"]), s["now"]).otherwise(s["before"])
        return F.struct(out.alias("out"), now.alias("now"), before.alias("before"), (s["quoted"] | (is_mark & quote)).alias("quoted"))

    return F.reverse(F.aggregate(F.reverse(units), start, step, lambda s: s["out"]))


def modifiers(values: Column, lengths: Column, low: float = 0.1, high: float = 2.0) -> Column:
    """Percentages of words, kept within 50 and 200, as factors per unit, kept within the bounds; what is not a whole
    number counts 100."""
    one = lambda v: F.when(v.rlike("^[0-9]+$"), F.greatest(F.lit(50.0), F.least(F.lit(200.0), v.try_cast("double")))).otherwise(100.0) / 100
    factors = F.transform(values, lambda v: F.greatest(F.lit(low), F.least(F.lit(high), one(F.coalesce(v, F.lit(""))))))
    return F.flatten(F.zip_with(factors, lengths, lambda f, n: F.array_repeat(f, n.cast("int"))))


def rate_modifiers(rates: Column, burrs: Column, lengths: Column, units: Column, low: float = 0.1, high: float = 2.0) -> Column:
    """Factors of duration per unit: the inverse of the rate, times the inverse of the burr for units that can have one."""
    can = lambda u: F.coalesce(u.isin(*BURR), F.lit(False))
    burr = F.zip_with(modifiers(burrs, lengths, low, high), units, lambda b, u: F.when(can(u), b).otherwise(1.0))
    return F.zip_with(modifiers(rates, lengths, low, high), burr, lambda r, b: 1 / (r * b))


#: Sounds that a burr changes.
BURR = ("R", "R0", "P", "P0", "K", "K0")


def joined_sentences(parts: Column) -> Column:
    """Sentences joined by commas, their final stops dropped."""
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"[.!?…]+\s*$", "")), ", ")


def edges_alike(a: Column, b: Column, n: int = 15, least: float = 0.7) -> Column:
    """Whether the first and the last n characters of two texts are like enough by edit distance."""
    like = lambda x, y: F.when(F.greatest(F.length(x), F.length(y)) > 0, 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))).otherwise(1.0)
    tail = lambda x: F.substring(x, F.greatest(F.length(x) - n + 1, F.lit(1)), F.lit(n))
    return (like(F.left(a, F.lit(n)), F.left(b, F.lit(n))) >= least) & (like(tail(a), tail(b)) >= least)


def words(text: Column) -> Column:
    """Lower-cased words without marks."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}'’-]+"), lambda w: w != "")


def pauses(df: DataFrame, key: str, order: str, is_pause: Column, cell: Column) -> DataFrame:
    """Runs of consecutive pauses of a sample: (key, island, first, last, n). cell: what the order is cut by, see celled."""
    marked = df.withColumn("_p", F.coalesce(is_pause, F.lit(False)))
    before = celled.lag(marked, [key], [order], cell, {"_q": "_p"})
    start = (F.col("_p") & ~F.coalesce(F.col("_q"), F.lit(False))).cast("bigint")
    numbered = celled.running_sum(before, [key], [order], cell, start, "island")
    return numbered.where("_p").groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def wrapped(units: Column, first: str, last: str, overwrite: bool = False) -> Column:
    """Service signs around the units, or in place of the first and last ones."""
    if overwrite:
        return F.transform(units, lambda u, i: F.when(i == 0, first).when(i == F.size(units) - 1, last).otherwise(u))
    return F.concat(F.array(F.lit(first)), units, F.array(F.lit(last)))


def multi_symbols(units: Column, mode: str, rows: int = 2, unknown: str = UNKNOWN) -> Column:
    """Units of several symbols joined by bars. lines: one array per row of symbols; full: all symbols in a row; short:
    the first two joined."""
    split = F.transform(units, lambda u: F.split(u, "[|]"))
    if mode == "lines":
        return F.array(*(F.transform(split, lambda p, r=r: F.coalesce(F.get(p, F.lit(r)), F.lit(unknown))) for r in range(rows)))
    if mode == "full":
        return F.flatten(split)
    return F.transform(split, lambda p: F.array_join(F.slice(p, 1, 2), "|"))


def lengths(units: Column) -> Column:
    return F.transform(units, lambda u: F.length(u))


def unit_shares(n: Column) -> Column:
    """Inverse length of its word for every unit."""
    return F.flatten(F.transform(n, lambda k: F.array_repeat(F.try_divide(F.lit(1.0), k), F.greatest(k.cast("int"), F.lit(0)))))


def clauses(a: Column) -> Column:
    """Sum of an array, as used for lengths of clauses."""
    return N.array_sum(a)


def prosody_codes(tags: Column) -> Column:
    """Tags as classes from 0 up: tag + 1, null as 0; and back with prosody_tags."""
    return F.transform(tags, lambda t: F.coalesce(t, F.lit(-1)) + 1)


def prosody_tags(codes: Column) -> Column:
    return F.transform(codes, lambda c: c - 1)


def emphasis_labels(units: Column, emphasis: Column) -> Column:
    """1 for units of words with emphasis, else 0, repeated by the numbers of units of the words."""
    return F.flatten(F.zip_with(units, emphasis, lambda n, e: F.array_repeat(F.when(F.coalesce(e, F.lit(False)), 1).otherwise(0), n.cast("int"))))


def breath_mask(units: Column, levels: Column, silence: str = "<SIL>") -> Column:
    """Noise level of silent units, -3 where it is not known, -10 for all other units."""
    return F.zip_with(units, levels, lambda u, v: F.when(u == silence, F.coalesce(v.cast("double"), F.lit(-3.0))).otherwise(-10.0))


def subword_places(words_: Column, pieces: Column) -> Column:
    """For every piece of the words the place of its word: pieces are an array of pieces per word."""
    return F.flatten(F.transform(F.arrays_zip(words_.alias("w"), pieces.alias("p")), lambda x, i: F.array_repeat(i, F.greatest(F.size(x["p"]), F.lit(0)))))


def row_bytes(df: DataFrame) -> Column:
    """Size of a row as JSON, for reports."""
    return F.octet_length(F.to_json(F.struct(*df.columns)))
