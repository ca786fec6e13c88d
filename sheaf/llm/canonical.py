"""One consistent form for text that looks the same but is written with different characters (problem 2).

Method: width, ligatures, composition, spaces, invisible signs and hyphens are unified by rule. Look-alike letters are
repaired script-aware: the letters of a token that exist in one script only tell its dominant script; in a token of
mixed scripts the look-alikes are replaced by those of the dominant script if the result is in the vocabulary of the
corpus (its single-script tokens) or several different spellings in the corpus lead to it. A token made of look-alikes
only takes the script of the nearest decided token around it, under the same condition.

Case, accents, digits, words and other punctuation are kept.

Defined results: null stays null; empty text stays empty; tokens with letters that have no look-alike in the dominant
script stay as they are; a repeated row has the same form; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import weakref
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look the same in Latin, Cyrillic and Greek ("-": none).
ALIKE = """
a а -  c с -  e е -  o о ο  p р -  x х -  y у -  i і -  j ј -  s ѕ -  h һ -  d ԁ -  q ԛ -  w ԝ -  v - ν
A А Α  B В Β  C С -  E Е Ε  H Н Η  I І Ι  J Ј -  K К Κ  M М Μ  N - Ν  O О Ο  P Р Ρ  S Ѕ -  T Т Τ  X Х Χ  Y Ү Υ  Z - Ζ
Q Ԛ -  W Ԝ -  G Ԍ -  ë ё -  Ë Ё -  ï ї -  Ï Ї -  ä ӓ -  Ä Ӓ -  ö ӧ -  Ö Ӧ -  ă ӑ -  Ă Ӑ -  æ ӕ -  Æ Ӕ -  ə ә -  Ə Ә -
"""
SCRIPTS = "LCG"  # Latin, Cyrillic, Greek: the columns of ALIKE
HYPHENS = "‐‑‒−﹣－⁃˗"
INVISIBLE = "".join(chr(c) for c in (0xAD, 0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x180F)))

_cells = [c for line in ALIKE.strip().splitlines() for c in line.split()]
_rows = [_cells[i : i + 3] for i in range(0, len(_cells), 3)]
#: letter -> its look-alike by script
TWINS = {c: dict(zip(SCRIPTS, row)) for row in _rows for c in row if c != "-"}
TO = {s: {ord(c): row[k] for row in _rows for c in row if c != "-" and row[k] != "-"} for k, s in enumerate(SCRIPTS)}
TOKEN = re.compile(r"[^\W\d_]+")
_UNIFY = {ord(c): "-" for c in HYPHENS} | {ord(c): None for c in INVISIBLE} | {c: None for c in range(0x200B, 0x2010)} | {c: None for c in (*range(0x2060, 0x2070), 0xFEFF, *range(0x202A, 0x202F), 0x61C, *range(0x206A, 0x2070))}


def unified(text: str) -> str:
    """The text without differences of width, composition, ligatures, spaces, invisible signs and hyphens."""
    if text.isascii():
        return text if text.isprintable() else re.sub(r"[\t\v\f\r]", " ", text)
    text = unicodedata.normalize("NFKC", text.translate(_UNIFY))
    text = text.translate(_UNIFY)
    return re.sub(r"[^\S\n ]", " ", text)


@lru_cache(1 << 16)
def script(c: str) -> str:
    """L, C or G for a letter of those scripts, else an empty string."""
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L" if c.isalpha() else ""
    if 0x400 <= o < 0x530:
        return "C"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    return ""


@lru_cache(1 << 16)
def nature(token: str) -> tuple[str, str]:
    """Scripts of a token's letters, and scripts of those letters that have no look-alike elsewhere."""
    every, sure = set(), set()
    for c in token:
        if s := script(c):
            every.add(s)
            if c not in TWINS:
                sure.add(s)
    return "".join(sorted(every)), "".join(sorted(sure))


def suspects(form: str) -> list[tuple[int, int, str]]:
    """Begin, end and repaired spelling of the tokens whose letters may be look-alikes."""
    if form.isascii():
        return []
    tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(form)]
    natures = [nature(t) for _, _, t in tokens]
    decided = [k for k, (_, sure) in enumerate(natures) if len(sure) == 1]
    out, d = [], 0
    for k, ((a, b, t), (every, sure)) in enumerate(zip(tokens, natures)):
        while d < len(decided) and decided[d] < k:
            d += 1
        if not every or len(sure) > 1 or (len(every) == 1 and sure):
            continue
        aim = sure
        if not aim:  # look-alikes only: the script of the nearest decided token, the one before first
            near = [j for j in (decided[d - 1] if d else None, decided[d] if d < len(decided) else None) if j is not None]
            aim = natures[min(near, key=lambda j: abs(j - k))][1] if near else ""
        if not aim or every == aim:
            continue
        fixed = t.translate(TO[aim])
        if fixed != t and nature(fixed)[0] == aim:
            out.append((a, b, fixed))
    return out


def forms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row (field, key, raw, form) per value that is not null: raw is a hash of the value, form the consistent form."""
    sort = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unified(t) for t in batch.column(2).to_pylist()]
            spots = [[{"a": a + 1, "n": b - a, "old": f[a:b], "new": x} for a, b, x in suspects(f)] for f in found]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("n", pa.int32()), ("old", pa.string()), ("new", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.string()), pa.array(spots, kind)], names=["field", key, "raw", "form", "spots"])

    tall = df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("v"))
    tall = tall.select(F.col("v.field").alias("field"), key, F.col("v.value").alias("value")).where("value is not null")
    read = tall.withColumn("raw", both(F.col("value"))).mapInArrow(run, f"field string, `{key}` {sort}, raw string, form string, spots array<struct<a:int,n:int,old:string,new:string>>")
    read = held(read)
    wanted = read.select(F.explode("spots").alias("s")).select(F.lower("s.new").alias("token"), F.lower("s.old").alias("old"))
    spelt = wanted.groupBy("token").agg(F.min("old").alias("x"), F.max("old").alias("y"))
    words = read.select(F.explode(F.split(F.lower("form"), r"[^\p{L}\p{M}]+")).alias("token")).distinct()
    known = spelt.join(words.withColumn("known", F.lit(True)), "token", "left").where("known or x <> y").select("token")
    plain = read.where("size(spots) = 0").select("field", key, "raw", "form")
    marked = read.where("size(spots) > 0").withColumn("row", F.xxhash64("field", key, "raw")).dropDuplicates(["field", key, "raw"])
    spots = marked.select("row", "field", key, "raw", F.explode("spots").alias("s")).withColumn("token", F.lower("s.new"))
    accepted = spots.join(known, "token").groupBy("field", key, "raw").agg(F.array_sort(F.collect_list(F.struct("s.a", "s.n", "s.new"))).alias("fix"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [repaired(f, x) for f, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(whole, pa.string())], names=["field", key, "raw", "form"])

    fixed = marked.join(accepted, ["field", key, "raw"], "left").select("field", key, "raw", "form", "fix").mapInArrow(rebuild, f"field string, `{key}` {sort}, raw string, form string")
    return keeping(plain.unionByName(fixed), read)


def repaired(form: str, fix: list[dict] | None) -> str:
    """The form with the accepted spellings put in, in one pass; a repair never changes the length."""
    out, at = [], 0
    for x in fix or ():
        out += [form[at : x["a"] - 1], x["new"]]
        at = x["a"] - 1 + x["n"]
    return "".join([*out, form[at:]]) if out else form


def both(value: Column) -> Column:
    """128 bits of hash as text."""
    return F.concat_ws("-", F.xxhash64(value), F.xxhash64(F.lit(1), value))


def held(df: DataFrame) -> DataFrame:
    """The table, kept once computed, and released when nothing refers to it any more."""
    kept = df.persist()
    weakref.finalize(kept, kept._jdf.unpersist, False).atexit = False
    return kept


def keeping(out: DataFrame, *parts: DataFrame) -> DataFrame:
    """The result, which refers to the kept tables that it is made of."""
    out._kept = parts
    return out


#: Rows of a form that meet all others of it in one task.
HOT = 2000


def alike(found: DataFrame, key: str) -> DataFrame:
    """Pairs (field, key a, key b) of different keys, smaller first, with the same form and different characters.

    Forms of which all values are the same are left out first, by pre-aggregated extremes, however often they repeat;
    the others meet on their form. A form of many rows is salted: one side is cut into parts of about HOT rows, the other
    meets each of them. Where a form has too many pairs to be written out, see classes."""
    rows = held(found.select("field", F.col(key).alias("k"), "raw", both(F.col("form")).alias("form")).distinct())
    several = rows.groupBy("field", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    some = held(rows.join(several.select("field", "form", F.ceil(F.col("n") / HOT).alias("parts")), ["field", "form"]))
    a = some.withColumn("part", F.pmod(F.xxhash64("k", "raw"), F.col("parts"))).alias("a")
    b = some.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).alias("b")
    same = (F.col("a.field") == F.col("b.field")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.part") == F.col("b.part"))
    pair = a.join(b, same & (F.col("a.raw") != F.col("b.raw")) & (F.col("a.k") < F.col("b.k")))
    out = pair.select(F.col("a.field").alias("field"), F.col("a.k").alias(f"{key}_a"), F.col("b.k").alias(f"{key}_b")).distinct()
    return keeping(out, found, rows, some)


def classes(found: DataFrame, key: str) -> DataFrame:
    """The same without writing out pairs: one row (field, key, class, spelling, links) per value of a form that is
    written in several ways. class and spelling are hashes of form and characters; links is the number of rows of the
    class with another spelling. Rows that are not here have no links; copies of a spelling are not linked."""
    rows = found.select("field", key, F.col("raw").alias("spelling"), both(F.col("form")).alias("class")).distinct()
    spellings = rows.groupBy("field", "class", "spelling").agg(F.count(F.lit(1)).alias("same"))
    whole = spellings.groupBy("field", "class").agg(F.sum("same").alias("all"), F.count(F.lit(1)).alias("ways")).where("ways > 1")
    links = spellings.join(whole, ["field", "class"]).select("field", "class", "spelling", (F.col("all") - F.col("same")).alias("links"))
    return keeping(rows.join(links, ["field", "class", "spelling"]).select("field", key, "class", "spelling", "links"), found)
