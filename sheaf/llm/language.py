"""Language of documents and of the parts of mixed ones (problem 6).

Method: compression classification. A text is encoded with a zstandard raw-content dictionary of each language in
question; the language whose dictionary gives the smallest output is chosen, and rejected where the margin to the next
is narrow. Sentences, and within a sentence runs of different scripts and long clauses, are classified apart; only
those of more than FEW words can make a document mixed, so that borrowed names and titles do not.

In every script a text without any dictionary is a rival too (STRANGE): a text in another language of the script is not
much smaller under any of its dictionaries, so a language alone in its script does not win unopposed.

The dictionaries are made here from a bounded sample: at most TRAIN_ROWS labelled rows of a label, of at most TRAIN_BYTES
bytes each. Labels may be wrong, so a row enters a dictionary only if its words, over the whole sample, speak for its
label.

Defined results: null, empty and letterless texts have no language and give no row; rows delivered again give one row;
a text whose parts all have narrow margins is judged by the sum over its parts; if that margin is narrow too, or the
script has no dictionary, its language is UNKNOWN, with the confidence of the best guess or 0; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import canonical

TRAIN_ROWS = 2_000  # bound of the labelled rows of a label
TRAIN_BYTES = 2_000  # bytes of a row of the sample
UNKNOWN = "und"
DICTIONARY = 64_000  # bytes of a dictionary
LEVEL = 9
FEW = 5  # words that a borrowed name or title may have
FEW_CJK = 8  # the same in Han and kana characters
MARGIN = 0.06  # least share of the output that the next language must take more
SUM_MARGIN = 0.02  # the same for the sum over all parts of a text whose parts have narrow margins
STRANGE, ALONE = 0.18, 0.6  # the same for the output without a dictionary; for a language alone in its script
TELLING = 12  # characters of a part from which the output without a dictionary tells
CLAUSE_MARGIN, CLAUSE_BYTES = 0.15, 6  # the same for a clause to stand apart from its sentence, and in bytes

# Three-letter codes and English names of the languages, by two-letter code.
NAMES = {
    "en": "eng english", "ru": "rus russian", "de": "deu ger german", "es": "spa spanish", "fr": "fra fre french", "it": "ita italian",
    "pt": "por portuguese", "kk": "kaz kazakh", "hi": "hin hindi", "zh": "zho chi cmn chinese mandarin", "ja": "jpn japanese",
    "uk": "ukr ukrainian", "pl": "pol polish", "nl": "nld dut dutch", "tr": "tur turkish", "ar": "ara arabic", "ko": "kor korean",
    "cs": "ces cze czech", "sv": "swe swedish", "da": "dan danish", "fi": "fin finnish", "el": "ell gre greek", "he": "heb hebrew",
    "hu": "hun hungarian", "ro": "ron rum romanian", "bg": "bul bulgarian", "vi": "vie vietnamese", "ca": "cat catalan",
}
SENTENCE = re.compile(r"[^.!?…。！？｡।]*(?:[.!?…。！？｡।]+|$)[\"”»’“‘)」』\]]*")
CLAUSE = re.compile(r"(?<=[,;:，、；：])\s*(?!\d)")
RUNS = {
    "L": re.compile(r"[A-Za-zÀ-ɏ]+(?:['’][A-Za-zÀ-ɏ]+)*"),
    "C": re.compile(r"[Ѐ-ԯ]+"),
    "D": re.compile(r"[ऀ-ॿ]+"),
    "H": re.compile(r"[぀-ヿ㐀-䶿一-鿿]"),
}
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[^\W\d_A-Za-zÀ-ɏЀ-ԯऀ-ॿ぀-ヿ㐀-䶿一-鿿]")  # letters of scripts that are not among the runs


def label_language(meta: Column) -> Column:
    """The two-letter language that the lang entry of a TextGrid meta label names, null if none: case, region suffix,
    three-letter codes and English names are understood."""
    value = F.regexp_extract(meta, r"""(?:'lang'|"lang")\s*:\s*(?:'([^']*)'|"([^"]*)")""", 0)
    raw = F.lower(F.trim(F.regexp_replace(value, r"""(?s)^(?:'lang'|"lang")\s*:\s*.|.$""", "")))
    head = F.regexp_extract(raw, r"^([a-z]+)(?:[-_].*)?$", 1)
    table = F.create_map(*[F.lit(x) for two, names in NAMES.items() for word in (two, *names.split()) for x in (word, two)])
    return table[head]


class Languages:
    """The dictionaries, ready to compress, by language; the script of each."""

    def __init__(self, content: dict[str, bytes], scripts: dict[str, str]) -> None:
        self.by_script: dict[str, list[str]] = defaultdict(list)
        self.code = {}
        for lang, data in sorted(content.items()):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.code[lang] = zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.by_script[scripts[lang]].append(lang)
        self.bare = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

    def rival(self, text: str) -> int:
        """Bytes of the text without a dictionary."""
        return len(self.bare.compress(text.encode()))

    def sizes(self, text: str, script: str) -> dict[str, int]:
        """Bytes of the text under each language of the script."""
        data = text.encode()
        return {lang: len(self.code[lang].compress(data)) for lang in self.by_script.get(script, ())}


def verdict(sizes: dict[str, int]) -> tuple[str | None, float, float]:
    """Language of the smallest output, confidence in it, and margin to the next as a share of the output."""
    if not sizes:
        return None, 0.0, 0.0
    (a, lang), *rest = sorted((n, k) for k, n in sizes.items())
    if not rest:
        return lang, 1.0, 1.0
    margin = (rest[0][0] - a) / a
    return lang, 1 / sum(math.exp(min(0.0, (a - n) / 2)) for n in sizes.values()), margin


def apart(sizes: dict[str, int]) -> bool:
    """Whether the margin of a clause is wide enough to part it from its sentence."""
    a, b = sorted(sizes.values())[:2]
    return b - a >= CLAUSE_BYTES and b - a >= CLAUSE_MARGIN * a


def weight(script: str, n: int) -> float:
    """How far n words or characters go beyond a borrowed title."""
    return n / (FEW_CJK if script == "H" else FEW)


def script_runs(text: str, a: int, b: int) -> list[tuple[str, int, int, int]]:
    """Script, begin, end and words of what stands of each script in text[a:b]."""
    out = []
    for s, pattern in RUNS.items():
        found = list(pattern.finditer(text, a, b))
        if found:
            out.append((s, found[0].start(), found[-1].end(), len(found)))
    return out


def parts(text: str, langs: Languages) -> list[tuple[int, int, str | None, float, bool, dict[str, int]]]:
    """Begin, end, language, confidence, whether it is more than a borrowed title, and sizes, of the parts of a text."""
    out = []

    def judge(s: str, p: int, q: int, n: int) -> tuple:
        sizes = langs.sizes(text[p:q], s)
        lang, sure, margin = verdict(sizes)
        if q - p >= TELLING:
            bare, a = langs.rival(text[p:q]), min(sizes.values())
            if len(sizes) == 1:
                sure = 1 / (1 + math.exp(min(0.0, (a - bare) / 2)))
            if bare - a < (STRANGE if len(sizes) > 1 else ALONE) * a:
                return (p, q, None, sure, weight(s, n) > 1, {})
        return (p, q, lang if margin >= MARGIN else None, sure, weight(s, n) > 1, sizes)

    for m in SENTENCE.finditer(text):
        if m.start() == m.end():
            continue
        for s, p, q, n in script_runs(text, m.start(), m.end()):
            if len(langs.by_script.get(s, ())) == 0:
                continue
            whole = judge(s, p, q, n)
            pieces = []
            if weight(s, n) > 2 and len(langs.by_script[s]) > 1:  # long clauses apart
                at = p
                for cut in [c.end() for c in CLAUSE.finditer(text, p, q)] + [q]:
                    k = sum(x[3] for x in script_runs(text, at, cut) if x[0] == s)
                    if weight(s, k) > 1:
                        pieces.append(judge(s, at, cut, k))
                    at = cut
            clear = [x for x in pieces if x[2] and len(x[5]) > 1 and apart(x[5])]
            if len({x[2] for x in clear}) > 1:
                out += clear
            else:
                out.append(whole)
    return out


def plain(text: str) -> str:
    """The consistent form, with all look-alike letters of mixed tokens repaired: which language a word is from needs no
    proof that the corpus has it."""
    form = canonical.unified(text)
    out, at = [], 0
    for a, b, fixed in canonical.suspects(form):
        out += [form[at:a], fixed]
        at = b
    return "".join([*out, form[at:]]) if out else form


def identify(text: str | None, langs: Languages) -> tuple[list[tuple[str, float]], list]:
    """Languages of a text with confidences (several: mixed), and its parts."""
    form = plain(text) if text else ""
    strange = len(OTHER.findall(form))
    if 2 * strange > len(LETTER.findall(form)):
        return [(UNKNOWN, 0.0)], []
    found = parts(form, langs)
    if not found:
        return [(UNKNOWN, 0.0)] if LETTER.search(form) else [], []
    best: dict[str, float] = {}
    for x in found:
        if x[4] and x[2]:
            best[x[2]] = max(best.get(x[2], 0.0), x[3])
    if best:
        return sorted(best.items()), found
    lead = max(found, key=lambda x: (x[4], x[1] - x[0]))
    total: Counter = Counter()
    for x in found:
        if x[5].keys() == lead[5].keys():
            total.update(x[5])
    lang, sure, margin = verdict(dict(total))
    return [(lang, sure) if lang and margin >= SUM_MARGIN else (UNKNOWN, sure)], found


def train(rows: list[tuple[str, str]]) -> Languages:
    """Dictionaries from (text, label) rows with some wrong labels."""
    content, scripts = dictionaries(rows)
    return Languages(content, scripts)


def dictionaries(rows: list[tuple[str, str]]) -> tuple[dict[str, bytes], dict[str, str]]:
    """Dictionary content and script of each label. Rows whose words, by their counts over all rows, speak for another
    label, or whose sentences disagree, are left out."""
    counts: dict[str, Counter] = defaultdict(Counter)
    total: Counter = Counter()
    split = []
    for text, label in rows:
        text = canonical.unified(text)
        s = max(RUNS, key=lambda s: len(RUNS[s].findall(text)))
        words = RUNS[s].findall(text)
        if words:
            split.append((text, label, s, words))
            counts[label].update(words)
            total.update([label] * len(words))
    major = {label: Counter(s for _, x, s, _ in split if x == label).most_common(1)[0][0] for label in counts}
    content: dict[str, list[str]] = defaultdict(list)
    size: Counter = Counter()
    for text, label, s, words in split:
        rivals = [x for x in counts if major[x] == s]
        if label not in rivals or size[label] >= DICTIONARY:
            continue
        score = {x: sum(math.log((counts[x][w] + 0.1) / (total[x] + 1000)) for w in words) for x in rivals}
        if max(score, key=score.get) == label and len(RUNS[s].findall(text)) == len(words) and not any(p.findall(text) for k, p in RUNS.items() if k != s):
            half = [max(rivals, key=lambda x: sum(math.log((counts[x][w] + 0.1) / (total[x] + 1000)) for w in part)) for part in (words[: len(words) // 2], words[len(words) // 2 :]) if len(part) > 3]
            if all(x == label for x in half):
                content[label].append(text)
                size[label] += len(text.encode()) + 1
    return {k: "\n".join(v).encode()[:DICTIONARY] for k, v in content.items()}, major


def sample(df: DataFrame, key: str, text: str, label: Column, rows: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows, for each label spread over the whole table by a hash of the key. The labels are
    those of NAMES, so their number is fixed."""
    short = F.octet_length(text) <= TRAIN_BYTES
    known = df.where(short).select(F.col(key).alias("k"), F.col(text).alias("t"), label.alias("l")).where("l is not null")
    sizes = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    if not sizes:
        return []
    parts = 1_000_000
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, math.ceil(parts * min(1.0, rows / n)))])
    some = known.where(F.pmod(F.xxhash64("k"), F.lit(parts)) < share[F.col("l")])
    return [(r["t"], r["l"]) for r in some.limit(2 * rows * len(sizes)).sort("k", "t").select("t", "l").collect()]


def languages(df: DataFrame, meta: str, key: str = "seg_id", text: str = "text") -> DataFrame:
    """One row per row with a language: key, label (or null), langs (language, confidence), parts (begin, end, language,
    confidence; of the form that canonical.unified gives)."""
    label = label_language(F.col(meta))
    content, scripts = dictionaries(sample(df, key, text, label))
    shared = df.sparkSession.sparkContext.broadcast((content, scripts))
    sort = df.schema[key].dataType.simpleString()
    named = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64())]))
    spans = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Languages(*shared.value)
        for batch in batches:
            got = [identify(t, known) for t in batch.column(1).to_pylist()]
            langs = pa.array([[{"lang": a, "confidence": b} for a, b in x] for x, _ in got], named)
            part = pa.array([[{"begin": x[0], "end": x[1], "lang": x[2], "confidence": x[3]} for x in y] for _, y in got], spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), langs, part], names=[key, "label", "langs", "parts"])

    out = f"`{key}` {sort}, label string, langs array<struct<lang:string,confidence:double>>, parts array<struct<begin:int,end:int,lang:string,confidence:double>>"
    return df.select(key, text, label.alias("label")).where(F.col(text).isNotNull()).mapInArrow(run, out).where("size(langs) > 0")


def issues(found: DataFrame, key: str = "seg_id") -> DataFrame:
    """Rows with a problem: mixed (a row per language), missing or wrong label; rows delivered again count once; of rows of
    an unknown language nothing can be said."""
    n = F.size("langs")
    issue = F.when(n > 1, "mixed").when(F.col("langs")[0]["lang"] == UNKNOWN, None).when(F.col("label").isNull(), "missing").when(F.col("label") != F.col("langs")[0]["lang"], "wrong")
    return found.select(key, issue.alias("issue"), F.explode("langs.lang").alias("lang")).where("issue is not null").distinct()
