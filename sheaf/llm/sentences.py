"""Sentence units across languages and scripts (problem 1).

Document-centred disambiguation: whether a stop ends a sentence is decided from how the word before it behaves where
the text is unambiguous (followed by a lower-case word or a digit, standing at the end of a paragraph, written without
a stop), first in the document itself, then, where the document is silent, over the whole corpus, with a rule for words
too rare to be counted.  Of a capitalised word after a short form, the document tells whether it is a name (capitalised
inside units, never lower-cased) or a common word (lower-cased, never capitalised inside units).  Initials are decided by
the corpus only.  Scripts without letter case or spaces have their own terminators and line rules.

Defined results: null, empty and blank texts give no unit; a text without any terminator is one unit per heading, list
entry or paragraph; repeated rows give repeated units; columns of the input other than id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of evidence up to which they are broadcast. Only rows that decide otherwise than no evidence would are kept, and
#: no word is too rare for that; a table with more of them is joined with the words that the texts ask for.
MOST = 500_000
#: Occurrences before a stop from which the corpus decides about a word.
MIN_EVIDENCE = 5
#: Characters of a unit before an ellipsis up to which its words are compared.
FRAGMENT = 400
#: Marks that may be open at once between a quotation mark or bracket and its partner.
DEEP = 100

# Terminators, brackets and quotation marks, list marks, reporting words.
OPEN = {"“": "”", "„": "“”", "‘": "’", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》"}
CLOSE = set("”“’»«›」』）)]】》")
EVENT = re.compile(r"[.!?…。！？｡．।॥]+|[\"＂“”„‘’«»‹›「」『』（）()\[\]【】《》]")
STOPS = ".!?…。！？｡．।॥"
STRONG = set("!?。！？｡।॥")
PARAGRAPH = re.compile(r"\r?\n(?:[^\S\r\n]*\r?\n)+|\r(?!\n)(?:\s*\r)+")
MARK = re.compile(r"[^\S\n]*(?:\(?\d{1,3}[.)．、）]|[A-Za-zА-я][)]|[-•*–·▪◦‣●])[^\S\n]+(?=\S)")
TOKEN = re.compile(r"[^\s.,;:!?…。！？।．\"“”„«»‘’()（）「」『』\[\]—]+")
NOT_TOKEN = set(" \t\n\r　\xa0,;:!?…。！？।．\"“”„«»‘’()（）「」『』[]—/")
CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")
LETTER = re.compile(r"[^\W\d_]")
LETTERS = re.compile(r"[^\W\d_]+")
INNER = re.compile(r"(?<=[^\W\d_][^\S\r\n])[^\W\d_]+")  # after a letter and a space: no unit starts here
SAYS = re.compile(r"(?:说|說|问|問|答|道[：，。]|回答|追问|低声|小声|轻声|大声|喊|叫道|解释|と|って|बोल|कह|पूछ|फुसफुसा|जवाब|चिल्ला|पुकार|जानना|हैरान|दोहरा)")
HEAD = re.compile(r"\s*(?:[^\W\d_]+\s+)?(?:\d{1,4}|[IVXLCDM]{1,7})\s*(?:[.:)．]|-\w+\.?|$)")


def is_cjk(text: str) -> bool:
    """Whether most letters of the text are Han or kana."""
    n = len(CJK.findall(text))
    return n > 0 and 2 * n > len(LETTER.findall(text))


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Spans between blank lines."""
    at = 0
    for m in PARAGRAPH.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def blocks(text: str, cjk: bool) -> Iterator[tuple[int, int, bool]]:
    """Spans that no unit crosses, and whether the span is an entry or heading on its own line."""
    for a, b in paragraphs(text):
        lines, at = [], a
        for line in text[a:b].split("\n"):
            lines.append((at, at + len(line)))
            at += len(line) + 1
        lines = [(p, q) for p, q in lines if text[p:q].strip()]
        if cjk:
            for p, q in lines:
                yield p, q, bool(MARK.match(text, p, q))
            continue
        start, entry = None, False
        for i, (p, q) in enumerate(lines):
            if MARK.match(text, p, q) and (i == 0 or entry or text[lines[i - 1][0] : lines[i - 1][1]].rstrip().endswith(":")):
                if start is not None:
                    yield start, p, entry
                start, entry = p, True
            elif start is None:
                start = p
        if start is not None:
            yield start, b, entry or (len(lines) == 1 and heading(text[start:b]))


def heading(line: str) -> bool:
    """A single short line without a final stop that begins with a number, a roman numeral or a word and a number."""
    x = line.strip()
    return len(x) <= 120 and x[-1:] not in STOPS and x[-1:] not in CLOSE and x[-1:] not in '";:,' and bool(HEAD.match(x))


def quoted(text: str, a: int, b: int, events: list[re.Match]) -> list[tuple[int, int]]:
    """Outermost spans of quotation marks and brackets in text[a:b]; marks without a partner count as plain text."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for m in events:
        c = m.group()
        if c[0] in STOPS:
            continue
        p = m.start()
        if c in "’'" and a < p < b - 1 and text[p - 1].isalpha() and text[p + 1].isalpha():
            continue
        if c in '"＂':
            k = next((k for k in range(len(stack) - 1, max(-1, len(stack) - DEEP), -1) if stack[k][0] in '"＂'), None)
            if k is None:
                stack.append((c, p))
                continue
        elif c in CLOSE and (k := next((k for k in range(len(stack) - 1, max(-1, len(stack) - DEEP), -1) if c in OPEN.get(stack[k][0], "")), None)) is not None:
            pass
        elif c in OPEN:
            stack.append((c, p))
            continue
        else:
            continue
        spans.append((stack[k][1], p))
        del stack[k:]
    outer: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not outer or s > outer[-1][1]:
            outer.append((s, e))
    return outer


def before(text: str, a: int, i: int) -> str:
    """The word right before position i, inner stops included, at most 16 characters of it."""
    j = i
    while j > a and i - j < 16 and text[j - 1] not in NOT_TOKEN:
        j -= 1
    word = text[j:i]
    k = word.rfind(".")
    return word[k + 1 :] if k > 2 and word[k - 1].islower() and word[k + 1 : k + 2].isupper() else word  # a missing space


def upcoming(text: str, i: int, b: int) -> tuple[str, int]:
    """Kind of what follows position i: end, lower, upper, digit, other (uncased letter), speech, comma; where it is."""
    j = i
    while j < b and text[j].isspace():
        j += 1
    if j >= b:
        return "end", j
    c = text[j]
    if c in ",;:，；：、":
        return "comma", j
    k = j
    while k < b and (text[k] in "¿¡—–-" or text[k] in OPEN or text[k] in '"＂' or text[k].isspace()):
        k += 1
    d = text[k] if k < b else " "
    if c in "—–-":
        return ("lower" if d.islower() else "upper"), j
    if d.islower():
        return ("lower" if k == j else "speech"), j
    if d.isupper() or d.istitle():
        return "upper", j
    if d.isdigit():
        return "digit", j
    if d.isalpha():
        return "other", j
    return "mark", j


class Evidence:
    """What the corpus says about words before stops; empty: only the rules."""

    def __init__(self, rows: dict[tuple[str, str], tuple[int, int, int, int]] | None = None) -> None:
        self.rows = rows or {}
        self.known: dict[str, str] = {}

    def kind(self, word: str) -> str:
        """'word', 'final' (a short form that can end a sentence) or 'short' (one that cannot)."""
        if (found := self.known.get(word)) is None:
            found = self.known[word] = self._kind(word)
        return found

    def _kind(self, word: str) -> str:
        low, up, end, bare = self.rows.get(("w", word), (0, 0, 0, 0))
        seen = low + up + end
        if len(word) == 1 and word.isupper():  # an initial, unless paragraphs end in it
            return "final" if end >= max(1, 0.015 * (up + end)) else "short"
        if seen >= MIN_EVIDENCE and len(word) <= 8:
            if bare <= 0.1 * seen or (low >= 0.3 * seen and bare <= seen):
                return "final" if end >= max(1, 0.015 * (up + end)) else "short"
            return "word"
        if re.fullmatch(r"[IVXLC]+", word) or len(word) == 1 and not word.isdigit():
            return "short"
        if "." in word:
            return "final"
        return "short" if len(word) <= 3 and word[:1].isupper() and not re.search(r"(?i)[aeiouyаеёиоуыэюяәіөұүáéíóúàèìòùäöü]", word) else "word"

    def counted(self, word: str) -> bool:
        """Whether the word is frequent enough to be decided by counts."""
        return sum(self.rows.get(("w", word), (0, 0, 0, 0))[:3]) >= MIN_EVIDENCE

    def opener(self, fragment: str) -> bool:
        """Whether the corpus has the fragment before an ellipsis and a lower-case word."""
        return self.rows.get(("f", fragment), (0,))[0] > 0

    def closes(self, word: str) -> bool:
        """Whether sentences of an uncased script end in this word (Han, kana: two last characters)."""
        return self.rows.get(("c", word), (0,))[0] >= 2

    def follows(self, word: str) -> str:
        """'name', 'common' or 'unknown': only a document tells."""
        return "unknown"


def asks(text: str) -> set[tuple[str, str]]:
    """(kind, word) of all evidence that the units of a text may depend on: the words before all stops, the tails before
    ellipses, and what stands between an ellipsis and any place before it where a unit may begin."""
    out: set[tuple[str, str]] = set()
    for a, b in paragraphs(text):
        begins = [a]
        for m in EVENT.finditer(text, a, b):
            if m.group()[0] in STOPS:
                if (word := before(text, a, m.start())):
                    out.add(("w", word))
                if (t := tail(text, a, m.start())):
                    out.add(("c", t))
                if m.group() not in (".", "．") and not set(m.group()) & STRONG:
                    out |= {("f", part) for at in begins if (part := fragment(text, at, m.start()))}
            begins = [at for at in begins if m.end() - at <= FRAGMENT] + [m.end()]
        for line in re.finditer(r"\n", text[a:b]):  # lines may begin units too
            for m in EVENT.finditer(text, a + line.end(), min(b, a + line.end() + FRAGMENT)):
                if m.group()[0] in STOPS and m.group() not in (".", "．") and (part := fragment(text, a + line.end(), m.start())):
                    out.add(("f", part))
    return out


class Document(Evidence):
    """What a text says about itself; where it is silent, the corpus decides. Read once it is asked."""

    def __init__(self, text: str, corpus: Evidence) -> None:
        super().__init__()
        self.text, self.corpus, self.read = text, corpus, False
        self.words: set[str] | None = None

    def own(self, kind: str, word: str) -> tuple[int, ...]:
        if not self.read:
            into: Counter = Counter()
            evidence(self.text, into)
            self.rows = tabled(into)
            self.read = True
        return self.rows.get((kind, word), (0, 0, 0, 0))

    def _kind(self, word: str) -> str:
        """Besides the kinds of the corpus: 'either', a short form of which neither the document nor the corpus tells
        whether it can end a sentence."""
        if len(word) == 1 and word.isupper() or len(word) > 8:
            return self.corpus.kind(word)
        low, up, end, bare = self.own("w", word)
        seen = low + up + end
        if low and (bare <= 0.1 * seen or (low >= 0.3 * seen and bare < low)):
            if end:
                return "final"
            sort = self.corpus.kind(word)
            return sort if sort != "word" and self.corpus.counted(word) else "either"
        if not low and bare >= 2 and bare >= seen:
            return "word"
        return self.corpus.kind(word)

    def opener(self, fragment: str) -> bool:
        return self.corpus.opener(fragment) or self.own("f", fragment)[0] > 0

    def closes(self, word: str) -> bool:
        return self.corpus.closes(word) or self.own("c", word)[0] >= 2

    def follows(self, word: str) -> str:
        if self.words is None:
            self.words, self.inner = set(LETTERS.findall(self.text)), set(INNER.findall(self.text))
        lower = word.lower() in self.words
        if word in self.inner:
            return "unknown" if lower else "name"
        return "common" if lower else "unknown"


def tabled(into: Counter) -> dict[tuple[str, str], list[int]]:
    """(kind, word) -> low, up, end, bare."""
    rows: dict[tuple[str, str], list[int]] = {}
    for (kind, word, slot), n in into.items():
        rows.setdefault((kind, word), [0, 0, 0, 0])[slot] += n
    return rows


def tail(text: str, a: int, i: int) -> str:
    """What is counted before a sure terminator of an uncased script."""
    w = before(text, a, i)
    return w[-2:] if w and CJK.match(w[-1]) else w


def fragment(text: str, a: int, i: int) -> str | None:
    """The words of a unit before an ellipsis in one form, None if they are many."""
    if i - a > FRAGMENT:
        return None
    x = text[a:i].strip().lstrip("—–-¿¡\"'“„«‘»(")
    return " ".join(x.lower().split()) if len(x) <= 48 else None


def ends(text: str, a: int, b: int, at: int, m: re.Match, ev: Evidence, cjk: bool) -> bool:
    """Whether the stops m end the unit that began at position at of the block text[a:b]."""
    stops, i = m.group(), m.end()
    kind, j = upcoming(text, i, b)
    if kind in ("end",):
        return True
    if kind in ("comma", "mark") and not (kind == "mark" and set(stops) & STRONG):
        return False
    prev = text[m.start() - 1] if m.start() > a else " "
    if set(stops) & STRONG:
        return kind != "lower"
    if stops == "." or stops == "．":
        if CJK.match(prev) or prev in CLOSE and cjk:
            return kind != "digit" or j > i
        if cjk and stops == "．" and prev in "）」』”":
            return True
        word = before(text, a, m.start())
        if not word:
            return j > i and kind in ("upper", "speech")
        if m.start() - at < 40 and text[at : m.start()].strip() == word and (word.isdigit() or re.fullmatch(r"[IVXLC]+", word)):
            return False
        if kind == "lower":
            return False
        if j == i:  # nothing between the stop and what follows
            if kind != "upper" or not prev.islower() or len(word) < 2 or text[j] in CLOSE:
                return False
        sort = ev.kind(word)
        if sort == "word":
            return kind in ("upper", "digit", "other", "speech")
        if sort == "either":
            return kind == "upper" and (m := LETTERS.search(text, j, b)) is not None and ev.follows(m.group()) == "common"
        return sort == "final" and kind in ("upper", "other", "speech")
    # an ellipsis
    if kind in ("lower",):
        return False
    part = fragment(text, at, m.start())
    if part is None:
        return True
    if kind == "other":
        return ev.closes(tail(text, a, m.start()))
    return not ev.opener(part)


def units(text: str | None, ev: Evidence) -> list[tuple[int, int]]:
    """Half-open spans of the sentence units of a text, in order, without outer whitespace."""
    if not text or text.isspace():
        return []
    cjk = is_cjk(text)
    ev = Document(text, ev)
    out: list[tuple[int, int]] = []

    def give(p: int, q: int) -> None:
        while p < q and text[p].isspace():
            p += 1
        while q > p and text[q - 1].isspace():
            q -= 1
        if p < q:
            out.append((p, q))

    for a, b, whole in blocks(text, cjk):
        if whole:
            give(a, b)
            continue
        events = list(EVENT.finditer(text, a, b))
        spans = quoted(text, a, b, events)
        at, k = a, 0
        for m in events:
            p = m.start()
            while k < len(spans) and spans[k][1] < p:
                k += 1
            if p < at:
                continue
            if m.group()[0] in STOPS:
                if k < len(spans) and spans[k][0] < p:
                    continue
                if ends(text, a, b, at, m, ev, cjk):
                    give(at, m.end())
                    at = m.end()
            elif k < len(spans) and p == spans[k][1]:
                inner = p - 1
                while inner > spans[k][0] and (text[inner].isspace() or text[inner] in CLOSE):
                    inner -= 1
                if text[inner] not in STOPS:
                    continue
                kind, j = upcoming(text, p + 1, b)
                if kind == "end" or kind in ("upper", "digit", "speech") or (kind == "other" and not SAYS.match(text, j, b)):
                    give(at, p + 1)
                    at = p + 1
        give(at, b)
    return out


def evidence(text: str | None, into: Counter) -> None:
    """Adds what the unambiguous places of a text say about the words before stops."""
    if not text or text.isspace():
        return
    cjk = is_cjk(text)
    for a, b in paragraphs(text):
        if not cjk:
            for w in TOKEN.findall(text, a, b):
                if len(w) <= 8:
                    into["w", w, 3] += 1
        last = len(text[a:b].rstrip()) + a
        at = a
        for m in re.finditer(r"[.!?…。！？｡．।॥]+", text[a:b]):
            i, stops = a + m.end(), m.group()
            s = a + m.start()
            kind, j = upcoming(text, i, b)
            if stops in (".", "．"):
                w = before(text, a, s)
                if w and len(w) <= 8 and not CJK.match(w[-1]) and not w.isdigit():
                    if "." not in w:
                        into["w", w, 3] -= 1
                    line = text.rfind("\n", i, j) + 1
                    slot = 2 if i >= last or line and MARK.match(text, line, b) else 0 if kind in ("lower", "digit", "comma") else 1 if kind in ("upper", "other") and j > i else None
                    if slot is not None:
                        into["w", w, slot] += 1
            elif set(stops) & STRONG:
                if (cjk or "।" in stops) and (t := tail(text, a, s)):
                    into["c", t, 0] += 1
                at = i
                continue
            elif kind == "lower" and (part := fragment(text, at, s)):
                into["f", part, 0] += 1
                continue
            if kind == "upper":
                at = i


def decisive(kind: str, word: str, row: tuple[int, int, int, int]) -> bool:
    """Whether the evidence changes anything: the kind of the word, or whether it is counted as a short form."""
    ev = Evidence({(kind, word): row})
    if kind == "w":
        return ev.kind(word) != Evidence().kind(word) or (ev.counted(word) and ev.kind(word) != "word")
    return ev.opener(word) if kind == "f" else ev.closes(word)


ROW = "kind string, word string, low long, up long, fin long, bare long"


def corpus_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """The evidence of all texts that decides anything: (kind, word, low, up, fin, bare)."""
    names = ["kind", "word", "low", "up", "fin", "bare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                evidence(t, into)
            if len(into) > MOST:  # what a task holds stays bounded
                yield of(into)
                into = Counter()
        yield of(into)

    def of(into: Counter) -> pa.RecordBatch:
        rows = tabled(into)
        cols = [pa.array([k for k, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())]
        return pa.RecordBatch.from_arrays(cols + [pa.array([v[i] for v in rows.values()], pa.int64()) for i in range(4)], names=names)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([decisive(k, w, tuple(v)) for k, w, *v in zip(*(c.to_pylist() for c in batch.columns))], pa.bool_()))

    table = df.select(text).mapInArrow(run, ROW).groupBy("kind", "word").agg(*(F.sum(c).alias(c) for c in names[2:]))
    return table.where("low + up + fin > 0").mapInArrow(keep, ROW)


def gather(df: DataFrame, text: str = "text") -> Evidence | DataFrame:
    """Corpus evidence in one pass over the texts: on the driver if it has at most MOST rows, else as a table."""
    table = corpus_rows(df, text).persist()
    some = table.limit(MOST + 1).collect()
    if len(some) > MOST:
        return table
    table.unpersist()
    return Evidence({(r["kind"], r["word"]): (r["low"], r["up"], r["fin"], r["bare"]) for r in some})


def with_evidence(df: DataFrame, key: str, text: str, rows: DataFrame) -> DataFrame:
    """(key, text, said): each text with the evidence that it may ask for, as an array of rows. Only the words are joined
    with the evidence; the texts are shuffled once, by a hash of key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[str] = []
            kinds: list[str] = []
            words: list[str] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, word in asks(t):
                    ids.append(i)
                    kinds.append(kind)
                    words.append(word)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, kinds, words)], names=["_row", "kind", "word"])

    row = F.concat_ws("-", F.xxhash64(key, text), F.xxhash64(F.lit(1), key, text))
    texts = df.select(key, text).where(F.col(text).isNotNull()).withColumn("_row", row)
    asked = texts.select("_row", text).dropDuplicates(["_row"]).mapInArrow(run, "_row string, kind string, word string")
    said = asked.join(rows, ["kind", "word"]).groupBy("_row").agg(F.collect_list(F.struct("kind", "word", "low", "up", "fin", "bare")).alias("said"))
    return texts.join(said, "_row", "left").select(key, text, "said")


def with_known(df: DataFrame, key: str, text: str, ev: Evidence | DataFrame, of: Callable[[pa.Array, list[str], Iterator[Evidence]], pa.RecordBatch], schema: str) -> DataFrame:
    """of(keys, texts, evidence for each text) over all batches, with the evidence broadcast or joined."""
    if isinstance(ev, DataFrame):

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said = batch.column(2).to_pylist()
                yield of(batch.column(0), batch.column(1).to_pylist(), (Evidence({(r["kind"], r["word"]): (r["low"], r["up"], r["fin"], r["bare"]) for r in x or ()}) for x in said))

        return with_evidence(df, key, text, ev).mapInArrow(joined, schema)
    shared = df.sparkSession.sparkContext.broadcast(ev.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Evidence(shared.value)
        for batch in batches:
            yield of(batch.column(0), batch.column(1).to_pylist(), repeat(known))

    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)


def sentence_units(df: DataFrame, key: str = "source_id", text: str = "text", ev: Evidence | DataFrame | None = None) -> DataFrame:
    """One row per sentence unit: key, begin_char, end_char (code points, half-open)."""
    sort = df.schema[key].dataType.simpleString()
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[sort]

    def of(keys: pa.Array, texts: list[str], known: Iterator[Evidence]) -> pa.RecordBatch:
        ids: list[int] = []
        begin: list[int] = []
        end: list[int] = []
        for i, t, k in zip(keys.to_pylist(), texts, known):
            found = units(t, k)
            ids += [i] * len(found)
            begin += [p for p, _ in found]
            end += [q for _, q in found]
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=[key, "begin_char", "end_char"])

    return with_known(df, key, text, gather(df, text) if ev is None else ev, of, f"`{key}` {sort}, begin_char int, end_char int")
