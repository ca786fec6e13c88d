"""Text quality statistics and the kind of a document: prose, list, table or junk (problem 9).

Method: every line gets a vector of small statistics; a hidden Markov model over the lines of a document labels each
line prose, list, table or junk; the shares of the labels, weighted by characters, give the kind of the document.  The
model is trained here: lines that plain rules decide give the first tables, Viterbi training on a bounded sample of
TRAIN_DOCS documents the final ones.  All kernels work on whole batches of texts.

Words are runs of letters, digits and marks; every Han or kana character is a word. Common words are those of the
language that the document names; a document that names none, or one without a list, has the words of all languages. A
common word of several Han or kana characters counts as all of them.  Symbols are characters other than
letters, marks, digits, white space and common punctuation.

Defined results: null, empty and blank texts have word_count 0, null ratios and kind null; repeated rows give repeated
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes as K

KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK, REPEAT, MISREAD = range(6)
#: Kind of each state of the model: junk has three, unreadable lines, repeated ones and prose in the wrong encoding,
#: which look quite different.
KIND = np.array([PROSE, LIST, TABLE, JUNK, JUNK, JUNK])
STATES = len(KIND)
#: Documents of the training sample, and rounds of Viterbi training.
TRAIN_DOCS = 4000
ROUNDS = 3
#: Share of prose, by characters, from which a document is prose whatever stands beside it.
ENOUGH = 0.15
#: Sizes of the discrete statistics of a line, in the order of Lines.features.
#: States that one statistic (SIGNS) decides; in all others they allow for any value with a chance of LOOSE.
OPEN, SIGNS, LOOSE = [REPEAT, MISREAD], (10, 14), 0.1
SIZES = (10, 9, 8, 6, 7, 10, 6, 8, 6, 5, 4, 6, 7, 4, 3)


def buckets(x: np.ndarray, edges: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, "right")


class Common:
    """Lists of common words by language, as sorted hashes; language 0 has the words of all."""

    def __init__(self, rows: list[tuple[str | None, str]]) -> None:
        names = sorted({lang for lang, word in rows if lang and word})
        self.number = {lang: i + 1 for i, lang in enumerate(names)}
        tall = sorted({(k, word) for lang, word in rows if word for k in {0, self.number.get(lang, 0)}})
        flat, bounds = K.points(pa.array([w for _, w in tall], pa.string()))
        h, at, _ = K.words(flat)
        own = K.owner(at, bounds)
        size = np.bincount(own, minlength=len(tall)) if len(tall) else np.empty(0, np.int64)
        lang = np.array([k for k, _ in tall], np.uint64)
        #: words of one word, and of so many Han or kana characters, marked by their language
        self.lists: dict[int, np.ndarray] = {}
        for n in np.unique(size[size > 0]).tolist():
            value = K.shingles(h, own, n)
            first = np.searchsorted(own, np.flatnonzero(size == n))
            self.lists[n] = np.unique(self.marked(value[first], lang[size == n]))

    @staticmethod
    def marked(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return h ^ (lang * K.P2)

    def marks(self, h: np.ndarray, at: np.ndarray, text: np.ndarray, cjk: np.ndarray, langs: pa.Array) -> np.ndarray:
        """Which words are common: h hashes, at places, text and cjk of the words; langs: languages of the texts."""
        out = np.zeros(len(h), bool)
        number = np.array([self.number.get((x or "").lower(), 0) for x in langs.to_pylist()], np.uint64)
        for n, known in self.lists.items():
            value = self.marked(K.shingles(h, text, n), number[text])
            hit = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
            if n > 1:  # characters side by side
                hit[len(h) - n + 1 :] = False
                hit[: max(0, len(h) - n + 1)] &= (at[n - 1 :] - at[: max(0, len(h) - n + 1)] == n - 1) & cjk[: max(0, len(h) - n + 1)]
            for k in range(n):
                out[k:] |= hit[: len(h) - k]
        return out


class Lines:
    """Statistics of the lines that are not blank, of all texts of a slice."""

    def __init__(self, texts: pa.Array, langs: pa.Array, common: Common) -> None:
        flat, bounds = K.points(texts)
        kind = K.classes(flat)
        n = len(flat)
        starts = np.r_[0, np.flatnonzero(kind[:-1] == K.LINE) + 1] if n else np.empty(0, np.int64)
        line_of = np.zeros(n, np.int64)
        line_of[starts[1:]] = 1
        line_of = np.cumsum(line_of)
        total = len(starts)

        def count(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask.astype(np.int32), starts)

        space = (kind == K.SPACE) | (kind == K.LINE) | (kind == K.FORMAT)
        digit, cjk = kind == K.DIGIT, kind == K.CJK
        letter = (kind == K.LOWER) | (kind == K.UPPER) | (kind == K.LETTER) | cjk | (kind == K.MARK)
        symbol = kind == K.OTHER
        chars = count(~space)
        live = chars > 0
        some = np.maximum(chars, 1)
        self.hash, self.at, self.width = K.words(flat, kind)
        word_line = line_of[self.at]
        words = np.bincount(word_line, minlength=total)
        han = count(cjk)
        self.common = common.marks(self.hash, self.at, K.owner(self.at, bounds), cjk[self.at], langs)
        known = np.bincount(word_line, self.common, minlength=total)
        some_words = np.maximum(words, 1)

        # first and last sign that is not white space
        solid = np.flatnonzero(~space)
        first, last = np.zeros(total, np.int64), np.zeros(total, np.int64)
        if len(solid):
            of = line_of[solid]
            lead = np.r_[True, of[1:] != of[:-1]]
            first[of[lead]] = solid[lead]
            last[of[np.r_[of[1:] != of[:-1], True]]] = solid[np.r_[of[1:] != of[:-1], True]]
        pad = np.r_[flat, np.zeros(4, np.uint32)]
        pad_kind = np.r_[kind, np.full(4, K.SPACE, np.uint8)]
        c0, c1 = pad[first], pad[first + 1]
        after = np.r_[np.where(digit, n, np.arange(n)), n]  # where a run of digits ends
        after = np.minimum.accumulate(after[::-1])[::-1]
        stop1 = after[np.minimum(first, n)]
        e0, e1 = pad[np.minimum(stop1, n)], pad[np.minimum(stop1 + 1, n + 1)]
        blank1 = np.isin(c1, (32, 9, 0x3000, 10))
        start = np.full(total, 9)
        k0 = pad_kind[first]
        start[(k0 == K.UPPER) | cjk[np.minimum(first, max(0, n - 1))] | (k0 == K.LETTER)] = 8
        start[k0 == K.LOWER] = 7
        start[np.isin(c0, [ord(x) for x in "\"“„«‘「『»'(（¿¡>"])] = 6
        start[(c0 == ord("#"))] = 5
        start[(c0 == ord("["))] = 4
        numbered = (k0 == K.DIGIT) & (stop1 - first <= 4)
        start[numbered & np.isin(e0, (32, 9, 0x3000))] = 3
        start[numbered & np.isin(e0, [ord(x) for x in ".)．、）"]) & np.isin(e1, (32, 9, 0x3000))] = 2
        start[np.isin(c0, [ord(x) for x in "-•*+–·▪"]) & blank1] = 1

        end_kind = pad_kind[last]
        before_kind = pad_kind[np.maximum(last - 1, 0)]
        end = np.select([end_kind == K.STOP, (end_kind == K.PUNCT) & (before_kind == K.STOP), end_kind == K.PUNCT, end_kind == K.DIGIT, end_kind == K.OTHER], [0, 1, 2, 3, 4], 5)
        self.closed = (end_kind == K.STOP) | (end_kind == K.PUNCT)

        nxt_space = np.r_[space[1:], True]
        prev = np.r_[np.uint8(K.SPACE), kind[:-1]]
        lower, upper = kind == K.LOWER, kind == K.UPPER
        was_letter = (prev == K.LOWER) | (prev == K.UPPER) | (prev == K.LETTER) | (prev == K.MARK)
        now_letter = lower | upper | (kind == K.LETTER)
        inner = count(was_letter & (digit | symbol)) + count(((prev == K.DIGIT) | (prev == K.OTHER)) & now_letter) + count((prev == K.LOWER) & upper)
        odd = inner / some
        decimal = np.r_[False, digit[:-1]] & np.r_[digit[1:], False]
        cells = count(((flat == 44) | (flat == 59)) & ~nxt_space & ~decimal)
        pipes, tabs = count(flat == 124), count(flat == 9)
        gaps = count((flat == 32) & np.r_[False, flat[:-1] == 32] & ~nxt_space)
        slashes = count((flat == 47) | (flat == 92))
        clean = count(symbol) - pipes <= 0.03 * chars
        number_only = live & (count(letter) == 0) & (count(symbol) == 0) & (count(digit) > 0) & (words <= 2)
        quoted = live & np.isin(c0, (34,)) & np.isin(pad[last], (34,)) & (words <= 2) & (chars <= 30)
        delim = np.select([(pipes >= 2) & clean, (tabs > 0) & clean, (cells >= 2) & clean, (gaps >= 2) & clean, number_only, quoted, (slashes >= 1) & (count(kind == K.SPACE) == 0) & (odd < 0.25)], [1, 2, 3, 4, 5, 6, 7], 0)

        repeat = np.zeros(total)
        for lag in (1, 2, 3, 4):
            if len(self.hash) > lag:
                same = (self.hash[lag:] == self.hash[:-lag]) & (word_line[lag:] == word_line[:-lag])
                repeat = np.maximum(repeat, np.bincount(word_line[lag:], same, minlength=total) / some_words)
        repeat = np.where(words >= 5, repeat, 0)
        sizes = np.bincount(word_line, self.width, minlength=total)
        mean = np.where(words > han, (sizes - han) / np.maximum(words - han, 1), 0)
        sentence = count((kind == K.STOP) & np.r_[space[1:] | cjk[1:], True])
        lead = np.r_[np.uint32(0), flat[:-1]]  # bytes of UTF-8 read as single signs: a first byte, then a following one
        misread = (lead >= 0xC2) & (lead <= 0xF4) & (((flat >= 0x80) & (flat <= 0xBF)) | (flat == 0x20AC)) & ~((lead >= 0xE0) & (flat == 0xA0))
        share = known / some_words
        effective = (words - han) + han / 2

        mixed = np.zeros(total, np.uint64)
        if len(self.hash):
            with np.errstate(over="ignore"):
                np.add.at(mixed, word_line, self.hash * (K.P1 * (np.arange(len(self.hash), dtype=np.uint64) - np.searchsorted(word_line, word_line).astype(np.uint64) + np.uint64(7))))
        self.rows = np.flatnonzero(live)
        text_of = K.owner(starts, bounds)
        self.text = text_of[self.rows]
        fp = mixed[self.rows]
        back = np.zeros(len(self.rows), np.int64)
        for lag in (1, 2):  # 1: repeats a neighbour, 2: one of a long row of repeats
            if len(fp) > lag:
                same = (fp[lag:] == fp[:-lag]) & (self.text[lag:] == self.text[:-lag]) & (fp[lag:] != 0)
                edge = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
                run = np.repeat(np.diff(np.r_[edge, len(same)]), np.diff(np.r_[edge, len(same)])) * same
                value = np.where(run >= 3 * lag, 2, np.where(same & (lag == 1), 1, 0))
                back[lag:] = np.maximum(back[lag:], value)
                back[:-lag] = np.maximum(back[:-lag], value)
        self.chars = chars[self.rows]
        m = len(bounds) - 1
        self.solid = np.bincount(text_of, chars, minlength=m)
        wrong = np.bincount(text_of, count(misread), minlength=m) / np.maximum(self.solid, 1)  # of the whole text: it was read wrongly as one
        self.features = np.stack(
            [
                np.minimum(np.log2(self.chars + 1).astype(int), 9),
                buckets(effective, (0.9, 1.9, 2.9, 3.9, 4.9, 7.9, 11.9, 19.9))[self.rows],
                buckets(count(letter) / np.maximum(chars - count(digit), 1), (0.1, 0.3, 0.5, 0.65, 0.75, 0.85, 0.92))[self.rows],
                buckets(count(digit) / some, (0.001, 0.08, 0.2, 0.4, 0.7))[self.rows],
                buckets(count(symbol) / some, (0.01, 0.03, 0.08, 0.15, 0.3, 0.5))[self.rows],
                start[self.rows],
                end[self.rows],
                delim[self.rows],
                np.where(effective >= 5, 1 + buckets(share, (0.001, 0.12, 0.25, 0.9)), 0)[self.rows],
                buckets(repeat, (0.05, 0.2, 0.5, 0.8))[self.rows],
                np.where(repeat[self.rows] >= 0.8, 3, back),
                buckets(odd, (0.001, 0.02, 0.06, 0.12, 0.25))[self.rows],
                np.where(2 * han > chars, 6, buckets(mean, (1.5, 3.0, 6.5, 9.0, 14.0)))[self.rows],
                np.minimum(sentence, 3)[self.rows],
                buckets(wrong, (0.0005, 0.02))[self.text],
            ],
            1,
        )
        # of the texts
        word_text = text_of[word_line] if len(word_line) else np.empty(0, np.int64)
        self.word_count = np.bincount(word_text, minlength=m)
        self.word_chars = np.bincount(word_text, self.width, minlength=m)
        self.common_count = np.bincount(word_text, self.common, minlength=m)
        self.symbols = np.bincount(text_of, count(symbol), minlength=m)
        self.line_count = np.bincount(self.text, minlength=m)
        self.closed_count = np.bincount(self.text, self.closed[self.rows], minlength=m)


def seeds(f: np.ndarray) -> np.ndarray:
    """Labels of the lines that plain rules decide, -1 for all others; only the start of training."""
    size, words, letters, digits, symbols, start, end, delim, known, repeat, back, odd, mean, sentence, misread = f.T
    out = np.full(len(f), -1)
    out[(words >= 5) & (letters >= 4) & (known >= 2) & (symbols <= 1) & (odd <= 2) & (repeat <= 1) & (delim == 0)] = PROSE
    out[(words >= 1) & (words <= 5) & (end == 5) & (sentence == 0) & (delim == 0) & (letters >= 4) & (odd <= 2) & (repeat <= 1)] = LIST
    out[(start <= 5) & (start >= 1) & (words <= 6) & (sentence <= 1) & (letters >= 3) & (odd <= 3) & (delim == 0)] = LIST
    out[delim == 7] = LIST
    out[(delim >= 1) & (delim <= 6)] = TABLE
    out[(odd >= 4) & (delim != 7) & (delim != 1) & (delim != 2) & (delim != 4)] = JUNK
    out[(symbols >= 5) & (delim != 1)] = JUNK
    out[(mean == 5) & (delim != 7) & (size >= 5)] = JUNK
    out[(back == 3) | ((back == 2) & (delim == 0))] = REPEAT
    out[misread >= 1] = MISREAD
    out[(misread == 0) & (words >= 6) & (known == 1) & (end == 5) & (start == 7) & (sentence == 0)] = JUNK
    return out


class Model:
    """Hidden Markov model: log tables of the statistics per label, of the first label and of label to label."""

    def __init__(self, emit: list[np.ndarray], first: np.ndarray, step: np.ndarray) -> None:
        self.emit, self.first, self.step = emit, first, step

    def scores(self, f: np.ndarray) -> np.ndarray:
        return sum(self.emit[i][:, f[:, i]].T for i in range(f.shape[1]))

    def label(self, f: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Most probable labels of the lines; the texts advance side by side, one line of each at a time."""
        n = len(f)
        if n == 0:
            return np.empty(0, np.int64)
        score = self.scores(f)
        begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        length = np.diff(np.r_[begin, n])
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        best = score.copy()
        best[begin] += self.first
        back = np.zeros((n, STATES), np.int8)
        active = len(begin)
        for t in range(1, int(length[0])):
            while active and length[active - 1] <= t:
                active -= 1
            now = begin[:active] + t
            via = best[now - 1][:, :, None] + self.step[None]
            back[now] = via.argmax(1)
            best[now] += via.max(1)
        out = np.empty(n, np.int64)
        last = begin + length - 1
        out[last] = best[last].argmax(1)
        active = 0
        for t in range(int(length[0]) - 1, 0, -1):
            while active < len(begin) and length[active] > t:
                active += 1
            now = begin[:active] + t
            out[now - 1] = back[now, out[now]]
        return out


def fitted(f: np.ndarray, text: np.ndarray, labels: np.ndarray) -> Model:
    """Tables from labelled lines, smoothed."""
    emit = []
    for i, size in enumerate(SIZES):
        table = np.full((STATES, size), 0.5)
        for k in range(STATES):
            table[k] += np.bincount(f[labels == k, i], minlength=size)[:size]
        share = table / table.sum(1, keepdims=True)
        if i not in SIGNS:
            share[OPEN] = (1 - LOOSE) * share[OPEN] + LOOSE / size
        emit.append(np.log(share))
    step = np.full((STATES, STATES), 1.0) + 20 * np.eye(STATES)
    pair = (text[1:] == text[:-1]) & (labels[1:] >= 0) & (labels[:-1] >= 0)
    np.add.at(step, (labels[:-1][pair], labels[1:][pair]), 1)
    return Model(emit, np.log(np.array([0.7, 0.1, 0.1, 0.04, 0.03, 0.03])), np.log(step / step.sum(1, keepdims=True)))


def train(texts: pa.Array, langs: pa.Array, common: Common) -> Model:
    """Viterbi training from the rule-labelled lines."""
    f, text, base = [], [], 0
    for a, b in K.slices(texts):
        x = Lines(texts.slice(a, b - a), langs.slice(a, b - a), common)
        f.append(x.features)
        text.append(x.text + base)
        base += b - a
    f_, text_ = (np.concatenate(f), np.concatenate(text)) if f else (np.empty((0, len(SIZES)), np.int64), np.empty(0, np.int64))
    seed = seeds(f_)
    model = fitted(f_, text_, seed)
    for _ in range(ROUNDS):
        found = model.label(f_, text_)
        model = fitted(f_, text_, np.where(seed >= 0, seed, found))
    return model


def statistics(df: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: statistics, label shares and kind. common_words: a table of (lang, word); that it is small is
    checked (MOST_COMMON rows), its hashes are broadcast. Where documents or words have no column lang, all words count.

    The model is trained on at most 2 x TRAIN_DOCS documents of at most TRAIN_BYTES bytes, chosen by a hash of the key."""
    spark = df.sparkSession
    named = lambda d: F.lower(lang) if lang in d.columns else F.lit(None).cast("string")
    words = [tuple(r) for r in common_words.select(named(common_words), "word").distinct().limit(MOST_COMMON + 1).collect()]
    if len(words) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    common = Common(words)
    n = df.count()
    some = F.col(text).isNotNull() & (F.octet_length(text) <= TRAIN_BYTES) & (F.pmod(F.xxhash64(key), F.lit(max(1, n // TRAIN_DOCS))) == 0)
    sample = df.where(some).select(F.col(key).alias("_k"), F.col(text).alias("_t"), named(df).alias("_l")).limit(2 * TRAIN_DOCS).sort("_k", "_t").toArrow()
    column = lambda c: sample.column(c).cast(pa.string()).combine_chunks()
    whole = [pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in (column("_t"), column("_l"))]
    model = train(*whole, common)
    shared = spark.sparkContext.broadcast((common, model.emit, model.first, model.step))
    sort = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *tables = shared.value
        hmm = Model(*tables)
        for batch in batches:
            ids, texts, langs = batch.column(0), batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string())
            for a, b in K.slices(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *measured(texts.slice(a, b - a), langs.slice(a, b - a), known, hmm)], names=[key, *COLUMNS])

    return df.select(key, text, named(df)).mapInArrow(run, f"`{key}` {sort}, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


MOST_COMMON = 100_000
TRAIN_BYTES = 50_000
COLUMNS = {"word_count": "long", "mean_word_length": "double", "symbol_ratio": "double", "closed_line_share": "double", "common_word_share": "double", **{f"{k}_share": "double" for k in KINDS}, "kind": "string"}


def measured(texts: pa.Array, langs: pa.Array, common: Common, model: Model) -> list[pa.Array]:
    """The columns COLUMNS of the texts."""
    x = Lines(texts, langs, common)
    labels = model.label(x.features, x.text)
    m = len(texts)
    weight = np.zeros((m, 4))
    np.add.at(weight, (x.text, KIND[labels]), x.chars)
    total = weight.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        shares = weight / total[:, None]
    kind = np.where(shares[:, PROSE] >= ENOUGH, PROSE, weight.argmax(1))
    names = pa.array(KINDS).take(pa.array(kind, pa.int64(), mask=total == 0))

    def ratio(a: np.ndarray, b: np.ndarray) -> pa.Array:
        return pa.array(a / np.maximum(b, 1), pa.float64(), mask=b == 0)

    return [pa.array(x.word_count, pa.int64()), ratio(x.word_chars, x.word_count), ratio(x.symbols, x.solid), ratio(x.closed_count, x.line_count), ratio(x.common_count, x.word_count), *(ratio(weight[:, k], total) for k in range(4)), names]
