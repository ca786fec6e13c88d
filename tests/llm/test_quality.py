import random

from sheaf.llm import quality as Q

COMMON = "the and was near of in to a with his".split()


def documents(rnd):
    w = lambda n: " ".join(rnd.choice(COMMON + ["potter", "harbour", "silver", "ladder", "walked", "slowly", "garden", "evening"]) for _ in range(n))
    out = []
    for k in range(120):
        out.append((k, " ".join(w(rnd.randint(8, 15)).capitalize() + "." for _ in range(8)), "prose"))
        out.append((1000 + k, "\n".join(f"{rnd.choice(['- ', '• '])}{w(3)}" for _ in range(12)), "list"))
        out.append((2000 + k, "\n".join("|".join(str(rnd.randint(0, 99)) for _ in range(5)) for _ in range(10)), "table"))
        out.append((3000 + k, "".join(rnd.choice("%$#@^&*~{}<>=+\\/|0123456789") for _ in range(300)), "junk"))
    return out


def test_kinds_and_statistics(spark):
    rows = documents(random.Random(3)) + [(9000, None, None), (9001, "", None), (9002, " \n\t", None), (9003, "Near the harbour. " * 20_000, "prose")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    common = spark.createDataFrame([(x,) for x in COMMON], "word string")
    got = {r.doc_id: r for r in Q.statistics(df, common).collect()}
    assert len(got) == len(rows)
    wrong = [k for k, _, want in rows if got[k].kind != want]
    assert len(wrong) <= 2
    assert got[9000].word_count == got[9001].word_count == got[9002].word_count == 0 and got[9001].mean_word_length is None
    assert got[9003].word_count == 60_000 and abs(got[9003].common_word_share - 2 / 3) < 1e-9
    assert Q.statistics(df.limit(0), common).count() == 0


def test_numbers_of_one_text():
    import pyarrow as pa

    x = Q.Lines(pa.array(["Der Hund, 3 Katzen!\n中文 $$"]), pa.array(["de"]), Q.Common([("de", "der")]))
    assert x.word_count.tolist() == [6] and x.common_count.tolist() == [1]
    assert x.symbols.tolist() == [2] and x.line_count.tolist() == [2] and x.closed_count.tolist() == [1]


def test_common_words_are_those_of_the_language():
    import pyarrow as pa

    common = Q.Common([("en", "die"), ("de", "die"), ("de", "und"), ("ja", "から"), ("ja", "の"), ("ja", "けれども"), (None, "x")])
    texts = ["die und x", "die und x", "die und x", "それからけれ ども、のか。ら", "die und x", ""]
    x = Q.Lines(pa.array(texts), pa.array(["en", "DE", None, "ja", "xx", None]), common)
    # ja: the characters of から side by side, and の
    assert x.common_count.tolist() == [1, 2, 3, 3, 3, 0]
    assert Q.Lines(pa.array(["a"]), pa.array([None], pa.string()), Q.Common([])).common_count.tolist() == [0]
