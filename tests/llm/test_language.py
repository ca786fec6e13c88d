import random

from pyspark.sql import functions as F

from sheaf.llm import language as L

WORDS = {
    "en": "the wooden ladder stood near old harbour while potter counted silver spoons and quiet stranger walked slowly along river bank".split(),
    "de": "die alte Karte hing neben dem leeren Brunnen während der Müller drei silberne Löffel zählte und ein fremder Gast langsam ging".lower().split(),
    "fr": "la vieille carte restait devant la chapelle tandis que le potier comptait trois cuillères et un étranger marchait lentement".split(),
    "ru": "старая карта висела возле пустого колодца пока мельник считал серебряные ложки и тихий гость медленно шёл домой".split(),
    "kk": "ескі карта бос құдықтың қасында тұрды ал диірменші күміс қасықты санады және үнсіз қонақ үйіне қайтты".split(),
}


def sentence(lang, rnd, n=12):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n)) + "."


def trained():
    rnd = random.Random(1)
    rows = [(sentence(x, rnd), x) for x in WORDS for _ in range(200)]
    rows = [(t, rnd.choice(list(WORDS)) if rnd.random() < 0.05 else x) for t, x in rows]  # some labels are wrong
    return L.train(rows)


def test_held_out_accuracy():
    langs, rnd = trained(), random.Random(2)
    for lang in WORDS:
        hits = [L.identify(sentence(lang, rnd), langs)[0] for _ in range(50)]
        assert sum(len(h) == 1 and h[0][0] == lang for h in hits) >= 48
        assert all(0 < h[0][1] <= 1 for h in hits if h)


def test_mixed_and_borrowed():
    langs, rnd = trained(), random.Random(4)
    for a, b in (("en", "de"), ("fr", "ru"), ("ru", "kk"), ("en", "fr")):
        got = {x for x, _ in L.identify(sentence(a, rnd) + " " + sentence(b, rnd), langs)[0]}
        assert got == {a, b}
    assert [x for x, _ in L.identify(sentence("en", rnd)[:-1] + " " + " ".join(WORDS["ru"][:4]) + ".", langs)[0]] == ["en"]
    assert L.identify(None, langs)[0] == L.identify("", langs)[0] == L.identify("123 !!", langs)[0] == []


def test_labels(spark):
    rows = [("{'lang': 'EN', 'x': 1}", "en"), ('{"x": "a", "lang": "de-AT"}', "de"), ("{'lang': 'en_GB'", "en"), ("{'lang': 'French'}", "fr"), ("{'lang': 'rus'}", "ru"), ("{'lang': 'D", None), ("{'lang': ''}", None), ("{'lang': None}", None), ('{"lang": null}', None), ("{'lang': '??'}", None), ("{'lang': 'und'}", None), (None, None), ("{'bos_label': 'l'alba', 'lang': 'IT'}", "it")]
    got = spark.createDataFrame(rows, "meta string, want string").select("meta", "want", L.label_language(F.col("meta")).alias("got")).collect()
    assert [(r.meta, r.got) for r in got] == [(r.meta, r.want) for r in got]


def test_issues(spark):
    rnd = random.Random(5)
    rows = [(i, sentence(x, rnd), f"{{'lang': '{x}'}}") for i, x in enumerate(list(WORDS) * 60)]
    rows += [(9001, sentence("en", rnd), "{'lang': 'DE'}"), (9002, sentence("en", rnd), None), (9003, sentence("en", rnd) + " " + sentence("de", rnd), "{'lang': 'EN'}"), (9004, None, None), (9005, "", None)]
    rows += [rows[-5]]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "seg_id long, text string, meta string, lang string")
    got = sorted(tuple(r) for r in L.issues(L.languages(df, "meta")).collect())
    assert got == [(9001, "wrong", "en"), (9002, "missing", "en"), (9003, "mixed", "de"), (9003, "mixed", "en")]
    assert L.issues(L.languages(df.limit(0), "meta")).count() == 0


def test_rejection():
    langs = trained()
    assert L.identify("Suomen kieli kuuluu uralilaisiin kieliin ja sitä puhutaan pääasiassa Suomessa.", langs)[0][0][0] == L.UNKNOWN
    for text in ("هذه جملة باللغة العربية", "Αυτή είναι μια πρόταση", "한국어 문장입니다", "זה משפט בעברית", "نص عربي طويل with two words"):
        assert L.identify(text, langs)[0] == [(L.UNKNOWN, 0.0)]
    # a language alone in its script does not win unopposed
    rnd = random.Random(6)
    hindi = "यह नदी के किनारे सुबह बहुत सुंदर लगती है और लोग वहाँ घूमने आते हैं".split()
    rows = [(" ".join(rnd.choice(hindi) for _ in range(12)), "hi") for _ in range(200)]
    one = L.train(rows)
    assert L.identify(rows[0][0], one)[0][0][0] == "hi"
    assert L.identify("मराठी ही महाराष्ट्राची अधिकृत भाषा असून तिचा इतिहास खूपच जुना आहे", one)[0][0][0] == L.UNKNOWN


def test_sample_is_bounded_by_label_and_bytes(spark):
    rows = [(i, "a b", "en") for i in range(300)] + [(1000 + i, "c d", "fi") for i in range(5)] + [(2000, "x" * 5000, "fi"), (2001, None, "en"), (2002, "e", None)]
    df = spark.createDataFrame(rows, "seg_id long, text string, l string")
    got = L.sample(df, "seg_id", "text", F.col("l"), 50)
    assert 20 < sum(x == "en" for _, x in got) < 100 and sum(x == "fi" for _, x in got) == 5
