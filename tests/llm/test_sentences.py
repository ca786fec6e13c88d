import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import sentences as S

CASES = [
    ("Mr. Bell slept. He woke at 5 p.m. The day was over.", ["Mr. Bell slept.", "He woke at 5 p.m.", "The day was over."]),
    ("It cost 12.50 pounds. “Come in! Sit down,” said the old man. He sat.", ["It cost 12.50 pounds.", "“Come in! Sit down,” said the old man.", "He sat."]),
    ("He said: “Go. Now.” She went.", ["He said: “Go. Now.”", "She went."]),
    ("(It rained.) They left.", ["(It rained.)", "They left."]),
    ("Chapter I. The pond\n\nIt was cold.\nVery cold.", ["Chapter I. The pond", "It was cold.", "Very cold."]),
    ("1) one thing\n2) another thing;\n3) a third", ["1) one thing", "2) another thing;", "3) a third"]),
    ("He went\nhome late. He slept", ["He went\nhome late.", "He slept"]),
    ("他来了。她走了！“好吗？”他问", ["他来了。", "她走了！", "“好吗？”", "他问"]),
    ("他来了\n她走了", ["他来了", "她走了"]),
    ("彼は「行くの？」と言った。雨だ。", ["彼は「行くの？」と言った。", "雨だ。"]),
    ("वह आया। वह गया।", ["वह आया।", "वह गया।"]),
    ("— Пойдём! — сказал он. Она ушла.", ["— Пойдём! — сказал он.", "Она ушла."]),
    ("The end.Next day came.", ["The end.", "Next day came."]),
    ("See reel_28.wav or v. 4.2 now. Done.", ["See reel_28.wav or v. 4.2 now.", "Done."]),
]


def evidence():
    into = Counter()
    for t in ["Mr. Bell ate. Mr. Cole ate. Mr. Dunn ran. Mr. Fox hid. Mr. Gold sang. Mr. Hill rose."] * 3:
        S.evidence(t, into)
    for t in ["He slept at 3 p.m. and left at 5 p.m. The day. At 6 p.m.\n\nAt 7 p.m."] * 4:
        S.evidence(t, into)
    rows = {}
    for (k, w, i), n in into.items():
        rows.setdefault((k, w), [0, 0, 0, 0])[i] += n
    return S.Evidence({k: tuple(v) for k, v in rows.items()})


@pytest.mark.parametrize("text, want", CASES)
def test_units(text, want):
    assert [text[a:b] for a, b in S.units(text, evidence())] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\r\t.!?…。“”\"'‘’()«»「」aAbBжЖ中あ1—-,", max_size=120))
def test_units_cover_the_text(text):
    found = S.units(text, S.Evidence())
    assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    inside = set()
    for a, b in found:
        inside.update(range(a, b))
        assert not text[a].isspace() and not text[b - 1].isspace()
    assert all(c.isspace() for i, c in enumerate(text) if i not in inside)


def test_long_texts_stay_linear():
    for t in ("1.2." * 100_000, "(" * 100_000 + "”" * 100_000, "a… " * 50_000, "." * 200_000, "x" * 500_000):
        S.units(t, S.Evidence())
        S.evidence(t, Counter())


def test_table(spark):
    rows = [(1, "One. Two.", 9), (1, "One. Two.", 9), (2, None, 9), (3, "", 9), (4, " \n", 9), (5, "x" * 100_000 + ".", 9)]
    df = spark.createDataFrame(rows, "source_id long, text string, begin_char int")
    got = sorted(tuple(r) for r in S.sentence_units(df).collect())
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (5, 0, 100_001)]
    assert S.sentence_units(df.limit(0)).count() == 0


def corpus(*texts):
    into = Counter()
    for t in texts:
        S.evidence(t, into)
    return S.Evidence(S.tabled(into))


def cut(text, ev):
    return [text[a:b] for a, b in S.units(text, ev)]


def test_the_document_decides_first():
    rare = "They sat abt. twelve days. It took abt. Nine men came."  # clear in the document, in no corpus
    assert cut(rare, S.Evidence()) == ["They sat abt. twelve days.", "It took abt. Nine men came."]
    # another use in the corpus: there "fig" is a word
    other = corpus(*["She ate a fig. They saw a fig tree and a fig leaf. One fig fell."] * 9)
    assert cut("See fig. four. See fig. Twelve now.", other) == ["See fig. four.", "See fig. Twelve now."]
    assert cut("She ate a fig. Twelve men left.", other) == ["She ate a fig.", "Twelve men left."]
    # the document tells names from common words after a short form
    assert cut("They sat abt. twelve days. It took abt. The men came, for the men know Bell.", S.Evidence())[1:] == ["It took abt.", "The men came, for the men know Bell."]
    assert cut("They sat abt. twelve days. It took abt. Bell came, for men know Bell.", S.Evidence())[1:] == ["It took abt. Bell came, for men know Bell."]
    # the end of a list entry is no sign of a short form
    assert cut("1) an empty cradle.\n2) a kettle\n\nHe saw a cradle. Bell left.", S.Evidence())[2:] == ["He saw a cradle.", "Bell left."]


def test_joined_evidence_gives_the_same(spark, monkeypatch):
    words = "abt. fig. Gen. No. said… well… he end. p.m. cradle kettle 中文。 かな… と वह। Bell".split()
    rnd = random.Random(3)
    rows = [(i % 90, " ".join(rnd.choice(words + ["Then", "the", "men"]) + rnd.choice(["", " ", "\n", "\n\n", "? ", "… "]) for _ in range(rnd.randint(0, 80)))) for i in range(100)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "source_id long, text string")
    whole = sorted(map(tuple, S.sentence_units(df).collect()))
    monkeypatch.setattr(S, "MOST", 3)
    assert sorted(map(tuple, S.sentence_units(df).collect())) == whole and len(whole) > 500


def test_more_corpus_does_not_change_a_text():
    text = "They met at Abt. Nine men came. See abt. twelve."
    rare = corpus(*["It is abt. ten. It is abt. nine."] * 6)
    big = corpus(*["It is abt. ten. It is abt. nine."] * 6, *[f"The word{k % 50} ended. Then word{k % 70} ended." for k in range(3000)])
    assert cut(text, rare) == cut(text, big)
