from itertools import combinations

from sheaf.llm import canonical as C


def test_unified():
    assert C.unified("ｂｕｎｄｌｅ ﬁne") == "bundle fine"
    assert C.unified("a­b​c⁠d﻿") == "abcd"
    assert C.unified("é x y z") == "é x y z"
    assert C.unified("well‑known ⼤") == "well-known 大"
    assert C.unified("Case ‘kept’ é") == "Case ‘kept’ é"
    assert C.unified("") == "" and C.unified("a\tb") == "a b"


def test_suspects():
    assert C.suspects("stеvik") == [(0, 6, "stevik")]  # a Cyrillic letter
    assert C.suspects("cтена") == [(0, 5, "стена")]  # a Latin letter
    assert C.suspects("the сосо tree") == [(4, 8, "coco")]
    assert C.suspects("plain") == [] and C.suspects("стена дом") == []
    assert C.suspects("жz") == []  # no twin
    C.suspects("а " * 100_000)


def test_pairs_match_brute_force(spark):
    texts = ["The tree stood.", "Thе tree stооd.", "The tree stood.", "The tree stood", "the tree stood.", "Стена дома", "Cтенa дома", "Стена  дома", "", "", None, "x" * 50_000, "fi", "ﬁ", "Стена дома"]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "k")]
    df = spark.createDataFrame(rows, "seg_id long, text string, field string")
    got = sorted((r.seg_id_a, r.seg_id_b) for r in C.alike(C.forms(df, "seg_id", ["text"]), "seg_id").collect())
    look = {0: "a", 1: "a", 2: "a", 5: "b", 6: "b", 14: "b", 12: "c", 13: "c"}
    want = [(i, j) for i, j in combinations(range(len(texts)), 2) if look.get(i) and look.get(i) == look.get(j) and texts[i] != texts[j]]
    assert got == want
    assert C.forms(df.limit(0), "seg_id", ["text"]).count() == 0


def test_many_repairs_in_a_long_text(spark):
    df = spark.createDataFrame([(1, "Dеr Müller sаng. " * 5000), (2, "Der Müller sang. " * 5000)], "seg_id long, text string")
    forms = {r.seg_id: r.form for r in C.forms(df, "seg_id", ["text"]).collect()}
    assert forms[1] == forms[2] and len(forms[1]) == 85_000


def test_hot_forms_and_classes(spark, monkeypatch):
    rows = [(i, ["a b", "a b", "a​b c", "ab c", "other"][i % 5] + ("!" if i % 3 else "")) for i in range(60)] + [(100, None), (5, "a b")]
    df = spark.createDataFrame(rows, "id long, t string")
    want = {(a, b) for a, x in rows for b, y in rows if x is not None and y is not None and a < b and x != y and C.unified(x) == C.unified(y)}
    forms = C.forms(df, "id", ["t"])
    for hot in (2000, 4):
        monkeypatch.setattr(C, "HOT", hot)
        got = [(r.id_a, r.id_b) for r in C.alike(forms, "id").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    got = C.classes(forms, "id").collect()
    assert {r.id for r in got} == set(links) and sum(r.links for r in got if r.id != 5) == sum(n for k, n in links.items() if k != 5)
    assert C.classes(C.forms(df.limit(0), "id", ["t"]), "id").count() == 0
