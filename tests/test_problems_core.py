"""Problems 4 and 5 against brute force, with nulls, empty and long values, ties, repeats and clashing columns."""

import random
import re

from pyspark.sql import functions as F

from sheaf.operators import bad_rows, intervals


def parse(line):
    """Brute force: (cells or None, reason or None); None, None for a blank line."""
    line = line[:-1] if line.endswith("\r") else line
    if not line.strip():
        return None, None
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            j, cell = i + 1, ""
            while True:
                if j >= len(line):
                    return None, "quoting"
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        cell, j = cell + '"', j + 2
                        continue
                    break
                cell, j = cell + line[j], j + 1
            j += 1
            if j < len(line) and line[j] != "|":
                return None, "quoting"
        else:
            j = line.find("|", i)
            j = len(line) if j < 0 else j
            cell = line[i:j]
        out.append(cell)
        if j >= len(line):
            break
        i = j + 1
    if len(out) != 3:
        return out, "column_count"
    bad = not re.fullmatch(r"[A-Z]{2}[0-9]{3}-[0-9]{4}", out[0]) or not any(c.isalpha() for c in out[1]) or re.search("[\x00-\x1f\x7f-\x9f�]", out[1])
    return out, "value" if bad else None


def test_bad_rows_match_brute_force(spark):
    rnd = random.Random(5)
    lines = ["", " ", "\r", "AB123-4567|x|", "AB123-4567|x|\r", "AB123-4567|x|\r\r", '"AB123-4567"|"a ""b"" | c"|', 'AB123-4567|"a"b|c', 'AB123-4567|"a|c', 'AB123-4567|a"b|c"', "AB123-4567||", "ab123-4567|x|y", "AB123-4567|1|2", "AB123-4567|a\tb|", "AB123-4567|a�|", "ÄB123-4567|x|", '""|""|""', "AB123-4567|" + "x" * 50000 + "|", 'AB123-4567|"' + 'y""' * 500 + '"|', "AB123-4567|ж|z"]
    lines += ["".join(rnd.choice(['"', '""', "|", "a", "AB123-4567", "\r", " "]) for _ in range(rnd.randint(1, 9))) for _ in range(600)]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(lines)] + [(9999, None, 1)], "line_id long, raw_line string, reason int")
    got = bad_rows.split_lines(df, bad_rows.METADATA)
    failed = {r.line_id: r.reason for r in got.failed.collect()}
    valid = {r.line_id: [r.c0, r.c1, r.c2] for r in got.valid.collect()}
    want = {i: parse(x) for i, x in enumerate(lines)}
    assert failed == {i: w for i, (_, w) in want.items() if w}
    assert valid == {i: c for i, (c, w) in want.items() if c and not w}


def test_bad_rows_empty(spark):
    got = bad_rows.split_lines(spark.createDataFrame([], "line_id long, raw_line string"), bad_rows.METADATA)
    assert got.failed.count() == got.valid.count() == 0


def gaps(pairs):
    out, reach = set(), None
    for b, e in sorted((b, e) for b, e in pairs if b is not None and e is not None and b < e):
        if reach is not None and b > reach:
            out.add((reach, b))
        reach = e if reach is None else max(reach, e)
    return out


def test_gaps_match_brute_force(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(60):
        n = rnd.choice([0, 1, 2, 5, 30])
        pairs = [(b, b + rnd.randint(-2, 9)) for b in (rnd.randint(0, 150) for _ in range(n))]
        rows.append((k, [(None if rnd.random() < 0.05 else float(b), None if rnd.random() < 0.05 else float(e)) for b, e in pairs]))
    rows += [(60, None), (61, [None, (1.0, 2.0), (5.0, 6.0)])] + rows[:3]
    df = spark.createDataFrame([(k, x, "x") for k, x in rows], "id long, a array<struct<begin:double,end:double>>, tier string")
    want = {(k, b, e) for k, x in rows for b, e in gaps([p for p in x or [] if p])}
    got = intervals.tier_gaps(df, "id", {"words": F.col("a")}, 1.0).collect()
    assert sorted(r[:1] + r[2:] for r in got) == sorted(want)
    tall = df.select("id", F.explode("a").alias("x")).select("id", "x.begin", "x.end")
    assert {tuple(r) for r in intervals.tall_gaps(tall, ["id"], "begin", "end", 20.0).collect()} == want
    starts, ends = intervals.bounds(F.col("a"), 1.0)
    periods = df.select("id", F.explode(intervals.array_periods(starts, ends)).alias("p")).select("id", "p.begin", "p.end").distinct()
    assert {tuple(r) for r in intervals.tall_gaps(periods, ["id"], "begin", "end", 20.0).collect()} == want
    per = {k: x for k, x in rows}
    assert periods.where("id = 61").count() == 2 and periods.where("id = 60").count() == 0 and len(per) == 62


def test_periods_of_both_tiers(spark, tmp_path):
    from sheaf.plans import problems

    x = "array<struct<begin:double,end:double>>"
    rows = [(1, [(0.0, 1.0), (1.0, 2.0), (3.0, 4.0)], [[(0.0, 0.5), (0.4, 1.0)], None, [(3.5, 4.0)]]), (2, None, [[(1.0, 2.0)]]), (3, [], None)]
    spark.createDataFrame(rows + rows[:1], f"seg_id long, ts_by_words {x}, ts_by_phonemes array<{x}>").write.parquet(f"{tmp_path}/audioseg.parquet")
    got = sorted((r.seg_id, r.tier, r.begin_ms, r.end_ms) for r in problems.p5_periods(spark, str(tmp_path)).collect())
    assert got == [(1, "phonemes", 0, 1000), (1, "phonemes", 3500, 4000), (1, "words", 0, 2000), (1, "words", 3000, 4000), (2, "phonemes", 1000, 2000)]
