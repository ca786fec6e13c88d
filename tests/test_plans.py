"""Sources, registry, pipelines, streams and plan shapes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sheaf.operators import joins, ordering
from sheaf.plans import pipeline, registry
from sheaf.sources import files, textgrid
from sheaf.streaming import batches

ROWS = [("a/1.TextGrid", "orig", 0, 0.0, 0.5, ""), ("a/1.TextGrid", "orig", 1, 0.5, 2.0, 'He said "yes".'), ("a/1.TextGrid", "text", 0, 0.0, 0.4, "BOS"), ("a/1.TextGrid", "text", 1, 0.5, 1.0, "he"), ("a/1.TextGrid", "text", 2, 1.5, 2.0, "EOS"), ("a/1.TextGrid", "meta", 0, 0.0, 2.0, "{'lang': 'EN', 'orig_audio_chunk': [0.0, 2.0]}"), ("b/2.TextGrid", "text", 0, 0.0, 1.0, "x\ny")]


def test_textgrid_round_trip(spark, tmp_path):
    spark.dataSource.register(textgrid.TextGridSource)
    df = spark.createDataFrame(ROWS, textgrid.SCHEMA)
    textgrid.write(df, str(tmp_path))
    (tmp_path / "b" / "broken.TextGrid").write_text("nonsense")
    back = spark.read.format("textgrid").load(str(tmp_path))
    got = sorted((os.path.relpath(r.file_path, tmp_path), r.tier, r.pos, r.begin, r.end, r.label) for r in back.where("tier is not null").collect())
    assert got == sorted(ROWS)
    assert back.where("tier is null").count() == 1
    some = spark.read.format("textgrid").option("tiers", "text").option("silence", "false").load(str(tmp_path))
    assert {r.tier for r in some.where("tier is not null").collect()} == {"text"}
    p = {os.path.basename(r.file_path): r for r in textgrid.preview(back.where("tier is not null")).collect()}["1.TextGrid"]
    assert p.orig == 'He said "yes".' and [w.label for w in p.words] == ["he"] and (p.ts_bos, p.ts_eos) == (0.4, 1.5)
    m = back.where("tier = 'meta'").select(textgrid.meta(F.col("label")).alias("m")).collect()[0].m
    assert m.lang == "EN" and m.orig_audio_chunk == [0.0, 2.0]


def test_manifests_and_scans(spark, tmp_path):
    (tmp_path / "list.txt").write_text("[TRAIN]\n a/x.wav|1\na/y.wav|0\n\n[TEST]\nb/z.wav\n")
    m = files.read_manifest(spark, str(tmp_path / "list.txt"), exclude_parts=["y.wav"]).collect()
    assert [(r.path, r.label, r.subset) for r in sorted(m, key=lambda r: r.line_no)] == [("a/x.wav", "1", "TRAIN"), ("b/z.wav", None, "TEST")]
    for n in ("s.flac", "s.wav", "t.mp3"):
        (tmp_path / n).write_bytes(files.encode_wave([0.0, 0.5, -0.5], 8000) if n == "s.wav" else b"x")
    scan = files.scan(spark, str(tmp_path))
    assert sorted(os.path.basename(r.path) for r in files.locate_audio(scan).collect()) == ["s.wav", "t.mp3"]
    w = {os.path.basename(r.path): r for r in files.decode_waves(spark.read.format("binaryFile").load(str(tmp_path / "s.*"))).collect()}
    assert w["s.wav"].rate == 8000 and w["s.wav"].wave[1] == pytest.approx(0.5, abs=1e-3) and w["s.flac"].message
    files.write_manifest(spark.createDataFrame([("p", None, "a"), ("q", "1", "b")], "path string, label string, subset string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "subset=b")).collect()[0].value == "q|1"


def test_transcripts(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps({"text": "a b", "timestamps": [["a", 0.0, 0.5], ["b", 0.5, 1.0]], "lang": "EN"}))
    t = files.read_transcripts(spark, str(tmp_path / "*.json"))
    assert [tuple(x) for x in t.collect()[0].timestamps] == [("a", 0.0, 0.5), ("b", 0.5, 1.0)]
    assert json.loads(files.transcript_json(t).collect()[0].value)["timestamps"] == [["a", 0.0, 0.5], ["b", 0.5, 1.0]]


def test_feature_store_resumes(spark, tmp_path):
    store = files.FeatureStore(spark, str(tmp_path))
    seen = []

    def f(df):
        seen.append(df.count())
        return df.select("id", (F.col("id") * 2).alias("x"))

    a = store.compute(spark.range(5), "id", "double", f, k=1)
    b = store.compute(spark.range(8), "id", "double", f, blocked=spark.range(7, 8), k=1)
    assert a.count() == 5 and b.count() == 7 and seen == [5, 2]
    assert store.load("double", k=2) is None


@registry.step("a", "b")
def add_b(df, by: int = 1):
    return df.withColumn("b", F.col("a") + by)


@registry.step("b", "c")
def add_c(df, dims=None):
    return df.withColumn("c", F.col("b") * (dims["top"].collect()[0].m if dims else 1))


def test_registry():
    steps = [add_b, add_c]
    assert registry.check(steps, ["a"]) == {"a", "b", "c"}
    with pytest.raises(registry.MissingColumns):
        registry.check([add_c], ["a"])
    with pytest.raises(TypeError):
        add_b.with_parameters(nothing=1)
    assert registry.without_columns(steps, ["b"]) == [] and registry.before(steps, "add_c") == [add_b] and registry.after(steps, "add_b") == [add_c]
    assert registry.only(steps, ["add_c"]) == registry.without(steps, ["add_b"]) == [add_c]
    assert registry.names("a|b, c") == {"a", "b", "c"}


def test_pipeline(spark):
    tree = {"meta": [{"name": "add_b", "by": {"default": 1, "debug": 10}}], "features": [{"name": "add_c"}], "sampler": {"key": "a", "size": 4}}
    p = pipeline.Pipeline.from_tree(tree, ["debug"], {"top": lambda df: df.agg(F.max("b").alias("m"))})
    assert p.check(["a"]) == {"a", "b", "c"}
    rows = p.batches(spark.range(6).select(F.col("id").alias("a"))).orderBy("a").collect()
    assert [r.b for r in rows] == [10, 11, 12, 13, 14, 15] and rows[1].c == 11 * 15 and [r.batch_id for r in rows] == [0] * 4 + [1] * 2
    t = {"x": {"y": 1, "device": "gpu"}, "z": [1]}
    assert pipeline.rebuilt(pipeline.flat(t)) == t and pipeline.by_path(t, "x.y") == 1 and pipeline.by_suffix(t, "y") == 1
    assert pipeline.digest(t) == pipeline.digest({"x": {"y": 1, "device": "cpu"}, "z": [1]}) != pipeline.digest({"x": {"y": 2}, "z": [1]})


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = batches.source(spark, str(tmp_path / "in"), "id long", max_files=1)
    q = batches.run_epoch(s, str(tmp_path / "out"), str(tmp_path / "state"), each=lambda part: part)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in out.collect()) == list(range(30)) and out.select("epoch_batch").distinct().count() >= 3
    assert sum(p["rows"] for p in batches.progress(q)) == 30
    b = ordering.sequential_batches(spark.range(10), "id", 4)
    assert [len(x) for x in batches.local_batches(b)] == [4, 4, 2] and [len(x) for x in batches.local_batches(b, drop_incomplete=4)] == [4, 4]
    assert {r.batch_id for r in batches.own_share(b, 1, 2).collect()} == {1}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.lit("x" * 10).alias("t")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    p = plan(joins.with_ids(df.withColumn("name", F.col("k").cast("string")), "name", joins.dense_ids(df.select(F.col("k").cast("string").alias("name")), "name"), "n").where("id > 5").select("id", "n"))
    assert "BroadcastHashJoin" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in p and "t:string" not in p
