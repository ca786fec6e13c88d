"""Queries of the operators on text, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import canonical, chunking, language, leakage, packing, quality, sentences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf_dir, "audiobook"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = canonical.forms(table(spark, sf_dir, "audioseg"), "seg_id", ["orig", "text"])
    return canonical.keeping(forms.select("field", "seg_id", "form").distinct(), forms)


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.classes(canonical.forms(table(spark, sf_dir, "audioseg"), "seg_id", ["orig", "text"]), "seg_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = canonical.forms(table(spark, sf_dir, "audioseg"), "seg_id", ["orig", "text"])
    pairs = canonical.alike(forms, "seg_id")
    return canonical.keeping(pairs.toDF("field", "seg_a", "seg_b"), pairs)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, limit = table(spark, sf_dir, "audiobook"), chunking.limits(table(spark, sf_dir, "size_limit"))
    text = chunking.text_pieces(books, limit["audiobook.text"]).selectExpr("source_id", "'text' as field", "piece", "begin", "end", "hard")
    return text.unionByName(chunking.entry_pieces(books, limit["audiobook.transcription"]).selectExpr("source_id", "'transcription' as field", "piece", "begin", "end", "hard"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    books, limit = table(spark, sf_dir, "audiobook"), chunking.limits(table(spark, sf_dir, "size_limit"))
    text = chunking.cuts(chunking.text_pieces(books, limit["audiobook.text"]), "text")
    return text.unionByName(chunking.cuts(chunking.entry_pieces(books, limit["audiobook.transcription"]), "transcription"))


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "audioseg"), "meta").dropDuplicates(["seg_id"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.issues(language.languages(table(spark, sf_dir, "audioseg"), "meta"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = chunking.limits(table(spark, sf_dir, "size_limit"))["documents.text"]
    return packing.containers(table(spark, sf_dir, "documents"), limit.max_size)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.oversized(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_statistics(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL for queries that it can express."""
    return {"p7_found": "select doc_id from documents where octet_length(encode(text)) > 0 and octet_length(encode(text)) + 1 > (select max_size from size_limit where item = 'documents.text')"}
