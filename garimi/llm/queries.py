"""The queries of this subpackage, over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimi.llm import bpe, frequency, mojibake, packing, pii, skeleton
from garimi.llm.seen import SeenBefore
from garimi.sources.tables import table


def _seen(spark: SparkSession, d: str) -> SeenBefore:
    return SeenBefore(table(spark, d, "archived_keys"), table(spark, d, "audit_log"), "archive_id", "audit_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).found().select(F.col("id").alias("audit_id"), F.col("field").alias("key_field"))


def p1_seen(spark: SparkSession, d: str) -> DataFrame:
    """Every audit row with the answer for both fields."""
    found = p1_found(spark, d).groupBy("audit_id").agg(*[F.bool_or(F.col("key_field") == f).alias(f"{f}_seen") for f in ("original_sha256", "original_filename")])
    rows = table(spark, d, "audit_log").select("audit_id").join(found, "audit_id", "left")
    return rows.select("audit_id", *[F.coalesce(f"{f}_seen", F.lit(False)).alias(f"{f}_seen") for f in ("original_sha256", "original_filename")])


def p1_error_report(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).error_report()


def _pii(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    findings = table(spark, d, "findings")
    texts = pii.free_texts(table(spark, d, "gold_cases"), findings)
    return texts, pii.Detector(texts, pii.gazetteer(findings)).found()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pii(spark, d)[1].select("tbl", "row_id", "pii_type", "start_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts, found = _pii(spark, d)
    return pii.redact(found, texts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_counts(table(spark, d, "candidate_events")).filter("mark is not null").select("word", "direction", "mark")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_counts(table(spark, d, "candidate_events"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a = skeleton.same_look_pairs(table(spark, d, "findings"), "finding_id", "value", "findings")
    return a.unionByName(skeleton.same_look_pairs(table(spark, d, "spans"), "span_id", "text", "spans"))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    a = skeleton.canonical(table(spark, d, "findings"), "finding_id", "value", "findings")
    return a.unionByName(skeleton.canonical(table(spark, d, "spans"), "span_id", "text", "spans"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row with the class of its look in its document and its number of links."""
    a = skeleton.same_look_classes(table(spark, d, "findings"), "finding_id", "value", "findings")
    return a.unionByName(skeleton.same_look_classes(table(spark, d, "spans"), "span_id", "text", "spans"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p7_assignments(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "containers"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_assignments(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_seen, p1_error_report, p2_found, p2_redacted, p3_found, p3_counts, p5_found, p5_canonical, p5_classes, p6_ids, p7_assignments, p7_fill, p8_found, p8_restored)}
