"""What must hold before a masked text is let out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimi.functions.masking import mask_text, mask_value, standing, within
from garimi.functions.offsets import each
from garimi.operators import detect


def redaction_plan(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Each approved finding with its mask and whether it can be placed: the text at its span must be its
    value, and the mask as long as the value. Unmapped findings block the document."""
    x = findings.filter("approved").join(documents.select("doc_id", "text"), "doc_id", "left")
    there = F.substring(F.col("text"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    mask = mask_value(F.col("type"), F.col("value"))
    ok = F.coalesce((there == F.col("value")) & (F.length(mask) == F.length("value")), F.lit(False))
    return x.select("doc_id", "finding_id", "type", "start_pos", "end_pos", mask.alias("mask"), ok.alias("mapped"))


def masked(documents: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text, found, masked: every text with all its findings masked. One pass, no shuffle."""
    rows = documents.filter("text is not null").select("doc_id", *keep, "text", detect.detect_all("text").alias("found"))
    return rows.withColumn("masked", mask_text(F.col("text"), F.col("found")))


def leftovers(masked_rows: DataFrame) -> DataFrame:
    """Findings whose value still stands at its span after masking."""
    rows = each(masked_rows, F.arrays_zip(F.col("found").alias("f"), standing(F.col("masked"), F.col("found")).alias("left")), "x", "doc_id").filter("x.left")
    return rows.select("doc_id", "x.f.type", "x.f.value", "x.f.start_pos")


def redetected(masked_rows: DataFrame) -> DataFrame:
    """Strict recheck: findings of the masked text, by type. A masked address may be found again by its label."""
    return detect.exploded(masked_rows.select("doc_id", F.col("masked").alias("text")), detect.detect_all("text"))


def _kinds() -> Column:
    return F.array_distinct(F.transform("found", lambda f: F.struct(f["type"].alias("type"), f["value"].alias("value"))))


def checks(masked_rows: DataFrame) -> DataFrame:
    """doc_id, left_over, residue: how many findings still stand at their span after masking, and how many
    different ones (by type and value) stand anywhere in the masked text, counted within the row."""
    held = within(F.col("masked"), F.transform(_kinds(), lambda k: k["value"]))
    n = lambda flags: F.size(F.array_remove(flags, False)).cast("long")  # no lambda: it may hold no Python function
    return masked_rows.select("doc_id", n(standing(F.col("masked"), F.col("found"))).alias("left_over"), n(held).alias("residue"))


def gate(plan: DataFrame, checked: DataFrame, hidden: DataFrame, documents: DataFrame) -> DataFrame:
    """For every document what may not be there: findings that can't be placed (``redaction_plan``), findings
    left over and values that stand anywhere in the masked text (``checks``), and hidden strings that still
    hold one of their values (``scrub_hidden``). It may be published only with none of them."""
    a = plan.filter(~F.col("mapped")).groupBy("doc_id").agg(F.count("*").alias("unmapped"))
    b = checked.groupBy("doc_id").agg(F.sum("left_over").alias("left_over"), F.sum("residue").alias("residue"))
    c = hidden.groupBy("doc_id").agg(F.count_if(~F.col("clean")).alias("unclean_hidden"))
    x = documents.select("doc_id")
    for part in (a, b, c):
        x = x.join(part, "doc_id", "left")
    counts = ["unmapped", "left_over", "residue", "unclean_hidden"]
    x = x.select("doc_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])
    return x.withColumn("publish", F.greatest(*counts) == 0)


def byte_residue(masked_rows: DataFrame) -> DataFrame:
    """Original values whose UTF-8 bytes still occur anywhere in the masked text. A value that also stands
    elsewhere, where no detector finds it, shows up here."""
    held = within(F.col("masked"), F.transform(_kinds(), lambda k: k["value"]))
    rows = each(masked_rows, F.arrays_zip(_kinds().alias("k"), held.alias("left")), "x", "doc_id").filter("x.left")
    return rows.select("doc_id", "x.k.type", "x.k.value")


def retry_spans(findings: DataFrame, left: DataFrame) -> DataFrame:
    """Findings to highlight again: those whose value is among the document's leftovers."""
    return findings.join(left.select("doc_id", "value").distinct(), ["doc_id", "value"], "left_semi")


def scrub_hidden(hidden: DataFrame) -> DataFrame:
    """Hidden strings (doc_id, kind, ord, content), each detected and masked by itself, without review.
    ``clean``: none of the original values is left."""
    strings = hidden.select("doc_id", "kind", "ord", F.col("content").alias("text"))
    rows = strings.withColumn("found", detect.detect_all("text")).withColumn("masked", mask_text(F.col("text"), F.col("found")))
    clean = F.when(F.col("found").isNotNull(), ~F.array_contains(within(F.col("masked"), F.transform("found", lambda f: f["value"])), True))
    return rows.select("doc_id", "kind", "ord", F.size("found").alias("n_found"), "masked", clean.alias("clean"))
