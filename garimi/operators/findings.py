"""Set, order and count operators over a table of findings (one row a finding).

Every operator partitions by document together with the span or page, never by document type or source,
so a source that holds a third of all rows is spread like the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimi.operators.ranking import numbered



BLOCK = 4096  # characters: findings are ordered block by block, so a long document isn't one task


def _block() -> Column:
    return F.floor(F.col("start_pos") / BLOCK)


def first_of_span(findings: DataFrame, *order: str) -> DataFrame:
    """The first finding of each exact (doc_id, start_pos, end_pos), by ``order``; rows that tie are copies.
    An aggregate with map-side partials, so copies collapse before they move."""
    span = ["doc_id", "start_pos", "end_pos"]
    first = findings.groupBy(*span).agg(F.min_by(F.struct(*[c for c in findings.columns if c not in span]), F.struct(*order)).alias("_f"))
    return first.select(*span, "_f.*").select(*findings.columns)


def document_order(findings: DataFrame) -> DataFrame:
    """Adds position: by start; equal starts in order of emission."""
    out = numbered(findings, ["doc_id"], _block(), ["start_pos", "emit_ord", "finding_id"], "position")
    return out.withColumn("position", F.col("position").cast("int"))


def review_order(findings: DataFrame) -> DataFrame:
    """Adds review_position: least confident first, then document order; unknown confidence counts as least."""
    level = F.coalesce("confidence_ord", F.lit(-1))
    block = F.struct(level.alias("level"), _block().alias("block"))
    out = numbered(findings, ["doc_id"], block, [level, "start_pos", "emit_ord", "finding_id"], "review_position")
    return out.withColumn("review_position", F.col("review_position").cast("int"))


def next_unconfirmed(findings: DataFrame) -> DataFrame:
    """For every finding the next one, around the end, whose confidence isn't 높음 (null if there is none).
    Looked for in the finding's block, then among the first of the later blocks, then from the start."""
    open_id = F.when(~F.coalesce(F.col("confidence") == "높음", F.lit(False)), F.struct("start_pos", "emit_ord", "finding_id"))
    x = findings.withColumn("block", _block()).withColumn("open", open_id)
    own = Window.partitionBy("doc_id", "block").orderBy("start_pos", "emit_ord", "finding_id").rowsBetween(1, Window.unboundedFollowing)
    x = x.withColumn("near", F.first("open", ignorenulls=True).over(own))
    blocks = x.groupBy("doc_id", "block").agg(F.min("open").alias("open"))
    later = F.first("open", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing))
    blocks = blocks.select("doc_id", "block", later.alias("later"), F.min("open").over(Window.partitionBy("doc_id")).alias("around"))
    out = x.join(blocks, ["doc_id", "block"])
    return out.select("doc_id", "finding_id", F.coalesce("near", "later", "around").getField("finding_id").alias("next_id"))


def counts_by_type(findings: DataFrame) -> DataFrame:
    """Approved findings of each document and type."""
    return findings.filter("approved").groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def count_map(findings: DataFrame) -> DataFrame:
    """doc_id, counts: a map of type to count, as the audit log holds it."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n"))))
    return counts_by_type(findings).filter("type is not null").groupBy("doc_id").agg(pairs.alias("counts"))
