"""Review decisions as data: approve by default, with exceptions, additions, deletions and undo."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimi import dictionaries as D
from garimi.functions.offsets import each, literal_occurrences
from garimi.operators.detect import classify

SPAN = ["doc_id", "start_pos", "end_pos"]


def apply_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every finding approved unless its last decision says otherwise. ``decisions``: doc_id, start_pos,
    end_pos, seq, approve."""
    last = decisions.groupBy(*SPAN).agg(F.max_by("approve", "seq").alias("approve"))
    return findings.join(last, SPAN, "left").withColumn("approved", F.coalesce("approve", F.lit(True))).drop("approve")


def set_all(findings: DataFrame, orders: DataFrame) -> DataFrame:
    """One order for all findings of a document (doc_id, seq, approve); the last counts."""
    last = orders.groupBy("doc_id").agg(F.max_by("approve", "seq").alias("approve"))
    return findings.join(last, "doc_id", "left").withColumn("approved", F.coalesce("approve", "approved")).drop("approve")


def occurrences_of(values: DataFrame, documents: DataFrame) -> DataFrame:
    """Every place of each (doc_id, value) in its document."""
    x = values.select("doc_id", "value").distinct().join(documents.select("doc_id", "text"), "doc_id")
    x = each(x, literal_occurrences(F.col("text"), F.col("value")), "m", "doc_id", "value")
    return x.select("doc_id", "value", "m.start_pos", "m.end_pos")


def same_value(findings: DataFrame, picked: DataFrame, documents: DataFrame) -> DataFrame:
    """Picking a value (doc_id, type, value) approves its findings and adds the occurrences no finding
    covers, as 동일값추가. The rows: doc_id, type, value, start_pos, end_pos, grp, source."""
    have = findings.join(picked.select("doc_id", "value").distinct(), ["doc_id", "value"], "left_semi").select("doc_id", "type", "value", "start_pos", "end_pos", "grp", "source")
    places = occurrences_of(picked, documents).join(findings.select(*SPAN).distinct(), SPAN, "left_anti")
    kinds = picked.groupBy("doc_id", "value").agg(F.min("type").alias("type"))
    new = places.join(kinds, ["doc_id", "value"]).select("doc_id", "type", "value", "start_pos", "end_pos", F.lit(D.GROUP_SAME_VALUE).alias("grp"), F.lit(D.SOURCE_MANUAL).alias("source"))
    return have.unionByName(new)


def manual_additions(findings: DataFrame, added: DataFrame) -> DataFrame:
    """Spans marked by hand (doc_id, value, start_pos, end_pos) as findings, typed by their form. ``refused``
    where a finding has the span already."""
    have = findings.select(*SPAN).distinct().withColumn("refused", F.lit(True))
    return added.join(have, SPAN, "left").select("doc_id", "value", "start_pos", "end_pos", classify(F.col("value")).alias("type"), F.lit(D.GROUP_MANUAL).alias("grp"), F.coalesce("refused", F.lit(False)).alias("refused"))


def retyped(findings: DataFrame, added: DataFrame) -> DataFrame:
    """The dialog's way: a span found already takes the new type, others are added. Columns: doc_id, start_pos, end_pos, type."""
    new = added.groupBy(*SPAN).agg(F.min("type").alias("new_type"))
    old = findings.groupBy(*SPAN).agg(F.min("type").alias("old_type"))
    return old.join(new, SPAN, "full").select(*SPAN, F.coalesce("new_type", "old_type").alias("type"))


def search(findings: DataFrame, terms: DataFrame, documents: DataFrame) -> DataFrame:
    """All places of a searched string, the new ones checked."""
    have = findings.select(*SPAN).distinct().withColumn("have", F.lit(True))
    return occurrences_of(terms, documents).join(have, SPAN, "left").select("doc_id", "value", "start_pos", "end_pos", F.col("have").isNull().alias("checked"))


def _standing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk actions sorted by document and order, with the stacks of one document in hand."""
    doc, done, undone, out = None, [], [], []

    def close() -> None:
        out.extend((doc, t, a) for t, a in dict(done).items())

    for b in batches:
        for of, kind, target, approve in zip(b["doc_id"], b["kind"], b["target"], b["approve"], strict=True):
            if of != doc:
                close()
                doc, done, undone = of, [], []
            if kind == "undo":
                undone += [done.pop()] if done else []
            elif kind == "redo":
                done += [undone.pop()] if undone else []
            else:
                done.append((target, approve))
                undone = []
        yield _approvals(out)
        out = []
    close()
    yield _approvals(out)


def _approvals(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "target", "approve"])


def undo_redo(actions: DataFrame) -> DataFrame:
    """Actions (doc_id, seq, kind set/undo/redo, target, approve) taken in order; the standing ones come out:
    doc_id, target, approve, the last of each target. A new action forgets what was undone; undo or redo of
    nothing does nothing. Each document is walked once, in time linear in its actions. Actions without a
    document are left out."""
    rows = actions.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "seq", "kind", F.col("target").cast("long").alias("target"), "approve")
    walked = rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq").select("doc_id", "kind", "target", "approve")
    return walked.mapInPandas(_standing, "doc_id long, target long, approve boolean")


def deleted(findings: DataFrame, removals: DataFrame) -> DataFrame:
    """Findings without those removed."""
    return findings.join(removals.select("finding_id").distinct(), "finding_id", "left_anti")


def learning_signals(findings: DataFrame) -> DataFrame:
    """What a review teaches: an automatic name unchecked says 제외 (the value), a name added by hand says
    이름후보 (its first character)."""
    off = (F.col("source") == D.SOURCE_AUTO) & ~F.col("approved")
    add = F.col("source") == D.SOURCE_MANUAL
    names = findings.filter((F.col("type") == D.NAME) & (F.col("value") != "") & (off | add))
    word = F.when(add, F.substring("value", 1, 1)).otherwise(F.col("value"))
    return names.select("doc_id", "finding_id", word.alias("word"), F.when(add, D.NAME_DIRECTION).otherwise(D.EXCLUDE_DIRECTION).alias("direction"))
