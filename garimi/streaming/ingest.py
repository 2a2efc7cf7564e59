"""Structured Streaming: documents in, masked documents and audit rows out; learning as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from garimi import dictionaries as D
from garimi.functions.masking import mask_text
from garimi.functions.text import strip_ws
from garimi.operators import detect
from garimi.operators.audit import content_hash, format_counts
from garimi.operators.learning import DIRECTIONS, base_dictionary
from garimi.operators.verify import checks, scrub_hidden
from garimi.staging import scratch


def publish(batch: DataFrame, folder: str, batch_id: int) -> None:
    """One batch let out as a whole: masked texts of the documents that pass every check, and an audit row for
    each of them with findings, both under the batch's id. A document passes if none of its values is left
    at its place or anywhere in the masked text, and no hidden string (column ``hidden``, an array, if the
    batch has it) keeps one; its hidden strings are masked without review.

    A batch that is run again overwrites its own part, so a retry neither doubles nor loses rows; readers see
    ``_SUCCESS`` only when all of it is there. The masked rows are computed once, into the shared folder."""
    found = detect.detect_all("text")
    extra = ["hidden"] if "hidden" in batch.columns else []
    rows = batch.filter("text is not null").select("doc_id", "text", *extra, found.alias("found")).withColumn("masked", mask_text(F.col("text"), F.col("found")))
    rows = rows.join(checks(rows).groupBy("doc_id").agg(F.sum(F.col("left_over") + F.col("residue")).alias("left")), "doc_id")
    with scratch(rows, "batch") as rows:
        good = rows.filter("left = 0").drop("left")
        if extra:
            strings = rows.select("doc_id", F.posexplode("hidden").alias("ord", "content")).select("doc_id", F.lit("hidden").alias("kind"), "ord", "content")
            scrubbed = scrub_hidden(strings).groupBy("doc_id").agg(F.bool_and(F.coalesce("clean", F.lit(True))).alias("clean"), F.array_sort(F.collect_list(F.struct("ord", "masked"))).alias("m"))
            good = good.drop("hidden").join(scrubbed, "doc_id", "left").filter(F.coalesce("clean", F.lit(True))).withColumn("hidden", F.transform("m", lambda h: h["masked"])).drop("m", "clean")
        kinds = F.array_distinct(F.transform("found", lambda f: f["type"]))
        counts = F.map_from_entries(F.transform(kinds, lambda t: F.struct(t.alias("k"), F.size(F.filter("found", lambda f: f["type"] == t)).alias("v"))))
        good.select("doc_id", "masked", *extra).write.mode("overwrite").parquet(f"{folder}/masked/batch_id={batch_id}")
        # A document without findings leaves no audit row.
        audit = good.filter(F.size("found") > 0).select("doc_id", content_hash(F.col("text")).alias("original_sha256"), format_counts(counts).alias("masked_counts"))
        audit.write.mode("overwrite").parquet(f"{folder}/audit/batch_id={batch_id}")


def mask_stream(documents: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Run ``publish`` over a stream of documents, a batch for what has arrived."""
    return documents.writeStream.foreachBatch(lambda df, i: publish(df, folder, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PROMOTED = "word string, direction string, event string, n long"
STATE = "n long, promoted boolean"


def _learn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Count a word's candidates; at the threshold it enters the dictionary, a reversal clears all. What is
    held of a batch are its instants and which of them are reversals."""
    n, promoted = state.get if state.exists else (0, False)
    out = []
    steps = sorted((ts, event == "취소") for b in batches for ts, event in zip(b["ts"], b["event"], strict=True))
    for _, reversal in steps:
        if reversal:
            if promoted:
                out.append((*key, "취소", n))
            n, promoted = 0, False
        else:
            n += 1
            if n >= D.PROMOTE_AT and not promoted:
                promoted = True
                out.append((*key, "반영", n))
    state.update((int(n), bool(promoted)))
    yield pd.DataFrame(out, columns=["word", "direction", "event", "n"])


def learn_stream(events: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Promotions and reversals as they happen. ``events``: word, direction, ts, event (취소 or anything else
    for a candidate). The state of a word is two values, whatever the number of its events. Words that the
    ``dictionary`` (word, direction) holds need not enter it; directions but the two of a dictionary don't count."""
    rows = events.select(strip_ws(F.col("word")).alias("word"), "direction", "ts", F.coalesce("event", F.lit("")).alias("event")).filter((F.col("word") != "") & F.col("direction").isin(DIRECTIONS) & F.col("ts").isNotNull())
    known = base_dictionary(events.sparkSession) if dictionary is None else dictionary
    rows = rows.join(known.select("word", "direction").distinct(), ["word", "direction"], "left_anti")
    return rows.groupBy("word", "direction").applyInPandasWithState(_learn, PROMOTED, STATE, "append", GroupStateTimeout.NoTimeout)


def trust_stream(findings: DataFrame, late: str = "1 day", window: str = "7 days") -> DataFrame:
    """Extension: findings kept by window of event time (column ``at``), with a bound for late rows."""
    return findings.withWatermark("at", late).groupBy(F.window("at", window), "type").agg(F.count("*").alias("n"), F.count_if("approved").alias("kept"))
