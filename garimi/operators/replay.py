"""Ordered replay of a change feed.

Changes come late, out of order and more than once. The feed is range-partitioned by
(key, instant, sequence), so a key with a third of all changes is spread over many tasks, each sorted
within itself. A task walks its rows in constant memory through the state machine and emits, for every
key it meets, what its run of changes does to an absent and to a present entry. Such effects compose
associatively; the few effects of a key that spans several tasks are composed in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimi.functions.text import strip_ws

#: Fixed event names of the feed.
PUT, UPDATE, REMOVE = "반영", "정정", "취소"

_HAS_OFFSET = r":\d{2}(\.\d+)?([Zz]|[+-]\d{2}(:?\d{2})?)$"


def instant(ts, zone: str = "+09:00"):
    """ISO text as a timestamp; text without an offset is in ``zone``; what is no time gives null."""
    t = strip_ws(ts)
    return F.when(t.rlike(_HAS_OFFSET), t).otherwise(F.concat(t, F.lit(zone))).try_cast("timestamp")


def valid_changes(log: DataFrame) -> DataFrame:
    """Trimmed changes with their instant. Left out: rows in which word, direction, event, ts or
    change_id is null or blank, ts is no time, or the event is unknown."""
    out = log.select(
        strip_ws(F.col("word")).alias("word"),
        strip_ws(F.col("direction")).alias("direction"),
        strip_ws(F.col("event")).alias("event"),
        instant(F.col("ts")).alias("at"),
        F.col("change_id").cast("long").alias("change_id"),
        F.col("hit_count").cast("int").alias("hit_count"),
    )
    return out.filter(
        (F.col("word") != "") & (F.col("direction") != "") & F.col("event").isin(PUT, UPDATE, REMOVE) & F.col("at").isNotNull() & F.col("change_id").isNotNull()
    )


# The effect of a run of changes on an entry: three cases, by what stands before it.
#   keep: the run holds no change that applies whatever stands before (only updates)
#   removed / put: the run ends with the entry absent / present, whatever stood before
_EFFECT = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("first_at", T.TimestampType()),
        T.StructField("first_change", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("change_id", T.LongType()),
        T.StructField("hit_count", T.IntegerType()),
        T.StructField("hit_known", T.BooleanType()),
    ]
)


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk one sorted partition; one row for each key, however many changes it has."""
    key = None
    out: list[tuple] = []
    kind = change = hits = first = last = None
    known = False

    def close() -> None:
        if key is not None:
            out.append((*key, first[0], first[1], kind, change, hits, known))

    for batch in batches:
        for word, direction, event, at, seq, hit in zip(
            batch["word"], batch["direction"], batch["event"], batch["at"], batch["change_id"], batch["hit_count"], strict=True
        ):
            hit = None if pd.isna(hit) else int(hit)
            if (word, direction) != key:
                close()
                key, first, last = (word, direction), (at, int(seq)), None
                kind, change, hits, known = "keep", None, None, False
            if last == (at, seq):
                continue  # already applied
            last = (at, seq)
            if event == PUT:
                kind, change, hits, known = "put", int(seq), hit, True
            elif event == REMOVE:
                kind, change, hits, known = "removed", None, None, True
            elif kind != "removed":  # an update; on an entry known to be absent it does nothing
                change = int(seq)
                if hit is not None:
                    hits, known = hit, True
        if len(out) >= 20_000:
            yield pd.DataFrame(out, columns=_EFFECT.names)
            out = []
    close()
    yield pd.DataFrame(out, columns=_EFFECT.names)


def replay(changes: DataFrame) -> DataFrame:
    """Entries that stand after all changes: word, direction, change_id (the change that last set it),
    hit_count (the last one given since the entry was put; an update without one keeps it).

    Order: instant, then ascending change_id. A change delivered several times is applied once: copies
    sort next to each other and the later ones are skipped; across a partition border applying one
    again right after itself changes nothing. An empty feed gives no entries."""
    order = ["word", "direction", "at", "change_id"]
    parts = changes.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_effects, _EFFECT)
    # Composition: the last run that sets the entry absolutely decides; updates after it apply if it is present.
    # Each key has at most one effect per range partition, so the arrays stay small.
    step = F.struct("first_at", "first_change", "kind", "change_id", "hit_count", "hit_known")
    runs = parts.groupBy("word", "direction").agg(F.array_sort(F.collect_list(step)).alias("runs"))
    zero = F.struct(F.lit("removed").alias("kind"), F.lit(None).cast("long").alias("change_id"), F.lit(None).cast("int").alias("hit_count"))

    def compose(acc, run):
        updates = (run["kind"] == "keep") & (acc["kind"] == "put")
        return F.struct(
            F.when(run["kind"] == "keep", acc["kind"]).otherwise(run["kind"]).alias("kind"),
            F.when(updates, F.coalesce(run["change_id"], acc["change_id"])).when(run["kind"] == "keep", acc["change_id"]).otherwise(run["change_id"]).alias("change_id"),
            F.when(updates & run["hit_known"], run["hit_count"]).when(run["kind"] == "keep", acc["hit_count"]).otherwise(run["hit_count"]).alias("hit_count"),
        )

    end = runs.select("word", "direction", F.aggregate("runs", zero, compose).alias("s"))
    return end.filter(F.col("s.kind") == "put").select("word", "direction", F.col("s.change_id").alias("change_id"), F.col("s.hit_count").alias("hit_count"))
