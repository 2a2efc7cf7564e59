"""Has this key been seen before?

Every record carries keys in named fields; a key counts as seen if it stands in the archive or in a
record with a smaller id. The archive and the records, cut by id into a few batches, are sealed batch
by batch: the distinct key hashes of a batch, spread over shards by hash, become one ribbon filter for
each shard (about 10 bits a key; the keys themselves are not kept). The distinct keys of a batch probe
the filters of all earlier batches of their shard. Repeats within the open batch are decided by its own
distinct keys, which it holds until it is sealed. A negative answer is certain; each generation asked adds
1/256 to the rate of wrong yes answers, so ``batches`` bounds it. The few positives are
then checked exactly, which also gives the rate of wrong answers; probes with keys that are certainly
absent give it independently.

No row is ever joined on a hot key: keys are made distinct, with map-side aggregation, before any
shuffle, and the rows that are *not* seen - at most one for each distinct key - are taken away from all
rows by id.

Nulls: null and blank values never count and never come out; rows without an id have no order and do
not come out. Empty tables give empty results.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimi.functions.text import nfc, strip_ws
from garimi.llm import ribbon
from garimi.llm.bloom import Bloom
from garimi.staging import staged

FIELDS = ("original_sha256", "original_filename")
BATCHES = 4  # sealed batches the records are cut into, by id; the archive is one more, before them
SHARD_KEYS = 1_000_000  # hashes a shard's filter holds at most, about


def keys(df: DataFrame, id_col: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, key): one row for each non-blank value; outer spaces, letter case and composition
    make no difference. ``h`` is the hash of field and key."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(strip_ws(F.col(f))).alias("v")) for f in fields]))
    out = df.select(F.col(id_col).alias("id"), pairs.alias("p")).filter(F.col("p.v") != "")
    out = out.select("id", F.col("p.field").alias("field"), nfc(F.col("p.v")).alias("key"))
    return out.withColumn("h", F.xxhash64("field", "key"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    data = ribbon.build(pdf["h"].to_numpy())
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "batch": [int(pdf["batch"].iloc[0])], "n_keys": [data.n_keys], "filter": [data.to_bytes()]})


def _probe(filters: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    """For each probe, the number of filters of earlier batches asked and answering yes."""
    h, batch = probes["h"].to_numpy(), probes["batch"].to_numpy()
    asked, yes = np.zeros(len(h), np.int32), np.zeros(len(h), np.int32)
    for b, data in zip(filters["batch"], filters["filter"], strict=True):
        later = np.flatnonzero(batch > b)
        if len(later):
            asked[later] += 1
            yes[later] += ribbon.Ribbon.from_bytes(data).contains(h[later])
    return probes.assign(asked=asked, yes=yes)


class SeenBefore:
    """The operator over an archive and a stream of records; its parts are lazy DataFrames."""

    def __init__(self, archive: DataFrame, records: DataFrame, archive_id: str, record_id: str, fields: tuple[str, ...] = FIELDS, batches: int = BATCHES):
        self.spark, self.batches, self.fields = records.sparkSession, batches, fields
        self.archive = keys(archive, archive_id, fields)
        records = records.filter(F.col(record_id).isNotNull())
        self.rows = keys(records, record_id, fields)
        low, high, n = records.agg(F.min(record_id), F.max(record_id), F.count("*")).first()
        low, high = low or 0, high or 0
        width = max(1, (high - low + batches) // batches)
        batch = (F.floor((F.col("id") - F.lit(low)) / F.lit(width)) + 1).cast("int")
        # First record of each distinct key of a batch: what the open batch knows exactly before it is sealed.
        firsts = self.rows.withColumn("batch", batch).groupBy("field", "key", "h", "batch").agg(F.min("id").alias("first_id"))
        self.firsts = staged(firsts, "batch-keys")
        total = (n + archive.count()) * len(fields)
        self.shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_KEYS))

    def _shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.col("h"), F.lit(self.shards)).cast("int"))

    def filters(self) -> DataFrame:
        """One ribbon filter for each shard of each sealed batch. The last batch has no later one to probe it."""
        old = self.archive.select(F.lit(0).alias("batch"), "h")
        new = self.firsts.filter(F.col("batch") < self.batches).select("batch", "h")
        hashes = self._shard(old.unionByName(new).distinct())
        return hashes.groupBy("shard", "batch").applyInPandas(_build, "shard int, batch int, n_keys long, filter binary")

    def probe(self, probes: DataFrame) -> DataFrame:
        """``probes`` (field, h, batch) with the filters asked and the yes answers."""
        schema = "field string, h long, batch int, shard int, asked int, yes int"
        left = self.filters().groupBy("shard")
        return left.cogroup(self._shard(probes).groupBy("shard")).applyInPandas(_probe, schema).drop("shard")

    def maybe(self) -> DataFrame:
        """Distinct (field, h, batch) that some earlier filter says yes to."""
        return self.probe(self.firsts.select("field", "h", "batch").distinct()).filter("yes > 0")

    def checked(self) -> DataFrame:
        """Every distinct (field, key, batch) with the filters' answer ``maybe`` and the truth ``seen``;
        only keys with a yes are looked up exactly."""
        maybe = self.maybe().select("field", "h", "batch", F.lit(True).alias("maybe"))
        asked = self.firsts.join(maybe, ["field", "h", "batch"], "left").withColumn("maybe", F.coalesce("maybe", F.lit(False)))
        asked = staged(asked, "answers")
        # Archive keys that can be no positive are let go before they are made distinct and move; a key that
        # stands in a third of the archive is one row for each task then.
        yes = asked.filter("maybe").select("h")
        old = self.archive.filter(Bloom(yes, yes.count()).might(F.col("h"))).select("field", "key").distinct().withColumn("archived", F.lit(True))
        both = asked.join(old, ["field", "key"], "left")
        # At most one row for each sealed batch is in a window.
        first = F.min("batch").over(Window.partitionBy("field", "key"))
        seen = F.col("maybe") & (F.coalesce("archived", F.lit(False)) | (F.col("first") < F.col("batch")))
        return both.withColumn("first", first).withColumn("seen", seen).drop("archived", "first")

    def found(self) -> DataFrame:
        """(id, field) of every record and field whose key was seen before: all non-blank keys but the
        first of each key that no earlier batch holds."""
        new = self.checked().filter(~F.col("seen")).select(F.col("first_id").alias("id"), "field")
        return self.rows.select("id", "field").join(new, ["id", "field"], "left_anti")

    def error_report(self, absent: int = 20_000) -> DataFrame:
        """For each field: probes with keys of the data and with ``absent`` keys that cannot occur (they
        hold capital letters, which no normalised key does), wrong yes answers, and their rates. A wrong
        no cannot occur; ``missed`` counts them all the same, over all keys."""
        checked = staged(self.checked(), "checked")
        by = checked.groupBy("field").agg(
            F.count("*").alias("distinct_keys"),
            F.count_if("maybe").alias("yes_answers"),
            F.count_if(F.col("maybe") & ~F.col("seen")).alias("wrong_yes"),
            F.count_if(~F.col("seen")).alias("truly_new"),
        )
        truth = self.archive.select("field", "key").distinct().join(checked.filter(~F.col("seen")), ["field", "key"], "left_semi")
        missed = truth.groupBy("field").agg(F.count("*").alias("missed"))
        names = F.explode(F.array(*[F.lit(f) for f in self.fields])).alias("field")
        sure = self.spark.range(absent).select("id", names).select("field", F.xxhash64("field", F.concat(F.lit("ABSENT "), F.col("id").cast("string"))).alias("h"), F.lit(self.batches + 1).alias("batch"))
        audit = self.probe(sure).groupBy("field").agg(F.count("*").alias("absent_probes"), F.count_if(F.col("yes") > 0).alias("absent_yes"))
        out = by.join(missed, "field", "left").join(audit, "field", "left")
        return out.select(
            "field", "distinct_keys", "yes_answers", "wrong_yes", "truly_new", F.coalesce("missed", F.lit(0)).alias("missed"),
            F.try_divide("wrong_yes", "truly_new").alias("wrong_yes_rate"), "absent_probes", "absent_yes", F.try_divide("absent_yes", "absent_probes").alias("absent_yes_rate"),
        )


