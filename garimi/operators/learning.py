"""Dictionaries that learn from review events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimi import dictionaries as D
from garimi.functions.offsets import each
from garimi.functions.text import strip_ws
from garimi.operators.detect import MOST_WORDS, Words, names
from garimi.operators.replay import PUT, REMOVE, instant
from garimi.staging import staged

DIRECTIONS = [D.EXCLUDE_DIRECTION, D.NAME_DIRECTION]


def base_dictionary(spark: SparkSession) -> DataFrame:
    """The dictionary before anything is learned: (word, direction)."""
    rows = [(w, D.EXCLUDE_DIRECTION) for w in D.EXCLUDE_WORDS] + [(w, D.NAME_DIRECTION) for w in D.SURNAMES]
    return spark.createDataFrame(rows, "word string, direction string")


def learned_words(spark: SparkSession, standing: DataFrame) -> Words:
    """The words of detection after learning: the base and the ``standing`` entries (word, direction) of the log.
    They become part of the plan, so a dictionary of more than ``MOST_WORDS`` entries is an error."""
    rows = base_dictionary(spark).unionByName(standing.filter(F.col("direction").isin(DIRECTIONS)).select("word", "direction")).distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words is too large for a plan")
    return Words(*(tuple(sorted(r["word"] for r in rows if r["direction"] == d)) for d in (D.NAME_DIRECTION, D.EXCLUDE_DIRECTION)))


def learned_names(documents: DataFrame, standing: DataFrame) -> DataFrame:
    """(doc_id, value, start_pos, grp): the names of the documents by the base and the ``standing`` entries (word,
    direction) of the log, however many: they are joined with the words that stand where a name would and the
    beginnings of these."""
    kept = standing.filter(F.col("direction").isin(DIRECTIONS)).select("word", "direction")
    held = staged(base_dictionary(documents.sparkSession).unionByName(kept).distinct(), "dictionary")
    of = lambda direction: held.filter(F.col("direction") == direction).select("word")
    rows = each(documents, names(F.col("text"), None), "f", "doc_id").select("doc_id", "f.value", "f.start_pos", "f.grp")
    rows = staged(rows, "name-places")
    begin = rows.select("value").distinct().withColumn("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("value")), lambda n: F.substring("value", F.lit(1), n))))
    good = begin.join(of(D.NAME_DIRECTION), "word", "left_semi").select("value").distinct()
    good = good.join(of(D.EXCLUDE_DIRECTION), F.col("value") == F.col("word"), "left_anti")
    return rows.join(good, "value", "left_semi").select("doc_id", "value", "start_pos", "grp")


def valid_candidates(candidates: DataFrame) -> DataFrame:
    """event_id, word, direction, tsz. Left out: blank words, directions but the two that a dictionary has, and
    events without an id or an instant, which have no place in the order."""
    clean = candidates.select("event_id", strip_ws(F.col("word")).alias("word"), "direction", instant(F.col("ts")).alias("tsz"))
    return clean.filter((F.col("word") != "") & F.col("direction").isin(DIRECTIONS) & F.col("tsz").isNotNull() & F.col("event_id").isNotNull())


def promotions(candidates: DataFrame, dictionary: DataFrame, at: int = D.PROMOTE_AT) -> DataFrame:
    """(word, direction, event_id): the event at which a word that ``dictionary`` (word, direction) doesn't hold
    reaches ``at`` candidates and enters it. Only each key's first ``at`` events matter: they are kept by a
    bounded aggregate before any row is ordered."""
    once = valid_candidates(candidates).groupBy("event_id").agg(F.min(F.struct("tsz", "word", "direction")).alias("e")).select("event_id", "e.*")
    # Salted top-k: the first of each salt hold the first of all, so a word with a third of the rows is no hot task.
    salted = once.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(32)))
    w1 = Window.partitionBy("word", "direction", "salt").orderBy("tsz", "event_id")
    few = salted.withColumn("n", F.row_number().over(w1)).filter(F.col("n") <= at)
    w2 = Window.partitionBy("word", "direction").orderBy("tsz", "event_id")
    reached = few.withColumn("n", F.row_number().over(w2)).filter(F.col("n") == at).select("word", "direction", "event_id")
    return reached.join(dictionary.select("word", "direction").distinct(), ["word", "direction"], "left_anti")


def log_events(log: DataFrame) -> DataFrame:
    """Entries and reversals of the log, each change once, with their instant."""
    t = log.select("change_id", strip_ws(F.col("word")).alias("word"), strip_ws(F.col("direction")).alias("direction"), strip_ws(F.col("event")).alias("event"), instant(F.col("ts")).alias("tsz"))
    return t.filter("word <> '' and direction <> '' and tsz is not null").filter(F.col("event").isin(PUT, REMOVE)).distinct()


def recent_promotions(log: DataFrame, days: int = D.RECENT_DAYS, most: int = D.RECENT_LIMIT) -> DataFrame:
    """The newest ``most`` entries of the ``days`` days before the log's last event whose last event is no reversal."""
    e = log_events(log)
    last = e.groupBy("word", "direction").agg(F.max(F.struct("tsz", F.expr("-change_id as back"), "event")).alias("e")).select("word", "direction", F.col("e.tsz").alias("tsz"), F.col("e.event").alias("event"))
    now = e.agg(F.max("tsz")).first()[0]
    keep = last.filter((F.col("event") == PUT) & (F.col("tsz") >= F.lit(now) - F.expr(f"interval {days} days")))
    return keep.orderBy(F.desc("tsz"), "word", "direction").limit(most).select("word", "direction", F.unix_micros("tsz").alias("promoted_us"))


def epochs(candidates: DataFrame, log: DataFrame, dictionary: DataFrame, at: int = D.PROMOTE_AT) -> DataFrame:
    """(word, direction, n_since, promote): candidates since the last reversal, which clears the history, and
    whether they suffice to enter (again); a word that ``dictionary`` holds needs not."""
    cut = log_events(log).filter(F.col("event") == REMOVE).groupBy("word", "direction").agg(F.max("tsz").alias("cut"))
    clean = valid_candidates(candidates).distinct()
    # Counted by instant first, so that the join meets few rows of a frequent word.
    by_time = clean.groupBy("word", "direction", "tsz").agg(F.count("*").alias("n"))
    x = by_time.join(cut, ["word", "direction"], "left").filter("cut is null or tsz > cut")
    out = x.groupBy("word", "direction").agg(F.sum("n").alias("n_since"))
    out = out.join(dictionary.select("word", "direction", F.lit(True).alias("held")).distinct(), ["word", "direction"], "left")
    return out.select("word", "direction", "n_since", ((F.col("n_since") >= at) & F.col("held").isNull()).alias("promote"))
