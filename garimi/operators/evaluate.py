"""Accuracy against marked texts: ``{{name}}`` and ``[[address]]``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimi import dictionaries as D
from garimi.functions.offsets import each, occurrences
from garimi.operators import detect

MARK = r"\{\{.*?\}\}|\[\[.*?\]\]"


def parse_marked(cases: DataFrame) -> DataFrame:
    """case_id, plain, gold: the text without its markers and the marked spans in it. Each marker is four
    characters longer than its value. Repeated cases come once; null texts are left out."""
    rows = cases.filter("marked_text is not null").select("case_id", "marked_text").distinct()
    hits = occurrences(F.col("marked_text"), MARK)
    gold = F.transform(hits, lambda m, i: F.struct(
        F.when(m["value"].startswith("{{"), D.NAME).otherwise(D.ADDRESS).alias("type"), F.substring(m["value"], F.lit(3), F.length(m["value"]) - 4).alias("value"),
        (m["start_pos"] - 4 * i).cast("int").alias("start_pos"), (m["end_pos"] - 4 * (i + 1)).cast("int").alias("end_pos"),
    ))
    plain = F.regexp_replace("marked_text", r"\{\{(.*?)\}\}|\[\[(.*?)\]\]", "$1$2")
    return rows.select("case_id", plain.alias("plain"), gold.alias("gold"))


def gold_spans(cases: DataFrame) -> DataFrame:
    return each(parse_marked(cases), F.col("gold"), "g", "case_id").select("case_id", "g.*")


def predictions(cases: DataFrame) -> DataFrame:
    """Names and addresses that the rules find in the plain texts."""
    p = parse_marked(cases)
    found = F.concat(detect.names(F.col("plain")), detect.addresses(F.col("plain")))
    return each(p, found, "f", "case_id").select("case_id", "f.type", "f.value", "f.start_pos", "f.end_pos")


def accuracy(cases: DataFrame) -> DataFrame:
    """For each type: exact-span hits, predictions, gold spans, precision and recall; NaN without any."""
    key = ["case_id", "type", "start_pos", "end_pos"]
    g, p = gold_spans(cases).select(*key).distinct().withColumn("g", F.lit(1)), predictions(cases).select(*key).distinct().withColumn("p", F.lit(1))
    n = g.join(p, key, "full").groupBy("type").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("hits"), F.count("p").alias("predicted"), F.count("g").alias("gold"))
    rate = lambda d: F.coalesce(F.try_divide("hits", d), F.lit(float("nan")))
    return n.withColumn("precision", rate("predicted")).withColumn("recall", rate("gold"))


def misses(cases: DataFrame) -> DataFrame:
    """Gold spans not found."""
    key = ["case_id", "type", "start_pos", "end_pos"]
    return gold_spans(cases).join(predictions(cases).select(*key).distinct(), key, "left_anti").select(*key, "value")
