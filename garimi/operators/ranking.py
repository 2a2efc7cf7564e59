"""Numbering rows within a key that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: list[str], block: Column, order: list[str | Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... within ``by``, in ``order``, as ``row_number`` would, but in blocks.

    ``block`` must rise with the order (all rows of a lower block come first) and cut a large key into parts
    that fit a task. Rows are numbered within their block; the sizes of the blocks before it, a small table,
    are added. Null keys form a group of their own."""
    x = df.withColumn("_block", block)
    inner = x.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order)))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = x.groupBy(*by, "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    sizes = sizes.select(*[F.col(c).alias(f"_{c}_of") for c in [*by, "_block"]], "_before")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in [*by, "_block"]]
    out = inner.join(sizes, on)
    return out.withColumn(name, F.col("_before") + F.col("_at")).drop("_block", "_at", "_before", *[f"_{c}_of" for c in [*by, "_block"]])
