"""Intermediate tables in the folder that all executors share.

A table that several jobs read, or whose lineage is long, is written once and read back with its
columns pruned. The folder is the session's ``spark.checkpoint.dir``; only a local session without
one gets a temporary folder of its own, so losing an executor never loses an intermediate table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local_root:
        _local_root[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="garimi-")
    return _local_root[sc.applicationId]


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(target)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; deleted when the application ends."""
    path = f"{shared_root(spark)}/garimi-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _delete_on_exit(spark, path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back; deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/garimi-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``staged`` for the time of a ``with`` block, for batches of a stream that never ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/garimi-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Logical operators behind which a plan's partitions are those of a shuffle.
_SHUFFLING = {"Aggregate", "Join", "Window", "Sort", "Repartition", "RepartitionByExpression", "Distinct", "Deduplicate"}


def _operators(node) -> Iterator[str]:
    yield node.nodeName()
    children = node.children()
    for i in range(children.size()):
        yield from _operators(children.apply(i))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores, for stages of costly work on few
    input files. A plain scan that has enough already is left as it is; anything behind a shuffle is
    repartitioned outright, for asking an adaptive plan for its partitions would run it."""
    least = least or df.sparkSession.sparkContext.defaultParallelism
    if _SHUFFLING.intersection(_operators(df._jdf.queryExecution().optimizedPlan())):
        return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)
