"""Frequency of every distinct term: in how many events and in how many documents it occurs.

Heavy-light aggregation. A mergeable frequent-items sketch over one scan names the terms that hold a
noticeable share of all rows; it only decides the path, so its error cannot touch a count. Those at
most ``HEAVY_MOST`` terms are broadcast (that number bounds the size). Rows of heavy terms are counted
where they are read: a task keeps for each term the distinct ids it has met, as sets of 16-bit
offsets by the ids' upper 48 bits, and a counter of rows without an event id. What leaves the task are
these packed sets (two bytes an id, one bit an id where they are dense), never rows; equal blocks are
united and their sizes added up. Only rows of the remaining terms are shuffled, once, by term: none of
them holds a large share, so no task is hot. The two count tables are united.

Nulls: rows with a null or blank word or a null direction don't count; a null document is no document;
rows with the same event id are copies of one event and count once, rows without one each for itself.
Should copies contradict each other, each term and each document that they name is counted. An empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimi.functions.text import nfc, strip_ws

HEAVY_MOST = 256  # terms that are counted in local sets
HEAVY_SHARE = 0.001  # least share of rows that makes a term heavy
RARE_BELOW, COMMON_ABOVE = 3, 0.05

EVENTS, DOCS, ALONE = 0, 1, 2  # kinds of local counts: distinct events, distinct documents, rows without an event id
LOCAL = "which int, kind int, block long, ids binary, n long"
LOCAL_ROWS = 2_000_000  # rows a task holds before it packs them
DENSE = 4096  # ids of a block above which a bit for each possible one takes less room


def terms(events: DataFrame) -> DataFrame:
    """(word, direction, doc_id, event_id) of the rows that count; word trimmed and in NFC."""
    raw = events.select(strip_ws(F.col("word")).alias("w"), "direction", F.col("doc_id").cast("long").alias("doc_id"), F.col("event_id").cast("long").alias("event_id"))
    raw = raw.filter((F.col("w") != "") & F.col("direction").isNotNull())
    # Never null, so that no join infers a null test and computes the composed form twice for it.
    return raw.select(F.coalesce(nfc(F.col("w")), F.lit("")).alias("word"), "direction", "doc_id", "event_id")


def heavy_terms(rows: DataFrame) -> list[tuple[str, str]]:
    """The terms with at least ``HEAVY_SHARE`` of all rows, at most ``HEAVY_MOST``, by one mergeable sketch."""
    top, n = rows.agg(F.expr(f"approx_top_k(concat(word, '\\u0001', direction), {HEAVY_MOST}, {HEAVY_MOST * 16})"), F.count("*")).first()
    return [tuple(t["item"].split("\u0001", 1)) for t in top or [] if t["count"] >= max(2, HEAVY_SHARE * n)]


def _pack(low: np.ndarray) -> bytes:
    """Distinct ascending 16-bit offsets: as they are, or as a bitmap of 8,192 bytes where that is shorter."""
    if len(low) < DENSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(65_536, np.uint8)
    bits[low] = 1
    return np.packbits(bits).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    """The bitmap (a byte for each possible offset) of a packed set."""
    if len(data) == 8192:
        return np.unpackbits(np.frombuffer(data, np.uint8))
    bits = np.zeros(65_536, np.uint8)
    bits[np.frombuffer(data, "<u2")] = 1
    return bits


def _blocks(which: np.ndarray, ids: np.ndarray, kind: int) -> Iterator[tuple[int, int, int, bytes, int]]:
    """The packed distinct ids of each term and block."""
    order = np.lexsort((ids, which))
    which, ids = which[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (which[1:] != which[:-1]) | (ids[1:] != ids[:-1])
    which, ids = which[new], ids[new]
    block, low = ids >> 16, ids & 0xFFFF
    edge = np.flatnonzero((which[1:] != which[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip(np.r_[0, edge], np.r_[edge, len(ids)], strict=True):
        if a < b:
            yield int(which[a]), kind, int(block[a]), _pack(low[a:b]), 0


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """which, event_id, doc_id of a task's heavy rows, packed."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        which = t.column(0).to_numpy().astype(np.int64)
        rows = []
        for kind, column in ((EVENTS, t.column(1)), (DOCS, t.column(2))):
            some = column.is_valid().to_numpy()
            rows += _blocks(which[some], column.drop_null().to_numpy().astype(np.int64), kind)
            if kind == EVENTS:
                n = np.bincount(which[~some])
                rows += [(int(w), ALONE, 0, None, int(n[w])) for w in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["which", "kind", "block", "ids", "n"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= LOCAL_ROWS:
            yield from flush(held)
            held, n = [], 0
    if n:
        yield from flush(held)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sizes of equal blocks united, of a partition sorted by them, in the memory of one block."""
    key, bits, n, out = None, None, 0, []
    for b in batches:
        for *k, ids, count in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if k != key:
                if key:
                    out.append((key[0], key[1], n + (int(bits.sum()) if bits is not None else 0)))
                key, bits, n = k, None, 0
            n += count
            if ids is not None:
                bits = _unpack(ids) if bits is None else bits | _unpack(ids)
    if key:
        out.append((key[0], key[1], n + (int(bits.sum()) if bits is not None else 0)))
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["which", "kind", "n"])


def heavy_counts(rows: DataFrame) -> DataFrame:
    """which, n_events, n_docs of the rows (which, event_id, doc_id) of heavy terms."""
    key = ["which", "kind", "block"]
    packed = rows.select("which", "event_id", "doc_id").mapInArrow(_local_counts, LOCAL)
    sizes = packed.repartition(*key).sortWithinPartitions(*key).mapInArrow(_united, "which int, kind int, n long")
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    return sizes.groupBy("which").agg(of(EVENTS, ALONE).alias("n_events"), of(DOCS).alias("n_docs"))


def light_counts(rows: DataFrame) -> DataFrame:
    """word, direction, n_events, n_docs of terms that hold little: each row gives its event and its document
    as one id each, shuffled once, by term; both aggregates keep that partitioning."""
    term = ["word", "direction"]
    alone = F.col("event_id").isNull()
    event = F.struct(F.when(alone, ALONE).otherwise(EVENTS).alias("kind"), F.when(alone, F.monotonically_increasing_id()).otherwise(F.col("event_id")).alias("id"))
    both = F.array(event, F.struct(F.lit(DOCS).alias("kind"), F.col("doc_id").alias("id")))
    ids = rows.select(*term, F.explode(both).alias("i")).select(*term, "i.kind", "i.id").filter("id is not null")
    once = ids.repartition(*term).distinct()
    return once.groupBy(*term).agg(F.count_if(F.col("kind") != DOCS).alias("n_events"), F.count_if(F.col("kind") == DOCS).alias("n_docs"))


def term_counts(events: DataFrame) -> DataFrame:
    """word, direction, n_events, n_docs of every distinct term."""
    spark, rows = events.sparkSession, terms(events)
    heavy = heavy_terms(rows)
    if not heavy:
        return light_counts(rows)
    names = spark.createDataFrame([(w, d, i) for i, (w, d) in enumerate(heavy)], "word string, direction string, which int")
    marked = rows.join(F.broadcast(names), ["word", "direction"], "left")
    exact = heavy_counts(marked.filter("which is not null")).join(F.broadcast(names), "which")
    columns = ["word", "direction", "n_events", "n_docs"]
    return exact.select(*columns).unionByName(light_counts(marked.filter("which is null")).select(*columns))


def marked_counts(events: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """``term_counts`` with mark: ``rare`` below ``rare_below`` documents, ``common`` above that share of
    the distinct documents of all rows, null between them; ``rare`` holds if both do."""
    n_docs = events.select("doc_id").distinct().filter("doc_id is not null").count()
    mark = F.when(F.col("n_docs") < rare_below, "rare").when(F.col("n_docs") > common_above * n_docs, "common")
    return term_counts(events).withColumn("mark", mark)
