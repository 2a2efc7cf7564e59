"""Filling containers of fixed capacity with documents, sized in tokens.

Sizes are whole numbers up to the largest capacity, so all documents together are described by a
histogram of at most ``capacity`` entries, whatever their number: that is all the driver sees. Best fit,
largest sizes first, runs on the histogram. Equal containers are handled as one group with a count, so
a step costs as much for a billion documents as for one. The result is a list of groups, each with its
slots (size, how many a container); a document finds its slot by its rank among those of its size.
Ranks come from counts by (size, salt): a size that a third of all documents have is numbered in many
tasks.

Variable capacity: with several permitted capacities the least-cost one is opened when nothing open
fits, cost being the share of the container left unused if it is filled with what is at hand, the larger
container among equals; at last each container is downsized to the smallest capacity that holds its contents.

A document is split only where it alone exceeds the largest permitted capacity: into full containers
and a rest, which is packed like a document.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from garimi.llm.bpe import count_tokens
from garimi.staging import staged

PARTS_A_SALT = 500_000  # parts of a size that one task numbers, about
JOINT = "joint"
MOST_SLOTS = 5_000_000  # entries of the look-up that every task gets, 40 bytes each


@dataclass
class Group:
    """``count`` containers with the same contents."""

    capacity: int
    room: int
    count: int
    slots: list[tuple[int, int, int]] = field(default_factory=list)  # size, how many a container, first rank


def best_fit(histogram: dict[int, int], capacities: list[int]) -> list[Group]:
    """Groups of containers that hold ``histogram[size]`` items of each size, 1 <= size <= max(capacities).

    Best fit decreasing: sizes from large to small, each item into the container with the least room
    that holds it. A step takes whole groups and cuts at most one, so there are at most four groups more
    for each size."""
    capacities = sorted(set(capacities))
    open_at: dict[int, list[Group]] = {}
    rooms: list[int] = []  # the keys of open_at, ascending
    groups: list[Group] = []

    def put(g: Group) -> None:
        if g.room not in open_at:
            open_at[g.room] = []
            insort(rooms, g.room)
        open_at[g.room].append(g)

    def fill(g: Group, size: int, each: int, rank: int) -> Group:
        return Group(g.capacity, g.room - size * each, g.count, [*g.slots, (size, each, rank)])

    for size in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                g = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(at)
            else:  # nothing open fits
                best, n = None, 0
                for c in capacities:
                    if c >= size:
                        each = min(c // size, left)
                        cost = (c - each * size) / c
                        if best is None or cost <= best[0]:
                            best, n = (cost, c), each
                c = best[1]
                g = Group(c, c, max(1, left // n))
            each = min(g.room // size, left)
            whole = min(g.count, left // each)
            if whole < g.count:  # the rest of the group stays as it is
                put(Group(g.capacity, g.room, g.count - whole, [(s, e, r + e * whole) for s, e, r in g.slots]))
            full = Group(g.capacity, g.room, whole, g.slots)
            put(fill(full, size, each, rank))
            rank += whole * each
            left -= whole * each
    for held in open_at.values():
        groups.extend(held)
    groups = [g for g in groups if g.slots]
    for g in groups:  # downsizing
        used = g.capacity - g.room
        g.capacity = next(c for c in capacities if c >= used)
        g.room = g.capacity - used
    return sorted(groups, key=lambda g: g.slots[0][::2])


class Assignment:
    """Look-up of (size, rank) in sorted arrays; their length is bounded by the capacity, not the data."""

    def __init__(self, groups: list[Group]):
        rows, at = [], 0
        for g in groups:
            for size, each, rank in g.slots:
                rows.append((size, rank, each, at, g.capacity))
            at += g.count
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.size, self.rank, self.each, self.base, self.capacity = table.T
        self.n_bins, self.first_capacity = at, groups[0].capacity if groups else None

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and capacity of items. Ranks of a size are laid out slot after slot."""
        key = (self.size << 40) + self.rank
        i = np.searchsorted(key, (size << 40) + rank, side="right") - 1
        return self.base[i] + (rank - self.rank[i]) // self.each[i], self.capacity[i]


_OUT = T.StructType(
    [T.StructField("plan", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("doc_id", "part", "n_parts", "start_token", "n_tokens", "bin_id", "capacity_tokens")]
    + [T.StructField("container_kind", T.StringType())]
)


def _place(shared: Broadcast):
    """Container of each ranked part, by look-up in its plan's assignment: (name, assignment, kinds) of each plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            for k, (plan, assign, kinds) in enumerate(shared.value):
                mine = cols["plan_no"] == k
                n = int(mine.sum())
                if not n:
                    continue
                doc, part, n_parts, start, size, rank = (cols[c][mine].astype(np.int64) for c in ("doc_id", "part", "n_parts", "start_token", "size", "rank"))
                bins, caps = np.zeros(n, np.int64), np.full(n, assign.first_capacity or min(kinds), np.int64)
                some = size > 0
                bins[some], caps[some] = assign.find(size[some], rank[some])
                arrays = [pa.array([plan] * n), *(pa.array(x) for x in (doc, part, n_parts, start, size, bins, caps)), pa.array([kinds[int(c)] for c in caps], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, _OUT.names)

    return run


def _ranked(parts: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, ... among the parts of the same plan and size. A size is cut by salt; the cuts are
    counted and numbered one after the other, so no task holds all parts of a size."""
    salts = max(16, -(-parts.count() // PARTS_A_SALT))
    by = ["plan_no", "size", "salt"]
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("plan_no", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*by).agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = salted.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "copy", "part")) - 1)
    return numbered.join(offsets, by).withColumn("rank", F.col("offset") + F.col("at"))


def parts_of(sizes: DataFrame, capacities: list[int]) -> DataFrame:
    """One row for each plan (its number and largest capacity) and part of a document: full parts only
    where the document alone exceeds the capacity, and what is left."""
    plans = F.explode(F.array(*[F.struct(F.lit(k).alias("plan_no"), F.lit(c).cast("long").alias("cap")) for k, c in enumerate(capacities)]))
    n, cap = F.col("n_tokens"), F.col("p.cap")
    n_parts = F.greatest(F.lit(1), F.ceil(n / cap)).cast("long")
    out = sizes.select("doc_id", "copy", "n_tokens", plans.alias("p")).withColumn("n_parts", n_parts)
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    start = F.col("part") * cap
    return out.select(F.col("p.plan_no").alias("plan_no"), "doc_id", "copy", "part", "n_parts", start.alias("start_token"), F.least(cap, n - start).alias("size"))


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Every document of ``sizes`` (doc_id, n_tokens) assigned to containers, under several plans: one for
    each capacity of ``containers``, named after its kind, that uses containers of that capacity only, and
    ``joint``, which may use all of them.

    Columns: plan, doc_id, part, n_parts, start_token, n_tokens, bin_id (0, 1, ... within the plan),
    capacity_tokens, container_kind. Documents without tokens, null ones among them, take no room and go
    to container 0 (of the smallest permitted kind if the plan holds nothing else). Rows that repeat a
    doc_id are documents of their own. No documents give no rows; no usable capacity is an error."""
    kinds = {int(r[0]): r[1] for r in containers.groupBy("capacity_tokens").agg(F.min("container_kind")).filter("capacity_tokens > 0").collect()}
    if not kinds:
        raise ValueError("no container has a capacity")
    plans = [(kinds[c], [c]) for c in sorted(kinds)] + ([(JOINT, sorted(kinds))] if len(kinds) > 1 else [])
    sizes = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.monotonically_increasing_id().alias("copy"))
    parts = parts_of(staged(sizes, "sizes"), [max(c) for _, c in plans])
    # At most capacity + 1 sizes a plan, however many documents.
    counted = parts.groupBy("plan_no", "size").agg(F.count("*").alias("n")).filter("size > 0").collect()
    ready = []
    for k, (name, permitted) in enumerate(plans):
        groups = best_fit({r["size"]: r["n"] for r in counted if r["plan_no"] == k}, permitted)
        ready.append((name, Assignment(groups), {c: kinds[c] for c in permitted}))
    ranked = _ranked(parts).select("plan_no", "doc_id", "part", "n_parts", "start_token", "size", "rank")
    # Best fit makes at most a few groups for each size, so what is broadcast is bounded by the capacities alone.
    if sum(len(a.size) for _, a, _ in ready) > MOST_SLOTS:
        raise ValueError(f"containers of more than {MOST_SLOTS} slots in all: their capacity is too large for one look-up")
    return ranked.mapInArrow(_place(sizes.sparkSession.sparkContext.broadcast(ready)), _OUT)


def pack_documents(documents: DataFrame, containers: DataFrame, folder: str | None = None) -> DataFrame:
    """``pack`` of documents sized in tokens of the public byte-level vocabulary."""
    return pack(count_tokens(documents, folder), containers)


def fill_report(assigned: DataFrame) -> DataFrame:
    """For each plan and kind: containers, their capacity and the tokens in them, and the share filled."""
    bins = assigned.groupBy("plan", "container_kind", "bin_id", "capacity_tokens").agg(F.sum("n_tokens").alias("used"))
    out = bins.groupBy("plan", "container_kind").agg(F.count("*").alias("containers"), F.sum("capacity_tokens").alias("capacity"), F.sum("used").alias("tokens"))
    return out.withColumn("filled", F.try_divide("tokens", "capacity"))
