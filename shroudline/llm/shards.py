"""Shards of near equal size from groups that must stay together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudline.llm.work import body, dense_ranks, lookup, settle

# Small groups are first packed into parcels; the driver sees at most a few times this many.
PARCELS_PER_SHARD = 128


class Capacities:
    """Open bins ordered by remaining capacity: a treap, so the tightest bin that still takes an item is found in O(log n)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [room, bin, priority, left, right]
        self.random = np.random.default_rng(7)

    def add(self, room: int, at: int) -> None:
        low, high = self._split(self.root, (room, at))
        self.root = self._merge(self._merge(low, [room, at, self.random.random(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the smallest room that is at least ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        path, node = [], high
        while node[3] is not None:
            path.append(node)
            node = node[3]
        if path:
            path[-1][3] = node[4]
        else:
            high = node[4]
        self.root = self._merge(low, high)
        return node[0], node[1]

    def _split(self, node, key):
        """Below and from ``key`` on."""
        if node is None:
            return None, None
        if (node[0], node[1]) < key:
            node[4], high = self._split(node[4], key)
            return node, high
        low, node[3] = self._split(node[3], key)
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[2] > b[2]:
            a[4] = self._merge(a[4], b)
            return a
        b[3] = self._merge(a, b[3])
        return b


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item; an item larger than ``capacity`` has a bin of its own."""
    bins, open_bins, count = np.zeros(len(sizes), np.int64), Capacities(), 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        found = open_bins.take_tightest(size)
        if found is None:
            room, at = max(capacity, size), count
            count += 1
        else:
            room, at = found
        bins[i] = at
        if room > size:
            open_bins.add(room - size, at)
    return bins


def level(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item: the smallest capacity at which best fit needs no more than ``shards`` bins.

    An item above the average of what is left fills a shard alone, else that capacity would leave others empty.
    """
    out = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    left, alone = int(sizes.sum()), 0
    while alone < min(shards - 1, len(order)) and int(sizes[order[alone]]) * (shards - alone) >= left:
        out[order[alone]] = alone
        left -= int(sizes[order[alone]])
        alone += 1
    rest, k = order[alone:], shards - alone
    if not len(rest):
        return out
    low, high = max(-(-left // k), int(sizes[rest[0]])) - 1, left
    best = best_fit_decreasing(sizes[rest], high)
    while high - low > 1:
        middle = (low + high) // 2
        bins = best_fit_decreasing(sizes[rest], middle)
        if bins.max() < k:
            best, high = bins, middle
        else:
            low = middle
    out[rest] = alone + best
    return out


def assign_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot; byte sizes of the shards near equal.

    Equal texts are one indivisible group.  Groups enter the tightest bin that still takes them, largest first: once
    inside each partition, which makes parcels of at most 1 / (shards * PARCELS_PER_SHARD) of all bytes out of
    small groups, and once over the parcels.  Their number depends on shards and partitions, not on rows, so the second
    packing is small.  A group larger than an average shard fills one alone, and the others share the rest evenly.
    Slots count from 0 without gaps inside each shard.

    Null text has no bytes and counts as empty; every row adds one byte.  Null and repeated ids are rows like any
    other.  An empty table gives an empty result.
    """
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body(text)).cast("long") + 1).alias("size"), F.crc32(body(text)).alias("text_crc32"),
        F.xxhash64(body(text)).alias("k1"), F.xxhash64(F.lit("group"), body(text)).alias("k2"),
    )
    rows = settle(narrow, "sizes")
    groups = settle(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    parcel = max(1, total // (shards * PARCELS_PER_SHARD))
    packed = settle(groups.mapInArrow(into_parcels(parcel), "k1 long, k2 long, n long, bytes long, parcel string"), "parcels")
    sizes = packed.groupBy("parcel").agg(F.sum("bytes").alias("bytes")).orderBy("parcel").collect()
    spark = docs.sparkSession
    where = level(np.array([r["bytes"] for r in sizes], np.int64), shards)
    table = spark.createDataFrame([(r["parcel"], int(s)) for r, s in zip(sizes, where, strict=True)], "parcel string, shard int")
    placed = packed.join(F.broadcast(table), "parcel").select("k1", "k2", "n", "shard")
    placed = settle(lookup(rows, placed, ["k1", "k2"], "n", "inner"), "placed")
    return dense_ranks(placed, ["shard"], ["doc_id", "k1", "k2"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def into_parcels(capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        bins = best_fit_decreasing(rows.column("bytes").to_numpy(), capacity)
        part = TaskContext.get().partitionId()
        names = pa.array([f"{part}-{b}" for b in bins.tolist()], pa.string())
        out = rows.select(["k1", "k2", "n", "bytes"]).append_column("parcel", names)
        yield from out.to_batches()

    return run
