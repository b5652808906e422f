"""Prefix trie of conversations: vertical bitmaps per shard of conversations, walked depth first and added up by node.

A node is a distinct sequence of first turns.  Its name is the exclusive or of 128-bit hashes of its (position, turn) pairs, so the
same prefix has the same name in every shard, and equal names of different prefixes are as unlikely as equal 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroudline.llm.work import body, lookup, settle

# A shard is closed at so many conversations or turns, whichever comes first; a conversation is never cut.
SHARD_CONVERSATIONS, SHARD_TURNS = 4096, 1 << 16

TURNS = "conv_id long, position long, turn_key binary, size long"
NODE = ["k1", "k2"]
WORD = np.uint64


def keyed_turns(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per row of ``convs``: conv_id, position (from 0, by turn, null first), turn_key (128 bits of role and text), size (bytes of the text).

    Texts go no further than this: what moves is the key.  Null role or text counts as empty.  Rows of one conversation with the same
    turn are ordered by role and then by key.  Rows without conversation id belong to no conversation and are left out.
    """
    rows = convs.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), body(role).alias("role"),
        F.unhex(F.md5(F.concat(F.octet_length(body(role)).cast("string"), F.lit(":"), body(role), body(text)))).alias("turn_key"),
        F.octet_length(body(text)).cast("long").alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "turn_key")
    return rows.withColumn("position", F.row_number().over(order).cast("long") - 1).select("conv_id", "position", "turn_key", "size")


def prefix_trie(convs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the trie of ``convs``, as :func:`trie_of` gives them."""
    return trie_of(keyed_turns(convs, conv_id, turn, role, text))


def trie_of(turns: DataFrame, shard_conversations: int = SHARD_CONVERSATIONS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` holds keyed turns in the order of ``position``, gaps allowed; a row with null ``turn_key`` makes its conversation a member
    of the root and adds no turn.  A subtree includes its top; saved_tokens adds up (members - 1) times the bytes of the last
    text; ends_sha256 hashes the decimal ids, ascending and comma-joined, of the conversations that end at the node.

    Range partitions of conversations are cut into shards.  In a shard, each (position, turn) has a bitset of conversations, and a
    node's bitset is its parent's met with a posting.  Members and end lists are added up over shards.  The smallest member of a
    node stands for it, so a second walk adds up, as popcounts, what members that do not stand for a node save.  End lists that
    lie in several shards are hashed shard by shard in order, so no list is ever in memory whole.  A conversation is held by one
    task, with 24 bytes a turn.  No turns at all, no nodes: an empty table gives an empty result.
    """
    shards = settle(
        turns.select(*(f.split()[0] for f in TURNS.split(", "))).repartitionByRange("conv_id").sortWithinPartitions("conv_id", "position")
        .mapInArrow(sharded(shard_conversations, shard_turns), "shard long, ids array<long>, lengths array<int>, turn_keys binary, sizes array<long>"), "shards",
    )
    local = settle(shards.mapInArrow(
        members, "k1 long, k2 long, p1 long, p2 long, depth long, shard long, conv_id long, n_convs long, ends array<long>, ends_sha256 string",
    ), "shard-nodes")
    nodes = settle(local.groupBy(*NODE).agg(
        *(F.first(c).alias(c) for c in ("p1", "p2", "depth")), F.min(F.struct("conv_id", "shard")).alias("least"), F.sum("n_convs").alias("n_convs"),
        F.coalesce(F.sum(F.array_size("ends")), F.lit(0)).alias("n_ends"), F.count("ends_sha256").alias("lists"), F.min("ends_sha256").alias("ends_sha256"),
    ).select("*", "least.conv_id", "least.shard").drop("least"), "nodes")

    stands = nodes.groupBy("shard", "conv_id").agg(F.min("depth").alias("from"), F.max(F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    stands = stands.groupBy("shard").agg(F.collect_list(F.struct("conv_id", "from", "leaf")).alias("stands"))  # SHARD_CONVERSATIONS at most
    sums = shards.join(stands, "shard", "left").mapInArrow(subtrees, "k1 long, k2 long, n_leaves long, saved_tokens long")
    sums = sums.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    spread = local.filter(F.size("ends") > 0).join(nodes.filter("lists > 1").select(*NODE), NODE, "left_semi")
    spread = spread.select(*NODE, "ends").repartition(*NODE).sortWithinPartitions(*NODE, F.col("ends")[0]).mapInArrow(hashed, "k1 long, k2 long, whole string")
    full = nodes.join(children, NODE, "left").join(sums, NODE).join(spread, NODE, "left")
    full = settle(full.select(
        *NODE, "p1", "p2", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("whole", "ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    ), "trie")
    parents = full.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("brood"))
    below = lookup(full.filter("depth > 0"), parents, ["p1", "p2"], "brood", "inner")
    out = below.unionByName(full.filter("depth = 0"), allowMissingColumns=True)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def sharded(most_conversations: int, most_turns: int):
    """Rows sorted by conversation, cut into shards of whole conversations."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        lengths: list[int] = []
        keys: list[bytes] = []
        sizes: list[int] = []

        def closed() -> pa.RecordBatch:
            values = (number, ids, lengths, b"".join(keys), sizes)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["shard", "ids", "lengths", "turn_keys", "sizes"])

        for batch in batches:
            for conv, key, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_key", "size")), strict=True):
                if not ids or conv != ids[-1]:
                    if len(ids) >= most_conversations or len(keys) >= most_turns:
                        yield closed()
                        number += 1
                        ids, lengths, keys, sizes = [], [], [], []
                    ids.append(conv)
                    lengths.append(0)
                if key is not None:
                    lengths[-1] += 1
                    keys.append(key)
                    sizes.append(size)
        if ids:
            yield closed()

    return run


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> WORD(32))) * WORD(0xD6E8FEB86659FD93)
    h = (h ^ (h >> WORD(29))) * WORD(0xA0761D6478BD642F)
    return h ^ (h >> WORD(32))


class Shard:
    """Conversations of a shard, their prefix names, and bitsets (whole numbers) of conversations by (position, turn)."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, keys: bytes, sizes: np.ndarray) -> None:
        self.ids, self.lengths, self.sizes = ids, lengths.astype(np.int64), sizes
        self.first = np.cumsum(self.lengths) - self.lengths
        self.owner = np.repeat(np.arange(len(ids)), self.lengths)
        self.depth = np.arange(len(sizes)) - self.first[self.owner] + 1
        halves = np.frombuffer(keys, "<u8").reshape(-1, 2)
        at = self.depth.astype(WORD)
        self.names = np.stack([self.prefixes(mixed(halves[:, 0] + at * WORD(0x9E3779B97F4A7C15))), self.prefixes(mixed(halves[:, 1] ^ mixed(at)))])
        turn = np.stack([self.depth.astype(WORD), halves[:, 0], halves[:, 1]], axis=1)
        self.posting = np.unique(turn, axis=0, return_inverse=True)[1].reshape(-1) if len(turn) else np.zeros(0, np.int64)
        many = np.bincount(self.posting) if len(turn) else np.zeros(0, np.int64)
        self.postings: dict[int, int] = {}
        shared = np.flatnonzero(many[self.posting] > 1)
        for code, conv in zip(self.posting[shared].tolist(), self.owner[shared].tolist(), strict=True):
            self.postings[code] = self.postings.get(code, 0) | 1 << conv
        self.ending: dict[int, int] = {}
        for conv, length in enumerate(self.lengths.tolist()):
            self.ending[length] = self.ending.get(length, 0) | 1 << conv

    def prefixes(self, hashes: np.ndarray) -> np.ndarray:
        """Exclusive or of a conversation's hashes up to each turn."""
        runs = np.bitwise_xor.accumulate(hashes) if len(hashes) else hashes
        before = np.r_[np.zeros(1, WORD), runs][self.first]
        return runs ^ before[self.owner]

    def walk(self) -> Iterator[tuple[int, int, int, int]]:
        """(bitset, depth, smallest conversation, number of the parent among these) of each node with two members or more, parents
        first; a node with one member comes alone for all that is below it."""
        first, posting, postings = self.first.tolist(), self.posting.tolist(), self.postings
        stack, number = [((1 << len(self.ids)) - 1, 0, -1)], 0
        while stack:
            bits, depth, parent = stack.pop()
            low = (bits & -bits).bit_length() - 1
            yield bits, depth, low, parent
            if bits & (bits - 1):
                rest = bits & ~self.ending.get(depth, 0)
                while rest:
                    one = rest & -rest
                    child = rest & postings.get(posting[first[one.bit_length() - 1] + depth], one)
                    stack.append((child, depth + 1, number))
                    rest ^= child
            number += 1

    def name(self, convs: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """Names of the prefixes of ``depths`` turns; the root's is zero."""
        out = np.zeros((2, len(convs)), WORD)
        below = np.flatnonzero(depths > 0)
        out[:, below] = self.names[:, self.first[convs[below]] + depths[below] - 1]
        return out.view(np.int64)

    def tails(self, convs: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All prefixes of single members from a depth to the end: (conversation, depth)."""
        many = self.lengths[convs] - depths + 1
        owner = np.repeat(convs, many)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(depths, many)

    def bits_of(self, bits: int) -> np.ndarray:
        raw = np.frombuffer(bits.to_bytes(len(self.ids) // 8 + 1, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Shard]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            arrays = (row[c].values.to_numpy(zero_copy_only=False) for c in ("ids", "lengths", "sizes"))
            ids, lengths, sizes = arrays
            yield row, Shard(ids, lengths, row["turn_keys"].as_py(), sizes)


def id_hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard with their members and ends there."""
    for row, shard in opened(batches):
        convs, depths, counts, ends, alone, start = [], [], [], [], [], []
        for bits, depth, low, _ in shard.walk():
            if bits & (bits - 1):
                ended = bits & shard.ending.get(depth, 0)
                convs.append(low)
                depths.append(depth)
                counts.append(bits.bit_count())
                ends.append(shard.ids[shard.bits_of(ended)].tolist() if ended else None)
            else:
                alone.append(low)
                start.append(depth)
        tail, below = shard.tails(np.array(alone, np.int64), np.array(start, np.int64))
        last = below == shard.lengths[tail]
        conv, depth = np.r_[np.array(convs, np.int64), tail], np.r_[np.array(depths, np.int64), below]
        n = np.r_[np.array(counts, np.int64), np.ones(len(tail), np.int64)]
        ends += [[i] if e else None for i, e in zip(shard.ids[tail].tolist(), last.tolist(), strict=True)]
        k1, k2 = shard.name(conv, depth)
        p1, p2 = shard.name(conv, np.maximum(depth - 1, 0))
        out = pa.table({
            "k1": k1, "k2": k2, "p1": p1, "p2": p2, "depth": depth, "shard": np.full(len(conv), row["shard"].as_py()), "conv_id": shard.ids[conv], "n_convs": n,
            "ends": pa.array(ends, pa.list_(pa.int64())), "ends_sha256": pa.array([id_hash(e) if e else None for e in ends], pa.string()),
        })
        yield from out.to_batches(max_chunksize=5000)


def subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each shard with the leaves and savings of its own members below them.

    A member saves a turn's bytes at each node that another conversation stands for.
    """
    for row, shard in opened(batches):
        known = row["stands"].as_py() or []
        place = {c: i for i, c in enumerate(shard.ids.tolist())}
        leaf = np.zeros(len(shard.ids), bool)
        begin = shard.lengths + 1
        for s in known:
            begin[place[s["conv_id"]]] = s["from"]
            leaf[place[s["conv_id"]]] = s["leaf"]
        saving = np.where(shard.depth < begin[shard.owner], shard.sizes, 0)
        leaves = sum(1 << int(c) for c in np.flatnonzero(leaf))
        later: dict[int, int] = {}  # by depth: conversations that do not stand for their node there
        for conv, depth in zip(shard.owner[shard.depth < begin[shard.owner]].tolist(), shard.depth[shard.depth < begin[shard.owner]].tolist(), strict=True):
            later[depth] = later.get(depth, 0) | 1 << conv
        total = np.r_[np.cumsum(saving[::-1])[::-1], 0]
        after = np.r_[total[:-1] - total[(shard.first + shard.lengths)[shard.owner]], 0]  # from a turn to its conversation's end
        convs, depths, parents, n_leaves, saved, single = [], [], [], [], [], []
        sizes, first, lengths = shard.sizes.tolist(), shard.first.tolist(), shard.lengths.tolist()
        for bits, depth, low, parent in shard.walk():
            convs.append(low)
            depths.append(depth)
            parents.append(parent)
            n_leaves.append((bits & leaves).bit_count())
            one = not bits & (bits - 1)
            single.append(one)
            if one:
                at = first[low] + max(depth, 1) - 1
                saved.append(int(after[at]) if lengths[low] >= max(depth, 1) else 0)
            else:
                saved.append((bits & later.get(depth, 0)).bit_count() * sizes[first[low] + depth - 1] if depth else 0)
        for i in range(len(saved) - 1, 0, -1):
            saved[parents[i]] += saved[i]
        one, conv, depth = np.array(single, bool), np.array(convs, np.int64), np.array(depths, np.int64)
        tail, below = shard.tails(conv[one], depth[one])
        under = np.where(shard.lengths[tail] > 0, after[np.minimum(shard.first[tail] + np.maximum(below, 1) - 1, len(sizes))], 0)
        k1, k2 = shard.name(np.r_[conv[~one], tail], np.r_[depth[~one], below])
        out = pa.table({
            "k1": k1, "k2": k2, "n_leaves": np.r_[np.array(n_leaves, np.int64)[~one], leaf[tail].astype(np.int64)],
            "saved_tokens": np.r_[np.array(saved, np.int64)[~one], under.astype(np.int64)],
        })
        yield from out.to_batches(max_chunksize=20_000)


def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per node over its end lists, which come in order; only one list is held at a time."""
    name, running = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name[0]]), pa.array([name[1]]), pa.array([running.hexdigest()])], ["k1", "k2", "whole"])

    for batch in batches:
        lists = batch.column("ends")
        for i, mine in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True)):
            text = ",".join(map(str, lists[i].as_py())).encode()
            if mine != name:
                if name:
                    yield closed()
                name, running = mine, hashlib.sha256(text)
            else:
                running.update(b"," + text)
    if name:
        yield closed()
