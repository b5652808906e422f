"""Sequences of fixed capacity from documents of any length."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudline.llm.tokens import encoder
from shroudline.llm.work import body, dense_ranks, settle

# Patterns offered to the fit; the step between the smallest members of three grows until so many remain.
PATTERNS = 12_000
SWEEPS = 30
# Ids whose pieces a worker holds at a time, or one document's.
PIECE_IDS = 1 << 20


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ``ids`` if asked for).

    A document is its token ids and ``end_id``; one longer than ``capacity`` is cut, the first piece taking the
    remainder.  Only the histogram of lengths, at most ``capacity`` numbers, goes to the driver: length patterns of up to
    three pieces that fill a sequence exactly are fitted to it by non-negative least squares, counts are rounded down
    to what is there, and the rest is packed best fit, largest first, length by length.  Pieces then take the places
    of their length by rank.

    Null text counts as empty and is one piece of ``end_id`` alone.  Repeated rows are packed as often as they come; an empty
    table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = settle(rows.mapInArrow(cut_pieces(vocabulary, capacity, end_id, with_ids), shape), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    places = layout(plan(counts, capacity), capacity)
    ranked = dense_ranks(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", bucket_rows=50_000)
    return ranked.select(*pieces.columns, "rank").mapInArrow(put(places), f"{shape}, sequence_id long, offset long")


def cut_pieces(vocabulary: str, capacity: int, end_id: int, with_ids: bool):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = encoder(vocabulary, "byte").each
        for batch in batches:
            for some in some_rows(batch, each(batch.column("body"), end)):
                yield from pieces_of(*some)

    def some_rows(batch: pa.RecordBatch, found: Iterator[np.ndarray]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        """Documents go on when PIECE_IDS ids have gathered."""
        lo, ids, size = 0, [], 0
        for i, mine in enumerate(found):
            ids.append(mine)
            size += len(mine)
            if size >= PIECE_IDS or i + 1 == batch.num_rows:
                yield batch.column("doc_id").slice(lo, len(ids)), ids
                lo, ids, size = i + 1, [], 0

    def pieces_of(names: pa.Array, documents: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, columns = [], ([], [], [], [], [])
        for i, ids in enumerate(documents):
            n = len(ids)
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                at.append(i)
                part = ids[a:b]
                for column, value in zip(columns, (piece, a, b - a, zlib.crc32(part), part), strict=True):
                    column.append(value)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        out = [names.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))]
        heads = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            out.append(pa.array([x.astype(np.int32) for x in columns[4]], pa.list_(pa.int32())))
            heads.append("ids")
        yield from pa.table(dict(zip(heads, out, strict=True))).to_batches(max_chunksize=2000)

    return run


def patterns_of(counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Exact fills of one, two or three lengths that occur, longest first."""
    there = np.flatnonzero(counts)
    found = [(capacity,)] if counts[capacity] else []
    found += [(int(a), int(capacity - a)) for a in there[::-1] if capacity > a >= capacity - a and counts[capacity - a]]
    step = 1
    while step <= capacity:
        threes = []
        for c in there[(there % step == 0) & (there <= capacity // 3)]:
            b = there[(there >= c) & (there <= (capacity - c) // 2)]
            b = b[counts[capacity - c - b] > 0]
            threes += [(int(capacity - c - x), int(x), int(c)) for x in b]
            if len(threes) > PATTERNS:
                break
        if len(threes) <= PATTERNS:
            break
        step *= 2
    return found + sorted(threes, reverse=True)


def fit(patterns: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts nearest to the histogram in the least-squares sense, by coordinate descent."""
    members = [np.unique(p, return_counts=True) for p in patterns]
    members = [([int(a) for a in lengths], [int(t) for t in times]) for lengths, times in members]
    rest, x = counts.astype(float).tolist(), [0.0] * len(patterns)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, (lengths, times) in enumerate(members):
            slope = sum(rest[a] * t for a, t in zip(lengths, times, strict=True))
            new = max(0.0, x[j] + slope / sum(t * t for t in times))
            change = new - x[j]
            if change:
                x[j] = new
                moved = max(moved, abs(change))
                for a, t in zip(lengths, times, strict=True):
                    rest[a] -= change * t
        if moved < 0.25:
            break
    return np.array(x)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many such sequences); uses every piece of the histogram exactly once."""
    left = counts.copy()
    patterns = patterns_of(counts, capacity)
    x = fit(patterns, counts)
    out = []
    for j in np.argsort(-x, kind="stable"):
        lengths, times = np.unique(patterns[j], return_counts=True)
        n = int(min(np.floor(x[j] + 0.5), (left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            out.append((patterns[j], n))
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on the histogram: alike bins are handled together, whatever their number."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                each = min(capacity // length, n)
                opened, pattern = n // each, (length,) * each
                n -= opened * each
                rooms.setdefault(capacity - length * each, []).append((pattern, opened))
                continue
            pattern, count = rooms[room].pop()
            used = min(n, count)
            if count > used:
                rooms[room].append((pattern, count - used))
            if not rooms[room]:
                del rooms[room]
            rooms.setdefault(room - length, []).append(((*pattern, length), used))
            n -= used
    return [x for found in rooms.values() for x in found]


def layout(sequences: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each run of places, what to add to a rank for its sequence, and the offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    rank = np.zeros(capacity + 1, np.int64)
    number = 0
    for pattern, n in sequences:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((int(rank[length]), number - int(rank[length]), offset))
            rank[length] += n
            offset += length
        number += n
    return {length: tuple(np.array(c, np.int64) for c in zip(*found, strict=True)) for length, found in runs.items()}


def put(places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                mine = np.flatnonzero(length == value)
                first, add, place = places[int(value)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                sequence[mine], offset[mine] = rank[mine] + add[k], place[k]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run
