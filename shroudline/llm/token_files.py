"""Token files of patched frame-of-reference blocks.

A file set is a Parquet table of segments in ascending document order.  A segment holds whole documents: their ids and
token counts, and ``blocks``, the token ids in blocks of BLOCK: minimum, width, start and patches of each block, then the packed bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shroudline.llm.tokens import encoder
from shroudline.llm.work import body

BLOCK = 512
# Share of a block's values that the packed width must hold; the others are patches.
FITTING = 0.9
# Ids after which a segment ends with the document at hand; a longer document is a segment of its own.
SEGMENT = 1 << 19
MAGIC = b"PFR1"


def pack(ids: np.ndarray) -> bytes:
    """Blocks of ``ids``; the last block is filled up with its last value."""
    n = len(ids)
    count = -(-n // BLOCK)
    full = np.full(count * BLOCK, ids[-1] if n else 0, np.uint32)
    full[:n] = ids
    full = full.reshape(count, BLOCK)
    low = full.min(axis=1) if count else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    fits = np.partition(rest, int(FITTING * (BLOCK - 1)), axis=1)[:, int(FITTING * (BLOCK - 1))] if count else low
    width = np.frexp(fits.astype(np.float64))[1].astype(np.uint8)  # bits of the percentile value
    outside = (rest >> width[:, None].astype(np.uint32)) > 0
    block, place = np.nonzero(outside)
    patches = rest[block, place].astype("<u4")
    rest[outside] = 0
    starts = np.zeros(count + 1, np.int64)
    np.cumsum(width.astype(np.int64) * (BLOCK // 8), out=starts[1:])
    data = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        bits = ((rest[mine, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        packed = np.packbits(bits.reshape(len(mine), -1), axis=1, bitorder="little")
        data[starts[mine][:, None] + np.arange(packed.shape[1])] = packed
    head = struct.pack("<4sIII", MAGIC, n, count, len(patches))
    many = np.bincount(block, minlength=count).astype("<u2") if count else np.zeros(0, "<u2")
    return b"".join((head, low.astype("<u4").tobytes(), width.tobytes(), many.tobytes(), starts[:-1].astype("<u4").tobytes(), place.astype("<u2").tobytes(), patches.tobytes(), data.tobytes()))


def opened(blob: bytes):
    magic, n, count, patched = struct.unpack_from("<4sIII", blob)
    if magic != MAGIC:
        raise ValueError("no token blocks")
    at, out = 16, []
    for kind, size in (("<u4", count), ("u1", count), ("<u2", count), ("<u4", count), ("<u2", patched), ("<u4", patched)):
        out.append(np.frombuffer(blob, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return n, *out, np.frombuffer(blob, np.uint8, offset=at)


def unpack(blob: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (end exclusive), all by default; only those blocks are read."""
    n, low, width, many, starts, place, patches, data = opened(blob)
    last = len(low) if last is None else min(last, len(low))
    out = np.repeat(low[first:last].astype(np.uint32)[:, None], BLOCK, axis=1)
    for w in np.unique(width[first:last]):
        mine = first + np.flatnonzero(width[first:last] == w)
        if w:
            packed = data[starts[mine].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(mine), BLOCK, int(w))
            out[mine - first] += (bits.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    begin = np.r_[0, np.cumsum(many, dtype=np.int64)]
    owner = np.repeat(np.arange(first, last), many[first:last])
    span = slice(int(begin[first]), int(begin[last]))
    out[owner - first, place[span]] = low[owner] + patches[span]
    return out.reshape(-1)[: max(0, min(n, last * BLOCK) - first * BLOCK)]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text, add ``end_id``, and write segments in ascending document order.

    Rows are range-partitioned by id, so each task writes one stretch of the order.  Null text counts as empty; a
    null id comes first; rows of the same id follow each other, ordered by text.  An empty table writes no segment.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body")).withColumn("mix", F.xxhash64("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.repartitionByRange("doc_id", "mix").sortWithinPartitions("doc_id", "mix", "body").select("doc_id", "body")
    shape = f"part int, segment_start long, n_ids long, doc_ids array<{kind}>, lengths array<long>, blocks binary"
    dealt.mapInArrow(segments(vocabulary, end_id), shape).write.option("compression", "none").parquet(path)


def segments(vocabulary: str, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        each, part = encoder(vocabulary, "word").each, TaskContext.get().partitionId()
        start, held, names, lengths = 0, [], [], []

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(names[0].type), pa.list_(pa.int64()), pa.binary())
            values = (part, start, len(ids), [x.as_py() for x in names], lengths, pack(ids))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["part", "segment_start", "n_ids", "doc_ids", "lengths", "blocks"])

        size = 0
        for batch in batches:
            for name, ids in zip(batch.column("doc_id"), each(batch.column("body"), end), strict=True):
                held.append(ids)
                names.append(name)
                lengths.append(len(ids))
                size += lengths[-1]
                if size >= SEGMENT:
                    yield closed()
                    start, size, held, names, lengths = start + size, 0, [], [], []
        if held:
            yield closed()

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (and ``ids`` if asked for).

    ``start`` adds up what the parts before hold; there is one row per written part, so that table is small.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    shape = f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = files.mapInArrow(unfolded(with_ids), shape)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")


def unfolded(with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(batch.column("blocks")[i].as_py()).astype("<u4")
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                base = batch.column("segment_start")[i].as_py()
                out = {
                    "doc_id": batch.column("doc_ids")[i].values, "part": pa.array(np.full(len(ends), batch.column("part")[i].as_py(), np.int32)),
                    "start": pa.array(starts + base), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(sums, pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int32()))
                yield from pa.table(out).to_batches(max_chunksize=10_000)

    return run
