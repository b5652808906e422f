"""Exact duplicates by sorting the texts themselves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudline.llm.work import body, fresh, settle

RUNS = "doc_id {id}, text_sha256 string, keep_id {id}, group_size long, first boolean, edge boolean"


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix: int = 32) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256; of equal texts the largest id stays.

    Rows are range-partitioned by sampled splitters over (first ``prefix`` characters, hash, id), so neither a
    long text nor a hot group makes a splitter or a partition large.  Spark's external sort puts equal texts side by
    side, and each text is compared in full with its neighbour.  Groups that may reach over a partition's end
    are put together afterwards: at most a few per partition, which bounds the broadcast.

    Null text counts as empty, a null id sorts below all others.  Of identical rows one stays.  An empty
    table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), body(text).alias("body"))
    keyed = rows.select("doc_id", F.substring("body", 1, prefix).alias("head"), F.xxhash64("body").alias("mix"), "body")
    down = F.col("doc_id").desc_nulls_last()
    dealt = keyed.repartitionByRange("head", "mix", down).sortWithinPartitions("head", "mix", "body", down)
    kind = rows.schema["doc_id"].dataType.simpleString()
    runs = dealt.select("doc_id", "mix", F.sha2("body", 256).alias("sha"), "body").mapInArrow(mark_runs, RUNS.format(id=kind))
    runs = settle(runs, "copies")
    edges = runs.filter("edge").groupBy("text_sha256").agg(F.max("keep_id").alias("all_keep"), F.count("*").alias("all_size"))
    whole = runs.join(F.broadcast(edges), "text_sha256", "left")
    keep = F.when(F.col("all_size").isNull(), F.col("keep_id")).otherwise(F.col("all_keep"))
    return whole.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("first") & F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row per distinct text: of equal texts the row with the largest id, a null id being the least.

    Rows are numbered in order of their ids, and each stays or goes by its own text, also without id or with an id that others have.
    """
    (number,) = fresh(docs, "number")
    order = (F.col(doc_id).asc_nulls_first(), F.xxhash64(body(text)))
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(ordered.withColumn(number, F.monotonically_increasing_id()), "ordered")
    gone = find_copies(rows, number, text).filter(~F.col("kept")).select(F.col("doc_id").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def mark_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition; those that share a hash with either end are edges."""
    held: list[pa.Table] = []  # rows of the current hash value, whose group may not be complete
    held_mix, before, run, first_mix = None, None, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text, mix = batch.column("body"), batch.column("mix").to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[0] = before is None or before != text[0]
        if n > 1:
            new[1:] = ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        before = text[n - 1]
        runs = run + np.cumsum(new)
        run = int(runs[-1])
        rows = pa.table({"doc_id": batch.column("doc_id"), "sha": batch.column("sha"), "run": pa.array(runs)})
        first_mix = int(mix[0]) if first_mix is None else first_mix
        turn = np.flatnonzero(mix[1:] != mix[:-1])
        last = int(turn[-1]) + 1 if len(turn) else 0
        if last or (held and held_mix != int(mix[0])):
            done = mix[:last]
            ends = np.flatnonzero(done[1:] != done[:-1])
            cut = int(ends[0]) + 1 if len(ends) else last  # the first hash value here may continue the held one
            if held and last and held_mix == int(mix[0]):
                held.append(rows.slice(0, cut))
                yield from finished(held, held_mix == first_mix)
                yield from finished([rows.slice(cut, last - cut)], False)
            else:
                yield from finished(held, held_mix == first_mix)
                edge = last > 0 and int(mix[0]) == first_mix
                yield from finished([rows.slice(0, cut)], edge)
                yield from finished([rows.slice(cut, last - cut)], False)
            held = []
        held.append(rows.slice(last))
        held_mix = int(mix[-1])
    yield from finished(held, True)


def finished(parts: list[pa.Table], edge: bool) -> Iterator[pa.RecordBatch]:
    rows = pa.concat_tables(parts).combine_chunks() if parts else None
    if rows is None or not rows.num_rows:
        return
    run = rows.column("run").to_numpy()
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[start, len(run)])
    first = np.zeros(len(run), bool)
    first[start] = True
    ids = rows.column("doc_id")
    out = pa.table({
        "doc_id": ids, "text_sha256": rows.column("sha"), "keep_id": ids.take(pa.array(np.repeat(start, size))),
        "group_size": pa.array(np.repeat(size, size).astype(np.int64)), "first": pa.array(first), "edge": pa.array(np.full(len(run), edge)),
    })
    yield from out.to_batches()
