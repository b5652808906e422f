"""Streaming forms of the batch operators.

Every job writes through the file sink or an idempotent ``foreachBatch`` to a shared folder, and
keeps its progress in a checkpoint there, so it can be stopped or lose executors at any point.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shroudline.config import Detection, PolicyRule
from shroudline.operators import payloads as Y
from shroudline.session import shared_dir


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of its own per run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_files(stream: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Append-only results as Parquet, exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    return writer.option("path", f"{folder}/data").trigger(**(trigger or {"availableNow": True})).start()


def run_batches(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None], mode: str = "append",
                trigger: dict | None = None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.foreachBatch(handle).trigger(**(trigger or {"availableNow": True})).start()


def redact_stream(lines: DataFrame, config: Detection, caller: Column, rules: tuple[PolicyRule, ...] = ()) -> DataFrame:
    """Per-event rewriting; stateless, the same plan as in batch."""
    return Y.redact_lines(lines, config, caller, rules=rules)


def run_counters(events: DataFrame, by: list[str], folder: str, ts: str = "ts", width: str = "1 hour", sums: tuple[str, ...] = (),
                 trigger: dict | None = None) -> StreamingQuery:
    """Counters per tumbling window and keys, with sums of columns.

    Each batch writes what it adds to a partition of its own, so a repeated batch replaces itself, a row counts
    however late it comes, and no state grows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        added = batch.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
        added.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")

    return run_batches(events, folder, handle, "append", trigger)


def latest_counters(spark: SparkSession, folder: str, keys: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """The counters as of the last batch."""
    rows = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", *sums)))


def run_audit_sink(records: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Append audit records of a stream as JSON lines, each batch to its own partition."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/data/batch_id={batch_id}")

    return run_batches(records, folder, handle, "append", trigger)


def run_review_ingest(candidates: DataFrame, folder: str, trigger: dict | None = None, resolutions: DataFrame | None = None) -> StreamingQuery:
    """Open tickets from a stream of requests sent to review: at most one pending ticket per fingerprint.

    ``resolutions`` is the stream of (ticket_id, status, resolved_at), a ticket going by its request_id.  Each batch folds the tickets and
    resolutions of earlier batches with its own, so a fingerprint opens again after its ticket was resolved.  Without it no ticket
    is ever resolved.  A batch writes partitions of its own and ignores them when it runs again.  Time is that of the events: what
    comes late opens no ticket before the latest one of its fingerprint.
    """
    inner = candidates.select(F.struct("*").alias("asked"))
    shape = inner.schema["asked"].dataType
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    if resolutions is not None:
        closed = resolutions.select(F.struct(F.col("ticket_id").cast("string").alias("ticket_id"), "status", "resolved_at").alias("resolved"))
        inner = inner.unionByName(closed, allowMissingColumns=True)
    else:
        inner = inner.withColumn("resolved", F.lit(None).cast(RESOLUTION))

    def handle(batch: DataFrame, batch_id: int) -> None:
        from shroudline.operators import reviews as W

        spark = batch.sparkSession
        known = _earlier(spark, f"{folder}/resolutions", "ticket_id string, status string, resolved_at timestamp", batch_id)
        batch.where("resolved is not null").select("resolved.*").write.mode("overwrite").parquet(f"{folder}/resolutions/batch_id={batch_id}")
        tickets = _earlier(spark, f"{folder}/data", f"{fields}, status string", batch_id)
        closed = known.unionByName(batch.where("resolved is not null").select("resolved.*"))
        opened = W.open_history(batch.where("asked is not null").select("asked.*"), closed, tickets)
        opened.withColumn("status", F.lit("pending")).write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")

    return run_batches(inner, folder, handle, "append", trigger)


RESOLUTION = "struct<ticket_id:string,status:string,resolved_at:timestamp>"


def _earlier(spark: SparkSession, table: str, fields: str, batch_id: int) -> DataFrame:
    """What batches before this one have written."""
    spark.createDataFrame([], fields).write.mode("ignore").parquet(f"{table}/batch_id=-1")
    rows = spark.read.schema(f"{fields}, batch_id int").option("basePath", table).parquet(table)
    return rows.where(F.col("batch_id") < batch_id).drop("batch_id")
