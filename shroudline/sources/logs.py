"""Audit, review and benchmark logs as line-wise JSON.

Malformed lines are skipped, and a log that does not exist yet reads as empty.  Writers append one
file per task; order lies in the time columns and not in the files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.schemas import AUDIT, BENCH_SUMMARY, REVIEW_EVENTS


# Microseconds, so that order and expiry survive the round trip.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    rows = _read_lines(spark, path, AUDIT)
    return rows.where(F.col("request_id").isNotNull() & F.col("ts").isNotNull() & F.col("decision").isNotNull())


def append_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").option("timestampFormat", STAMP).json(path)


def stream_audit(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Records added since the last batch; the checkpoint remembers what was seen."""
    return spark.readStream.schema(AUDIT).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(path)


def read_review_events(spark: SparkSession, path: str) -> DataFrame:
    rows = _read_lines(spark, path, REVIEW_EVENTS)
    created = (F.col("type") == "created") & F.col("ticket.id").isNotNull()
    resolved = (F.col("type") == "resolved") & F.col("ticket_id").isNotNull() & F.col("resolved_at").isNotNull()
    return rows.where(created | resolved)


def append_review_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").option("timestampFormat", STAMP).json(path)


def read_bench_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row per scenario of a summary document, sample runs kept as an array."""
    doc = spark.read.schema(BENCH_SUMMARY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return doc.select(
        "generated_at", F.col("aggregation.method").alias("method"), F.col("aggregation.runs").alias("runs"), F.explode("scenarios").alias("s")
    ).select(
        "generated_at", "method", "runs", "s.scenario", "s.ok", "s.throughput_rps", F.col("s.latency_ms.avg").alias("avg_ms"),
        F.col("s.latency_ms.p50").alias("p50_ms"), F.col("s.latency_ms.p95").alias("p95_ms"), F.col("s.aggregation.sample_runs").alias("sample_runs"),
    )


def promote_baseline(spark: SparkSession, current: str, baseline: str) -> DataFrame:
    """Replace the baseline by the current summary, if that reads as one with scenarios."""
    doc = spark.read.schema(BENCH_SUMMARY).option("multiLine", True).option("mode", "FAILFAST").json(current)
    good = doc.where(F.size("scenarios") > 0)
    if good.isEmpty():
        raise ValueError(f"no benchmark scenarios in {current}")
    good.write.mode("overwrite").json(baseline)
    return spark.read.schema(BENCH_SUMMARY).json(baseline)
