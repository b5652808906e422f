"""Captured payloads and live stream lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shroudline.schemas import TRAFFIC

LINES = "stream_id string, seq bigint, line string"
CHUNKS = "stream_id string, seq bigint, chunk binary"


def read_traffic(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = TRAFFIC) -> DataFrame:
    """Payload table with its fixed schema; nothing is inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_sse_stream(spark: SparkSession, path: str, schema: str = LINES, fmt: str = "parquet", files_per_trigger: int = 1000,
                    **options: str) -> DataFrame:
    """Lines or chunks as they arrive in a folder; ``files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**options).load(path)


def read_attachments(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
