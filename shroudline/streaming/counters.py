"""All live counters as one table of sums: every event says what it adds, and additions merge in any order.

Each batch writes what it adds to a partition of its own, so a repeated batch replaces itself.  Every so many batches they are added up
into one table, and what it replaces goes, so files stay bounded however long the job runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shroudline.operators import metrics as M
from shroudline.operators.policy import FALLBACK_SOURCES
from shroudline.streaming.jobs import run_batches

KEYS = ("family", "k1", "k2", "k3")
COUNTS = "family string, k1 string, k2 string, k3 string, n double"

# What a row of the event stream may carry, one kind or several; the rest is NULL.
FIELDS = (
    ("audit", "struct<direction:string,decision:string,policy_source:string,matched_labels:array<string>,error_stage:string,error_kind:string>"),
    ("auth_failure", "string"), ("resolution", "string"), ("model", "string"), ("used_by", "string"), ("prompt_tokens", "bigint"), ("completion_tokens", "bigint"),
    ("timing", "struct<direction:string,kind:string,seconds:double>"),
)


def additions(buckets: tuple[float, ...] = M.BUCKETS) -> Column:
    """``array<struct<family,k1,k2,k3,n>>``: what an event adds to which counter; buckets are cumulative."""
    none = F.lit(None).cast("string")

    def add(family: str, *keys: Column, n: Column | None = None) -> Column:
        levels = [*keys, *[none] * (3 - len(keys))]
        return F.struct(F.lit(family).alias("family"), *[k.alias(f"k{i}") for i, k in enumerate(levels, 1)], (F.lit(1.0) if n is None else n.cast("double")).alias("n"))

    audit, timing = F.col("audit"), F.col("timing")
    way, source = audit["direction"], audit["policy_source"]
    seen, timed = audit.isNotNull(), timing["seconds"].isNotNull()
    used = F.coalesce("used_by", F.lit("unknown"))
    asked = seen & (audit["decision"] == "review") & (way == "request")
    single = F.array(
        F.when(seen, add("requests_total", way, audit["decision"])),
        F.when(seen, add("policy_decisions_total", way, audit["decision"], source)),
        F.when(seen & source.isin(*FALLBACK_SOURCES), add("processing_fallback_total", source)),
        F.when(seen & audit["error_stage"].isNotNull(), add("proxy_errors_total", audit["error_stage"], audit["error_kind"])),
        F.when(asked, add("review_events_total", F.lit("created"))),
        F.when(seen & source.isin("review_override_approved", "review_override_rejected"), add("review_events_total", F.substring(source, len("review_") + 1, 100))),
        F.when(F.col("resolution").isNotNull(), add("review_events_total", F.col("resolution"))),
        F.when(F.col("auth_failure").isNotNull(), add("auth_failures_total", F.col("auth_failure"))),
        F.when(F.col("model").isNotNull(), add("llm_requests_total", F.col("model"))),
        F.when(F.col("prompt_tokens").isNotNull(), add("llm_tokens_total", used, F.lit("prompt"), n=F.col("prompt_tokens"))),
        F.when(F.col("completion_tokens").isNotNull(), add("llm_tokens_total", used, F.lit("completion"), n=F.col("completion_tokens"))),
        F.when(timed, add("seconds_count", timing["direction"], timing["kind"])),
        F.when(timed, add("seconds_sum", timing["direction"], timing["kind"], n=timing["seconds"])),
        *[F.when(timed & (timing["seconds"] <= le), add("seconds_bucket", timing["direction"], timing["kind"], F.lit(str(le)))) for le in buckets],
    )
    labels = F.transform(F.coalesce(audit["matched_labels"], F.array().cast("array<string>")), lambda label: add("detections_total", way, label))
    return F.concat(F.array_compact(single), labels)


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def counted(events: DataFrame, buckets: tuple[float, ...] = M.BUCKETS) -> DataFrame:
    """(family, k1, k2, k3, n) of a table of events."""
    return summed(events.select(F.explode(additions(buckets)).alias("c")).select("c.*"))


def run_all_counters(events: DataFrame, folder: str, every: int = 20, buckets: tuple[float, ...] = M.BUCKETS, trigger: dict | None = None) -> StreamingQuery:
    """Keep all counters of a stream of events (see FIELDS); every ``every`` batches they are added up into one table.

    A table of sums up to a batch is complete once its mark of success is there, and only then is what it replaces removed; the table before
    it stays one round longer for those who are reading it.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counted(batch, buckets).write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")
        if (batch_id + 1) % every == 0:
            _add_up(spark, folder, batch_id, every)

    return run_batches(events, folder, handle, "append", trigger)


def _folders(spark: SparkSession, path: str, name: str, whole: bool = False) -> list[int]:
    """Numbers of the ``name=<number>`` folders below ``path``; with ``whole`` only those a write has finished."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [status.getPath() for status in fs.listStatus(where) if status.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if not whole or fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _add_up(spark: SparkSession, folder: str, upto: int, every: int) -> None:
    summed(_rows(spark, folder, upto, upto - every)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/sums/upto={upto}")
    for old in _folders(spark, f"{folder}/sums", "upto"):
        if old < upto - every:
            _remove(spark, f"{folder}/sums/upto={old}")
    for old in _folders(spark, f"{folder}/data", "batch_id"):
        if old <= upto - every:
            _remove(spark, f"{folder}/data/batch_id={old}")


def _rows(spark: SparkSession, folder: str, upto: int, base: int | None = None) -> DataFrame:
    """The newest sums not after ``base`` and the batches between them and ``upto``."""
    sums = [n for n in _folders(spark, f"{folder}/sums", "upto", whole=True) if base is None or n <= base]
    start = sums[-1] if sums else -1
    paths = [f"{folder}/sums/upto={start}"] if sums else []
    paths += [f"{folder}/data/batch_id={n}" for n in _folders(spark, f"{folder}/data", "batch_id", whole=True) if start < n <= upto]
    return spark.read.schema(COUNTS).parquet(*paths) if paths else spark.createDataFrame([], COUNTS)


def all_counters(spark: SparkSession, folder: str) -> DataFrame:
    """The counters as of the last finished batch."""
    batches = _folders(spark, f"{folder}/data", "batch_id", whole=True)
    return summed(_rows(spark, folder, batches[-1] if batches else -1))
