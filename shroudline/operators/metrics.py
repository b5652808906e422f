"""Counters, histograms and gauges: plain aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.operators.policy import FALLBACK_SOURCES
from shroudline.operators.skew import bound
from shroudline.operators.usage import model_of

# Default histogram buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def count_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def count_requests(audit: DataFrame) -> DataFrame:
    return count_by(audit, "direction", "decision")


def count_decisions(audit: DataFrame) -> DataFrame:
    return count_by(audit.withColumnRenamed("policy_source", "source"), "direction", "decision", "source")


def count_errors(audit: DataFrame) -> DataFrame:
    failed = audit.where(F.col("error_stage").isNotNull())
    return count_by(failed.select(F.col("error_stage").alias("stage"), F.col("error_kind").alias("kind")), "stage", "kind")


def count_detections(outcomes: DataFrame) -> DataFrame:
    return count_by(outcomes.select("direction", F.explode("resolved.label").alias("label")), "direction", "label")


def count_auth_failures(failures: DataFrame) -> DataFrame:
    return count_by(failures, "reason")


def count_review_events(review_log: DataFrame, audit: DataFrame) -> DataFrame:
    """``created`` for every request sent to review, the outcome of every resolution, every override used."""
    created = F.when((F.col("decision") == "review") & (F.col("direction") == "request"), F.lit("created"))
    used = F.when(F.col("policy_source").isin("review_override_approved", "review_override_rejected"), F.substring("policy_source", len("review_") + 1, 100))
    asked = audit.select(F.explode(F.array_compact(F.array(created, used))).alias("event"))  # one pass: a record may count twice
    resolved = review_log.where(F.col("type") == "resolved").select(F.col("status").alias("event"))
    return count_by(asked.unionByName(resolved), "event")


def count_fallbacks(audit: DataFrame) -> DataFrame:
    return count_by(audit.where(F.col("policy_source").isin(*FALLBACK_SOURCES)).withColumnRenamed("policy_source", "kind"), "kind")


def count_llm_requests(traffic: DataFrame, body: str = "body") -> DataFrame:
    return count_by(traffic.select(bound(model_of(F.col(body))).alias("model")).where("model is not null"), "model")


def histogram(df: DataFrame, value: str, by: tuple[str, ...], buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Count, sum and cumulative bucket counts per group."""
    counts = [F.count_if(F.col(value) <= le).alias(f"le_{str(le).replace('.', '_')}") for le in buckets]
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("sum_seconds"), *counts)


def hist_avg_ms(hist: DataFrame) -> DataFrame:
    mean = F.when(F.col("count") > 0, F.col("sum_seconds") / F.col("count") * 1000).otherwise(F.lit(0.0))
    return hist.withColumn("avg_ms", mean)


def dependency_gauges(health: DataFrame, row_id: str) -> DataFrame:
    """Last health check per dependency: configured, ready and status code (0 when unreachable)."""
    last = health.groupBy("dependency").agg(F.max(F.struct("ts", row_id, "configured", "status_code")).alias("h"))
    reachable = F.coalesce((F.col("h.status_code") >= 200) & (F.col("h.status_code") < 500), F.lit(False))
    return last.select(
        "dependency", F.col("h.configured").cast("int").alias("configured"),
        (~F.col("h.configured") | reachable).cast("int").alias("ready"),
        F.coalesce("h.status_code", F.lit(0)).alias("status_code"),
    )


def gauges(active: DataFrame, pending: DataFrame, capacity: int) -> DataFrame:
    """The single-number gauges as (gauge, value) rows."""
    one = active.select(F.lit("active_sessions").alias("gauge"), F.col("active_sessions").alias("value"))
    two = pending.select(F.lit("review_queue_pending").alias("gauge"), F.col("pending").alias("value"))
    three = pending.select(F.lit("review_queue_capacity").alias("gauge"), F.lit(capacity).cast("bigint").alias("value"))
    return one.unionByName(two).unionByName(three)


def counter_families(audit: DataFrame) -> DataFrame:
    """All counters an audit record feeds, from one pass: (family, k1, k2, k3, n) with unused levels NULL."""
    none = F.lit(None).cast("string")

    def counter(family: str, *levels: Column) -> Column:
        keys = [*levels, *[none] * (3 - len(levels))]
        return F.struct(F.lit(family).alias("family"), *[k.alias(f"k{i}") for i, k in enumerate(keys, 1)])

    way, source = F.col("direction"), F.col("policy_source")
    single = F.array_compact(F.array(
        counter("requests_total", way, F.col("decision")), counter("policy_decisions_total", way, F.col("decision"), source),
        F.when(source.isin(*FALLBACK_SOURCES), counter("processing_fallback_total", source)),
        F.when(F.col("error_stage").isNotNull(), counter("proxy_errors_total", F.col("error_stage"), F.col("error_kind"))),
    ))
    labels = F.transform("matched_labels", lambda label: counter("detections_total", way, label))
    return audit.select(F.explode(F.concat(single, labels)).alias("c")).select("c.*").groupBy("family", "k1", "k2", "k3").agg(F.count("*").alias("n"))


def snapshot(counts: DataFrame) -> DataFrame:
    """(family, values) rows: each counter family as JSON text of its nested object, keys in order."""

    def member(level: str, value: str) -> Column:
        name = F.regexp_replace(F.col(level), r'(["\\\\])', r"\\$1")
        return F.when(F.col(level).isNotNull(), F.struct(F.col(level).alias("k"), F.concat(F.lit('"'), name, F.lit('":'), value).alias("m")))

    def inner(level: str, value: str) -> Column:
        members = F.array_sort(F.collect_list(member(level, value)))
        text = F.concat(F.lit("{"), F.array_join(F.transform(members, lambda x: x["m"]), ","), F.lit("}"))
        return F.when(F.size(members) > 0, text).otherwise(F.max(F.when(F.col(level).isNull(), F.col(value))))

    rows = counts.withColumn("v", F.col("n").cast("string"))
    rows = rows.groupBy("family", "k1", "k2").agg(inner("k3", "v").alias("v"))
    rows = rows.groupBy("family", "k1").agg(inner("k2", "v").alias("v"))
    return rows.groupBy("family").agg(inner("k1", "v").alias("values"))
