"""The same derived inputs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.config import Detection, as_rows
from shroudline.operators import detect as D, policy as P, redact as R
from shroudline.plans.sql import CALLERS, INJECT

CONFIG = Detection()
EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return docs.withColumn("text", F.concat("text", F.expr(INJECT)))


def callers() -> Column:
    """The example callers as one literal array, picked by position."""
    rows = as_rows(CALLERS)
    return F.array(*[
        F.struct(
            F.lit(r["name"]).alias("name"), F.lit(r["tenant_id"]).alias("tenant_id"), F.lit(r["role"]).alias("role"),
            F.lit(r["clearance"]).alias("clearance"),
            F.array(*[F.lit(a) for a in r["allowed_labels"]]).cast("array<string>").alias("allowed_labels"),
        )
        for r in rows
    ])


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    return scan_docs(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("req-"), doc).alias("request_id"),
        (doc + EPOCH).alias("ts"),
        (doc % 4).alias("who"),
        F.element_at(callers(), (doc % 4 + 1).cast("int")).alias("caller"),
        F.concat(F.lit("sess-"), doc % 23).alias("session_id"),
        F.when(doc % 2 == 0, "request").otherwise("response").alias("direction"),
        F.when(doc % 3 == 0, "/v1/chat/completions").when(doc % 3 == 1, "/v1/embeddings").otherwise("/v1/responses").alias("path"),
        "text",
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``traffic`` with findings."""
    return D.detect(traffic(spark, sf_dir), CONFIG, pointer=F.lit("/"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``traffic`` with resolved findings, decision and rewritten text."""
    return R.judge(found(spark, sf_dir), F.col("caller"), F.col("direction"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``traffic`` with resolved findings and decision, text left alone."""
    resolved = P.resolve(F.col("findings"), F.col("caller"), F.col("direction"))
    return (
        found(spark, sf_dir).withColumn("resolved", resolved).withColumn("decision", P.decide(F.col("resolved"))).drop("findings")
    )


def joined(array: Column) -> Column:
    return F.array_join(array, ",")
