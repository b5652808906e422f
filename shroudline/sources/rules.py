"""Configuration as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shroudline.config import Detection, detection_from, parse_document

RULES = (
    "rule_name string, label string, pattern string, severity string, authorized_action string,"
    "unauthorized_action string, min_clearance string, masking string, ord int"
)


def rules_df(spark: SparkSession, config: Detection) -> DataFrame:
    rows = [
        (r.name, r.label, getattr(r, "pattern", None), r.severity, r.authorized_action, r.unauthorized_action,
         r.min_clearance, r.masking, i)
        for i, r in enumerate(config.scored)
    ]
    return spark.createDataFrame(rows, RULES)


def read_detection(spark: SparkSession, path: str) -> Detection:
    """Detection settings from one JSON, TOML or YAML file on any file system Spark reads."""
    kind = path.rsplit(".", 1)[-1].lower()
    text = spark.read.option("wholetext", True).text(path).head()[0]
    return detection_from(parse_document(text, kind))
