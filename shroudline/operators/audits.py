"""Audit records: built on the payload's row, then filtered, ranked and united."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.functions import ranks
from shroudline.operators import policy as P, skew

# How many records are listed unless a limit is given.
LIMIT_DEFAULT = 50
FILTERS = ("principal", "decision", "policy_source", "direction", "request_id", "session_id", "error_stage", "error_kind")

# Failures that leave an audit record behind.
AUDITED_ERRORS = ("attachment", "presidio", "opa", "tokenization", "detector", "review_store")


def _or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def build_audit(outcomes: DataFrame, status: bool = True) -> DataFrame:
    """One record per payload; arrays keep finding order and duplicates, values never appear."""
    resolved = F.col("resolved")
    escalated = F.coalesce(_or_null(outcomes, "session_escalated", "boolean"), F.lit(False))
    code = ranks.decision_status(F.col("decision")) if status else F.lit(None).cast("int")
    return outcomes.select(
        "ts", "request_id", F.col("caller.name").alias("principal"), F.col("caller.tenant_id").alias("tenant_id"), "direction", "path",
        "decision", F.coalesce(_or_null(outcomes, "source"), F.lit("builtin")).alias("policy_source"),
        _or_null(outcomes, "reason").alias("decision_reason"),
        F.transform(resolved, lambda f: f["label"]).alias("matched_labels"),
        F.transform(resolved, lambda f: f["rule_name"]).alias("matched_rules"),
        P.evidence(resolved).alias("findings"),
        _or_null(outcomes, "session_id").alias("session_id"), escalated.alias("session_escalated"), code.alias("status_code"),
        F.lit(None).cast("string").alias("error_stage"), F.lit(None).cast("string").alias("error_kind"),
    )


def error_audit(errors: DataFrame) -> DataFrame:
    """Records of requests whose processing failed before anything was sent on."""
    evidence = build_type()
    none = F.array().cast("array<string>")
    return errors.where(F.col("error_kind").isin(*AUDITED_ERRORS)).select(
        "ts", "request_id", F.col("caller.name").alias("principal"), F.col("caller.tenant_id").alias("tenant_id"),
        F.lit("request").alias("direction"), "path", F.lit("block").alias("decision"),
        F.lit("request_pre_upstream_error").alias("policy_source"),
        F.concat("error_stage", F.lit("/"), "error_kind", F.lit(": "), "error").alias("decision_reason"),
        none.alias("matched_labels"), none.alias("matched_rules"), F.array().cast(evidence).alias("findings"),
        "session_id", F.lit(False).alias("session_escalated"), F.lit(502).alias("status_code"), "error_stage", "error_kind",
    )


def build_type() -> str:
    from shroudline.schemas import EVIDENCE

    return f"array<{EVIDENCE.replace('matched_len:bigint', 'matched_len:int')}>"


def query_audit(audit: DataFrame, label: str | None = None, limit: int | None = None, newest: bool = False, **equal: str) -> DataFrame:
    """Records meeting every given condition; with ``newest`` the latest ``limit`` (default 50)."""
    unknown = set(equal) - set(FILTERS)
    if unknown:
        raise ValueError(f"unknown filters {sorted(unknown)}")
    rows = audit
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if label is not None:
        rows = rows.where(F.array_contains("matched_labels", label))
    if newest or limit is not None:
        rows = recent(rows, LIMIT_DEFAULT if limit is None else limit)
    return rows


def recent(audit: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` records."""
    return skew.top(audit, n, [("ts", True), ("request_id", True)])


def tail_then_filter(audit: DataFrame, n: int, **conditions) -> DataFrame:
    """Conditions applied to the newest ``n`` records only, so fewer may come back."""
    return query_audit(recent(audit, n), **conditions)


def union_audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of both sources, equal ones once, newest first."""
    return first.unionByName(second).dropDuplicates().orderBy(F.col("ts").desc(), F.col("request_id").desc())


def holds_raw(record: list[Column], resolved: Column) -> Column:
    """Whether any string of an audit record holds a raw matched value; none ever may.

    ``record`` lists the record's string and string array columns; strings are looked at as they are, not as JSON.
    """
    strings = F.flatten(F.array(*record))
    return F.exists(strings, lambda s: F.exists(resolved, lambda f: F.contains(s, f["matched"])))


def _field(name: str):
    return lambda entry: entry[name]


def record_strings(outcomes: DataFrame) -> list[Column]:
    """Every string that the audit record of an outcome carries beside its own identifiers."""
    evidence = P.evidence(F.col("resolved"))
    single = [_or_null(outcomes, name) for name in ("path", "direction", "decision", "source", "reason", "request_id", "session_id")]
    named = [f.name for f in outcomes.select(evidence.alias("e")).schema["e"].dataType.elementType.fields if f.dataType.typeName() == "string"]
    # the hash of a value is no raw value, whatever its digits
    lists = [F.transform(F.transform(evidence, _field(name)), lambda s: F.coalesce(s, F.lit(""))) for name in named if "sha256" not in name]
    return [F.array(*(F.coalesce(c, F.lit("")) for c in single)), *lists]


def leak_report(outcomes: DataFrame) -> DataFrame:
    """Findings checked and records that leak, in one pass."""
    return outcomes.agg(
        F.sum(F.size("resolved")).cast("bigint").alias("checked"), F.count_if(holds_raw(record_strings(outcomes), F.col("resolved"))).alias("leaks")
    )
