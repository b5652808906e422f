"""Audit queries over the judged traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroudline.operators import audits as A
from shroudline.plans import sql as S, views as V
from shroudline.plans.registry import query

S.VIEWS["audit"] = f"""SELECT t.doc_id, t.request_id, t.ts, p.principal, p.tenant_id, t.direction, t.path, t.base_decision AS decision,
    t.session_id, coalesce(f.labels, '') AS labels, coalesce(f.rules, '') AS rules, coalesce(f.evidence, '') AS evidence,
    {S.case('t.base_decision', {'allow': 200, 'redact': 200, 'review': 409, 'block': 403})} AS status_code
  FROM decisions t JOIN callers p ON p.who = t.who LEFT JOIN (
    SELECT doc_id, string_agg(label, ',' ORDER BY ord) AS labels, string_agg(rule_name, ',' ORDER BY ord) AS rules,
      string_agg(concat_ws('|', label, rule_name, action, '/', severity, matched_sha256, matched_len), ';' ORDER BY ord) AS evidence
    FROM resolved GROUP BY doc_id) f ON f.doc_id = t.doc_id"""
COLUMNS = "request_id, ts, principal, tenant_id, direction, path, decision, session_id, labels, rules, evidence, status_code"
SHORT = "request_id, ts, decision, labels"


def audit(spark, d):
    return A.build_audit(V.outcomes(spark, d))


def flat(rows, *names):
    lines = F.transform("findings", lambda e: F.concat_ws(
        "|", e["label"], e["rule_name"], e["action"], e["pointer"], e["severity"], e["matched_sha256"], e["matched_len"].cast("string")))
    shown = rows.withColumn("labels", V.joined(F.col("matched_labels"))).withColumn("rules", V.joined(F.col("matched_rules"))).withColumn(
        "evidence", F.array_join(lines, ";"))
    return shown.select(*(names or [n.strip() for n in COLUMNS.split(",")]))


def short(rows):
    return flat(rows, *[n.strip() for n in SHORT.split(",")])


@query("traffic_scan", "SELECT direction, path, count(*) AS n, count(DISTINCT session_id) AS sessions, sum(strlen(text))::BIGINT AS bytes FROM traffic GROUP BY ALL")
def traffic_scan(spark, d):
    # two steps, so that the distinct count does not multiply the rows
    per = V.traffic(spark, d).groupBy("direction", "path", "session_id").agg(F.count("*").alias("c"), F.sum(F.octet_length("text")).alias("b"))
    return per.groupBy("direction", "path").agg(
        F.sum("c").alias("n"), F.count("*").alias("sessions"), F.sum("b").cast("bigint").alias("bytes")
    )


@query("audit_build", f"SELECT {COLUMNS} FROM audit")
def audit_build(spark, d):
    return flat(audit(spark, d))


@query("audit_filter", f"""SELECT {SHORT} FROM audit WHERE direction = 'request' AND decision = 'block' AND list_contains(string_split(labels, ','), 'national_id')""")
def audit_filter(spark, d):
    return short(A.query_audit(audit(spark, d), direction="request", decision="block", label="national_id"))


@query("audit_topk", f"SELECT {SHORT} FROM audit WHERE decision = 'block' ORDER BY ts DESC, request_id DESC LIMIT 50")
def audit_topk(spark, d):
    return short(A.query_audit(audit(spark, d), decision="block", newest=True))


@query("audit_recent", f"SELECT {SHORT} FROM audit ORDER BY ts DESC, request_id DESC LIMIT 200")
def audit_recent(spark, d):
    return short(A.recent(audit(spark, d), 200))


@query("audit_tail_filter", f"""SELECT {SHORT} FROM (SELECT * FROM audit ORDER BY ts DESC, request_id DESC LIMIT 100)
  WHERE list_contains(string_split(labels, ','), 'email')""")
def audit_tail_filter(spark, d):
    return short(A.tail_then_filter(audit(spark, d), 100, label="email"))


@query("audit_union_dedup", f"SELECT {COLUMNS} FROM audit WHERE doc_id % 3 <> 0 UNION SELECT {COLUMNS} FROM audit WHERE doc_id % 3 = 0 OR doc_id % 2 = 0")
def audit_union_dedup(spark, d):
    rows = V.outcomes(spark, d)
    return flat(A.union_audit(A.build_audit(rows.where("doc_id % 3 <> 0")), A.build_audit(rows.where("doc_id % 3 = 0 or doc_id % 2 = 0"))))


@query("audit_no_raw", """SELECT count(*) AS checked, count(DISTINCT a.doc_id) FILTER (contains(a.evidence, r.matched)) AS leaks
  FROM audit a JOIN resolved r ON r.doc_id = a.doc_id""")
def audit_no_raw(spark, d):
    return A.leak_report(V.outcomes(spark, d))


ERRORS_SQL = """errors AS (SELECT doc_id, request_id, ts, session_id, path, who, CASE doc_id % 7 WHEN 0 THEN 'attachment' WHEN 1 THEN 'opa' WHEN 2 THEN 'auth'
  WHEN 3 THEN 'tokenization' WHEN 4 THEN 'config' ELSE 'review_store' END AS kind FROM traffic)"""


def errors(spark, d):
    doc = F.col("doc_id")
    kind = (
        F.when(doc % 7 == 0, "attachment").when(doc % 7 == 1, "opa").when(doc % 7 == 2, "auth").when(doc % 7 == 3, "tokenization")
        .when(doc % 7 == 4, "config").otherwise("review_store")
    )
    return V.traffic(spark, d).select(
        "request_id", "ts", "session_id", "path", "caller", F.lit("process_payload").alias("error_stage"), kind.alias("error_kind"),
        F.concat(F.lit("failed on "), "request_id").alias("error"),
    )


AUDITED = "kind IN ('attachment', 'presidio', 'opa', 'tokenization', 'detector', 'review_store')"


@query("error_audit", f"""WITH {ERRORS_SQL} SELECT request_id, ts, principal, 'block' AS decision, 'request_pre_upstream_error' AS policy_source, 502 AS status_code,
  concat('process_payload/', kind, ': failed on ', request_id) AS decision_reason, kind AS error_kind, 0::BIGINT AS n_findings
  FROM errors e JOIN callers p ON p.who = e.who WHERE {AUDITED}""")
def error_audit(spark, d):
    return A.error_audit(errors(spark, d)).select(
        "request_id", "ts", "principal", "decision", "policy_source", "status_code", "decision_reason", "error_kind",
        F.size("findings").cast("bigint").alias("n_findings"),
    )


@query("m_errors", f"WITH {ERRORS_SQL} SELECT 'process_payload' AS stage, kind, count(*) AS n FROM errors WHERE {AUDITED} GROUP BY kind")
def m_errors(spark, d):
    from shroudline.operators import metrics as M

    all_records = audit(spark, d).unionByName(A.error_audit(errors(spark, d)))
    return M.count_errors(all_records)
