"""Policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroudline.config import DEFAULT_POLICY_RULES
from shroudline.functions import ranks, text as T
from shroudline.operators import attachments as A, payloads as Y, policy as P, skew
from shroudline.plans import sql as S, views as V
from shroudline.plans.files import office_files
from shroudline.plans.registry import query

# Credentials by row: three known callers, an unknown secret, none.
HEADER = """CASE doc_id % 5 WHEN 0 THEN 'Bearer demo-secret' WHEN 1 THEN 'bearer admin-secret' WHEN 2 THEN 'analyst-secret'
  WHEN 3 THEN concat('Bearer wrong-', doc_id) END"""
STRIPPED = f"regexp_replace({HEADER}, '^[Bb]earer ', '')"


def credentials(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "source")
    return docs.withColumn("authorization", F.expr(HEADER))


@query("auth_join", f"""SELECT doc_id, p.principal, p.tenant_id, p.role, p.clearance FROM documents
  JOIN callers p ON p.secret_sha256 = sha256({STRIPPED})""")
def auth_join(spark, d):
    rows = P.attach_principal(credentials(spark, d), P.principals_df(spark, S.CALLERS[:3]))
    return rows.select("doc_id", F.col("caller.name").alias("principal"), "caller.tenant_id", "caller.role", "caller.clearance")


@query("auth_failures", f"""SELECT doc_id, CASE WHEN {HEADER} IS NULL THEN 'missing_credentials' ELSE 'invalid_credentials' END AS reason
  FROM documents WHERE {HEADER} IS NULL OR sha256({STRIPPED}) NOT IN (SELECT secret_sha256 FROM callers WHERE secret_sha256 IS NOT NULL)""")
def auth_failures(spark, d):
    return P.auth_failures(credentials(spark, d), P.principals_df(spark, S.CALLERS[:3])).select("doc_id", "reason")


def resolved_rows(spark, d):
    return V.outcomes(spark, d).select("doc_id", "direction", F.explode("resolved").alias("f"))


@query("resolve_actions", "SELECT doc_id, ord, label, action FROM resolved")
def resolve_actions(spark, d):
    return resolved_rows(spark, d).select("doc_id", "f.ord", "f.label", "f.action")


@query("effective_action", "SELECT doc_id, ord, direction, action, effective_action FROM resolved")
def effective_action(spark, d):
    return resolved_rows(spark, d).select("doc_id", "f.ord", "direction", "f.action", "f.effective_action")


@query("decide", "SELECT doc_id, base_decision AS decision, base_rank AS rank FROM decisions")
def decide(spark, d):
    return V.outcomes(spark, d).select("doc_id", "decision", ranks.action_rank(F.col("decision")).alias("rank"))


@query("decision_status", f"""SELECT doc_id, {S.case('base_decision', {'allow': 200, 'redact': 200, 'review': 409, 'block': 403})} AS status_code,
  {S.case('base_decision', {'allow': 'allow', 'redact': 'redact', 'review': 'review_required', 'block': 'blocked_sensitive_payload'})} AS error_code
  FROM decisions""")
def decision_status(spark, d):
    decision = F.col("decision")
    return V.outcomes(spark, d).select(
        "doc_id", ranks.decision_status(decision).alias("status_code"), ranks.decision_code(decision).alias("error_code")
    )


# Every row may have escalated; the policy rows then look at labels, role and direction.
EXTERNAL_VIEWS = """flags AS (SELECT t.doc_id, t.direction, p.role, t.doc_id % 3 = 0 AS escalated, t.base_decision, t.base_rank, t.text,
    coalesce((SELECT list(f.label) FROM findings f WHERE f.doc_id = t.doc_id), CAST([] AS VARCHAR[])) AS labels
  FROM decisions t JOIN callers p ON p.who = t.who),
external AS (SELECT *, CASE WHEN direction = 'request' AND list_contains(labels, 'bearer_token') AND role <> 'admin' THEN 3
    WHEN direction = 'request' AND escalated AND list_contains(labels, 'national_id') THEN 2
    WHEN direction = 'response' AND list_contains(labels, 'secret_like') THEN 1 END AS ext_rank,
  CASE WHEN direction = 'request' AND list_contains(labels, 'bearer_token') AND role <> 'admin' THEN 'OPA policy blocks bearer_token for non-admin callers'
    WHEN direction = 'request' AND escalated AND list_contains(labels, 'national_id') THEN 'OPA escalates multi-turn sessions touching national_id'
    WHEN direction = 'response' AND list_contains(labels, 'secret_like') THEN 'OPA forces response redaction when secret_like appears' END AS ext_reason
  FROM flags)"""


def with_external(rows):
    labels = F.transform("resolved", lambda f: f["label"])
    escalated = F.col("doc_id") % 3 == 0
    return rows.withColumn(
        "external", P.external_decision(DEFAULT_POLICY_RULES, F.col("direction"), labels, F.col("caller.role"), escalated)
    ).withColumn(
        "merged", P.merge_external(F.col("decision"), F.lit("builtin"), F.lit(None).cast("string"), F.col("external"))
    )


@query("policy_rules", f"""WITH {EXTERNAL_VIEWS} SELECT doc_id, {S.action_of('ext_rank')} AS action, ext_reason AS reason FROM external WHERE ext_rank IS NOT NULL""")
def policy_rules(spark, d):
    rows = with_external(V.outcomes(spark, d)).where("external is not null")
    return rows.select("doc_id", "external.action", "external.reason")


@query("strict_merge", f"""WITH {EXTERNAL_VIEWS} SELECT doc_id, {S.action_of('greatest(base_rank, coalesce(ext_rank, 0))')} AS decision,
  CASE WHEN ext_rank IS NULL THEN 'builtin' ELSE 'opa' END AS source, ext_reason AS reason FROM external""")
def strict_merge(spark, d):
    return with_external(V.outcomes(spark, d)).select("doc_id", "merged.decision", "merged.source", "merged.reason")


@query("policy_fallback", """SELECT doc_id,
  CASE WHEN doc_id % 5 <> 0 OR doc_id % 10 = 0 AND doc_id % 4 = 0 THEN base_decision
       WHEN doc_id % 4 = 0 THEN base_decision WHEN direction = 'response' THEN 'redact' ELSE 'block' END AS decision,
  CASE WHEN doc_id % 5 <> 0 THEN 'builtin' WHEN doc_id % 4 = 0 THEN 'builtin_fail_open' WHEN direction = 'response' THEN 'opa_error_fallback'
       ELSE 'request_pre_upstream_error' END AS source,
  CASE WHEN doc_id % 5 <> 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'opa error ignored: timeout' WHEN direction = 'response'
       THEN 'opa failed during response filtering' ELSE 'process_payload/opa: timeout' END AS reason FROM decisions""")
def policy_fallback(spark, d):
    doc = F.col("doc_id")
    error = F.when(doc % 5 == 0, F.lit("timeout"))
    answer = P.on_policy_error(F.col("decision"), F.lit("builtin"), F.lit(None).cast("string"), error, F.col("direction"), doc % 4 == 0)
    rows = V.outcomes(spark, d).withColumn("answer", answer)
    return rows.select("doc_id", "answer.decision", "answer.source", "answer.reason")


@query("merge_outcomes", """WITH lines AS (
    SELECT user_id, event_id, {'r': CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN event_id % 3 ELSE event_id % 4 END::BIGINT,
      's': CASE WHEN event_type = 'view' THEN 'builtin' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'builtin' WHEN event_type = 'error' THEN 'opa_error_fallback' ELSE 'opa' END,
      'c': CASE WHEN event_type IN ('error', 'signup') OR event_type = 'click' AND event_id % 6 = 0 THEN concat('because ', event_id % 7) END} AS x FROM events),
  folded AS (SELECT user_id, list_reduce(list(x ORDER BY event_id), lambda a, b: {
      'r': greatest(a.r, b.r),
      's': CASE WHEN b.r > a.r OR (b.r = a.r AND a.s = 'builtin' AND b.s <> 'builtin') OR (a.c IS NULL AND b.c IS NOT NULL) THEN b.s ELSE a.s END,
      'c': CASE WHEN b.r > a.r OR (b.r = a.r AND a.s = 'builtin' AND b.s <> 'builtin') OR (a.c IS NULL AND b.c IS NOT NULL) THEN b.c ELSE a.c END},
      {'r': 0::BIGINT, 's': 'builtin', 'c': NULL::VARCHAR}) AS y FROM lines GROUP BY user_id)
  SELECT user_id, (['allow','redact','review','block'])[y.r + 1] AS decision, y.s AS source, y.c AS reason FROM folded""")
def merge_outcomes(spark, d):
    event, kind = F.col("event_id"), F.col("event_type")
    rank = (
        F.when(kind.isin("view", "click"), 0).when(kind == "signup", 1).when(kind == "purchase", event % 3).otherwise(event % 4)
    )
    source = (
        F.when((kind == "view") | ((kind == "click") & (event % 2 == 0)), "builtin")
        .when(kind == "error", "opa_error_fallback").otherwise("opa")
    )
    reason = F.when(kind.isin("error", "signup") | ((kind == "click") & (event % 6 == 0)), F.concat(F.lit("because "), event % 7))
    lines = V.table(spark, d, "events").select(
        "user_id", event.alias("seq"), ranks.action_of(rank).alias("decision"), source.alias("source"), reason.alias("reason")
    )
    return P.merge_outcomes(lines, "user_id")


RESPONSE = f"""WITH {EXTERNAL_VIEWS} SELECT e.doc_id, CASE WHEN greatest(base_rank, coalesce(ext_rank, 0)) = 0 THEN 'allow' ELSE 'redact' END AS decision,
  CASE WHEN greatest(base_rank, coalesce(ext_rank, 0)) = 0 THEN e.text
    WHEN coalesce(ext_rank, 0) > base_rank THEN CASE WHEN e.doc_id % 4 = 1 THEN '{T.REDACTED_JSON}' ELSE '{T.REDACTED_TEXT}' END
    ELSE s.redacted END AS body
  FROM external e JOIN sanitised s ON s.doc_id = e.doc_id"""


@query("response_select", RESPONSE)
def response_select(spark, d):
    rows = with_external(V.judged(spark, d))
    final = F.col("merged.decision")
    body = P.response_body(F.col("text"), F.col("redacted"), F.col("doc_id") % 4 == 1, F.col("decision"), final)
    return rows.select("doc_id", P.response_decision(final).alias("decision"), body.alias("body"))


@query("outbound_select", """SELECT t.doc_id, CASE base_decision WHEN 'redact' THEN s.redacted WHEN 'allow' THEN t.text END AS body
  FROM decisions t JOIN sanitised s ON s.doc_id = t.doc_id""")
def outbound_select(spark, d):
    return V.judged(spark, d).select("doc_id", P.outbound_body(F.col("text"), F.col("redacted"), F.col("decision")).alias("body"))


@query("signed_body", """SELECT t.doc_id, CASE WHEN t.doc_id % 7 = 0 THEN t.text ELSE s.redacted END AS body, t.n AS n_findings
  FROM decisions t JOIN sanitised s ON s.doc_id = t.doc_id""")
def signed_body(spark, d):
    body = P.preserve_signed(F.col("text"), F.col("redacted"), F.col("doc_id") % 7 == 0)
    return V.judged(spark, d).select("doc_id", body.alias("body"), F.size("resolved").cast("bigint").alias("n_findings"))


@query("processing_fallback", f"""SELECT t.doc_id,
  CASE WHEN t.doc_id % 6 IN (0, 1, 2) THEN 'redact' ELSE base_decision END AS decision,
  {S.case('t.doc_id % 6', {0: 'json_processing_error_fallback', 1: 'presidio_error_fallback', 2: 'processing_error_fallback'})[:-3]} ELSE 'builtin' END AS source,
  {S.case('t.doc_id % 6', {0: T.REDACTED_JSON, 1: T.REDACTED_TEXT, 2: T.REDACTED_JSON})[:-3]} ELSE s.redacted END AS body
  FROM decisions t JOIN sanitised s ON s.doc_id = t.doc_id""")
def processing_fallback(spark, d):
    """Three kinds of rows fail: a JSON body or a text whose outside recogniser gave an error, and an archive that cannot be read."""
    doc = F.col("doc_id")
    rows = V.traffic(spark, d).withColumn("body", F.when(doc % 6 == 0, F.to_json(F.struct("text"))).otherwise(F.col("text")))
    answers = V.table(spark, d, "documents").where("doc_id % 6 IN (0, 1)").select("doc_id", F.lit("recogniser answered 503").alias("ner_error"))
    files = office_files(spark, d).where(doc % 6 == 2).select("doc_id", "pointer", F.expr("substring(content, 1, octet_length(content) div 2)").alias("content"))
    archives = files.select("doc_id", skew.bound(A.read_office(F.col("content"), F.col("pointer"))).alias("read")).select("doc_id", F.col("read.error").alias("archive_error"))
    rows = rows.join(answers, "doc_id", "left").join(archives, "doc_id", "left")
    done = Y.process(rows, V.CONFIG, F.col("caller"), F.col("direction"), is_json=doc % 6 == 0, failure=F.col("ner_error"))
    done = done.withColumn("failed_stage", F.coalesce("failed_stage", P.failed_stage(F.col("archive_error"), F.lit("archive"))))
    return Y.withheld(done, "sanitised").select("doc_id", "decision", "source", F.col("sanitised").alias("body"))


@query("post_approval", "SELECT doc_id, CASE WHEN base_decision = 'redact' THEN 'redact' ELSE 'allow' END AS post_approval_action FROM decisions")
def post_approval(spark, d):
    return V.outcomes(spark, d).select("doc_id", P.post_approval(F.col("decision")).alias("post_approval_action"))


@query("evidence_projection", """SELECT doc_id, string_agg(concat_ws('|', label, rule_name, action, '/', severity, matched_sha256, matched_len), ';' ORDER BY ord) AS evidence
  FROM resolved GROUP BY doc_id""")
def evidence_projection(spark, d):
    rows = V.outcomes(spark, d).where(F.size("resolved") > 0)
    lines = F.transform(P.evidence(F.col("resolved")), lambda e: F.concat_ws(
        "|", e["label"], e["rule_name"], e["action"], e["pointer"], e["severity"], e["matched_sha256"], e["matched_len"].cast("string")))
    return rows.select("doc_id", F.array_join(lines, ";").alias("evidence"))
