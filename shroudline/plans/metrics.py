"""Counter, histogram and gauge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroudline.operators import metrics as M, policy as P, reviews as W, sessions as N
from shroudline.plans import policies as PP, reviews as PR, sessions as PN, sql as S, views as V
from shroudline.plans.registry import query

# Sources as they would be after external policy and reviews, by row.
SOURCE = """CASE doc_id % 9 WHEN 0 THEN 'opa' WHEN 1 THEN 'builtin_fail_open' WHEN 2 THEN 'opa_error_fallback' WHEN 3 THEN 'attachment_review_fallback'
  WHEN 4 THEN 'review_override_approved' WHEN 5 THEN 'review_override_rejected' ELSE 'builtin' END"""
DECISION = "CASE WHEN doc_id % 6 = 2 THEN 'review' ELSE {base} END"


def judged_audit(spark, d):
    from shroudline.operators import audits as A

    rows = V.outcomes(spark, d).withColumn("source", F.expr(SOURCE)).withColumn("decision", F.expr(DECISION.format(base="decision")))
    return A.build_audit(rows)


JUDGED = f"judged AS (SELECT doc_id, direction, {DECISION.format(base='base_decision')} AS decision, {SOURCE} AS source FROM decisions)"


@query("m_requests", f"WITH {JUDGED} SELECT direction, decision, count(*) AS n FROM judged GROUP BY ALL")
def m_requests(spark, d):
    return M.count_requests(judged_audit(spark, d))


@query("m_decisions", f"WITH {JUDGED} SELECT direction, decision, source, count(*) AS n FROM judged GROUP BY ALL")
def m_decisions(spark, d):
    return M.count_decisions(judged_audit(spark, d))


@query("m_detections", "SELECT direction, label, count(*) AS n FROM resolved GROUP BY ALL")
def m_detections(spark, d):
    return M.count_detections(V.outcomes(spark, d))


@query("m_auth_failures", f"""SELECT CASE WHEN {PP.HEADER} IS NULL THEN 'missing_credentials' ELSE 'invalid_credentials' END AS reason, count(*) AS n
  FROM documents WHERE doc_id % 5 IN (3, 4) GROUP BY 1""")
def m_auth_failures(spark, d):
    return M.count_auth_failures(P.auth_failures(PP.credentials(spark, d), P.principals_df(spark, S.CALLERS[:3])))


@query("m_review_events", f"""WITH {JUDGED}, {PR.REVIEW_SQL} SELECT event, count(*) AS n FROM (
  SELECT 'created' AS event FROM judged WHERE decision = 'review' AND direction = 'request' UNION ALL SELECT status FROM log WHERE type = 'resolved'
  UNION ALL SELECT replace(source, 'review_override', 'override') FROM judged WHERE source LIKE 'review_override%') GROUP BY event""")
def m_review_events(spark, d):
    return M.count_review_events(PR.review_log(spark, d), judged_audit(spark, d))


@query("m_fallbacks", f"WITH {JUDGED} SELECT source AS kind, count(*) AS n FROM judged WHERE source IN ('builtin_fail_open', 'opa_error_fallback', 'attachment_review_fallback') GROUP BY 1")
def m_fallbacks(spark, d):
    return M.count_fallbacks(judged_audit(spark, d))


LATENCY = "latency AS (SELECT event_type AS kind, CASE WHEN event_id % 2 = 0 THEN 'request' ELSE 'response' END AS direction, value / 1000 AS seconds FROM events)"
LES = ", ".join(f"count(*) FILTER (seconds <= {le}) AS le_{str(le).replace('.', '_')}" for le in M.BUCKETS)


def latency(spark, d):
    return V.table(spark, d, "events").select(
        F.col("event_type").alias("kind"), F.when(F.col("event_id") % 2 == 0, "request").otherwise("response").alias("direction"),
        (F.col("value") / 1000).alias("seconds"),
    )


@query("m_histogram", f"WITH {LATENCY} SELECT direction, kind, count(*) AS count, round(sum(seconds), 6) AS sum_seconds, {LES} FROM latency GROUP BY direction, kind")
def m_histogram(spark, d):
    hist = M.histogram(latency(spark, d), "seconds", ("direction", "kind"))
    return hist.withColumn("sum_seconds", F.round("sum_seconds", 6))


@query("m_hist_avg", f"WITH {LATENCY} SELECT kind, count(*) AS count, round(avg(seconds) * 1000, 6) AS avg_ms FROM latency GROUP BY kind")
def m_hist_avg(spark, d):
    hist = M.hist_avg_ms(M.histogram(latency(spark, d), "seconds", ("kind",)))
    return hist.select("kind", "count", F.round("avg_ms", 6).alias("avg_ms"))


HEALTH = """health AS (SELECT concat('dep-', user_id % 6) AS dependency, ts, event_id, user_id % 6 <> 3 AS configured,
  CASE WHEN event_type <> 'error' THEN (100 + (event_id * 37) % 500)::INT END AS status_code FROM events)"""


@query("m_dependencies", f"""WITH {HEALTH} SELECT dependency, configured::INT AS configured,
  (NOT configured OR coalesce(status_code >= 200 AND status_code < 500, false))::INT AS ready, coalesce(status_code, 0) AS status_code
  FROM (SELECT *, row_number() OVER (PARTITION BY dependency ORDER BY ts DESC, event_id DESC) AS k FROM health) WHERE k = 1""")
def m_dependencies(spark, d):
    health = V.table(spark, d, "events").select(
        F.concat(F.lit("dep-"), F.col("user_id") % 6).alias("dependency"), "ts", "event_id", (F.col("user_id") % 6 != 3).alias("configured"),
        F.when(F.col("event_type") != "error", (F.col("event_id") * 37 % 500 + 100).cast("int")).alias("status_code"),
    )
    return M.dependency_gauges(health, "event_id")


@query("m_gauges", f"""WITH {PR.REVIEW_SQL} SELECT 'active_sessions' AS gauge, count(*) AS value FROM (SELECT user_id, max(ts) AS last FROM events
    WHERE ts <= TIMESTAMP '{PN.MOMENT}' GROUP BY user_id) WHERE TIMESTAMP '{PN.MOMENT}' - last <= INTERVAL {PN.TTL} SECOND
  UNION ALL SELECT 'review_queue_pending', count(*) FROM tickets WHERE status = 'pending' UNION ALL SELECT 'review_queue_capacity', 1000""")
def m_gauges(spark, d):
    active = N.active_sessions(V.table(spark, d, "events"), F.lit(PN.MOMENT).cast("timestamp_ntz"), PN.TTL, "user_id")
    return M.gauges(active, W.pending_count(PR.tickets(spark, d)), 1000)


def _map_sql(key: str, value: str) -> str:
    return f"map_from_entries(list(({key}, {value}) ORDER BY {key}))"


@query("m_snapshot", f"""WITH {JUDGED} SELECT 'requests_total' AS family, to_json({_map_sql('direction', 'm')})::VARCHAR AS values FROM (
    SELECT direction, {_map_sql('decision', 'n')} AS m FROM (SELECT direction, decision, count(*) AS n FROM judged GROUP BY ALL) GROUP BY direction)
  UNION ALL SELECT 'detections_total', to_json({_map_sql('direction', 'm')})::VARCHAR FROM (
    SELECT direction, {_map_sql('label', 'n')} AS m FROM (SELECT direction, label, count(*) AS n FROM resolved GROUP BY ALL) GROUP BY direction)
  UNION ALL SELECT 'processing_fallback_total', to_json({_map_sql('source', 'n')})::VARCHAR FROM (SELECT source, count(*) AS n FROM judged
    WHERE source IN ('builtin_fail_open', 'opa_error_fallback', 'attachment_review_fallback') GROUP BY 1)
  UNION ALL SELECT 'policy_decisions_total', to_json({_map_sql('direction', 'm')})::VARCHAR FROM (SELECT direction, {_map_sql('decision', 'm')} AS m FROM (
    SELECT direction, decision, {_map_sql('source', 'n')} AS m FROM (SELECT direction, decision, source, count(*) AS n FROM judged GROUP BY ALL) GROUP BY ALL) GROUP BY direction)""")
def m_snapshot(spark, d):
    return M.snapshot(M.counter_families(judged_audit(spark, d)))
