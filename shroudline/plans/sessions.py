"""Session queries over ``events``: user = session, event type = label, half an hour to live."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroudline.functions import ranks
from shroudline.operators import sessions as N
from shroudline.plans import sql as S, views as V
from shroudline.plans.registry import query

TTL, THRESHOLD = 1800, 2


def labelled(spark, d):
    """Rows without a finding (views) keep a session alive and can still fire."""
    labels = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array("event_type"))
    return V.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", labels.alias("labels"))


SEGMENTS = f"""seg AS (SELECT event_id, user_id, ts, event_type, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL {TTL} SECOND THEN 1 ELSE 0 END AS b FROM events))"""
ESCALATED = f"""{SEGMENTS}, esc AS (SELECT *, count(DISTINCT CASE WHEN event_type <> 'view' THEN event_type END)
  OVER (PARTITION BY user_id, segment ORDER BY ts, event_id) >= {THRESHOLD} AS escalated FROM seg)"""


@query("sessionize", f"WITH {SEGMENTS} SELECT event_id, segment::BIGINT AS segment FROM seg")
def sessionize(spark, d):
    return N.sessionize(labelled(spark, d), TTL, "user_id", "ts", "event_id").select("event_id", "segment")


@query("session_correlation", f"WITH {ESCALATED} SELECT event_id, segment::BIGINT AS segment, escalated FROM esc")
def session_correlation(spark, d):
    return N.correlate(labelled(spark, d), TTL, THRESHOLD, "user_id", "ts", "event_id").select("event_id", "segment", "escalated")


@query("session_escalate", f"""WITH {ESCALATED} SELECT event_id, CASE WHEN escalated THEN {S.action_of("greatest(r, 2)")} ELSE {S.action_of("r")} END AS decision
  FROM (SELECT *, (event_id % 4)::INT AS r FROM esc)""")
def session_escalate(spark, d):
    rows = N.correlate(labelled(spark, d), TTL, THRESHOLD, "user_id", "ts", "event_id")
    base = ranks.action_of(F.col("event_id") % 4)
    return rows.select("event_id", N.escalate(base, F.col("escalated"), "review").alias("decision"))


MOMENT = "2024-01-15 12:00:00"


@query("active_sessions", f"""SELECT count(*) AS active_sessions FROM (SELECT user_id, max(ts) AS last FROM events
  WHERE ts <= TIMESTAMP '{MOMENT}' GROUP BY user_id) WHERE TIMESTAMP '{MOMENT}' - last <= INTERVAL {TTL} SECOND""")
def active_sessions(spark, d):
    at = F.lit(MOMENT).cast("timestamp_ntz")
    return N.active_sessions(V.table(spark, d, "events"), at, TTL, "user_id")


@query("session_cap", "SELECT user_id, epoch_us(max(ts)) AS updated_us FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 40")
def session_cap(spark, d):
    return N.cap_sessions(V.table(spark, d, "events"), 40, "user_id").select("user_id", N.micros(F.col("updated_at")).alias("updated_us"))


@query("ttl_mark_asof", """WITH marks AS (SELECT user_id, ts FROM events WHERE event_type = 'error')
  SELECT e.event_id, coalesce(e.ts < m.ts + INTERVAL 1800 SECOND, false) AS marked
  FROM (SELECT * FROM events WHERE event_type <> 'error') e ASOF LEFT JOIN marks m ON e.user_id = m.user_id AND e.ts >= m.ts""")
def ttl_mark_asof(spark, d):
    events = V.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    probes, marks = events.where("event_type <> 'error'"), events.where("event_type = 'error'")
    return N.flag_marked(probes, marks, TTL, "user_id", "ts", "event_id").select("event_id", "marked")
