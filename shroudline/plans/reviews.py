"""Review queries: sign-ups open tickets, most of which are resolved later."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroudline.operators import reviews as W
from shroudline.operators.sessions import micros
from shroudline.plans import views as V
from shroudline.plans.registry import query

TTL = 86400

# Expressions for both engines.
TENANT = "concat('tenant-', user_id % 5)"
PATH = "concat('/p', user_id % 3)"
BODY = "concat('body-', user_id % 10)"
STATUS = "CASE WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'approved' END"
POST = "CASE WHEN event_id % 2 = 0 THEN 'redact' ELSE 'allow' END"

REVIEW_SQL = f"""base AS (SELECT *, epoch_us(ts) AS us, {TENANT} AS tenant_id, {PATH} AS path, sha256({BODY}) AS request_sha256,
    sha256(concat({TENANT}, '|', {PATH}, '|', sha256({BODY}))) AS fingerprint, concat('user-', user_id) AS principal FROM events),
  log AS (
    SELECT concat('t', event_id) AS ticket_id, 'created' AS type, us AS at_us, NULL AS status, NULL AS resolved_by, fingerprint, principal, path, request_sha256, {POST} AS post
      FROM base WHERE event_type = 'signup'
    UNION ALL SELECT concat('t', event_id), 'resolved', us + (event_id % 36000) * 1000000, {STATUS}, 'admin', NULL, NULL, NULL, NULL, NULL
      FROM base WHERE event_type = 'signup' AND event_id % 4 <> 0
    UNION ALL SELECT concat('t', event_id), 'resolved', us + 40000000000, 'rejected', 'second', NULL, NULL, NULL, NULL, NULL
      FROM base WHERE event_type = 'signup' AND event_id % 20 = 1
    UNION ALL SELECT concat('t', event_id), 'resolved', us, 'approved', 'nobody', NULL, NULL, NULL, NULL, NULL
      FROM base WHERE event_type = 'purchase' AND event_id % 10 = 0),
  tickets AS (SELECT c.ticket_id, c.at_us AS created_us, coalesce(r.status, 'pending') AS status, r.at_us AS resolved_us, r.resolved_by,
      r.at_us + {TTL}000000 AS expires_us, c.fingerprint, c.principal, c.path, c.request_sha256, c.post
    FROM (SELECT * FROM log WHERE type = 'created') c LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY at_us DESC) AS k FROM log WHERE type = 'resolved') r
      ON r.ticket_id = c.ticket_id AND r.k = 1 AND r.at_us >= c.at_us)"""


def base(spark, d):
    return rows_of(V.table(spark, d, "events"))


def rows_of(events):
    events = events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return (
        events.withColumn("tenant_id", F.expr(TENANT)).withColumn("path", F.expr(PATH))
        .withColumn("request_sha256", F.sha2(F.expr(BODY), 256)).withColumn("principal", F.concat(F.lit("user-"), "user_id"))
        .withColumn("fingerprint", W.fingerprint(F.col("tenant_id"), F.col("path"), F.col("request_sha256")))
    )


def review_log(spark, d):
    rows = base(spark, d).where("event_type = 'signup' OR event_type = 'purchase' AND event_id % 10 = 0")
    ticket = F.struct(
        F.concat(F.lit("t"), "event_id").alias("id"), F.col("ts").alias("created_at"), F.lit("pending").alias("status"),
        "fingerprint", "principal", "path", "request_sha256", F.expr(POST).alias("post_approval_action"),
    )
    no_ticket, no_text = F.lit(None).cast(ticket_type()), F.lit(None).cast("string")
    no_time = F.lit(None).cast("timestamp")

    def event(kind, made, status, by, at):
        expires = at + F.make_dt_interval(days=F.lit(TTL // 86400))
        return F.struct(
            F.lit(kind).alias("type"), made.alias("ticket"), F.concat(F.lit("t"), "event_id").alias("ticket_id"), status.alias("status"),
            by.alias("resolved_by"), no_text.alias("note"), at.alias("resolved_at"), expires.alias("expires_at"),
        )

    after = F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 36000).cast("decimal(18,6)"))
    late = F.col("ts") + F.make_dt_interval(secs=F.lit(40000).cast("decimal(18,6)"))
    signup = F.col("event_type") == "signup"
    events = F.array_compact(F.array(
        F.when(signup, event("created", ticket, no_text, no_text, no_time)),
        F.when(signup & (F.col("event_id") % 4 != 0), event("resolved", no_ticket, F.expr(STATUS), F.lit("admin"), after)),
        F.when(signup & (F.col("event_id") % 20 == 1), event("resolved", no_ticket, F.lit("rejected"), F.lit("second"), late)),
        F.when(~signup, event("resolved", no_ticket, F.lit("approved"), F.lit("nobody"), F.col("ts"))),
    ))
    return rows.select(F.explode(events).alias("e")).select("e.*")


def ticket_type():
    return ("struct<id:string,created_at:timestamp,status:string,fingerprint:string,principal:string,path:string,"
            "request_sha256:string,post_approval_action:string>")


def tickets(spark, d):
    return W.fold_tickets(review_log(spark, d))


@query("review_fingerprint", f"WITH {REVIEW_SQL} SELECT event_id, fingerprint FROM base")
def review_fingerprint(spark, d):
    return base(spark, d).select("event_id", "fingerprint")


@query("review_fold", f"WITH {REVIEW_SQL} SELECT ticket_id, status, resolved_by, created_us, resolved_us, expires_us, post AS post_approval_action FROM tickets")
def review_fold(spark, d):
    return tickets(spark, d).select(
        "ticket_id", "status", "resolved_by", micros(F.col("created_at")).alias("created_us"), micros(F.col("resolved_at")).alias("resolved_us"),
        micros(F.col("expires_at")).alias("expires_us"), "post_approval_action",
    )


@query("review_open_dedup", f"""WITH {REVIEW_SQL} SELECT fingerprint, min(us) AS opened_us, arg_min(event_id, (us, event_id)) AS event_id FROM base
  WHERE event_type = 'click' AND fingerprint NOT IN (SELECT fingerprint FROM tickets WHERE status = 'pending' AND created_us < 1704100000000000) GROUP BY fingerprint""")
def review_open_dedup(spark, d):
    asked = base(spark, d).where("event_type = 'click'")
    old = tickets(spark, d).where(micros(F.col("created_at")) < 1704100000000000)
    return W.open_tickets(asked, old, "ts", "event_id").select("fingerprint", micros(F.col("ts")).alias("opened_us"), "event_id")


HISTORY_SQL = f"""WITH RECURSIVE {REVIEW_SQL},
  asked AS (SELECT b.event_id, b.us, b.fingerprint, min(l.at_us) AS done FROM base b LEFT JOIN log l ON l.type = 'resolved'
    AND l.ticket_id = concat('t', b.event_id) AND l.at_us >= b.us WHERE b.event_type = 'signup' GROUP BY ALL),
  chain AS (SELECT fingerprint, arg_min({{'us': us, 'id': event_id, 'done': done}}, (us, concat('t', event_id))) AS o FROM asked GROUP BY fingerprint
    UNION ALL SELECT c.fingerprint, arg_min({{'us': a.us, 'id': a.event_id, 'done': a.done}}, (a.us, concat('t', a.event_id))) AS o FROM chain c JOIN asked a
      ON a.fingerprint = c.fingerprint AND a.us >= c.o.done AND (a.us, concat('t', a.event_id)) > (c.o.us, concat('t', c.o.id)) GROUP BY c.fingerprint)
  SELECT fingerprint, o.id AS event_id FROM chain"""


@query("review_open_history", HISTORY_SQL)
def review_open_history(spark, d):
    """Sign-ups open tickets, also again after the ticket before was resolved."""
    asked = base(spark, d).where("event_type = 'signup'").select("fingerprint", "event_id", "ts", F.concat(F.lit("t"), "event_id").alias("request_id"))
    resolutions = review_log(spark, d).where("type = 'resolved'").select("ticket_id", "resolved_at")
    return W.open_history(asked, resolutions).select("fingerprint", "event_id")


AT_US = 1705320000000000


@query("review_overrides", f"""WITH {REVIEW_SQL} SELECT fingerprint, ticket_id, status, post AS post_approval_action FROM (
  SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY resolved_us DESC, ticket_id DESC) AS k FROM tickets
  WHERE status <> 'pending' AND resolved_us <= {AT_US}) WHERE k = 1 AND expires_us > {AT_US}""")
def review_overrides(spark, d):
    at = F.timestamp_micros(F.lit(AT_US))
    return W.overrides_asof(tickets(spark, d), at).select("fingerprint", "ticket_id", "status", "post_approval_action")


@query("review_apply", f"""WITH {REVIEW_SQL},
  asked AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN concat('t', event_id - event_id % 7) END AS review_ticket FROM base WHERE event_type IN ('click', 'view')),
  live AS (SELECT a.event_id, t.* EXCLUDE (principal, path, request_sha256) FROM asked a ASOF JOIN (
      SELECT *, resolved_us AS r FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint, resolved_us ORDER BY ticket_id DESC) AS k
        FROM tickets WHERE status <> 'pending') WHERE k = 1) t ON a.fingerprint = t.fingerprint AND a.us >= t.r),
  joined AS (SELECT a.event_id, n.status AS n_status, n.post AS n_post, n.ticket_id AS n_ticket,
      CASE WHEN l.expires_us > a.us THEN l.status END AS o_status, l.post AS o_post
    FROM asked a LEFT JOIN tickets n ON n.ticket_id = a.review_ticket AND n.status <> 'pending' AND n.principal = a.principal
      AND n.path = a.path AND n.request_sha256 = a.request_sha256 AND n.resolved_us <= a.us
    LEFT JOIN live l ON l.event_id = a.event_id)
  SELECT event_id, CASE coalesce(n_status, o_status) WHEN 'approved' THEN CASE WHEN n_status IS NOT NULL THEN n_post ELSE o_post END
      WHEN 'rejected' THEN 'block' ELSE 'review' END AS decision,
    coalesce('review_override_' || coalesce(n_status, o_status), 'builtin') AS source,
    CASE WHEN n_status IS NOT NULL THEN 'request ' || n_status || ' via review ticket ' || n_ticket
      WHEN o_status IS NOT NULL THEN 'request previously ' || o_status || ' by admin review' END AS reason FROM joined""")
def review_apply(spark, d):
    asked = base(spark, d).where("event_type in ('click', 'view')").select(
        "event_id", "ts", "principal", "path", "request_sha256", "fingerprint",
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("t"), F.col("event_id") - F.col("event_id") % 7)).alias("review_ticket"),
        F.lit("review").alias("decision"), F.lit("builtin").alias("source"), F.lit(None).cast("string").alias("reason"),
    )
    return W.apply_overrides(asked, tickets(spark, d), TTL, "ts", "event_id").select("event_id", "decision", "source", "reason")


@query("review_resolve", f"""WITH {REVIEW_SQL},
  req AS (SELECT event_id, us, concat('t', event_id - event_id % 4) AS ticket_id FROM base WHERE event_type = 'error'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY us, event_id) AS k FROM req)
  SELECT r.event_id, CASE WHEN t.ticket_id IS NULL THEN 'not_found' WHEN t.status = 'pending' AND k = 1 THEN 'resolved' ELSE 'already_resolved' END AS outcome,
    CASE WHEN t.status = 'pending' AND k = 1 THEN us + 900000000 END AS expires_us
  FROM ranked r LEFT JOIN tickets t ON t.ticket_id = r.ticket_id""")
def review_resolve(spark, d):
    requests = base(spark, d).where("event_type = 'error'").select(
        "event_id", F.col("ts").alias("requested_at"), F.concat(F.lit("t"), F.col("event_id") - F.col("event_id") % 4).alias("ticket_id"),
        F.lit("approved").alias("status"), F.lit("admin").alias("resolved_by"), F.lit(None).cast("string").alias("note"),
    )
    return W.resolve(requests, tickets(spark, d), 900).select("event_id", "outcome", micros(F.col("expires_at")).alias("expires_us"))


@query("review_list", f"WITH {REVIEW_SQL} SELECT ticket_id, status, created_us FROM tickets WHERE status = 'pending' ORDER BY created_us DESC, ticket_id DESC LIMIT 50")
def review_list(spark, d):
    return W.list_tickets(tickets(spark, d)).select("ticket_id", "status", micros(F.col("created_at")).alias("created_us"))


@query("review_pending", f"WITH {REVIEW_SQL} SELECT count(*) AS pending FROM tickets WHERE status = 'pending'")
def review_pending(spark, d):
    return W.pending_count(tickets(spark, d))


@query("review_trim", f"""WITH {REVIEW_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY created_us DESC, ticket_id DESC) AS k FROM tickets)
  SELECT ticket_id, status, fingerprint NOT IN (SELECT fingerprint FROM ranked WHERE k > 30) AS entry_live FROM ranked WHERE k <= 30""")
def review_trim(spark, d):
    return W.trim_tickets(tickets(spark, d), 30).select("ticket_id", "status", "entry_live")
