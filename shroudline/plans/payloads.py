"""Payload shaping, stream-line and metering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroudline.config import DEFAULT_POLICY_RULES, Detection
from shroudline.functions import text as T
from shroudline.operators import payloads as Y, policy as P, usage as U
from shroudline.plans import sql as S, views as V
from shroudline.plans.registry import query

# Chat requests: one per conversation turn, with a value appended as in ``scan_docs``.
CHAT_ID = "conv_id * 100 + turn"
S.VIEWS["chat"] = f"""SELECT doc_id, role, concat(text, {S.INJECT}) AS text, concat('model-', doc_id % 3) AS model
  FROM (SELECT {CHAT_ID} AS doc_id, role, text FROM conversations)"""
S.VIEWS["chat_findings"] = S.findings_sql("chat", "doc_id")
S.VIEWS["chat_resolved"] = "SELECT *, unauthorized_action AS action, unauthorized_action AS effective_action FROM chat_findings"
S.VIEWS["chat_redacted"] = S.redacted_sql("chat_resolved", "chat", "doc_id")


def chat(spark, d):
    turns = V.table(spark, d, "conversations").select(F.expr(CHAT_ID).alias("doc_id"), "role", "text")
    rows = turns.select("doc_id", "role", F.concat("text", F.expr(S.INJECT)).alias("text"), F.concat(F.lit("model-"), F.col("doc_id") % 3).alias("model"))
    body = F.to_json(F.struct(
        F.col("model"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit("be brief").alias("content")), F.struct("role", F.col("text").alias("content"))).alias("messages"),
        F.lit(False).alias("stream"),
        F.struct(F.struct(F.col("role").alias("b/c~d")).alias("a")).alias("meta"),
    ))
    return rows.withColumn("body", body)


KIND_TYPES = """CASE doc_id % 9 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/plain; charset=utf-8' WHEN 2 THEN 'application/vnd.api+json'
  WHEN 3 THEN 'multipart/form-data; boundary=x' WHEN 4 THEN 'Text/Event-Stream' WHEN 5 THEN 'APPLICATION/JSON' WHEN 6 THEN 'application/octet-stream'
  WHEN 7 THEN 'application/json; charset=utf-8' END"""


@query("payload_kind", f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND starts_with(lower(ct), 'multipart/form-data') THEN 'multipart'
    WHEN doc_id % 2 = 1 AND starts_with(lower(ct), 'text/event-stream') THEN 'sse'
    WHEN (contains(ct, 'application/json') OR contains(ct, '+json')) AND doc_id % 4 <> 3 THEN 'json' ELSE 'text' END AS kind
  FROM (SELECT doc_id, {KIND_TYPES} AS ct FROM documents)""")
def payload_kind(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", "text").withColumn("ct", F.expr(KIND_TYPES))
    body = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("{"), "text")).otherwise(F.to_json(F.struct("text")))
    direction = F.when(F.col("doc_id") % 2 == 0, "request").otherwise("response")
    return rows.select("doc_id", T.payload_kind(F.col("ct"), direction, body).alias("kind"))


LEAVES_SQL = """SELECT doc_id, '/messages/0/content' AS pointer, 'be brief' AS text FROM chat
  UNION ALL SELECT doc_id, '/messages/0/role', 'system' FROM chat UNION ALL SELECT doc_id, '/messages/1/content', text FROM chat
  UNION ALL SELECT doc_id, '/messages/1/role', role FROM chat UNION ALL SELECT doc_id, '/model', model FROM chat"""


@query("json_leaves", LEAVES_SQL)
def json_leaves(spark, d):
    return Y.explode_chat(chat(spark, d), "doc_id")


@query("json_leaves_any", LEAVES_SQL + " UNION ALL SELECT doc_id, '/meta/a/b~1c~0d', role FROM chat")
def json_leaves_any(spark, d):
    return Y.explode_leaves(chat(spark, d), "doc_id")


@query("ignore_pointers", f"SELECT * FROM ({LEAVES_SQL}) WHERE pointer NOT IN ('/model', '/messages/1/role')")
def ignore_pointers(spark, d):
    from shroudline.operators import detect as D

    config = Detection(ignore_json_pointers=("/model", "/messages/1/role"))
    return D.drop_ignored(Y.explode_chat(chat(spark, d), "doc_id"), config)


@query("json_rebuild", """SELECT c.doc_id, to_json({'messages': [{'content': 'be brief', 'role': 'system'}, {'content': r.redacted, 'role': c.role}],
  'meta': {'a': {'b/c~d': c.role}}, 'model': c.model, 'stream': false})::VARCHAR AS body FROM chat c JOIN chat_redacted r ON r.doc_id = c.doc_id""")
def json_rebuild(spark, d):
    return Y.scrub_bodies(chat(spark, d), V.CONFIG).select("doc_id", F.col("sanitised").alias("body"))


@query("json_rebuild_chat", """SELECT doc_id, to_json({'messages': [{'content': 'BE BRIEF', 'role': 'system'}, {'content': upper(text), 'role': role}],
  'model': model})::VARCHAR AS body FROM (SELECT doc_id, role, model, replace(text, 'ß', '') AS text FROM chat)""")
def json_rebuild_chat(spark, d):
    rewrite = lambda c: F.upper(F.replace(c, F.lit("ß"), F.lit("")))
    return chat(spark, d).select("doc_id", Y.rebuild_chat(F.col("body"), rewrite).alias("body"))


@query("process_payload", f"""SELECT c.doc_id, coalesce(f.top, 'allow') AS decision, coalesce(f.pointers, '') AS pointers,
  r.redacted AS content FROM chat c JOIN chat_redacted r ON r.doc_id = c.doc_id LEFT JOIN (
    SELECT doc_id, {S.action_of(f"max({S.case('action', S.ACTION_RANK)})")} AS top, string_agg('/messages/1/content', ',') AS pointers FROM chat_resolved GROUP BY doc_id) f
    ON f.doc_id = c.doc_id""")
def process_payload(spark, d):
    rows = Y.process(chat(spark, d), Detection(ignore_json_pointers=("/model",)), P.local_principal(), F.lit("request"))
    pointers = V.joined(F.transform("resolved", lambda f: f["pointer"]))
    content = F.from_json("sanitised", Y.CHAT)["messages"][1]["content"]
    return rows.select("doc_id", "decision", pointers.alias("pointers"), content.alias("content"))


NAME = """concat('file', doc_id, CASE doc_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.pptx' WHEN 4 THEN '.json'
  WHEN 5 THEN '.csv' WHEN 6 THEN '.xml' WHEN 7 THEN '.bin' ELSE '' END)"""
DECLARED = """CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'Application/Octet-Stream' WHEN 2 THEN ' Image/PNG ' WHEN 3 THEN 'text/csv' END"""
MEDIA_SQL = f"""media AS (SELECT doc_id, n_chars, text, CASE WHEN lower(trim(coalesce(dc, ''))) NOT IN ('', 'application/octet-stream', 'binary/octet-stream') THEN trim(dc) ELSE
  CASE {' '.join(f"WHEN ends_with(lower(fn), '{e}') THEN '{m}'" for e, m in T.MEDIA_TYPES.items())} ELSE 'text/plain' END END AS media_type
  FROM (SELECT doc_id, n_chars, text, {NAME} AS fn, {DECLARED} AS dc FROM documents))"""
ALLOWED = ("text/*", "application/json", "image/png")


def media(spark, d):
    rows = V.table(spark, d, "documents").withColumn("fn", F.expr(NAME)).withColumn("dc", F.expr(DECLARED))
    return rows.withColumn("media_type", T.media_type(F.col("dc"), F.col("fn")))


@query("media_type", f"WITH {MEDIA_SQL} SELECT doc_id, media_type FROM media")
def media_type(spark, d):
    return media(spark, d).select("doc_id", "media_type")


@query("media_allow", f"""WITH {MEDIA_SQL} SELECT doc_id, media_type FROM media
  WHERE starts_with(lower(media_type), 'text/') OR lower(media_type) IN ('application/json', 'image/png')""")
def media_allow(spark, d):
    return media(spark, d).where(T.media_allowed(F.col("media_type"), ALLOWED)).select("doc_id", "media_type")


@query("attachment_cap", f"""SELECT doc_id, strlen(text)::BIGINT AS size, strlen(text) > 4096 AS too_large FROM documents""")
def attachment_cap(spark, d):
    from shroudline.operators import attachments as A

    parts = V.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return A.flag_too_large(parts, 4096).select("doc_id", F.octet_length("content").cast("bigint").alias("size"), "too_large")


@query("preview_text", """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '[binary request body]' ELSE substring(text, 1, 256) END AS preview FROM documents""")
def preview_text(spark, d):
    body = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit(b"\xff\xfe"), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return V.table(spark, d, "documents").select("doc_id", T.preview(body, 256).alias("preview"))


@query("truncate_middle", "SELECT page_id, CASE WHEN length(url) <= 32 THEN url ELSE left(url, 14) || '...' || right(url, 15) END AS shown FROM pages")
def truncate_middle(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.truncate_middle(F.col("url"), 32).alias("shown"))


LINE = """CASE event_id % 8 WHEN 0 THEN concat('data: ', props) WHEN 1 THEN concat('data:data:  plain ', event_type, ' ') WHEN 2 THEN ': comment'
  WHEN 3 THEN 'data: [DONE]' WHEN 4 THEN '' WHEN 5 THEN concat('event: ', event_type) WHEN 6 THEN 'data:   ' ELSE concat('data:', event_id) END"""


@query("sse_parse", f"""SELECT event_id, payload, CASE WHEN payload IS NULL THEN 'pass' WHEN json_valid(payload) THEN 'json' ELSE 'text' END AS kind FROM (
  SELECT event_id, CASE WHEN starts_with(line, 'data:') AND p NOT IN ('', '[DONE]') THEN p END AS payload
  FROM (SELECT event_id, line, trim(regexp_replace(line, '^(data:)+', '')) AS p FROM (SELECT event_id, {LINE} AS line FROM events)))""")
def sse_parse(spark, d):
    rows = V.table(spark, d, "events").select("event_id", T.sse_payload(F.expr(LINE)).alias("payload"))
    kind = F.when(F.col("payload").isNull(), "pass").when(T.parses(F.col("payload")), "json").otherwise("text")
    return rows.select("event_id", "payload", kind.alias("kind"))


@query("header_filter", """SELECT event_id, concat('accept=', event_type, ',content-type=application/json,x-request-id=', event_id) AS forwarded,
  concat('accept=', event_type, ',content-type=application/json,x-other=1') AS returned FROM events""")
def header_filter(spark, d):
    headers = F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in (
        "Accept", F.col("event_type"), "Content-Type", "application/json", "Connection", "close", "TE", "trailers",
        "Content-Length", "12", "X-Other", "1")])
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    allow = ("accept", "content-type", "connection", "x-request-id")
    rows = V.table(spark, d, "events").select("event_id", headers.alias("h"))
    return rows.select(
        "event_id", shown(T.forward_headers(F.col("h"), allow, F.col("event_id").cast("string"))).alias("forwarded"),
        shown(T.response_headers(F.col("h"))).alias("returned"),
    )


@query("host_extract", r"""SELECT page_id, regexp_replace(lower(coalesce(CASE WHEN page_id % 3 <> 0 THEN regexp_extract(url, '^https?://([^/:?#]+)', 1) END,
  concat('Host', page_id % 5, '.Example.COM.'))), '\.+$', '') AS host FROM pages""")
def host_extract(spark, d):
    page = F.col("page_id")
    header = F.concat(F.lit("Host"), page % 5, F.lit(".Example.COM.:8443"))
    return V.table(spark, d, "pages").select("page_id", T.host_of(F.when(page % 3 != 0, F.col("url")), header).alias("host"))


# Usage bodies: both spellings of the token counts, zeros, a count that is no number, no JSON.
USAGE = """CASE event_id % 6
  WHEN 0 THEN concat('{"model":"', event_type, '","usage":{"prompt_tokens":', CAST(floor(value) AS INT), ',"completion_tokens":', event_id % 50, '}}')
  WHEN 1 THEN concat('{"model":"', event_type, '","usage":{"input_tokens":', CAST(floor(value) AS INT), ',"output_tokens":', event_id % 50, '}}')
  WHEN 2 THEN '{"model":"m","usage":{"prompt_tokens":0,"completion_tokens":0}}'
  WHEN 3 THEN concat('{"usage":{"prompt_tokens":"x","input_tokens":9,"output_tokens":', event_id % 7, '}}')
  WHEN 4 THEN concat('{"model":', event_id, '}') ELSE concat('not json ', event_id) END"""
USAGE_SQL = f"""used AS (SELECT event_id, user_id, ts, model, p, c FROM (SELECT event_id, user_id, ts,
    CASE WHEN event_id % 6 IN (0, 1) THEN event_type WHEN event_id % 6 = 2 THEN 'm' END AS model,
    CASE WHEN event_id % 6 IN (0, 1) THEN floor(value)::BIGINT ELSE 0 END AS p,
    CASE event_id % 6 WHEN 0 THEN event_id % 50 WHEN 1 THEN event_id % 50 WHEN 3 THEN event_id % 7 ELSE 0 END AS c FROM events) WHERE p > 0 OR c > 0)"""


def usage_bodies(spark, d):
    return V.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value").select(
        "event_id", "user_id", "ts", F.expr(USAGE).alias("body"))


@query("usage_model", "SELECT event_id, CASE WHEN event_id % 6 IN (0, 1) THEN event_type WHEN event_id % 6 = 2 THEN 'm' END AS model FROM events")
def usage_model(spark, d):
    return usage_bodies(spark, d).select("event_id", U.model_of(F.col("body")).alias("model"))


@query("usage_tokens", f"WITH {USAGE_SQL} SELECT event_id, model, p AS prompt_tokens, c AS completion_tokens FROM used")
def usage_tokens(spark, d):
    return U.usages(usage_bodies(spark, d), "event_id")


@query("usage_sse_first", f"""WITH {USAGE_SQL} SELECT user_id, arg_min(coalesce(model, ''), event_id) AS model, arg_min(p, event_id) AS prompt_tokens,
  arg_min(c, event_id) AS completion_tokens FROM used GROUP BY user_id""")
def usage_sse_first(spark, d):
    lines = usage_bodies(spark, d).select("user_id", "event_id", T.sse_payload(F.concat(F.lit("data: "), "body")).alias("payload"))
    first = U.first_usage(lines, "payload", "user_id", "event_id")
    return first.select("user_id", F.coalesce("model", F.lit("")).alias("model"), "prompt_tokens", "completion_tokens")


@query("m_llm_tokens", f"""WITH {USAGE_SQL} SELECT coalesce(model, 'unknown') AS model, 'prompt' AS kind, sum(p)::BIGINT AS tokens FROM used GROUP BY 1
  UNION ALL SELECT coalesce(model, 'unknown'), 'completion', sum(c)::BIGINT FROM used GROUP BY 1""")
def m_llm_tokens(spark, d):
    return U.meter(U.usages(usage_bodies(spark, d)))


@query("m_llm_requests", """SELECT CASE WHEN event_id % 6 IN (0, 1) THEN event_type WHEN event_id % 6 = 2 THEN 'm' END AS model, count(*) AS n FROM events
  WHERE event_id % 6 IN (0, 1, 2) GROUP BY 1""")
def m_llm_requests(spark, d):
    from shroudline.operators import metrics as M

    return M.count_llm_requests(usage_bodies(spark, d))


# Stream lines carrying one text each, as JSON delta or plain, and as many marks, numbered from MARKS on.
MARKS = 1_000_000_000


def sse_lines(spark, d):
    text, kind = F.col("text"), F.col("kind")
    docs = V.scan_docs(spark, d)
    rows = docs.select("doc_id", (F.col("doc_id") % 2).alias("kind"), "text").unionByName(
        docs.select((F.col("doc_id") + MARKS).alias("doc_id"), (F.col("doc_id") % 2 + 2).alias("kind"), F.lit("").alias("text"))
    )
    line = (
        F.when(kind == 0, F.concat(F.lit("data: "), F.to_json(F.struct(text.alias("delta")))))
        .when(kind == 1, F.concat(F.lit("data: "), F.replace(text, F.lit("\n"), F.lit(" "))))
        .when(kind == 2, F.lit("data: [DONE]")).otherwise(F.lit(": keep-alive"))
    )
    return rows.select("doc_id", (F.col("doc_id") % 11).alias("stream_id"), line.alias("line"))


SSE_SQL = f"""sse AS (SELECT doc_id, doc_id % 11 AS stream_id, doc_id % 2 AS kind,
    CASE WHEN doc_id % 2 = 0 THEN text ELSE trim(replace(text, chr(10), ' ')) END AS text FROM scan_docs
    UNION ALL SELECT doc_id + {MARKS}, (doc_id + {MARKS}) % 11, 2 + doc_id % 2, '' FROM scan_docs),
  sse_findings AS ({S.findings_sql('sse', 'doc_id')}),
  sse_resolved AS (SELECT *, CASE WHEN unauthorized_action = 'allow' THEN 'allow' ELSE 'redact' END AS effective_action FROM sse_findings),
  sse_redacted AS ({S.redacted_sql('sse_resolved', 'sse', 'doc_id')}),
  sse_out AS (SELECT s.doc_id, s.stream_id, coalesce(f.secret, false) AS secret, coalesce(f.top, 0) AS top, coalesce(f.n, 0) AS n,
      CASE s.kind WHEN 0 THEN concat('data: ', to_json({{'delta': r.redacted}}), chr(10)) WHEN 1 THEN concat('data: ', r.redacted, chr(10))
        WHEN 2 THEN 'data: [DONE]' ELSE ': keep-alive' END AS line_out
    FROM sse s JOIN sse_redacted r ON r.doc_id = s.doc_id LEFT JOIN (SELECT doc_id, bool_or(label = 'secret_like') AS secret, count(*) AS n,
      max({S.case('unauthorized_action', S.ACTION_RANK)}) AS top FROM sse_resolved GROUP BY doc_id) f ON f.doc_id = s.doc_id)"""


@query("sse_redact", f"""WITH {SSE_SQL} SELECT doc_id, line_out AS line, {S.action_of('top')} AS decision, CASE WHEN secret THEN 'opa' ELSE 'builtin' END AS source FROM sse_out""")
def sse_redact(spark, d):
    rows = Y.redact_lines(sse_lines(spark, d), V.CONFIG, P.local_principal(), rules=DEFAULT_POLICY_RULES)
    return rows.select("doc_id", F.col("out").alias("line"), "decision", "source")
