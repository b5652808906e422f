"""Sources, sinks and streaming queries.

Each writes what it needs from the driver tables to a new folder on shared storage, runs the stream
to its end, and reads the result back.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from shroudline.config import DEFAULT_POLICY_RULES
from shroudline.functions import sql as FS
from shroudline.operators import lines as L, payloads as Y, policy as P, skew
from shroudline.operators.sessions import micros
from shroudline.plans import audits as PA, drifts as PD, payloads as PP, reviews as PR, sessions as PN, sql as S, views as V
from shroudline.plans import metrics as _metrics, policies as PPOL  # noqa: F401  their SQL is built upon here
from shroudline.plans.registry import ORACLES, query
from shroudline.sources import logs, traffic as TR
from shroudline.streaming import counters as C, jobs as J, outcomes as O, sessions as SS, tickets as TB


def live(spark, d, name):
    """A driver table as a stream of its file."""
    schema = V.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@contextmanager
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, SS.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def finished(spark, stream, name):
    folder = J.work_dir(spark, name)
    J.run_to_files(stream, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/data")


CHUNK = 100


@query("sse_lines", """WITH s AS (SELECT doc_id % 50 AS stream_id, string_split(string_agg(text, '' ORDER BY doc_id), chr(10)) AS lines FROM scan_docs GROUP BY 1)
  SELECT stream_id, n AS line_no, line FROM (SELECT stream_id, unnest(lines) AS line, unnest(range(len(lines))) AS n, len(lines) AS total FROM s) WHERE n < total - 1 OR line <> ''""")
def sse_lines(spark, d):
    docs = V.scan_docs(spark, d).select("doc_id", F.col("text").cast("binary").alias("raw"))
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / CHUNK).cast("int"))
    cut = docs.select("doc_id", "raw", F.explode(starts).alias("i"))
    chunks = cut.select(
        (F.col("doc_id") % 50).alias("stream_id"), (F.col("doc_id") * 100_000 + F.col("i")).alias("seq"),
        F.substring(F.col("raw"), F.col("i") * CHUNK + 1, F.lit(CHUNK)).alias("chunk"),
    )
    return L.reassemble_lines(chunks).select("stream_id", "line_no", "line")


OUTCOME_SQL = f"""WITH {PP.SSE_SQL}, x AS (SELECT stream_id, doc_id, n, {{'r': top::BIGINT, 's': CASE WHEN secret THEN 'opa' ELSE 'builtin' END,
    'c': CASE WHEN secret THEN 'OPA forces response redaction when secret_like appears' END}} AS x FROM sse_out),
  y AS (SELECT stream_id, sum(n)::BIGINT AS n_findings, count(*) AS n_lines, list_reduce(list(x ORDER BY doc_id), lambda a, b: {{
      'r': greatest(a.r, b.r),
      's': CASE WHEN b.r > a.r OR (b.r = a.r AND a.s = 'builtin' AND b.s <> 'builtin') OR (a.c IS NULL AND b.c IS NOT NULL) THEN b.s ELSE a.s END,
      'c': CASE WHEN b.r > a.r OR (b.r = a.r AND a.s = 'builtin' AND b.s <> 'builtin') OR (a.c IS NULL AND b.c IS NOT NULL) THEN b.c ELSE a.c END}},
      {{'r': 0::BIGINT, 's': 'builtin', 'c': NULL::VARCHAR}}) AS y FROM x GROUP BY stream_id)
  SELECT stream_id, (['allow','redact','review','block'])[y.r + 1] AS decision, y.s AS source, y.c AS reason, n_findings, n_lines FROM y"""


@query("sse_outcome", OUTCOME_SQL)
def sse_outcome(spark, d):
    lines = PP.sse_lines(spark, d).withColumn("seq", F.col("doc_id"))
    return L.stream_outcome(Y.redact_lines(lines, V.CONFIG, P.local_principal(), rules=DEFAULT_POLICY_RULES))


def outcome_lines(spark, d):
    """The rewritten lines as files of a stream, numbered per stream, dealt out regardless of order, some of them twice."""
    from pyspark.sql import Window

    folder = J.work_dir(spark, "outcome-lines")
    lines = PP.sse_lines(spark, d)
    done = Y.redact_lines(lines, V.CONFIG, P.local_principal(), rules=DEFAULT_POLICY_RULES)
    of = Window.partitionBy("stream_id")
    # only what is judged of a line is numbered, neither its text nor its findings
    judged = O.judged_lines(done, F.col("doc_id"), F.col("doc_id"), F.lit(False))
    numbered = judged.withColumn("seq", F.row_number().over(of.orderBy("us")).cast("bigint") - 1)
    judged = numbered.withColumn("last", F.col("seq") == F.count("*").over(of) - 1)
    part = F.pmod(F.xxhash64("stream_id", "seq"), F.lit(5))
    twice = F.when(F.col("seq") % 7 == 0, F.array(part, F.pmod(part + 1, F.lit(5)))).otherwise(F.array(part))
    judged.withColumn("part", F.explode(twice)).repartition(5, "part").drop("part").write.parquet(folder)
    schema = judged.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("stream_outcome_live", OUTCOME_SQL)
def stream_outcome_live(spark, d):
    """The outcomes of sse_outcome, from keyed state over several batches."""
    with rocksdb(spark):
        out = finished(spark, O.outcome_stream(outcome_lines(spark, d)), "outcomes")
    return out.where("ended").select(F.col("stream_id").cast("bigint").alias("stream_id"), "decision", "source", "reason", "n_findings", "n_lines")


@query("stream_outcome_audit", OUTCOME_SQL.replace("SELECT stream_id, (['allow'", "SELECT stream_id::VARCHAR AS request_id, (['allow'").replace(
    "y.s AS source, y.c AS reason, n_findings, n_lines FROM y", "y.s AS policy_source, y.c AS decision_reason FROM y"))
def stream_outcome_audit(spark, d):
    """One audit record per stream, appended by the live sink and read back."""
    folder = J.work_dir(spark, "outcome-audit")
    with rocksdb(spark):
        J.run_audit_sink(O.outcome_audit(O.outcome_stream(outcome_lines(spark, d))), folder).awaitTermination()
    return logs.read_audit(spark, f"{folder}/data").select("request_id", "decision", "policy_source", "decision_reason")


@query("stream_sse_redact", f"WITH {PP.SSE_SQL} SELECT doc_id, line_out AS line, {S.action_of('top')} AS decision FROM sse_out")
def stream_sse_redact(spark, d):
    folder = J.work_dir(spark, "sse-lines")
    lines = PP.sse_lines(spark, d).select(F.col("stream_id").cast("string").alias("stream_id"), F.col("doc_id").alias("seq"), "line")
    lines.write.parquet(f"{folder}/in")
    stream = TR.read_sse_stream(spark, f"{folder}/in")
    out = J.redact_stream(stream, V.CONFIG, P.local_principal(), DEFAULT_POLICY_RULES)
    return finished(spark, out.select("seq", "out", "decision"), "sse-out").select(F.col("seq").alias("doc_id"), F.col("out").alias("line"), "decision")


@query("stream_session", f"WITH {PN.ESCALATED} SELECT event_id, escalated FROM esc")
def stream_session(spark, d):
    ts = F.col("ts").cast("timestamp")
    labels = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array("event_type"))
    rows = live(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("row_id"), ts.alias("ts"),
        micros(ts).alias("us"), labels.alias("labels"),
    )
    with rocksdb(spark):
        done = finished(spark, SS.correlate_stream(rows, PN.TTL, PN.THRESHOLD), "sessions")
    return done.select(F.col("row_id").cast("bigint").alias("event_id"), "escalated")


@query("stream_counters", "SELECT epoch_us(date_trunc('hour', ts)) AS window_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counters(spark, d):
    folder = J.work_dir(spark, "counters")
    events = live(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    J.run_counters(events, ["event_type"], folder).awaitTermination()
    rows = J.latest_counters(spark, folder, ["window", "event_type"])
    return rows.select(micros(F.col("window.start")).alias("window_us"), "event_type", "n")


def counter_events(spark, d):
    """Everything that counts, as rows of one event table."""
    from functools import reduce

    from shroudline.operators import usage as U
    from shroudline.plans import metrics as PM

    audit = PM.judged_audit(spark, d).select(F.struct("direction", "decision", "policy_source", "matched_labels", "error_stage", "error_kind").alias("audit"))
    failures = P.auth_failures(PPOL.credentials(spark, d), P.principals_df(spark, S.CALLERS[:3])).select(F.col("reason").alias("auth_failure"))
    resolved = PR.review_log(spark, d).where("type = 'resolved'").select(F.col("status").alias("resolution"))
    bodies = PP.usage_bodies(spark, d)
    # a body without usage is a request to a model; one with usage adds its tokens
    models = bodies.select(skew.bound(U.model_of(F.col("body"))).alias("model")).where("model is not null")
    tokens = U.usages(bodies).select(F.coalesce("model", F.lit("unknown")).alias("used_by"), "prompt_tokens", "completion_tokens")
    timing = PM.latency(spark, d).select(F.struct("direction", "kind", "seconds").alias("timing"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (audit, failures, resolved, models, tokens, timing)).select(*[
        F.col(name).cast(kind).alias(name) for name, kind in C.FIELDS
    ])


def counts_sql(name, family, *keys, n="n"):
    levels = [*keys, *["NULL"] * (3 - len(keys))]
    return f"SELECT '{family}' AS family, {', '.join(f'{k}::VARCHAR AS k{i}' for i, k in enumerate(levels, 1))}, {n}::DOUBLE AS n FROM ({ORACLES[name]})"


def all_counts_sql():
    from shroudline.plans import metrics as PM

    buckets = [counts_sql("m_histogram", "seconds_bucket", "direction", "kind", f"'{le}'", n=f"le_{str(le).replace('.', '_')}") for le in PM.M.BUCKETS]
    return " UNION ALL ".join([
        counts_sql("m_requests", "requests_total", "direction", "decision"), counts_sql("m_decisions", "policy_decisions_total", "direction", "decision", "source"),
        counts_sql("m_fallbacks", "processing_fallback_total", "kind"), counts_sql("m_detections", "detections_total", "direction", "label"),
        counts_sql("m_auth_failures", "auth_failures_total", "reason"), counts_sql("m_review_events", "review_events_total", "event"),
        counts_sql("m_llm_requests", "llm_requests_total", "model"), counts_sql("m_llm_tokens", "llm_tokens_total", "model", "kind", n="tokens"),
        counts_sql("m_histogram", "seconds_count", "direction", "kind", n="count"), counts_sql("m_histogram", "seconds_sum", "direction", "kind", n="sum_seconds"),
        *[f"SELECT * FROM ({b}) WHERE n > 0" for b in buckets],
    ])


BATCHES = 5


@query("stream_m_all", all_counts_sql())
def stream_m_all(spark, d):
    """All counters of a live stream over several batches, added up every two of them."""
    folder = J.work_dir(spark, "all-counters")
    events = counter_events(spark, d)
    # a batch is as many files as there are cores: one file would be counted by one of them
    files = max(2, spark.sparkContext.defaultParallelism)
    events.repartition(BATCHES * files, F.rand(3)).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    C.run_all_counters(stream, folder, every=2).awaitTermination()
    return C.all_counters(spark, folder).select(*C.KEYS, F.round("n", 6).alias("n"))


@query("stream_review", f"WITH {PR.REVIEW_SQL} SELECT fingerprint, arg_min(event_id, (us, event_id)) AS event_id FROM base WHERE event_type = 'click' GROUP BY fingerprint")
def stream_review(spark, d):
    from shroudline.operators import reviews as W

    folder = J.work_dir(spark, "reviews")
    asked = live(spark, d, "events").where("event_type = 'click'").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("request_id"),
        W.fingerprint(F.expr(PR.TENANT), F.expr(PR.PATH), F.sha2(F.expr(PR.BODY), 256)).alias("fingerprint"),
    )
    J.run_review_ingest(asked, folder).awaitTermination()
    return spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data").select("fingerprint", "event_id")


@query("stream_review_reopen", PR.HISTORY_SQL)
def stream_review_reopen(spark, d):
    """Ticket ingest fed with the resolutions that the events give."""
    folder = J.work_dir(spark, "reopen")
    log = PR.review_log(spark, d).where("type = 'resolved'").select("ticket_id", "status", "resolved_at")
    log.write.parquet(f"{folder}/log")
    asked = PR.rows_of(live(spark, d, "events")).where("event_type = 'signup'").select("fingerprint", "event_id", "ts", F.concat(F.lit("t"), "event_id").alias("request_id"))
    resolutions = spark.readStream.schema(log.schema).parquet(f"{folder}/log")
    J.run_review_ingest(asked, folder, resolutions=resolutions).awaitTermination()
    return spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data").select("fingerprint", "event_id")


@query("stream_review_keyed", PR.HISTORY_SQL)
def stream_review_keyed(spark, d):
    """The same tickets from keyed state: a batch reads no ticket but the latest of its fingerprints."""
    folder = J.work_dir(spark, "keyed")
    named = PR.rows_of(V.table(spark, d, "events")).select("fingerprint", F.concat(F.lit("t"), "event_id").alias("ticket_id"))
    log = PR.review_log(spark, d).where("type = 'resolved'").select("ticket_id", "resolved_at").join(named, "ticket_id")
    log.write.parquet(f"{folder}/log")
    asked = PR.rows_of(live(spark, d, "events")).where("event_type = 'signup'").select("fingerprint", "ts", F.concat(F.lit("t"), "event_id").alias("request_id"))
    with rocksdb(spark):
        out = finished(spark, TB.ticket_stream(asked, spark.readStream.schema(log.schema).parquet(f"{folder}/log")), "keyed-out")
    return out.select("fingerprint", F.substring("request_id", 2, 30).cast("bigint").alias("event_id"))


def audit_records(spark, d):
    return PA.audit(spark, d).withColumn("ts", F.timestamp_seconds("ts"))


def short(rows):
    return rows.select("request_id", micros(F.col("ts")).alias("ts_us"), "decision", V.joined(F.col("matched_labels")).alias("labels"), F.size("findings").cast("bigint").alias("n"))


AUDIT_SQL = "SELECT request_id, ts * 1000000 AS ts_us, decision, labels, CASE WHEN labels = '' THEN 0 ELSE len(string_split(labels, ',')) END AS n FROM audit"


@query("audit_roundtrip", AUDIT_SQL)
def audit_roundtrip(spark, d):
    folder = J.work_dir(spark, "audit")
    logs.append_audit(audit_records(spark, d), folder)
    return short(logs.read_audit(spark, folder))


@query("audit_read_skip_bad", AUDIT_SQL)
def audit_read_skip_bad(spark, d):
    """Broken lines and lines of another shape, one per document, are skipped."""
    folder = J.work_dir(spark, "audit-bad")
    logs.append_audit(audit_records(spark, d), folder)
    docs = V.table(spark, d, "documents")
    docs.select(F.concat(F.lit('{"request_id": "'), "doc_id", F.when(F.col("doc_id") % 2 == 0, '", "decision": ').otherwise('"}'))).write.mode("append").text(folder)
    return short(logs.read_audit(spark, folder))


@query("stream_audit_tail", AUDIT_SQL)
def stream_audit_tail(spark, d):
    folder = J.work_dir(spark, "audit-live")
    logs.append_audit(audit_records(spark, d), folder)
    return short(finished(spark, logs.stream_audit(spark, folder), "audit-tail"))


EVENT_SQL = f"WITH {PR.REVIEW_SQL} SELECT ticket_id, type, at_us, coalesce(status, 'pending') AS status FROM log"


def event_rows(rows):
    at = F.coalesce("resolved_at", "ticket.created_at")
    return rows.select(F.coalesce("ticket_id", "ticket.id").alias("ticket_id"), "type", micros(at).alias("at_us"), F.coalesce("status", F.lit("pending")).alias("status"))


@query("review_events_append", EVENT_SQL)
def review_events_append(spark, d):
    folder = J.work_dir(spark, "review-log")
    log = PR.review_log(spark, d)
    logs.append_review_events(log.where("type = 'created'"), folder)
    logs.append_review_events(log.where("type = 'resolved'"), folder)
    return event_rows(logs.read_review_events(spark, folder))


@query("review_events_read", f"WITH {PR.REVIEW_SQL} SELECT ticket_id, status, resolved_us FROM tickets")
def review_events_read(spark, d):
    """The log read back, broken lines left out, and folded to tickets."""
    from shroudline.operators import reviews as W

    folder = J.work_dir(spark, "review-read")
    logs.append_review_events(PR.review_log(spark, d), folder)
    V.table(spark, d, "documents").select(F.concat(F.lit('{"type":"resolved","doc":'), "doc_id", F.when(F.col("doc_id") % 2 == 0, "}").otherwise(""))).write.mode("append").text(folder)
    return W.fold_tickets(logs.read_review_events(spark, folder)).select("ticket_id", "status", micros(F.col("resolved_at")).alias("resolved_us"))


def summary_document(spark, d, folder):
    rows = PD.summary(spark, d)
    runs = F.transform("sample_runs", lambda s: F.struct(*[s[c].alias(c) for c in ("run", "throughput_rps", "avg_ms", "p95_ms", "ok")]))
    scenario = F.struct(
        "scenario", "ok", "throughput_rps",
        F.struct(*[F.col(f"{c}_ms").alias(c) for c in ("avg", "p50", "p95", "min", "max")]).alias("latency_ms"),
        F.struct(F.lit("median").alias("method"), F.col("n_runs").cast("int").alias("runs"), runs.alias("sample_runs")).alias("aggregation"),
    )
    # a summary is one document with one entry per scenario
    doc = rows.agg(F.collect_list(scenario).alias("scenarios")).select(
        F.lit("2024-02-01T00:00:00Z").alias("generated_at"), F.size("scenarios").alias("scenario_count"),
        F.struct(F.lit("median").alias("method"), F.lit(3).alias("runs")).alias("aggregation"), "scenarios",
    )
    doc.write.json(folder)


@query("bench_summary_scan", f"WITH {PD.BOTH_SQL} SELECT scenario, 'median' AS method, throughput_rps, avg_ms, p95_ms, ok, n_runs AS runs FROM cur_sum")
def bench_summary_scan(spark, d):
    folder = J.work_dir(spark, "summary")
    summary_document(spark, d, folder)
    rows = logs.read_bench_summary(spark, folder)
    return rows.select("scenario", "method", "throughput_rps", "avg_ms", "p95_ms", "ok", F.size("sample_runs").cast("bigint").alias("runs"))


@query("bench_promote", f"WITH {PD.BOTH_SQL} SELECT scenario, throughput_rps, avg_ms FROM cur_sum")
def bench_promote(spark, d):
    folder = J.work_dir(spark, "promote")
    summary_document(spark, d, f"{folder}/current")
    logs.promote_baseline(spark, f"{folder}/current", f"{folder}/baseline")
    return logs.read_bench_summary(spark, f"{folder}/baseline").select("scenario", "throughput_rps", "avg_ms")


@query("attachments_scan", "SELECT count(*) > 0 AS any_file, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents")
def attachments_scan(spark, d):
    folder = J.work_dir(spark, "attachments")
    V.table(spark, d, "documents").select("text").write.text(folder)
    files = TR.read_attachments(spark, folder, "*.txt")
    return files.agg((F.count("*") > 0).alias("any_file"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


@query("find_pii_sql", "SELECT doc_id, label, start_::BIGINT AS span_start, matched FROM findings")
def find_pii_sql(spark, d):
    FS.register(spark, V.CONFIG)
    V.scan_docs(spark, d).createOrReplaceTempView("shroudline_texts")
    return spark.sql("SELECT doc_id, label, CAST(start AS BIGINT) AS span_start, matched FROM shroudline_texts LATERAL VIEW inline(find_pii(text)) f AS label, start, end, matched")


@query("stream_lines", """WITH s AS (SELECT doc_id AS stream_id, string_split(text, chr(10)) AS lines FROM scan_docs)
  SELECT stream_id, n AS line_no, line FROM (SELECT stream_id, unnest(lines) AS line, unnest(range(len(lines))) AS n, len(lines) AS total FROM s) WHERE n < total - 1 OR line <> ''""")
def stream_lines(spark, d):
    folder = J.work_dir(spark, "chunks")
    raw = F.col("text").cast("binary")
    half = F.floor(F.octet_length(raw) / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(0).cast("bigint").alias("seq"), F.substring(raw, F.lit(1), half).alias("chunk"), F.lit(False).alias("last")),
        F.struct(F.lit(1).cast("bigint").alias("seq"), F.substring(raw, half + 1, F.octet_length(raw)).alias("chunk"), F.lit(True).alias("last")),
    )
    V.scan_docs(spark, d).select(F.col("doc_id").cast("string").alias("stream_id"), F.explode(parts).alias("p")).select("stream_id", "p.*").write.parquet(f"{folder}/in")
    chunks = TR.read_sse_stream(spark, f"{folder}/in", TR.CHUNKS + ", last boolean")
    with rocksdb(spark):
        done = finished(spark, SS.reassemble_stream(chunks), "lines")
    return done.select(F.col("stream_id").cast("bigint").alias("stream_id"), "line_no", "line")
