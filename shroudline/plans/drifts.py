"""Drift queries: event values as latencies, the first half of the month as baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from shroudline.operators import drift as B, skew
from shroudline.plans import views as V
from shroudline.plans.registry import query

SPLIT = "2024-01-16 00:00:00"
# An extra scenario without a baseline, and faster current runs of one, so that every class occurs.
SCENARIO = "CASE WHEN user_id % 10 = 0 AND ts >= TIMESTAMP_NTZ '2024-01-16 00:00:00' THEN 'fresh' ELSE concat(event_type, '-', user_id % 10 % 4) END"
LATENCY = "CASE WHEN event_type = 'view' AND ts >= TIMESTAMP_NTZ '2024-01-16 00:00:00' THEN value * 0.5 ELSE value END"


def facts(spark, d):
    """Latencies of both halves of the time; ``current`` tells which."""
    return V.table(spark, d, "events").select(
        F.expr(f"ts >= TIMESTAMP_NTZ '{SPLIT}'").alias("current"), F.expr(SCENARIO).alias("scenario"), (F.col("user_id") % 3).alias("run"),
        F.expr(LATENCY).alias("latency_ms"), F.col("ts").cast("timestamp").alias("started_at"),
    )


def with_marks(rows):
    return rows.withColumn("ok", F.col("max_ms") < 480).withColumn("sources", F.array(F.concat(F.lit("src-"), F.col("run")), F.lit("builtin")))


def stats(spark, d):
    """Figures of the runs of the current half."""
    return with_marks(B.run_stats(facts(spark, d).where("current"), ["scenario", "run"]))


def summary(spark, d):
    return B.median_runs(stats(spark, d))


def summaries(spark, d):
    """Medians of the current and of the earlier half, from one pass with the half as a key."""
    rows = with_marks(skew.settle(B.run_stats(facts(spark, d).where("current IS NOT NULL"), ["current", "scenario", "run"])))
    return tuple(B.median_runs(rows.where(half).drop("current")) for half in ("current", "NOT current"))


def _stats_sql(name: str, where: str) -> str:
    return f"""{name}_facts AS (SELECT {SCENARIO} AS scenario, user_id % 3 AS run, {LATENCY} AS latency_ms, ts FROM events WHERE {where}),
  {name}_stats AS (SELECT scenario, run, count(*) AS n, count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS throughput_rps, min(latency_ms) AS min_ms,
    max(latency_ms) AS max_ms, avg(latency_ms) AS avg_ms, list_sort(list(latency_ms))[floor((count(*) - 1) * 0.5)::BIGINT + 1] AS p50_ms,
    list_sort(list(latency_ms))[floor((count(*) - 1) * 0.95)::BIGINT + 1] AS p95_ms, max(latency_ms) < 480 AS ok FROM {name}_facts GROUP BY ALL),
  {name}_sum AS (SELECT scenario, round(median(throughput_rps), 2) AS throughput_rps, round(median(min_ms), 3) AS min_ms, round(median(p50_ms), 3) AS p50_ms,
    round(median(p95_ms), 3) AS p95_ms, round(median(max_ms), 3) AS max_ms, round(median(avg_ms), 3) AS avg_ms, bool_and(ok) AS ok, count(*) AS n_runs,
    min(round(throughput_rps, 2)) AS throughput_rps_low, max(round(throughput_rps, 2)) AS throughput_rps_high, min(round(avg_ms, 3)) AS avg_ms_low,
    max(round(avg_ms, 3)) AS avg_ms_high, min(round(p95_ms, 3)) AS p95_ms_low, max(round(p95_ms, 3)) AS p95_ms_high,
    string_agg(concat('src-', run), ',' ORDER BY run) AS srcs FROM {name}_stats GROUP BY scenario)"""


BOTH_SQL = (_stats_sql("cur", f"ts >= TIMESTAMP '{SPLIT}'") + ", " + _stats_sql("base", f"ts < TIMESTAMP '{SPLIT}'")).replace("TIMESTAMP_NTZ", "TIMESTAMP")


def _delta(metric: str) -> str:
    return f"CASE WHEN abs(b.{metric}) >= {B.EPSILON!r} THEN (c.{metric} - b.{metric}) / b.{metric} * 100 END"


def _signal(metric: str, worse: bool) -> str:
    if metric == "throughput_rps":
        return f"coalesce(d_{metric} {'<= -5' if worse else '>= 5'}, false)"
    floor = {"avg_ms": 0.25, "p95_ms": 0.5}[metric]
    test = f"d_{metric} >= 10 AND {metric}_c - {metric}_b >= {floor}" if worse else f"d_{metric} <= -10 AND {metric}_b - {metric}_c >= {floor}"
    return f"coalesce({test}, false)"


def _decisive(metric: str, worse: bool) -> str:
    low_side = (metric == "throughput_rps") == worse
    return f"coalesce({f'c_high_{metric} < b_low_{metric}' if low_side else f'c_low_{metric} > b_high_{metric}'}, false)"


ROWS_SQL = f"""{BOTH_SQL}, joined AS (SELECT c.scenario, c.ok, b.scenario AS known, {', '.join(
    f'c.{m} AS {m}_c, b.{m} AS {m}_b, {_delta(m)} AS d_{m}, c.{m}_low AS c_low_{m}, c.{m}_high AS c_high_{m}, b.{m}_low AS b_low_{m}, b.{m}_high AS b_high_{m}' for m in B.METRICS)}
  FROM cur_sum c LEFT JOIN base_sum b ON b.scenario = c.scenario),
  judged AS (SELECT *, CASE WHEN known IS NULL THEN 'new' WHEN {' OR '.join(_signal(m, True) for m in B.METRICS)} THEN 'regression'
      WHEN {' OR '.join(_signal(m, False) for m in B.METRICS)} THEN 'improvement' ELSE 'unchanged' END AS plain,
    CASE WHEN known IS NULL THEN 'new' WHEN {' OR '.join(f'({_signal(m, True)} AND {_decisive(m, True)})' for m in B.METRICS)} THEN 'regression'
      WHEN {' OR '.join(f'({_signal(m, False)} AND {_decisive(m, False)})' for m in B.METRICS)} THEN 'improvement' ELSE 'unchanged' END AS gated,
    concat_ws(',', {', '.join(f"CASE WHEN {_signal(m, True)} THEN '{m}' END" for m in B.METRICS)}) AS raw_regressions,
    concat_ws(',', {', '.join(f"CASE WHEN {_signal(m, True)} AND NOT {_decisive(m, True)} THEN '{m}' END" for m in B.METRICS)}) AS suppressed_regressions,
    concat_ws(',', {', '.join(f"CASE WHEN {_signal(m, False)} AND NOT {_decisive(m, False)} THEN '{m}' END" for m in B.METRICS)}) AS suppressed_improvements
  FROM joined)"""

FIGURES = ("throughput_rps", "min_ms", "p50_ms", "p95_ms", "max_ms", "avg_ms")


def rounded(rows, *names, places=6):
    return [F.round(n, places).alias(n) for n in names]


@query("bench_run_stats", f"WITH {BOTH_SQL} SELECT scenario, run, n, {', '.join(f'round({c}, 6) AS {c}' for c in FIGURES)} FROM cur_stats")
def bench_run_stats(spark, d):
    rows = stats(spark, d)
    return rows.select("scenario", "run", "n", *rounded(rows, *FIGURES))


@query("bench_median", f"WITH {BOTH_SQL} SELECT scenario, {', '.join(FIGURES)}, ok, n_runs, 'builtin,' || srcs AS sources FROM cur_sum")
def bench_median(spark, d):
    return summary(spark, d).select("scenario", *FIGURES, "ok", "n_runs", V.joined(F.col("sources")).alias("sources"))


@query("pct_delta", "SELECT event_id, CASE WHEN abs(b) >= 2.220446049250313e-16 THEN round((value - b) / b * 100, 6) END AS delta FROM (SELECT event_id, value, (event_id % 5)::DOUBLE AS b FROM events)")
def pct_delta(spark, d):
    base = (F.col("event_id") % 5).cast("double")
    return V.table(spark, d, "events").select("event_id", F.round(B.pct_delta(F.col("value"), base), 6).alias("delta"))


@query("bench_drift", f"WITH {ROWS_SQL} SELECT scenario, plain AS classification, {', '.join(f'round(d_{m}, 6) AS {m}_delta' for m in B.METRICS)} FROM judged")
def bench_drift(spark, d):
    rows = B.drift(*summaries(spark, d))
    return rows.select("scenario", "classification", *rounded(rows, *[f"{m}_delta" for m in B.METRICS]))


@query("bench_drift_counts", f"WITH {ROWS_SQL} SELECT plain AS classification, count(*) AS n FROM judged GROUP BY 1")
def bench_drift_counts(spark, d):
    return B.drift_counts(B.drift(*summaries(spark, d)))


@query("bench_band", f"WITH {BOTH_SQL} " + " UNION ALL ".join(
    f"""SELECT scenario, '{m}' AS metric, n_runs AS sample_count, {m}_low AS low, {m}_high AS high, round(greatest(abs({m} - {m}_low), abs({m}_high - {m})), 6) AS spread_abs,
  round(greatest(abs({m} - {m}_low), abs({m}_high - {m})) / abs({m}) * 100, 6) AS spread_pct FROM cur_sum""" for m in B.METRICS))
def bench_band(spark, d):
    return B.bands(summary(spark, d)).select(
        "scenario", "metric", F.col("sample_count").cast("bigint").alias("sample_count"), "low", "high",
        F.round("spread_abs", 6).alias("spread_abs"), F.round("spread_pct", 6).alias("spread_pct"),
    )


def gated(spark, d):
    return B.gate_rows(*summaries(spark, d))


@query("bench_gate_rows", f"WITH {ROWS_SQL} SELECT scenario, gated AS classification, raw_regressions, suppressed_regressions, suppressed_improvements, ok FROM judged")
def bench_gate_rows(spark, d):
    return gated(spark, d).select(
        "scenario", "classification", *[V.joined(F.col(c)).alias(c) for c in ("raw_regressions", "suppressed_regressions", "suppressed_improvements")], "ok")


@query("bench_gate", f"""WITH {ROWS_SQL}, texts AS (
    SELECT 0 AS part, 'scenario ' || scenario || ' marked not ok in summary.json' AS t FROM judged WHERE NOT ok
    UNION ALL SELECT 3, 'new scenario count ' || count(*) || ' exceeds allowed 0' FROM judged WHERE gated = 'new' HAVING count(*) > 0
    UNION ALL SELECT 4, 'new scenario ' || scenario || ' is missing in baseline' FROM judged WHERE gated = 'new'
    UNION ALL SELECT 1, 'regression count ' || count(*) || ' exceeds allowed 0' FROM judged WHERE gated = 'regression' HAVING count(*) > 0
    UNION ALL SELECT 2, 'regression ' || scenario || ': throughput ' || {{}} || ' · avg ' || {{}} || ' · p95 ' || {{}} FROM judged WHERE gated = 'regression')
  SELECT count(*) AS scenario_count, count(*) FILTER (gated = 'regression') AS n_regression, count(*) FILTER (gated = 'improvement') AS n_improvement,
    count(*) FILTER (gated = 'unchanged') AS n_unchanged, count(*) FILTER (gated = 'new') AS n_new,
    CASE WHEN (SELECT count(*) FROM texts) > 0 THEN 'fail' ELSE 'pass' END AS status, coalesce((SELECT string_agg(t, ';' ORDER BY part, t) FROM texts), '') AS failures FROM judged""".format(
    *[f"(CASE WHEN d_{m} IS NULL THEN '—' ELSE CASE WHEN d_{m} > 0 THEN '+' ELSE '' END || printf('%.2f%%', d_{m}) END)" for m in B.METRICS]))
def bench_gate(spark, d):
    verdict = B.gate(gated(spark, d), ("median", 3), ("median", 3), 0, True)
    return verdict.select("scenario_count", *[f"n_{k}" for k in B.SEVERITY], "status", F.array_join("failures", ";").alias("failures"))


@query("bench_gate_mismatch", f"""WITH {ROWS_SQL} SELECT count(*) AS scenario_count, 'fail' AS status,
  'aggregation mismatch: summary=median/3 baseline=single-run/1 · promote baseline before treating drift as release-blocking' AS last_failure FROM judged""")
def bench_gate_mismatch(spark, d):
    verdict = B.gate(gated(spark, d), ("median", 3), ("single-run", 1))
    return verdict.select("scenario_count", "status", F.element_at("failures", -1).alias("last_failure"))


@query("bench_rank", f"""WITH {ROWS_SQL} SELECT scenario, gated AS classification, row_number() OVER (ORDER BY CASE gated WHEN 'regression' THEN 0 WHEN 'new' THEN 1
    WHEN 'improvement' THEN 2 ELSE 3 END, round(coalesce(abs(d_throughput_rps), 0) + coalesce(abs(d_avg_ms), 0) + coalesce(abs(d_p95_ms), 0), 6) DESC, scenario) AS place FROM judged""")
def bench_rank(spark, d):
    """A ranked report has one row per scenario."""
    rows = B.rank_rows(gated(spark, d)).withColumn("score", F.round("score", 6))
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("severity_rank", F.col("score").desc(), "scenario"))
    return rows.select("scenario", "classification", place.cast("bigint").alias("place"))


@query("bench_fresh", """SELECT event_id, a IS NOT DISTINCT FROM c AND b IS NOT DISTINCT FROM e AS fresh FROM (SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 3 END AS a,
  CASE WHEN event_id % 7 > 0 THEN 1 END AS b, CASE WHEN event_id % 5 > 0 THEN event_id % 2 END AS c, CASE WHEN event_id % 14 > 0 THEN 1 END AS e FROM events)""")
def bench_fresh(spark, d):
    event = F.col("event_id")
    fresh = B.is_fresh(
        F.when(event % 5 > 0, (event % 3).cast("string")), F.when(event % 7 > 0, F.lit("1")),
        F.when(event % 5 > 0, (event % 2).cast("string")), F.when(event % 14 > 0, F.lit("1")),
    )
    return V.table(spark, d, "events").select("event_id", fresh.alias("fresh"))


LIMITS = [("view-0", 0.0001, 60.0, 100.0), ("click-1", 0.01, 80.0, 150.0), ("error-2", 0.0001, 45.0, 500.0), ("fresh", 0.0001, 1.0, 1.0)]


@query("bench_thresholds", f"""WITH {BOTH_SQL}, limits AS (SELECT * FROM (VALUES {', '.join(str(row) for row in LIMITS)}) AS l(scenario, lo, a, p))
  SELECT s.scenario, concat_ws(',', CASE WHEN NOT avg_ms < a * 1.5 THEN 'avg_ms' END, CASE WHEN NOT p95_ms < p * 1.5 THEN 'p95_ms' END,
    CASE WHEN NOT throughput_rps > lo * 0.5 THEN 'throughput_rps' END) AS failed FROM cur_sum s JOIN limits l ON l.scenario = s.scenario""")
def bench_thresholds(spark, d):
    limits = spark.createDataFrame(LIMITS, "scenario string, throughput_min double, avg_max double, p95_max double")
    rows = B.check_thresholds(summary(spark, d), limits, 0.5, 1.5)
    return rows.select("scenario", V.joined(F.col("failed")).alias("failed"))
