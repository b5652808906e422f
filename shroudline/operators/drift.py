"""Latency facts: per-run statistics, medians, and drift against a baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.operators import skew

# Drift thresholds in percent, noise floors in milliseconds.
THROUGHPUT_PCT = 5.0
LATENCY_PCT = 10.0
AVG_FLOOR_MS = 0.25
P95_FLOOR_MS = 0.5
EPSILON = 2.220446049250313e-16
METRICS = ("throughput_rps", "avg_ms", "p95_ms")
SEVERITY = {"regression": 0, "new": 1, "improvement": 2, "unchanged": 3}

# Cells that a bracket is cut into, and values in a bracket that are few enough to be put in order.
CELLS = 256
DIRECT = 100_000


def exact_quantiles(facts: DataFrame, value: str, by: list[str], quantiles: dict[str, float], stats: DataFrame,
                    direct: int = DIRECT) -> DataFrame:
    """The value at index floor((n − 1)·p) of each sorted group, for every named p.

    A quantile lies in a bracket, at first from the least to the greatest value.  A bracket of more than ``direct`` values is cut
    into CELLS cells at sketched borders, the cells are counted exactly, and the one that holds the rank is the next
    bracket; borders need not be right for the counts to be.  So no more than ``direct`` values are ever ordered in one task, and
    a bracket of one value is done.  ``stats`` holds the count ``n`` and the columns made by :func:`brackets`.
    """
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), F.floor((F.col("n") - 1) * F.lit(p)).cast("bigint").alias("rank")) for name, p in quantiles.items()
    ])
    open_ = stats.select(*by, F.explode(wanted).alias("t"), F.col("_least").alias("low"), F.col("_most").alias("high"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"))
    targets = open_.select(*by, "t.name", "t.rank", "low", "high", "below", "inside")
    wide = (F.col("inside") > direct) & (F.col("low") < F.col("high"))
    while not targets.where(wide).isEmpty():
        targets = skew.settle(targets.where(~wide).unionByName(_narrowed(_values(facts, value, by, targets.where(wide), stats), by)))

    upto = Window.partitionBy(*by, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = _values(facts, value, by, targets, stats).withColumn("_upto", F.col("below") + F.sum("_c").over(upto))
    placed = placed.where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_c") <= F.col("rank")))
    found = placed.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in quantiles])
    return stats.drop("_least", "_most").join(found, by)


def _values(facts: DataFrame, value: str, by: list[str], targets: DataFrame, stats: DataFrame) -> DataFrame:
    """Each value in the bracket of a target, and how often it occurs."""
    listed = targets.groupBy(*by).agg(F.collect_list(F.struct("name", "rank", "low", "high", "below")).alias("_targets"))  # one per quantile
    # groups may be few and large: the hot ones are dealt out over tasks
    met = skew.lookup(facts, listed, by, [c for c in facts.columns if c not in by], "inner", counts=stats.select(*by, "n"))
    inside = met.select(*by, F.col(value).alias("_v"), F.explode("_targets").alias("_t")).where((F.col("_v") >= F.col("_t.low")) & (F.col("_v") <= F.col("_t.high")))
    return inside.groupBy(*by, "_t.name", "_t.rank", "_t.below", "_v").agg(F.count("*").alias("_c"))


def _narrowed(values: DataFrame, by: list[str]) -> DataFrame:
    """Brackets of one cell each."""
    keys = [*by, "name"]
    values = skew.settle(values)
    borders = values.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)]), 10 * CELLS).alias("_borders"), F.count("*").alias("n"))
    met = skew.lookup(values, borders.drop("n"), keys, "_v", "inner", counts=borders.select(*keys, "n"))
    cell = F.size(F.filter("_borders", lambda border: border < F.col("_v"))).alias("_cell")
    cells = met.select(*keys, "rank", "below", "_v", "_c", cell).groupBy(*keys, "rank", "below", "_cell").agg(
        F.sum("_c").alias("_n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("inside"))
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    counted = cells.withColumn("_upto", F.col("below") + F.sum("_n").over(upto)).where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_n") <= F.col("rank")))
    return counted.select(*keys, "rank", "low", "high", (F.col("_upto") - F.col("_n")).alias("below"), "inside")


def brackets(value: str, quantiles: dict[str, float]) -> list[Column]:
    """Aggregates that bracket every quantile of a group."""
    return [F.min(value).alias("_least"), F.max(value).alias("_most")]


def run_stats(facts: DataFrame, by: list[str], value: str = "latency_ms", ts: str = "started_at") -> DataFrame:
    """Count, throughput and latency figures per run; throughput over the time from first to last start."""
    quantiles = {"p50_ms": 0.5, "p95_ms": 0.95}
    seconds = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    stats = facts.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count("*") / F.when(seconds > 0, seconds)).alias("throughput_rps"),
        F.min(value).alias("min_ms"), F.max(value).alias("max_ms"), F.avg(value).alias("avg_ms"), *brackets(value, quantiles),
    )
    return exact_quantiles(facts, value, by, quantiles, skew.settle(stats))


def median_runs(stats: DataFrame, scenario: str = "scenario", run: str = "run") -> DataFrame:
    """One row per scenario: rounded medians over its runs, the union of sources, and the runs themselves."""
    digits = {"throughput_rps": 2, "min_ms": 3, "p50_ms": 3, "p95_ms": 3, "max_ms": 3, "avg_ms": 3}
    sample = F.struct(
        F.col(run).cast("string").alias("run"), F.round("throughput_rps", 2).alias("throughput_rps"), F.round("avg_ms", 3).alias("avg_ms"),
        F.round("p95_ms", 3).alias("p95_ms"), F.col("ok").alias("ok"),
    )
    return stats.groupBy(scenario).agg(
        *[F.round(F.median(name), places).alias(name) for name, places in digits.items()],
        F.bool_and("ok").alias("ok"), F.count("*").alias("n_runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.array_sort(F.collect_list(sample)).alias("sample_runs"),
    )


def pct_delta(current: Column, baseline: Column) -> Column:
    """Change in percent; NULL where the baseline is practically zero."""
    return F.when(F.abs(baseline) >= EPSILON, (current - baseline) / baseline * 100.0)


def _side(df: DataFrame, suffix: str, columns: tuple[str, ...], *keep: Column) -> DataFrame:
    return df.select("scenario", *keep, *[F.col(c).alias(f"{c}_{suffix}") for c in columns])


def _signals(opts: dict[str, float]) -> dict[str, tuple[Column, Column]]:
    """Per metric: (regression signal, improvement signal), false where there is no baseline."""

    def known(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    out = {}
    for metric in METRICS:
        delta, current, base = F.col(f"{metric}_delta"), F.col(f"{metric}_current"), F.col(f"{metric}_baseline")
        if metric == "throughput_rps":
            out[metric] = (known(delta <= -opts["throughput_regression"]), known(delta >= opts["throughput_improvement"]))
        else:
            floor = opts["avg_floor"] if metric == "avg_ms" else opts["p95_floor"]
            limit = opts["avg_regression"] if metric == "avg_ms" else opts["p95_regression"]
            out[metric] = (
                known((delta >= limit) & (current - base >= floor)),
                known((delta <= -opts["latency_improvement"]) & (base - current >= floor)),
            )
    return out


DEFAULT_OPTS = {
    "throughput_regression": THROUGHPUT_PCT, "throughput_improvement": THROUGHPUT_PCT,
    "avg_regression": LATENCY_PCT, "p95_regression": LATENCY_PCT, "latency_improvement": LATENCY_PCT,
    "avg_floor": AVG_FLOOR_MS, "p95_floor": P95_FLOOR_MS,
}


def _compared(current: DataFrame, baseline: DataFrame, columns: tuple[str, ...], *keep: Column) -> DataFrame:
    rows = _side(current, "current", columns, *keep).join(_side(baseline, "baseline", columns).withColumn("_known", F.lit(True)), "scenario", "left")
    deltas = {f"{m}_delta": pct_delta(F.col(f"{m}_current"), F.col(f"{m}_baseline")) for m in METRICS}
    return rows.withColumns(deltas)


def _classed(regressed: Column, improved: Column) -> Column:
    return (
        F.when(F.col("_known").isNull(), F.lit("new")).when(regressed, F.lit("regression")).when(improved, F.lit("improvement"))
        .otherwise(F.lit("unchanged"))
    )


def _any(columns) -> Column:
    return reduce(lambda a, b: a | b, columns)


def drift(current: DataFrame, baseline: DataFrame, opts: dict[str, float] | None = None) -> DataFrame:
    """Scenario by scenario: deltas and class; a regression in any metric outweighs improvements."""
    rows = _compared(current, baseline, METRICS)
    signals = _signals({**DEFAULT_OPTS, **(opts or {})})
    verdict = _classed(_any(r for r, _ in signals.values()), _any(i for _, i in signals.values()))
    return rows.withColumn("classification", verdict).drop("_known")


def drift_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("classification").agg(F.count("*").alias("n"))


def _samples(metric: str) -> Column:
    """Values of the sample runs, or the figure itself where there are none."""
    given = F.coalesce(F.array_compact(F.col(f"sample_runs.{metric}")), F.array().cast("array<double>"))
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.coalesce(F.col(metric), F.lit(0.0))))


def bands(summary: DataFrame) -> DataFrame:
    """(scenario, metric, sample_count, low, high, spread_abs, spread_pct) over sample runs, else the figure itself."""
    rows = [
        F.struct(F.lit(metric).alias("metric"), F.coalesce(F.col(metric), F.lit(0.0)).alias("center"), _samples(metric).alias("samples"))
        for metric in METRICS
    ]
    spread = summary.select("scenario", F.explode(F.array(*rows)).alias("m"))
    low, high, center = F.array_min("m.samples"), F.array_max("m.samples"), F.col("m.center")
    reach = F.greatest(F.abs(center - low), F.abs(high - center))
    return spread.select(
        "scenario", "m.metric", F.size("m.samples").alias("sample_count"), low.alias("low"), high.alias("high"), reach.alias("spread_abs"),
        F.when(F.abs(center) >= EPSILON, reach / F.abs(center) * 100.0).alias("spread_pct"),
    )


def _with_ends(summary: DataFrame) -> DataFrame:
    """Band ends as columns of the summary row."""
    return summary.withColumns(
        {f"{end}_{m}": fn(_samples(m)) for m in METRICS for end, fn in (("low", F.array_min), ("high", F.array_max))}
    )


def gate_rows(current: DataFrame, baseline: DataFrame, opts: dict[str, float] | None = None) -> DataFrame:
    """Drift confirmed by sample runs: a signal counts only where the two bands do not overlap."""
    columns = (*METRICS, *[f"{end}_{m}" for m in METRICS for end in ("low", "high")])
    ok = F.coalesce("ok", F.lit(False)).alias("ok")
    rows = _compared(_with_ends(current), _with_ends(baseline), columns, ok)
    signals = _signals({**DEFAULT_OPTS, **(opts or {})})

    def below(metric: str) -> Column:
        return F.coalesce(F.col(f"high_{metric}_current") < F.col(f"low_{metric}_baseline"), F.lit(False))

    def above(metric: str) -> Column:
        return F.coalesce(F.col(f"low_{metric}_current") > F.col(f"high_{metric}_baseline"), F.lit(False))

    decisive = {m: (below(m), above(m)) if m == "throughput_rps" else (above(m), below(m)) for m in METRICS}

    def names(test) -> Column:
        return F.array_compact(F.array(*[F.when(test(m), F.lit(m)) for m in METRICS]))

    verdict = _classed(_any(signals[m][0] & decisive[m][0] for m in METRICS), _any(signals[m][1] & decisive[m][1] for m in METRICS))
    return rows.withColumns({
        "raw_regressions": names(lambda m: signals[m][0]), "raw_improvements": names(lambda m: signals[m][1]),
        "suppressed_regressions": names(lambda m: signals[m][0] & ~decisive[m][0]),
        "suppressed_improvements": names(lambda m: signals[m][1] & ~decisive[m][1]),
        "classification": verdict,
    }).drop("_known")


def _fmt(delta: Column) -> Column:
    sign = F.when(delta > 0, "+").otherwise("")
    return F.when(delta.isNull(), F.lit("—")).otherwise(F.concat(sign, F.format_string("%.2f%%", delta)))


def gate(rows: DataFrame, summary_aggregation: tuple[str, int], baseline_aggregation: tuple[str, int], max_regressions: int = 0,
         fail_on_new: bool = False) -> DataFrame:
    """One verdict row: counts, ``pass`` or ``fail``, and the failure texts.

    Different ways of aggregating make drift incomparable: that fails by itself, and regressions then
    do not count.  One scenario is one row of a report, so the texts gathered here are as many as scenarios.
    """
    comparable = summary_aggregation == baseline_aggregation

    def texts(test: Column, text: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(test, text)))

    kind = F.col("classification")
    detail = F.concat(
        F.lit("regression "), "scenario", F.lit(": throughput "), _fmt(F.col("throughput_rps_delta")), F.lit(" · avg "), _fmt(F.col("avg_ms_delta")),
        F.lit(" · p95 "), _fmt(F.col("p95_ms_delta")),
    )
    counted = rows.agg(
        F.count("*").alias("scenario_count"),
        *[F.count_if(kind == name).alias(f"n_{name}") for name in SEVERITY],
        texts(~F.col("ok"), F.concat(F.lit("scenario "), "scenario", F.lit(" marked not ok in summary.json"))).alias("_bad"),
        texts(kind == "regression", detail).alias("_regressed"),
        texts(kind == "new", F.concat(F.lit("new scenario "), "scenario", F.lit(" is missing in baseline"))).alias("_new"),
    )
    none = F.array().cast("array<string>")
    mismatch = (
        "aggregation mismatch: "
        f"summary={summary_aggregation[0]}/{summary_aggregation[1]} baseline={baseline_aggregation[0]}/{baseline_aggregation[1]} · "
        "promote baseline before treating drift as release-blocking"
    )
    if comparable:
        headline = F.concat(F.lit("regression count "), F.col("n_regression").cast("string"), F.lit(f" exceeds allowed {max_regressions}"))
        worse = F.when(F.col("n_regression") > max_regressions, F.concat(F.array(headline), "_regressed")).otherwise(none)
    else:
        worse = F.array(F.lit(mismatch))
    new_head = F.concat(F.lit("new scenario count "), F.col("n_new").cast("string"), F.lit(" exceeds allowed 0"))
    new = F.when(F.lit(fail_on_new) & (F.col("n_new") > 0), F.concat(F.array(new_head), "_new")).otherwise(none)
    failures = F.concat("_bad", worse, new)
    return counted.withColumn("failures", failures).withColumn("status", F.when(F.size("failures") > 0, "fail").otherwise("pass")).withColumn(
        "aggregation_compatible", F.lit(comparable)).drop("_bad", "_regressed", "_new")


def rank_rows(rows: DataFrame) -> DataFrame:
    """Worst first: by class, then by the sum of absolute deltas."""
    severity = reduce(lambda acc, kv: acc.when(F.col("classification") == kv[0], kv[1]), list(SEVERITY.items())[1:],
                      F.when(F.col("classification") == "regression", 0)).otherwise(4)
    score = reduce(lambda a, b: a + b, [F.abs(F.coalesce(F.col(f"{m}_delta"), F.lit(0.0))) for m in METRICS])
    return rows.withColumns({"severity_rank": severity, "score": score}).orderBy("severity_rank", F.col("score").desc(), "scenario")


def is_fresh(report_current: Column, report_baseline: Column, current: Column, baseline: Column) -> Column:
    """Whether a report was made from the very summaries at hand; two missing times agree."""
    return report_current.eqNullSafe(current) & report_baseline.eqNullSafe(baseline)


def check_thresholds(stats: DataFrame, limits: DataFrame, floor_scale: float = 1.0, ceil_scale: float = 1.0) -> DataFrame:
    """Failures per scenario against absolute limits (throughput_min, avg_max, p95_max): configuration rows."""
    rows = stats.join(limits, "scenario")
    failed = F.array_compact(F.array(
        F.when(~(F.col("avg_ms") < F.col("avg_max") * ceil_scale), F.lit("avg_ms")),
        F.when(~(F.col("p95_ms") < F.col("p95_max") * ceil_scale), F.lit("p95_ms")),
        F.when(~(F.col("throughput_rps") > F.col("throughput_min") * floor_scale), F.lit("throughput_rps")),
    ))
    return rows.withColumn("failed", failed)
