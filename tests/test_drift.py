import pytest

from shroudline.operators import drift as B

SCHEMA = "scenario string, throughput_rps double, avg_ms double, p95_ms double, ok boolean, sample_runs array<struct<run:string,throughput_rps:double,avg_ms:double,p95_ms:double,ok:boolean>>"


def summary(spark, *rows):
    return spark.createDataFrame([(*row, True, None) if len(row) == 4 else row for row in rows], SCHEMA)


@pytest.mark.parametrize("current, baseline, expected", [
    ((120, 10, 20), (160, 5, 10), "regression"), ((160, 3.62, 4.978), (160, 3.62, 4.523), "unchanged"),
    ((160, 3.62, 4.8), (160, 3.62, 5.5), "improvement"), ((160, 10, 4.8), (100, 3.62, 5.5), "regression"), ((5, 1, 1), (0, 1, 1), "unchanged"),
])
def test_classes(spark, current, baseline, expected):
    now = summary(spark, ("s", *map(float, current)), ("n", 1.0, 1.0, 1.0))
    rows = {r.scenario: r.classification for r in B.drift(now, summary(spark, ("s", *map(float, baseline)))).collect()}
    assert rows == {"s": expected, "n": "new"}


def test_overlapping_samples_suppress_a_signal(spark):
    def runs(*values):
        return [(f"run-{i}", *v, True) for i, v in enumerate(values)]

    now = summary(spark, ("s", 930.0, 5.55, 7.05, True, runs((900.0, 5.0, 6.0), (990.0, 5.9, 7.5))), ("t", 100.0, 50.0, 60.0, False, runs((99.0, 49.0, 59.0))))
    base = summary(spark, ("s", 1000.0, 5.0, 6.5, True, runs((950.0, 4.9, 6.2), (1010.0, 5.2, 6.9))), ("t", 1000.0, 5.0, 6.0))
    rows = B.gate_rows(now, base)
    got = {r.scenario: r for r in rows.collect()}
    assert got["s"].classification == "unchanged" and got["s"].suppressed_regressions == ["throughput_rps", "avg_ms"]
    assert got["t"].classification == "regression" and got["t"].suppressed_regressions == []
    verdict = B.gate(rows, ("median", 3), ("median", 3)).first()
    assert verdict.status == "fail" and verdict.failures == [
        "scenario t marked not ok in summary.json", "regression count 1 exceeds allowed 0",
        "regression t: throughput -90.00% · avg +900.00% · p95 +900.00%"]
    assert B.gate(rows.where("scenario = 's'"), ("median", 3), ("median", 3)).first().status == "pass"
    other = B.gate(rows.where("scenario = 's'"), ("median", 3), ("single-run", 1)).first()
    assert other.status == "fail" and not other.aggregation_compatible and other.failures[0].startswith("aggregation mismatch")


def test_ranking(spark):
    now = summary(spark, ("worse", 50.0, 1.0, 1.0), ("new", 1.0, 1.0, 1.0), ("same", 100.0, 1.0, 1.0), ("better", 200.0, 1.0, 1.0), ("worst", 10.0, 1.0, 1.0))
    base = summary(spark, *[(s, 100.0, 1.0, 1.0) for s in ("worse", "same", "better", "worst")])
    assert [r.scenario for r in B.rank_rows(B.drift(now, base)).collect()] == ["worst", "worse", "new", "better", "same"]
