import json

import pytest
from pyspark.sql import functions as F

from shroudline.config import FLOOR_HOSTS, HostRule, PASSTHROUGH_HOSTS
from shroudline.operators import audits as A, metrics as M, routing as G
from shroudline.sources import logs, rules as R, traffic as TR


def record(i, **over):
    base = {"ts": f"2024-01-01T00:00:0{i}.123456Z", "request_id": f"r{i}", "principal": "p", "tenant_id": "t", "direction": "request", "path": "/", "decision": "allow",
            "policy_source": "builtin", "decision_reason": None, "matched_labels": ["email"] if i % 2 else [], "matched_rules": [], "findings": [], "session_id": None,
            "session_escalated": False, "status_code": 200, "error_stage": None, "error_kind": None}
    return {**base, **over}


def test_audit_log(spark, tmp_path):
    path = tmp_path / "audit"
    assert logs.read_audit(spark, str(path)).count() == 0
    path.mkdir()
    lines = [json.dumps(record(i)) for i in range(4)] + ["{broken", "", '{"other": 1}', json.dumps(record(5, decision="block", error_kind="opa", error_stage="process_payload"))]
    (path / "a.jsonl").write_text("\n".join(lines))
    audit = logs.read_audit(spark, str(path))
    assert sorted(r.request_id for r in audit.collect()) == ["r0", "r1", "r2", "r3", "r5"]
    logs.append_audit(audit.where("request_id = 'r1'"), str(path))
    again = logs.read_audit(spark, str(path))
    assert again.count() == 6 and A.union_audit(again, audit).count() == 5
    assert [r.request_id for r in A.query_audit(again, label="email", newest=True, limit=2).collect()] == ["r5", "r3"]
    assert [r.request_id for r in A.query_audit(again, decision="block", error_kind="opa", error_stage="process_payload").collect()] == ["r5"]
    assert [r.request_id for r in A.tail_then_filter(audit, 2, decision="allow").collect()] == ["r3"]
    with pytest.raises(ValueError):
        A.query_audit(audit, colour="red")
    assert {(r.stage, r.kind): r.n for r in M.count_errors(audit).collect()} == {("process_payload", "opa"): 1}


def test_review_log_skips_what_it_does_not_know(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = [{"type": "created", "ticket": {"id": "t1", "created_at": "2024-01-01T00:00:00Z", "status": "pending"}}, {"type": "odd"}, {"type": "created"},
             {"type": "resolved", "ticket_id": "t1", "status": "approved", "resolved_by": "a", "resolved_at": "2024-01-01T00:00:01Z", "expires_at": "2024-01-01T00:10:00Z"}]
    (tmp_path / "log" / "x.json").write_text("\n".join(map(json.dumps, lines)) + "\nnope")
    assert sorted(r.type for r in logs.read_review_events(spark, str(tmp_path / "log")).collect()) == ["created", "resolved"]


def test_bench_summary_and_promotion(spark, tmp_path):
    runs = [{"run": "run-01", "throughput_rps": 1.0, "avg_ms": 2.0, "p95_ms": 3.0, "ok": True}]
    doc = {"generated_at": "now", "scenario_count": 1, "aggregation": {"method": "median", "runs": 1},
           "scenarios": [{"scenario": "s", "ok": True, "throughput_rps": 9.5, "latency_ms": {"avg": 1.0, "p50": 1.0, "p95": 2.0}, "aggregation": {"sample_runs": runs}}]}
    (tmp_path / "cur.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "empty.json").write_text(json.dumps({"scenarios": []}))
    row = logs.read_bench_summary(spark, str(tmp_path / "cur.json")).first()
    assert (row.scenario, row.throughput_rps, row.p95_ms, row.sample_runs[0].avg_ms, row.method) == ("s", 9.5, 2.0, 2.0, "median")
    for _ in range(2):
        logs.promote_baseline(spark, str(tmp_path / "cur.json"), str(tmp_path / "base"))
    assert logs.read_bench_summary(spark, str(tmp_path / "base")).count() == 1
    with pytest.raises(ValueError):
        logs.promote_baseline(spark, str(tmp_path / "empty.json"), str(tmp_path / "base"))


def test_rule_file_and_attachments(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"name": "n", "label": "l", "pattern": "x"}]}))
    config = R.read_detection(spark, str(tmp_path / "rules.json"))
    assert [r.name for r in config.rules] == ["n"] and R.rules_df(spark, config).count() == 1
    assert TR.read_attachments(spark, str(tmp_path), "*.json").select("length").count() == 1


@pytest.mark.parametrize("host, expected", [
    ("api.openai.com", "intercept"), ("a.b.openai.azure.com", "intercept"), ("openai.azure.com", "none"), ("notopenai.azure.com", "none"),
    ("bedrock-runtime.us-east-1.amazonaws.com", "intercept"), ("chatgpt.com", "passthrough"), ("x.chatgpt.com", "passthrough"), ("keep.example", "intercept"),
    ("both.example", "passthrough"),
])
def test_routes(spark, host, expected):
    rules = (*FLOOR_HOSTS, *PASSTHROUGH_HOSTS, HostRule("passthrough", "exact", "api.openai.com"), HostRule("intercept", "exact", "keep.example"),
             HostRule("intercept", "exact", "both.example"), HostRule("passthrough", "wildcard", "*.example2"), HostRule("passthrough", "regex", "^BOTH"))
    df = spark.createDataFrame([(host,)], "host string")
    assert df.select(G.route(F.col("host"), rules, "none")).first()[0] == expected
    assert G.route_hosts(df, rules, "none").first().route == expected
