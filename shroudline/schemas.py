"""Fixed table schemas; payload bodies stay JSON text."""

EVIDENCE = (
    "struct<label:string,rule_name:string,action:string,pointer:string,severity:string,matched_sha256:string,matched_len:bigint>"
)

TRAFFIC = (
    "request_id string, ts timestamp, tenant_id string, principal string, session_id string, direction string, path string,"
    "content_type string, body string, headers map<string,string>, stream_id string"
)

AUDIT = (
    "ts timestamp, request_id string, principal string, tenant_id string, direction string, path string, decision string,"
    "policy_source string, decision_reason string, matched_labels array<string>, matched_rules array<string>,"
    f"findings array<{EVIDENCE}>, session_id string, session_escalated boolean, status_code int, error_stage string, error_kind string"
)

TICKET = (
    "struct<id:string,created_at:timestamp,updated_at:timestamp,status:string,request_id:string,principal:string,tenant_id:string,"
    "direction:string,path:string,policy_source:string,decision_reason:string,matched_labels:array<string>,matched_rules:array<string>,"
    f"findings:array<{EVIDENCE}>,session_id:string,session_escalated:boolean,request_sha256:string,sanitized_preview:string,"
    "post_approval_action:string,resolution:struct<resolved_at:timestamp,resolved_by:string,note:string,expires_at:timestamp>,fingerprint:string>"
)

REVIEW_EVENTS = (
    f"type string, ticket {TICKET}, ticket_id string, status string, resolved_by string, note string,"
    "resolved_at timestamp, expires_at timestamp"
)

BENCH_SUMMARY = (
    "generated_at string, scenario_count int, aggregation struct<method:string,runs:int>,"
    "scenarios array<struct<scenario:string,ok:boolean,throughput_rps:double,"
    "latency_ms:struct<avg:double,p50:double,p95:double,min:double,max:double>,"
    "aggregation:struct<method:string,runs:int,sample_runs:array<struct<run:string,throughput_rps:double,avg_ms:double,p95_ms:double,ok:boolean>>>>>"
)
