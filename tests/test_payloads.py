import json

import pytest
from pyspark.sql import functions as F

from shroudline.config import DEFAULT_POLICY_RULES, Detection
from shroudline.functions import text as T
from shroudline.operators import payloads as Y, policy as P, usage as U

CONFIG = Detection()


def frame(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")


def test_leaves_in_key_order_with_escaped_pointers(spark):
    body = '{"b": ["x", {"k": "y"}, 1, null], "a/b~c": "z", "a": {"": "e"}}'
    rows = [(r.pointer, r.text) for r in Y.explode_leaves(frame(spark, body), "i").collect()]
    assert rows == [("/a/", "e"), ("/a~1b~0c", "z"), ("/b/0", "x"), ("/b/1/k", "y")]
    assert [(r.pointer, r.text) for r in Y.explode_leaves(frame(spark, '"root"'), "i").collect()] == [("", "root")]


def test_what_is_not_json_is_one_text(spark):
    bad = ["{", "plain a@b.example", '{"a": NaN}', '"\\ud800"', "[" * 5000]
    rows = [(r.pointer, r.text) for r in Y.explode_leaves(frame(spark, *bad), "i").orderBy("i").collect()]
    assert rows == [("/", b) for b in bad]


def test_scrub_bodies(spark):
    bodies = ['{"messages":[{"content":"mail me at leak@corp.example"}],"n":1.50,"u":"é"}', "contact leak@corp.example now", "hello world", None, '{"z":1,"a":true}']
    out = [r.sanitised for r in Y.scrub_bodies(frame(spark, *bodies), CONFIG).orderBy("i").collect()]
    assert json.loads(out[0]) == {"messages": [{"content": "mail me at l***@corp.example"}], "n": 1.5, "u": "é"}
    assert out[1:] == ["contact l***@corp.example now", "hello world", None, '{"a":true,"z":1}']


def test_ignored_pointers_are_not_scanned(spark):
    config = Detection(ignore_json_pointers=("/model",))
    row = Y.process(frame(spark, '{"model":"a@b.example","x":"13812341234"}'), config, P.local_principal(), F.lit("request")).first()
    assert (row.decision, row.sanitised) == ("block", '{"model":"a@b.example","x":"138****1234"}')
    assert [(f.label, f.pointer) for f in row.resolved] == [("phone", "/x")]


@pytest.mark.parametrize("kind, direction, body, expected", [
    ("multipart/form-data; boundary=x", "request", b"a", "multipart"), ("Multipart/Form-Data", "response", b"a", "text"),
    ("text/event-stream", "response", b"a", "sse"), ("application/json", "request", b'{"a":1}', "json"), ("application/json", "request", b"{", "text"),
    ("APPLICATION/JSON", "request", b'{"a":1}', "text"), ("application/x+json", "request", b"[]", "json"), (None, "request", b"\xff\xfe", "passthrough"),
])
def test_payload_kind(spark, kind, direction, body, expected):
    df = spark.createDataFrame([(kind, direction, body)], "ct string, d string, b binary")
    assert df.select(T.payload_kind(F.col("ct"), F.col("d"), F.col("b"))).first()[0] == expected


def test_stream_lines(spark):
    lines = ["data: {\"delta\":\"a@b.example\"}\n", "data:data:  mail a@b.example ", "data: [DONE]\n", ": x", "", "event: a@b.example", "data:  ",
             "data: tok 5f4dcc3b5aa765d61d8327deb882cf99", '{"a":"b@c.example"}']
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    rows = Y.redact_lines(df, CONFIG, P.local_principal(), rules=DEFAULT_POLICY_RULES).orderBy("i").collect()
    assert [r.out for r in rows] == [
        'data: {"delta":"a***@b.example"}\n', "data: mail a***@b.example\n", "data: [DONE]\n", ": x", "", "event: a@b.example", "data:  ",
        "data: tok [SECRET_LIKE:" + __import__("hashlib").sha256(b"5f4dcc3b5aa765d61d8327deb882cf99").hexdigest()[:12] + "]\n", '{"a":"b@c.example"}']
    assert [r.decision for r in rows][:2] == ["redact", "redact"] and rows[7].source == "opa" and rows[7].decision == "block"


def test_policy_that_tightens_withholds_the_event(spark):
    from shroudline.config import PolicyRule

    df = spark.createDataFrame([(0, 'data: {"a":"x"}'), (1, "data: x"), (2, ": x")], "i int, line string")
    rows = Y.redact_lines(df, CONFIG, P.local_principal(), rules=(PolicyRule("review", "all"),)).orderBy("i").collect()
    assert [r.out for r in rows] == ['data: {"error":"response redacted by gateway"}\n', "data: [REDACTED]\n", ": x"]
    assert [r.decision for r in rows] == ["review", "review", "allow"]


@pytest.mark.parametrize("body, expected", [
    ('{"model":"gpt-4","usage":{"prompt_tokens":12,"completion_tokens":34}}', ("gpt-4", 12, 34)),
    ('{"usage":{"input_tokens":5,"output_tokens":9}}', (None, 5, 9)),
    ('{"usage":{"prompt_tokens":0,"completion_tokens":0}}', None), ("nope", None), ('{"model":"x"}', None),
    ('{"usage":{"prompt_tokens":"7","input_tokens":9,"completion_tokens":1}}', (None, 0, 1)), ('{"model":3,"usage":{"input_tokens":1}}', (None, 1, 0)),
])
def test_usage(spark, body, expected):
    got = spark.range(1).select(U.usage_of(F.lit(body)).alias("u")).first().u
    assert (got and tuple(got)) == expected


def test_small_text_functions(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(T.truncate_middle(F.lit("abcdefghij"), 7)) == "ab...ij" and one(T.truncate_middle(F.lit("abc"), 7)) == "abc"
    assert one(T.preview(F.lit("😀bc"), 2)) == "😀b"
    assert one(T.char_to_byte(F.lit("é😀a"), F.lit(2))) == 6 and one(T.char_to_byte(F.lit("é"), F.lit(99))) == 2
    assert one(T.host_of(F.lit("https://u@API.Example.com.:8443/x?y"))) == "api.example.com"
    assert one(T.host_of(F.lit(None).cast("string"), F.lit("Host.Example:80"))) == "host.example"
    assert one(T.media_type(F.lit("binary/octet-stream"), F.lit("A.PDF"))) == "application/pdf"
    assert abs(one(T.shannon_entropy(F.lit("aabb"))) - 1.0) < 1e-12 and one(T.shannon_entropy(F.lit(""))) == 0.0


def test_failed_rows_are_withheld(spark):
    rows = spark.createDataFrame([(0, '{"a":"leak@corp.example"}', "503"), (1, "leak@corp.example", "503"), (2, "leak@corp.example", None)], "i int, body string, why string")
    out = Y.process(rows, CONFIG, P.local_principal(), F.lit("request"), failure=F.col("why")).orderBy("i").collect()
    assert [(r.failed_stage, r.decision, r.source, r.sanitised, len(r.resolved)) for r in out] == [
        ("json", "redact", "json_processing_error_fallback", T.REDACTED_JSON, 0), ("text", "redact", "presidio_error_fallback", T.REDACTED_TEXT, 0),
        (None, "redact", "builtin", "l***@corp.example", 1),
    ]


def test_one_row_that_cannot_be_scanned(spark, monkeypatch):
    """The batch is scanned again row by row; only the bad row has an error."""
    import pyarrow as pa

    def scan(texts, *_):
        if any(t == "bad" for t in texts.to_pylist()):
            raise TimeoutError("too slow")
        return pa.array([[]] * len(texts), Y.D._SPAN_TYPE)

    monkeypatch.setattr(Y.D, "scan_batch", scan)
    monkeypatch.setattr(Y.F, "arrow_udf", lambda _: lambda fn: fn)
    run = Y._scan_leaves(pa.array([["a"], ["b", "bad"], [], None]), CONFIG)
    assert run.field("error").to_pylist() == [None, "TimeoutError: too slow", None, None]
    assert run.field("spans").to_pylist() == [[[]], [], [], []]
