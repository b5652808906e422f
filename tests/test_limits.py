"""Nothing is cut in silence, and work grows with what is there."""

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shroudline import config, session
from shroudline.config import Detection, Principal
from shroudline.functions import tokens
from shroudline.operators import audits, policy, redact, reviews
from shroudline.streaming import sessions as live


def test_limits_are_taken_as_given(spark):
    rows = spark.range(700).select(F.col("id").alias("ts"), F.col("id").cast("string").alias("request_id"), F.array(F.lit("x")).alias("matched_labels"))
    assert audits.query_audit(rows, limit=650).count() == 650 and audits.query_audit(rows, newest=True).count() == 50
    tickets = spark.range(700).select(F.col("id").alias("ticket_id"), F.col("id").alias("created_at"), F.lit("pending").alias("status"))
    assert reviews.list_tickets(tickets, limit=650).count() == 650


def test_shared_folder_is_named_on_a_cluster():
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(away)
    assert session.is_local("local[8]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")


def test_only_authorization_has_a_scheme(spark):
    row = spark.range(1).select(policy.secret_hash(F.lit("Bearer abc")).alias("a"), policy.secret_hash(F.lit("Bearer abc"), "x-api-key").alias("b"), F.sha2(F.lit("abc"), 256).alias("c"), F.sha2(F.lit("Bearer abc"), 256).alias("d")).first()
    assert row.a == row.c and row.b == row.d
    with pytest.raises(ValueError):
        policy.principals_df(spark, (Principal("a", "t", "r", secret_sha256="ff"), Principal("b", "t", "r", secret_sha256="FF")))


def test_tokens_open_for_admins_only(spark):
    key = b"0123456789abcdef0123456789abcdef"
    sealed = spark.range(1).select(tokens.tokenizer(key, "tok1")(F.lit("email"), F.lit("a@b.co")).alias("t"))
    got = sealed.select(*(tokens.detokenize_for(F.lit(r), F.col("t"), key, "tok1")["value"].alias(r) for r in ("admin", "employee"))).first()
    assert (got.admin, got.employee) == ("a@b.co", None)


def test_raw_values_are_seen_anywhere_in_the_record(spark):
    base = spark.createDataFrame([(1, 'a"b@c.co'), (2, "x")], "id int, text string")
    finding = F.array(F.struct(F.col("text").alias("matched")))
    leaks = base.select(audits.holds_raw([F.array(F.concat(F.lit("/p/"), F.when(F.col("id") == 1, F.col("text")).otherwise("-")))], finding).alias("h")).collect()
    assert [r.h for r in leaks] == [True, False]


def test_loaders():
    rules = config.policy_rules_from({"policy": {"rules": [{"action": "block", "reason": "r", "label": "email"}]}})
    assert rules[0].label == "email" and rules[0].direction is None
    hosts = config.hosts_from({"hosts": {"floor": ["a.example", "*.b.example", r"/^c\.example$/"]}})
    assert [h.kind for h in hosts] == ["exact", "wildcard", "regex"]
    assert config.limits_from({"limits": {"ttl": 5}}, ttl=9, cap=2) == {"ttl": 5, "cap": 2}
    for bad in ({"limits": {"x": 1}}, {"limits": {"ttl": 0}}, {"hosts": {"nowhere": []}}, {"policy": {"rules": [{"action": "maybe", "reason": ""}]}}):
        with pytest.raises(ValueError):
            config.limits_from(bad, ttl=9), config.hosts_from(bad), config.policy_rules_from(bad if "policy" in bad else {"rules": []})


def test_rewriting_grows_with_the_findings(spark):
    def seconds(n):
        docs = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("user"), i, F.lit("@corp.example"))), "  ").alias("text"))
        started = time.perf_counter()
        out = redact.scrub(docs, Detection(high_entropy=None)).select("redacted").first()[0]
        assert out.count("***@corp.example") == n
        return time.perf_counter() - started

    seconds(100)
    assert seconds(40_000) < 20


class Held:
    def __init__(self):
        self.value, self.map, self.timers = None, {}, []

    exists = property(lambda self: lambda: self.value is not None)
    get = property(lambda self: lambda: self.value)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value, self.map = None, {}

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def iterator(self):
        return iter(self.map.items())


def test_chunks_find_their_order_across_batches():
    import pandas as pd

    state, waiting, clock = Held(), Held(), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
    handle = SimpleNamespace(getValueState=lambda *_: state, getMapState=lambda *_: waiting, listTimers=lambda: [], registerTimer=lambda at: None, deleteTimer=lambda at: None)
    job = live.Reassembler(idle_secs=60)
    job.init(handle)

    def feed(*chunks):
        frame = pd.DataFrame(chunks, columns=["seq", "chunk", "last"])
        return [(n, line) for out in job.handleInputRows(("s",), iter([frame]), clock) for n, line in zip(out["line_no"], out["line"])]

    assert feed((1, b"cd\nef", False)) == []
    assert feed((0, b"ab", False), (0, b"ab", False)) == [(0, "abcd")]
    assert feed((3, b"x", True)) == [] and feed((2, b"g\nh", False)) == [(1, "efg"), (2, "hx")]
    assert feed((4, b"late\n", False)) == []
    state.clear()
    assert feed((0, b"a\nb", False), (2, b"c", False)) == [(0, "a")]
    assert [tuple(r) for out in job.handleExpiredTimer(("s",), clock, None) for r in out[["line_no", "line"]].itertuples(index=False)] == [(1, "bc")]


def test_chunks_in_their_turn_take_no_state():
    import pandas as pd

    state, waiting, clock = Held(), Held(), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0)
    waiting.updateValue = waiting.getValue = waiting.removeKey = waiting.containsKey = None  # each is a round trip
    job = live.Reassembler()
    job.init(SimpleNamespace(getValueState=lambda *_: state, getMapState=lambda *_: waiting))
    frames = [pd.DataFrame([(n, b"a\nb", n == 3)], columns=["seq", "chunk", "last"]) for n in (2, 0, 3, 1, 1)]
    out = [line for part in job.handleInputRows(("s",), iter(frames), clock) for line in part["line"]]
    assert out == ["a", "ba", "ba", "ba", "b"] and state.value == (b"", 5, 4, True)


def test_registered_queries_bound_what_a_worker_holds(spark):
    from shroudline import plans

    held = {key: spark.conf.get(key) for key in session.ARROW_CONF}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
        plans.load()[0]["sse_redact"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4194304"
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10"
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


def test_opening_a_token_reads_it_once(spark):
    opened = tokens.detokenize(F.col("t"), bytes(32), "tok1")
    assert str(opened).count("regexp_extract(") <= 3
    sealed = spark.range(3).select("id", F.explode(F.array(tokens.tokenizer(bytes(32), "tok1")(F.lit("email"), F.col("id").cast("string")))).alias("t"))
    assert [tuple(r.o) for r in sealed.select("id", opened.alias("o")).orderBy("id").collect()] == [("email", str(i)) for i in range(3)]
