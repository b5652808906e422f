import datetime as dt
import hashlib

from pyspark.sql import functions as F

from shroudline.operators import reviews as W

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TICKET = "struct<id:string,created_at:timestamp,status:string,fingerprint:string,principal:string,path:string,request_sha256:string,post_approval_action:string>"
LOG = f"type string, ticket {TICKET}, ticket_id string, status string, resolved_by string, note string, resolved_at timestamp, expires_at timestamp"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def created(id_, secs, fp="f", principal="p", post="allow"):
    return ("created", (id_, at(secs), "pending", fp, principal, "/x", "sha", post), None, None, None, None, None, None)


def resolved(id_, secs, status="approved", ttl=900):
    return ("resolved", None, id_, status, "admin", None, at(secs), at(secs + ttl))


def tickets(spark, *events):
    return W.fold_tickets(spark.createDataFrame(list(events), LOG))


def test_fold_takes_the_latest_resolution_of_known_tickets(spark):
    rows = {r.ticket_id: r for r in tickets(
        spark, resolved("t1", 50, "rejected"), created("t1", 0), resolved("t1", 20), created("t2", 5), resolved("gone", 9), resolved("t3", 1), created("t3", 9)
    ).collect()}
    assert {k: r.status for k, r in rows.items()} == {"t1": "rejected", "t2": "pending", "t3": "pending"}
    assert rows["t1"].resolved_at.replace(tzinfo=dt.timezone.utc) == at(50) and rows["t2"].expires_at is None


def test_overrides_at_a_time(spark):
    state = tickets(spark, created("t1", 0), resolved("t1", 10), created("t2", 20), resolved("t2", 30, "rejected", ttl=100))

    def live(secs):
        when = F.lit(at(secs).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
        return [(r.ticket_id, r.status) for r in W.overrides_asof(state, when).collect()]

    assert live(5) == [] and live(10) == [("t1", "approved")] and live(30) == [("t2", "rejected")]
    assert live(130) == []  # expired, and it hides the older one


def test_apply_prefers_the_named_ticket_and_ignores_its_age(spark):
    state = tickets(
        spark, created("t1", 0, post="redact"), resolved("t1", 10, ttl=100), created("t2", 200, fp="g"), resolved("t2", 210, "rejected", ttl=100), created("t3", 0, fp="h"))
    asked = [
        ("before", 5, "f", None), ("within", 60, "f", None), ("edge", 110, "f", None), ("after", 5000, "f", None), ("replay", 5000, "f", "t1"),
        ("other fp", 5000, "z", "t1"), ("wrong", 60, "f", "t2x"), ("g", 250, "g", None), ("pending", 50, "h", "t3"),
    ]
    df = spark.createDataFrame(
        [(i, at(s), fp, ref, "p", "/x", "sha", "review", "builtin", None) for i, s, fp, ref in asked],
        "request_id string, ts timestamp, fingerprint string, review_ticket string, principal string, path string, request_sha256 string, decision string, source string, reason string")
    got = {r.request_id: (r.decision, r.source) for r in W.apply_overrides(df, state, 90).collect()}
    used = ("redact", "review_override_approved")
    assert got == {
        "before": ("review", "builtin"), "within": used, "edge": ("review", "builtin"), "after": ("review", "builtin"), "replay": used, "other fp": used,
        "wrong": used, "g": ("block", "review_override_rejected"), "pending": ("review", "builtin"),
    }


def test_named_ticket_of_someone_else_does_not_count(spark):
    state = tickets(spark, created("t1", 0, principal="q"), resolved("t1", 10, ttl=1))
    df = spark.createDataFrame([("r", at(500), "f", "t1", "p", "/x", "sha", "review", "builtin", None)],
        "request_id string, ts timestamp, fingerprint string, review_ticket string, principal string, path string, request_sha256 string, decision string, source string, reason string")
    assert W.apply_overrides(df, state).first().decision == "review"


def test_resolve_batch(spark):
    state = tickets(spark, created("t1", 0), created("t2", 0), resolved("t2", 5))
    asked = spark.createDataFrame([
        (1, "t1", "approved", at(20)), (2, "t1", "rejected", at(10)), (3, "t2", "approved", at(10)), (4, "nope", "approved", at(10)),
    ], "event_id bigint, ticket_id string, status string, requested_at timestamp")
    got = {r.event_id: r for r in W.resolve(asked, state, 900).collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "already_resolved", 2: "resolved", 3: "already_resolved", 4: "not_found"}
    assert got[2].expires_at.replace(tzinfo=dt.timezone.utc) == at(910) and got[1].expires_at is None


def test_open_once_per_fingerprint(spark):
    state = tickets(spark, created("t1", 0, fp="a"), created("t2", 0, fp="b"), resolved("t2", 5))
    asked = spark.createDataFrame([("r1", at(9), "a"), ("r3", at(9), "b"), ("r2", at(8), "b"), ("r4", at(9), "c")], "request_id string, ts timestamp, fingerprint string")
    assert sorted(r.request_id for r in W.open_tickets(asked, state).collect()) == ["r2", "r4"]


def test_trim_drops_shared_entries(spark):
    state = tickets(spark, created("t1", 1, fp="a"), created("t2", 2, fp="b"), created("t3", 3, fp="a"), created("t4", 4, fp="c"))
    assert {r.ticket_id: r.entry_live for r in W.trim_tickets(state, 3).collect()} == {"t2": True, "t3": False, "t4": True}


def test_listing(spark):
    state = tickets(spark, *[created(f"t{i}", i) for i in range(5)], resolved("t1", 50))
    assert [r.ticket_id for r in W.list_tickets(state, None, 2).collect()] == ["t4", "t3"]
    assert [r.ticket_id for r in W.list_tickets(state, "approved").collect()] == ["t1"]
    assert W.list_tickets(state, "all").count() == 5 and W.list_tickets(state, "odd").count() == 4
    assert W.pending_count(state).first()[0] == 4


def test_fingerprint(spark):
    got = spark.range(1).select(W.fingerprint(F.lit("t"), F.lit("/p"), F.lit("s"))).first()[0]
    assert got == hashlib.sha256(b"t|/p|s").hexdigest()


def test_history_opens_again_after_a_resolution(spark):
    asked = spark.createDataFrame(
        [(i, at(s), fp) for i, s, fp in [("a", 0, "f"), ("b", 5, "f"), ("c", 10, "f"), ("d", 11, "f"), ("e", 4000, "f"), ("g", 4001, "f"), ("h", 3, "z"), ("i", 3, "z"), ("j", 3, "z")]],
        "request_id string, ts timestamp, fingerprint string")
    # b opened nothing, so its resolution is nobody's; h is resolved at once, i is not
    done = spark.createDataFrame([(i, at(s)) for i, s in [("a", 10), ("a", 20), ("b", 6), ("c", 3000), ("e", 3999), ("h", 3)]], "ticket_id string, resolved_at timestamp")
    for bins in (1, 900):
        assert sorted(r.request_id for r in W.open_history(asked, done, None, bins).collect()) == ["a", "c", "e", "h", "i"]
    before = asked.where("request_id = 'c'")
    assert sorted(r.request_id for r in W.open_history(asked, done, before).collect()) == ["e", "h", "i"]


def test_cover_holds_each_bin_once(spark):
    spans = [(0, 0), (5, 9), (15, 16), (-40, 300), (4095, 4097), (1, 70_000), (-7, -7), (255, 256 * 16 + 3), (0, 3_506_000)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", W.cover(F.col("a"), F.col("b")).alias("c")).collect()
    for a, b, nodes in rows:
        bins = sorted((n.node * W.RADIX**n.level, (n.node + 1) * W.RADIX**n.level) for n in nodes)
        assert bins[0][0] == a and bins[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(bins, bins[1:]))
        assert len(nodes) <= 2 * W.RADIX * W.LEVELS
    paths = spark.createDataFrame([(b,) for b in (-41, -40, 0, 16, 299, 300, 301)], "bin long").select("bin", W.above(F.col("bin")).alias("p")).collect()
    held = {(n.level, n.node) for n in next(r.c for r in rows if (r.a, r.b) == (-40, 300))}
    assert {r.bin: sum((n.level, n.node) in held for n in r.p) for r in paths} == {-41: 0, -40: 1, 0: 1, 16: 1, 299: 1, 300: 1, 301: 0}


def test_overrides_of_a_century(spark):
    century = 100 * 365 * 86_400
    state = tickets(spark, created("t1", 0, post="redact"), resolved("t1", 10, ttl=century), created("t2", 0, fp="g"), resolved("t2", 10, "rejected", ttl=60))
    assert W.override_periods(state, 900).where("fingerprint = 'f'").count() <= 2 * W.RADIX * W.LEVELS
    asked = [("early", 9, "f"), ("first", 10, "f"), ("late", century // 2, "f"), ("last", century + 9, "f"), ("gone", century + 10, "f"), ("g", 69, "g"), ("g gone", 70, "g")]
    df = spark.createDataFrame(
        [(i, at(s), fp, None, "p", "/x", "sha", "review", "builtin", None) for i, s, fp in asked],
        "request_id string, ts timestamp, fingerprint string, review_ticket string, principal string, path string, request_sha256 string, decision string, source string, reason string")
    got = {r.request_id: r.decision for r in W.apply_overrides(df, state).collect()}
    assert got == {"early": "review", "first": "redact", "late": "redact", "last": "redact", "gone": "review", "g": "block", "g gone": "review"}
