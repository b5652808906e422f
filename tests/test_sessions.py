import datetime as dt
import random

from pyspark.sql import functions as F

from shroudline.operators import sessions as N

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "session_id string, ts timestamp, request_id string, labels array<string>"


def rows_of(spark, items):
    return spark.createDataFrame([(s, START + dt.timedelta(seconds=t), i, labels) for s, t, i, labels in items], SCHEMA)


def fold(items, ttl, threshold):
    state, out = {}, {}
    for session, at, row, labels in sorted(items, key=lambda x: (x[0], x[1], x[2])):
        last, held, segment = state.get(session, (None, set(), 0))
        if last is not None and at - last > ttl:
            held, segment = set(), segment + 1
        held = held | set(labels)
        state[session] = (at, held, segment)
        out[row] = (segment, len(held) >= threshold)
    return out


def test_correlation_equals_one_pass(spark):
    rng = random.Random(11)
    items = []
    for i in range(1500):
        session = "hot" if i % 3 == 0 else f"s{i % 17}"
        items.append((session, rng.randint(0, 40_000), f"r{i:05d}", rng.choice([[], [], ["a"], ["b"], ["a", "c"]])))
    for ttl, threshold in ((60, 2), (600, 3)):
        got = {r.request_id: (r.segment, r.escalated) for r in N.correlate(rows_of(spark, items), ttl, threshold).collect()}
        assert got == fold(items, ttl, threshold)
        segments = {r.request_id: r.segment for r in N.sessionize(rows_of(spark, items), ttl).collect()}
        assert segments == {k: v[0] for k, v in fold(items, ttl, threshold).items()}


def test_gap_of_exactly_the_ttl_keeps_the_session(spark):
    items = [("s", 0, "1", ["email"]), ("s", 1800, "2", []), ("s", 3600, "3", ["phone"]), ("s", 3700, "4", []), ("s", 5501, "5", [])]
    got = {r.request_id: (r.segment, r.escalated) for r in N.correlate(rows_of(spark, items), 1800, 2).collect()}
    assert got == {"1": (0, False), "2": (0, False), "3": (0, True), "4": (0, True), "5": (1, False)}


def test_marks_expire(spark):
    rng = random.Random(2)
    marks = [("a" if i % 3 else "b", rng.randint(0, 5000), f"m{i}", []) for i in range(40)]
    probes = [("a" if i % 3 else "b", rng.randint(0, 6000), f"p{i}", []) for i in range(400)] + [("c", 1, "c", [])]
    marks += [("d", 100, "d", [])]
    probes += [("d", 100, "same", []), ("d", 399, "last", []), ("d", 400, "over", []), ("d", 99, "early", [])]
    got = {r.request_id: r.marked for r in N.flag_marked(rows_of(spark, probes), rows_of(spark, marks), 300, "session_id").collect()}
    for key, at, row, _ in probes:
        assert got[row] == any(k == key and m <= at < m + 300 for k, m, *_ in marks)


def test_active_and_capped(spark):
    df = rows_of(spark, [("a", 0, "1", []), ("b", 10, "2", []), ("c", 20, "3", []), ("a", 30, "4", [])])
    at = F.lit("2024-01-01 00:00:40").cast("timestamp")
    assert N.active_sessions(df, at, 20).first()[0] == 2
    assert [r.session_id for r in N.cap_sessions(df, 2).collect()] == ["a", "c"]
