import random

import pyarrow as pa
from pyspark.sql import functions as F

from shroudline.config import DEFAULT_POLICY_RULES, Detection, PolicyRule
from shroudline.functions import ranks
from shroudline.operators import payloads as Y, policy as P, skew

RANK = {name: i for i, name in enumerate(ranks.ACTIONS)}


def test_authorised_needs_clearance_and_label(spark):
    finding = "named_struct('label','phone','min_clearance','confidential','authorized_action','allow','unauthorized_action','block')"
    callers = [("internal", ["email"]), ("internal", ["phone"]), ("confidential", ["email"]), ("confidential", ["phone"]), ("restricted", ["phone"])]
    df = spark.createDataFrame([(i, (c, a)) for i, (c, a) in enumerate(callers)], "i int, caller struct<clearance:string,allowed_labels:array<string>>")
    rows = df.select("i", P.finding_action(F.expr(finding), F.col("caller")).alias("a")).orderBy("i").collect()
    assert [r.a for r in rows] == ["block", "block", "block", "allow", "allow"]


def test_external_rules(spark):
    def decide(direction, labels, role, escalated, rules=DEFAULT_POLICY_RULES):
        got = spark.range(1).select(
            P.external_decision(rules, F.lit(direction), F.array(*map(F.lit, labels)).cast("array<string>"), F.lit(role), F.lit(escalated)).alias("d")
        ).first().d
        return got and got.action

    assert decide("request", ["bearer_token"], "employee", False) == "block"
    assert decide("request", ["bearer_token"], "admin", False) is None
    assert decide("request", ["national_id"], "employee", True) == "review"
    assert decide("response", ["secret_like"], "employee", False) == "redact"
    assert decide("request", [], "employee", True) is None
    assert decide("request", ["bearer_token", "national_id"], "employee", True) == "block"
    assert decide("request", ["a"], "x", False, (PolicyRule("redact", "one"), PolicyRule("redact", "two"))) == "redact"


def fold(items):
    """One outcome after another, by the rule in words."""
    rank, source, reason = 0, "builtin", None
    for r, s, c in items:
        if r > rank or (r == rank and source == "builtin" and s != "builtin") or (reason is None and c is not None):
            source, reason = s, c
        rank = max(rank, r)
    return ranks.ACTIONS[rank], source, reason


def test_ordered_merge_equals_one_pass_for_any_block_size(spark):
    rng = random.Random(3)
    rows, streams = [], {}
    for stream in range(25):
        items = [
            (rng.choice([0, 0, 0, 1, 2, 3]), rng.choice(["builtin", "opa", "other"]), rng.choice([None, None, "a", "b"]))
            for _ in range(rng.randint(1, 40))
        ]
        streams[stream] = fold(items)
        rows += [(stream, seq, ranks.ACTIONS[r], s, c) for seq, (r, s, c) in enumerate(items)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id int, seq bigint, decision string, source string, reason string")
    for size in (3, 7, 65_536):
        got = {r.stream_id: (r.decision, r.source, r.reason) for r in P.merge_outcomes(df, block_size=size).collect()}
        assert got == streams


def test_stream_that_finds_nothing_keeps_its_row(spark):
    df = spark.createDataFrame([(1, 0, "allow", "builtin", None)], "stream_id int, seq bigint, decision string, source string, reason string")
    assert [tuple(r) for r in P.merge_outcomes(df).collect()] == [(1, "allow", "builtin", None)]


def test_later_reason_replaces_an_empty_one_even_at_lower_rank(spark):
    df = spark.createDataFrame([(1, 0, "block", "opa", None), (1, 1, "redact", "x", "why")], "stream_id int, seq bigint, decision string, source string, reason string")
    assert [tuple(r) for r in P.merge_outcomes(df).collect()] == [(1, "block", "x", "why")]


def test_outcomes_are_made_once(spark, tmp_path):
    log = str(tmp_path / "rows")

    @F.arrow_udf("string")
    def decided(seqs: pa.Array) -> pa.Array:
        with open(log, "a") as out:
            out.write(f"{len(seqs)}\n")
        return pa.array(["block" if s >= 1500 else "allow" for s in seqs.to_pylist()])

    lines = spark.range(2000).select(
        (F.col("id") % 7).alias("stream_id"), (F.col("id") * 1_000_003 - 7).alias("seq"), skew.bound(decided("id")).alias("decision"),
        F.lit("builtin").alias("source"), F.lit(None).cast("string").alias("reason"),
    )
    got = {r.stream_id: (r.decision, r.n) for r in P.merge_outcomes(lines, sums={"n": F.lit(1)}).collect()}
    assert got == {k: ("block", len(range(k, 2000, 7))) for k in range(7)}
    assert sum(map(int, open(log))) == 2000


def test_order_may_be_sparse_negative_or_missing(spark):
    rng = random.Random(5)
    rows, streams = [], {}
    for stream, n in (("a", 3000), ("b", 1), ("c", 40)):
        items = [(rng.choice([0, 0, 0, 1, 2]), rng.choice(["builtin", "opa", "other"]), rng.choice([None, None, "x", "y"])) for _ in range(n)]
        streams[stream] = fold(items)
        seqs = sorted(rng.sample(range(-10**15, 10**15), n))
        rows += [(stream, seq, ranks.ACTIONS[r], s, c) for seq, (r, s, c) in zip(seqs, items)]
    rng.shuffle(rows)
    rows += [("a", None, "block", "opa", "no place"), (None, 5, "block", "opa", "no stream")]
    df = spark.createDataFrame(rows, "stream_id string, seq bigint, decision string, source string, reason string").repartition(6)
    for size in (4, 65_536):
        assert {r.stream_id: (r.decision, r.source, r.reason) for r in P.merge_outcomes(df, block_size=size).collect()} == streams


def test_outcome_alone_puts_no_body_together(spark):
    lines = spark.createDataFrame([(1, 'data: {"delta":"mail a@corp.example"}')], "stream_id int, line string")
    done = Y.redact_lines(lines, Detection(), P.local_principal(), rules=DEFAULT_POLICY_RULES)
    calls = [rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") for rows in (done.select("decision", "source", "resolved"), done)]
    assert calls == [2, 3]
    assert done.first().out.startswith("data: {") and "a@corp.example" not in done.first().out
