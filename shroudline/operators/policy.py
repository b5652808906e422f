"""Policy: who may see what, and what happens to a payload.

Lookups go against configuration (callers, policy rows), so they are local relations or literals of
known size; decisions are folds over the finding array of one row.  Nothing here shuffles except the
ordered merge of stream outcomes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.config import LOCAL_PRINCIPAL, PolicyRule, Principal, as_rows
from shroudline.functions import ranks, text as T
from shroudline.operators import skew

PRINCIPALS = (
    "name string, tenant_id string, role string, clearance string, secret_sha256 string, allowed_labels array<string>"
)
OUTCOME_STATE = "struct<rank:int,source:string,reason:string,touched:boolean>"
BLOCK = 65_536

# Policy sources counted as processing fallbacks.
FALLBACK_SOURCES = (
    "attachment_review_fallback", "json_processing_error_fallback", "presidio_error_fallback",
    "processing_error_fallback", "opa_error_fallback", "builtin_fail_open",
)


def principals_df(spark: SparkSession, principals: tuple[Principal, ...]) -> DataFrame:
    rows = [{**row, "allowed_labels": list(row["allowed_labels"])} for row in as_rows(principals)]
    secrets = [row["secret_sha256"].lower() for row in rows if row["secret_sha256"]]
    if len(set(secrets)) < len(secrets):
        raise ValueError("two callers share one secret")
    return spark.createDataFrame(rows, PRINCIPALS)


def secret_hash(header: Column, name: str = "authorization") -> Column:
    """Hash of the credential; only the Authorization header carries a scheme in front of it."""
    bare = F.regexp_replace(header, "^[Bb]earer ", "") if name.lower() == "authorization" else header
    return F.sha2(bare, 256)


def attach_principal(traffic: DataFrame, principals: DataFrame, header: str = "authorization") -> DataFrame:
    """Authenticated rows with their caller; Spark broadcasts the callers where they are few."""
    callers = principals.select(
        F.lower("secret_sha256").alias("_secret"), F.struct("name", "tenant_id", "role", "clearance", "allowed_labels").alias("caller")
    )
    return traffic.withColumn("_secret", secret_hash(F.col(header), header)).join(callers, "_secret").drop("_secret")


def auth_failures(traffic: DataFrame, principals: DataFrame, header: str = "authorization") -> DataFrame:
    """Rows without a known caller, with the reason."""
    known = principals.select(F.lower("secret_sha256").alias("_secret"))
    reason = F.when(F.col(header).isNull(), F.lit("missing_credentials")).otherwise(F.lit("invalid_credentials"))
    return (
        traffic.withColumn("_secret", secret_hash(F.col(header), header))
        .join(known, "_secret", "left_anti")
        .withColumn("reason", reason)
        .drop("_secret")
    )


def local_principal() -> Column:
    p = LOCAL_PRINCIPAL
    return F.struct(
        F.lit(p.name).alias("name"), F.lit(p.tenant_id).alias("tenant_id"), F.lit(p.role).alias("role"),
        F.lit(p.clearance).alias("clearance"), F.array().cast("array<string>").alias("allowed_labels"),
    )


def effective_action(action: Column, direction: Column) -> Column:
    """On responses everything but ``allow`` is carried out as ``redact``."""
    return F.when((direction == "response") & (action != "allow"), F.lit("redact")).otherwise(action)


def finding_action(finding: Column, caller: Column) -> Column:
    """The authorised action needs both the clearance and the label."""
    cleared = ranks.clearance_rank(caller["clearance"]) >= ranks.clearance_rank(finding["min_clearance"])
    granted = F.array_contains(caller["allowed_labels"], finding["label"])
    return F.when(cleared & granted, finding["authorized_action"]).otherwise(finding["unauthorized_action"])


def resolve(findings: Column, caller: Column, direction: Column) -> Column:
    """Findings with ``action`` and ``effective_action``."""

    def judged(f: Column) -> Column:
        return f.withField("action", finding_action(f, caller))

    def carried_out(f: Column) -> Column:
        return f.withField("effective_action", effective_action(f["action"], direction))

    return F.transform(F.transform(findings, judged), carried_out)


def decide(resolved: Column) -> Column:
    """Strictest action of a payload; ``allow`` without findings."""
    highest = F.array_max(F.transform(resolved, lambda f: ranks.action_rank(f["action"])))
    return ranks.action_of(F.coalesce(highest, F.lit(0)))


def evidence(resolved: Column) -> Column:
    """What leaves the engine about a finding: never the value itself."""
    return F.transform(
        resolved,
        lambda f: F.struct(*[f[n].alias(n) for n in
                             ("label", "rule_name", "action", "pointer", "severity", "matched_sha256", "matched_len")]),
    )


def external_decision(rules: tuple[PolicyRule, ...], direction: Column, labels: Column, role: Column,
                      escalated: Column) -> Column:
    """``struct<action,reason>`` of the strictest policy row that fires (earlier row on a tie), else NULL."""
    as_rows(rules)
    fired = []
    for position, rule in enumerate(rules):
        tests = [F.lit(True)]
        if rule.direction is not None:
            tests.append(direction == rule.direction)
        if rule.label is not None:
            tests.append(F.array_contains(labels, rule.label))
        if rule.role_not is not None:
            tests.append(role != rule.role_not)
        if rule.session_escalated is not None:
            tests.append(escalated == F.lit(rule.session_escalated))
        row = F.struct(
            F.lit(ranks.ACTIONS.index(rule.action)).alias("rank"), F.lit(-position).alias("before"),
            F.lit(rule.action).alias("action"), F.lit(rule.reason).alias("reason"),
        )
        fired.append(F.when(reduce(lambda a, b: a & b, tests), row))
    if not fired:
        return F.lit(None).cast("struct<action:string,reason:string>")
    best = F.array_max(F.array_compact(F.array(*fired)))
    return F.when(best.isNotNull(), F.struct(best["action"].alias("action"), best["reason"].alias("reason")))


def merge_external(decision: Column, source: Column, reason: Column, external: Column) -> Column:
    """``struct<decision,source,reason>``: the external answer can only tighten, and signs the result."""
    merged = F.struct(
        ranks.stricter(decision, external["action"]).alias("decision"), F.lit("opa").alias("source"),
        external["reason"].alias("reason"),
    )
    base = F.struct(decision.alias("decision"), source.alias("source"), reason.alias("reason"))
    return F.when(external.isNotNull(), merged).otherwise(base)


def on_policy_error(decision: Column, source: Column, reason: Column, error: Column, direction: Column,
                    fail_open: Column) -> Column:
    """``struct<decision,source,reason,failed>`` when the external policy could not answer."""

    def result(d: Column, s: Column, r: Column, failed: Column) -> Column:
        return F.struct(d.alias("decision"), s.alias("source"), r.alias("reason"), failed.alias("failed"))

    no, yes = F.lit(False), F.lit(True)
    ignored = result(decision, F.lit("builtin_fail_open"), F.concat(F.lit("opa error ignored: "), error), no)
    filtered = result(F.lit("redact"), F.lit("opa_error_fallback"), F.lit("opa failed during response filtering"), no)
    refused = result(F.lit("block"), F.lit("request_pre_upstream_error"), F.concat(F.lit("process_payload/opa: "), error), yes)
    return (
        F.when(error.isNull(), result(decision, source, reason, no))
        .when(fail_open, ignored)
        .when(direction == "response", filtered)
        .otherwise(refused)
    )


def sentinel(is_json: Column) -> Column:
    return F.when(is_json, F.lit(T.REDACTED_JSON)).otherwise(F.lit(T.REDACTED_TEXT))


def response_decision(final: Column) -> Column:
    return F.when(final == "allow", F.lit("allow")).otherwise(F.lit("redact"))


def response_body(original: Column, sanitised: Column, is_json: Column, base: Column, final: Column) -> Column:
    """What is sent back: untouched, rewritten, or a fixed text when policy tightened after scanning."""
    tightened = ranks.action_rank(final) > ranks.action_rank(base)
    return F.when(final == "allow", original).when(tightened, sentinel(is_json)).otherwise(sanitised)


def outbound_body(original: Column, sanitised: Column, decision: Column) -> Column:
    """What is sent on: rewritten only for ``redact``; nothing for ``review`` and ``block``."""
    return F.when(decision == "redact", sanitised).when(decision == "allow", original)


def preserve_signed(original: Column, outbound: Column, signs_body: Column) -> Column:
    return F.when(signs_body, original).otherwise(outbound)


def failed_stage(error: Column, kind: Column) -> Column:
    """The stage that ``error`` belongs to: reading a body as JSON or as text, or else the payload as a whole; NULL without error."""
    return F.when(error.isNotNull(), F.when(kind.isin("json", "text"), kind).otherwise(F.lit("payload")))


def with_fallback(decision: Column, source: Column, reason: Column, body: Column, failed_stage: Column) -> Column:
    """``struct<decision,source,reason,body>``: on a failed stage the body is withheld, not passed."""
    # Stage, source name and reason of each fallback.
    stages = {
        "json": ("json_processing_error_fallback", "json payload processing failed", T.REDACTED_JSON),
        "text": ("presidio_error_fallback", "presidio analysis failed", T.REDACTED_TEXT),
        "payload": ("processing_error_fallback", "payload processing failed", T.REDACTED_JSON),
    }
    chain = F
    for stage, (name, why, shown) in stages.items():
        chain = chain.when(
            failed_stage == stage,
            F.struct(F.lit("redact").alias("decision"), F.lit(name).alias("source"), F.lit(why).alias("reason"), F.lit(shown).alias("body")),
        )
    return chain.otherwise(F.struct(decision.alias("decision"), source.alias("source"), reason.alias("reason"), body.alias("body")))


def post_approval(base_decision: Column) -> Column:
    """What an approved request gets: masked if scanning alone asked for that, else forwarded as it is."""
    return F.when(base_decision == "redact", F.lit("redact")).otherwise(F.lit("allow"))


# -- ordered merge of the outcomes of one stream ------------------------------------------------
#
# The merge is order dependent and not a plain maximum, so one stream cannot be reduced by a SQL
# aggregate.  But what a run of outcomes does depends on little of the state before it: its rank,
# whether its source is the built-in one, and whether it has a reason.  A block of outcomes is
# therefore summarised by what it makes of each of those 16 start states, blocks are folded into
# larger ones, and no task ever holds more than a block of one stream.


def _state(rank: Column, source: Column, reason: Column, touched: Column) -> Column:
    return F.struct(rank.alias("rank"), source.alias("source"), reason.alias("reason"), touched.alias("touched"))


def _merge_step(acc: Column, nxt: Column) -> Column:
    stronger = nxt["rank"] > acc["rank"]
    named = (nxt["rank"] == acc["rank"]) & (acc["source"] == "builtin") & (nxt["source"] != "builtin")
    explains = acc["reason"].isNull() & nxt["reason"].isNotNull()
    taken = stronger | named | explains
    return _state(
        F.greatest(acc["rank"], nxt["rank"]),
        F.when(taken, nxt["source"]).otherwise(acc["source"]),
        F.when(taken, nxt["reason"]).otherwise(acc["reason"]),
        acc["touched"] | taken,
    )


def _class_of(state: Column) -> Column:
    builtin = F.when(state["source"] == "builtin", 1).otherwise(0)
    silent = F.when(state["reason"].isNull(), 1).otherwise(0)
    return (state["rank"] * 4 + builtin * 2 + silent + 1).cast("int")


def _start_states() -> Column:
    none = F.lit(None).cast("string")
    return F.array(*[
        _state(F.lit(rank), F.lit("builtin" if builtin else "?"), none if silent else F.lit("?"), F.lit(False))
        for rank in range(4) for builtin in (0, 1) for silent in (0, 1)
    ])


def _begin() -> Column:
    return _state(F.lit(0), F.lit("builtin"), F.lit(None).cast("string"), F.lit(False))


def _starts(block: Column) -> Column:
    """Start states to try: the first block of a stream has only one."""
    return F.when(block == 0, F.array(_begin())).otherwise(_start_states())


def _through(acc: Column, table: Column) -> Column:
    """Send a state through the table of a block."""
    end = F.element_at(table, F.when(F.size(table) == 1, 1).otherwise(_class_of(acc)))
    return _state(
        end["rank"],
        F.when(end["touched"], end["source"]).otherwise(acc["source"]),
        F.when(end["touched"], end["reason"]).otherwise(acc["reason"]),
        acc["touched"] | end["touched"],
    )


def merge_outcomes(outcomes: DataFrame, key: str = "stream_id", seq: str = "seq", block_size: int = BLOCK,
                   sums: dict[str, Column] | None = None, dense: bool = False) -> DataFrame:
    """Fold (decision, source, reason) of each stream in ``seq`` order to one outcome per stream.

    ``seq`` may be any unique whole numbers; ``dense`` says that they run from 0 without gaps, which saves ordering them.  Otherwise rows
    without stream or number are left out, and what is judged of the others is settled: however dear the outcomes are, they are made once.

    ``sums`` are added up on the way, so that counting lines or findings takes no second pass.
    """
    sums = sums or {}
    item = _state(ranks.action_rank(F.col("decision")), F.col("source"), F.col("reason"), F.lit(False))
    # what changes no state is NULL here, and NULLs are not collected: most lines of a stream find nothing
    idle = (F.col("decision") == "allow") & (F.col("source") == "builtin") & F.col("reason").isNull()
    changes = outcomes.select(key, F.col(seq).cast("bigint").alias("_seq"), F.when(~idle, item).alias("_item"),
                              *[column.alias(name) for name, column in sums.items()])
    if not dense:
        changes = skew.rising(changes.where(F.col(key).isNotNull() & F.col("_seq").isNotNull()), key, ["_seq", "_item"], "_seq")

    def folded(rows: DataFrame, column: str, *by) -> DataFrame:
        """Per group the list of ``column`` in order, bound before folds look into it sixteen times."""
        listed = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("_seq", column))))
        grouped = rows.groupBy(key, *by).agg(listed.alias("_found"), *[F.sum(name).alias(name) for name in sums])
        return grouped.withColumn("_list", skew.bound(F.transform("_found", lambda x: x[column]))).drop("_found")

    block = F.floor(F.col("_seq") / block_size).alias("_block")
    lines = folded(changes, "_item", block)
    # an outcome equal to the one before it changes nothing
    distinct = F.filter("_list", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get("_list", i - 1)))
    tables = lines.withColumn("_list", skew.bound(distinct)).select(
        key, F.col("_block").alias("_seq"), F.transform(_starts(F.col("_block")), lambda s: F.aggregate("_list", s, _merge_step)).alias("_table"), *sums
    )
    larger = folded(tables, "_table", block).select(
        key, F.col("_block").alias("_seq"), F.transform(_starts(F.col("_block")), lambda s: F.aggregate("_list", s, _through)).alias("_table"), *sums
    )
    end = folded(larger, "_table").select(key, F.aggregate("_list", _begin(), _through).alias("_end"), *sums)
    return end.select(
        key, ranks.action_of(F.col("_end.rank")).alias("decision"), F.col("_end.source").alias("source"), F.col("_end.reason").alias("reason"), *sums
    )
