"""Payloads: JSON bodies, plain texts and event-stream lines, scanned and rewritten on their own row.

A body is walked into its string leaves, the leaves are scanned together, and rewritten leaves are
put back, all on the payload's row: nothing is exploded and regrouped, so nothing shuffles.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.config import Detection, PolicyRule
from shroudline.functions import ranks, text as T
from shroudline.operators import detect as D, policy as P, redact as R, skew

LEAVES = "array<struct<pointer:string,text:string>>"
CHAT = "struct<messages:array<struct<role:string,content:string>>,model:string>"

_LEAF_TYPE = pa.list_(pa.struct([("pointer", pa.string()), ("text", pa.string())]))


def _refuse(constant: str):
    raise ValueError(constant)


def _parse(body: str):
    """The JSON value of a body; ValueError for anything a strict parser would refuse."""
    value = json.loads(body, parse_constant=_refuse)
    if "\\u" in body:  # an escape may stand for half a character, which no UTF-8 text can hold
        _dump(value).encode()
    return value


def _dump(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _walk(value, pointer: str):
    """String leaves in key order, with their RFC 6901 pointers."""
    if isinstance(value, str):
        yield pointer, value
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from _walk(item, f"{pointer}/{i}")
    elif isinstance(value, dict):
        for key in sorted(value):
            step = key.replace("~", "~0").replace("/", "~1")
            yield from _walk(value[key], f"{pointer}/{step}")


def _put(value, pointer: str, changed: dict[str, str]):
    if isinstance(value, str):
        return changed.get(pointer, value)
    if isinstance(value, list):
        return [_put(item, f"{pointer}/{i}", changed) for i, item in enumerate(value)]
    if isinstance(value, dict):
        return {key: _put(item, f"{pointer}/" + key.replace("~", "~0").replace("/", "~1"), changed) for key, item in value.items()}
    return value


def _leaves_batch(bodies: pa.Array) -> pa.Array:
    out = []
    for body in bodies.to_pylist():
        try:
            out.append(None if body is None else [{"pointer": p, "text": t} for p, t in _walk(_parse(body), "")])
        except (ValueError, RecursionError):
            out.append(None)
    return pa.array(out, _LEAF_TYPE)


def _rebuild_batch(bodies: pa.Array, changed: pa.Array) -> pa.Array:
    out = []
    for body, leaves in zip(bodies.to_pylist(), changed.to_pylist()):
        if body is None:
            out.append(None)
        else:
            out.append(_dump(_put(_parse(body), "", {leaf["pointer"]: leaf["text"] for leaf in leaves or ()})))
    return pa.array(out, pa.string())


def json_leaves(body: Column) -> Column:
    """String leaves of one JSON document; NULL where the text is not JSON."""
    return F.arrow_udf(_leaves_batch, LEAVES)(body)


def rebuild_json(body: Column, changed: Column) -> Column:
    """The document with the given leaves replaced, keys in order, no spaces."""
    return F.arrow_udf(_rebuild_batch, "string")(body, changed)


def explode_leaves(df: DataFrame, *keep: str, body: str = "body", is_json: Column | None = None) -> DataFrame:
    """One row per leaf; what is not JSON is one leaf at ``/``."""
    wanted = F.lit(True) if is_json is None else is_json
    leaves = json_leaves(F.when(wanted, F.col(body)))
    whole = F.array(F.struct(F.lit("/").alias("pointer"), F.col(body).alias("text")))
    return (
        df.withColumn("_leaves", leaves)
        .select(*keep, F.explode(F.coalesce("_leaves", whole)).alias("leaf"))
        .select(*keep, "leaf.pointer", "leaf.text")
    )


def explode_chat(df: DataFrame, *keep: str, body: str = "body") -> DataFrame:
    """Leaves of the known chat shape without leaving the JVM."""
    parsed = F.from_json(body, CHAT)

    def of_message(m: Column, i: Column) -> Column:
        at = F.concat(F.lit("/messages/"), i.cast("string"))
        return F.array(
            F.struct(F.concat(at, F.lit("/content")).alias("pointer"), m["content"].alias("text")),
            F.struct(F.concat(at, F.lit("/role")).alias("pointer"), m["role"].alias("text")),
        )

    model = F.array(F.struct(F.lit("/model").alias("pointer"), F.col("_c.model").alias("text")))
    leaves = F.concat(F.flatten(F.transform("_c.messages", of_message)), model)
    return df.withColumn("_c", parsed).select(*keep, F.explode(leaves).alias("leaf")).select(*keep, "leaf.*").where("text is not null")


def rebuild_chat(body: Column, rewrite) -> Column:
    """The chat shape with ``rewrite`` applied to every content, in key order."""
    parsed = F.from_json(body, CHAT)
    messages = F.transform(
        parsed["messages"], lambda m: F.struct(rewrite(m["content"]).alias("content"), m["role"].alias("role"))
    )
    return F.to_json(F.struct(messages.alias("messages"), parsed["model"].alias("model")))


SCANNED = f"struct<spans:array<{D.SPANS}>,error:string>"


def _scan_lists(lists: pa.Array, patterns: tuple[str, ...], min_length: int | None, min_entropy: float) -> pa.Array:
    """Spans per text of each list, the texts of all lists scanned together."""
    lengths = lists.value_lengths().fill_null(0).to_pylist()
    flat = D.scan_batch(lists.flatten(), patterns, min_length, min_entropy)
    offsets, at = [0], 0
    for length in lengths:
        at += length
        offsets.append(at)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _scan_leaves(texts: Column, config: Detection) -> Column:
    """``struct<spans,error>`` of an array column: spans per text, or why a row could not be scanned.

    The rows of a batch are scanned together; only where that fails is each tried alone.
    """
    patterns = tuple(rule.pattern for rule in config.rules)
    entropy = config.high_entropy
    min_length = entropy.min_length if entropy else None
    min_entropy = entropy.min_entropy if entropy else 0.0

    @F.arrow_udf(SCANNED)
    def spans(lists: pa.Array) -> pa.Array:
        try:
            found, errors = _scan_lists(lists, patterns, min_length, min_entropy), pa.nulls(len(lists), pa.string())
        except (TimeoutError, RecursionError, MemoryError, ValueError, pa.ArrowException):
            rows, why = [], []
            for i in range(len(lists)):
                try:
                    rows.append(_scan_lists(lists.slice(i, 1), patterns, min_length, min_entropy).to_pylist()[0])
                    why.append(None)
                except (TimeoutError, RecursionError, MemoryError, ValueError, pa.ArrowException) as error:
                    rows.append([])
                    why.append(f"{type(error).__name__}: {error}"[:200])
            found, errors = pa.array(rows, pa.list_(D._SPAN_TYPE)), pa.array(why, pa.string())
        return pa.StructArray.from_arrays([found, errors], ["spans", "error"])

    return spans(texts)


def judge_leaves(rows: DataFrame, config: Detection, caller: Column, direction: Column, tokenizer: R.Tokenizer | None = None,
                 scanned: Column | None = None) -> DataFrame:
    """From a ``_leaves`` array to ``resolved``, ``decision``, ``_changed`` (rewritten leaves that had findings) and ``scan_error``.

    ``scanned`` gives the texts to scan where that is only a beginning of each leaf.
    """
    texts = F.transform("_leaves", lambda leaf: leaf["text"]) if scanned is None else scanned
    rows = rows.withColumn("_scan", _scan_leaves(texts, config)).withColumn("_spans", F.col("_scan.spans"))

    def judged(leaf: Column) -> Column:
        found = D.findings_of(leaf["_spans"], leaf["_leaves"]["pointer"], config)
        return F.struct(
            leaf["_leaves"]["pointer"].alias("pointer"), leaf["_leaves"]["text"].alias("text"),
            P.resolve(found, caller, direction).alias("resolved"),
        )

    hit = F.filter(F.arrays_zip("_leaves", "_spans"), lambda z: F.size(z["_spans"]) > 0)
    seen = F.struct(F.transform(hit, judged).alias("hit"), F.col("_scan.error").alias("error"))
    rows = rows.withColumn("_seen", skew.bound(seen)).drop("_leaves", "_spans", "_scan")
    rows = rows.withColumn("_hit", F.col("_seen.hit")).withColumn("scan_error", F.col("_seen.error")).drop("_seen")
    changed = F.transform(
        "_hit", lambda h: F.struct(h["pointer"].alias("pointer"), R.redact_text(h["text"], h["resolved"], tokenizer).alias("text"))
    )
    return (
        rows.withColumn("resolved", F.flatten(F.transform("_hit", lambda h: h["resolved"])))
        .withColumn("decision", P.decide(F.col("resolved")))
        # computed once (tokens are random), and a plain column for the worker functions that read it
        .withColumn("_changed", skew.bound(changed))
        .drop("_hit")
    )


def process(df: DataFrame, config: Detection, caller: Column, direction: Column, body: str = "body",
            is_json: Column | None = None, text_pointer: str = "/", tokenizer: R.Tokenizer | None = None, failure: Column | None = None) -> DataFrame:
    """Scan and judge a payload column: adds ``json`` (whether it was read as JSON), ``resolved``,
    ``decision``, ``source``, ``reason``, ``sanitised`` and ``failed_stage``.

    Where ``is_json`` holds but the body does not parse, it is taken as text.  Ignored pointers are
    left out before scanning.  A row that could not be scanned, or for which ``failure`` says why an earlier step failed, is
    no end of the job: its stage is named, its body withheld and its findings left out.
    """
    wanted = F.lit(True) if is_json is None else is_json
    whole = F.array(F.struct(F.lit(text_pointer).alias("pointer"), F.col(body).alias("text")))
    rows = df.withColumn("_tree", json_leaves(F.when(wanted, F.col(body)))).withColumn("json", F.col("_tree").isNotNull())
    leaves = F.coalesce("_tree", whole)
    if config.ignore_json_pointers:
        leaves = F.filter(leaves, lambda leaf: ~leaf["pointer"].isin(*config.ignore_json_pointers))
    rows = rows.withColumn("_leaves", F.when(F.col(body).isNull(), F.array().cast(LEAVES)).otherwise(leaves)).drop("_tree")
    rows = judge_leaves(rows, config, caller, direction, tokenizer)
    as_text = F.when(F.size("_changed") > 0, F.element_at("_changed", 1)["text"]).otherwise(F.col(body))
    tree = rebuild_json(F.when(F.col("json"), F.col(body)), F.col("_changed"))
    rows = rows.withColumn("_tree", tree).withColumn("sanitised", F.when(F.col("json"), F.col("_tree")).otherwise(as_text)).drop("_changed", "_tree")
    why = F.col("scan_error") if failure is None else F.coalesce("scan_error", failure)
    return withheld(rows.withColumn("failed_stage", P.failed_stage(why, F.when(F.col("json"), "json").otherwise("text"))), "sanitised").drop("scan_error")


def withheld(rows: DataFrame, body: str) -> DataFrame:
    """Rows of a ``failed_stage`` get the fallback of that stage in ``decision``, ``source``, ``reason`` and ``body``, and no findings.

    The body is no part of the struct of the others, so where only the outcome is asked for, none is put together.
    """
    none = F.lit(None).cast("string")
    out = P.with_fallback(F.col("decision"), F.lit("builtin"), none, none, F.col("failed_stage"))
    shown = P.with_fallback(none, none, none, F.col(body), F.col("failed_stage"))["body"]
    return (
        rows.withColumn("_out", out)
        .withColumn("resolved", F.when(F.col("failed_stage").isNull(), F.col("resolved")).otherwise(F.filter("resolved", lambda _: F.lit(False))))
        .withColumn("decision", F.col("_out.decision")).withColumn("source", F.col("_out.source")).withColumn("reason", F.col("_out.reason"))
        .withColumn(body, shown).drop("_out")
    )


def scrub_bodies(df: DataFrame, config: Detection, body: str = "body", tokenizer: R.Tokenizer | None = None) -> DataFrame:
    """One-call scrub of bodies that may be JSON or text, for a caller nobody vouches for.

    Every string is scanned; ignored pointers do not apply here.
    """
    everything = Detection(config.rules, config.high_entropy, config.entities)
    return process(df, everything, P.local_principal(), F.lit("request"), body, tokenizer=tokenizer)


def redact_lines(lines: DataFrame, config: Detection, caller: Column, line: str = "line",
                 rules: tuple[PolicyRule, ...] = (), escalated: Column | None = None) -> DataFrame:
    """Event-stream lines rewritten one by one: adds ``out``, ``decision``, ``source``, ``reason`` and ``resolved``.

    Lines that carry no data pass untouched.  A value split over two events is not seen.
    """
    rows = lines.withColumn("_payload", T.sse_payload(F.col(line)))
    rows = process(rows, config, caller, F.lit("response"), "_payload", text_pointer="/sse")
    labels = F.transform("resolved", lambda f: f["label"])
    external = P.external_decision(rules, F.lit("response"), labels, caller["role"], F.lit(False) if escalated is None else escalated)
    none = F.lit(None).cast("string")
    final = P.merge_external(F.col("decision"), F.col("source"), F.col("reason"), external)
    rows = rows.withColumn("_final", F.when(F.col("_payload").isNull(), P.merge_external(F.lit("allow"), F.lit("builtin"), none, F.lit(None).cast("struct<action:string,reason:string>"))).otherwise(final))
    tightened = ranks.action_rank(F.col("_final.decision")) > ranks.action_rank(F.col("decision"))
    shown = F.when(tightened, P.sentinel(F.col("json"))).otherwise(F.col("sanitised"))
    out = F.when(F.col("_payload").isNull(), F.col(line)).otherwise(F.concat(F.lit("data: "), shown, F.lit("\n")))
    return (
        rows.withColumn("out", out)
        .withColumn("decision", F.col("_final.decision")).withColumn("source", F.col("_final.source")).withColumn("reason", F.col("_final.reason"))
        .drop("_payload", "_final", "json", "sanitised")
    )
