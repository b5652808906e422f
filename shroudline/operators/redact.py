"""Rewriting: keep one finding where several overlap, and cut the text around it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.config import Detection
from shroudline.functions import masks, ranks
from shroudline.operators import detect as D, policy as P

Tokenizer = Callable[[Column, Column], Column]


def _by_position(resolved: Column) -> Column:
    """Findings to carry out, leftmost first; of those the longest, strictest, earliest found."""
    active = F.filter(resolved, lambda f: f["effective_action"] != "allow")
    keyed = F.transform(
        active,
        lambda f: F.struct(
            f["byte_start"].alias("a"), (f["byte_start"] - f["byte_end"]).alias("b"),
            (-ranks.action_rank(f["effective_action"])).alias("c"), f["ord"].alias("d"), f.alias("f"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


def resolve_overlaps(resolved: Column) -> Column:
    """The findings that remain when each one must start at or after the end of the one before.

    The fold carries one byte per finding, not the findings, because each of its steps copies what it carries.
    """
    found = _by_position(resolved)

    def step(acc: Column, f: Column) -> Column:
        late = f["byte_start"] < acc["until"]
        return F.struct(
            F.when(late, acc["until"]).otherwise(f["byte_end"]).alias("until"), F.concat(acc["flags"], F.when(late, "0").otherwise("1")).alias("flags")
        )

    start = F.struct(F.lit(0).alias("until"), F.lit("").alias("flags"))
    bound = F.struct(found.alias("found"), F.aggregate(found, start, step, lambda acc: acc["flags"].cast("binary")).alias("flags"))

    def kept(x: Column) -> Column:
        return F.filter(x["found"], lambda f, i: F.substring(x["flags"], i + 1, F.lit(1)) == F.lit(b"1"))

    return F.element_at(F.transform(F.array(bound), kept), 1)


def redact_text(text: Column, resolved: Column, tokenizer: Tokenizer | None = None) -> Column:
    """The text with every kept finding replaced by its mask.

    The bytes of the text and the kept findings are bound once; each piece is cut between two neighbours, and all are
    joined once, so the work grows with the text plus the findings.
    """
    parts = F.transform(
        resolved,
        lambda f: F.struct(f["byte_start"].alias("byte_start"), f["byte_end"].alias("byte_end"), f["effective_action"].alias("effective_action"),
                           f["ord"].alias("ord"), masks.apply_mask(f["matched"], f["masking"], f["label"], tokenizer).alias("mask")),
    )
    bound = F.struct(resolve_overlaps(parts).alias("kept"), text.cast("binary").alias("raw"))

    def between(raw: Column, start: Column, end: Column) -> Column:
        return F.substring(raw, start + 1, end - start).cast("string")

    def rewritten(x: Column) -> Column:
        def piece(f: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(x["kept"], i - 1)["byte_end"])
            return F.concat(between(x["raw"], before, f["byte_start"]), f["mask"])

        last = F.coalesce(F.get(x["kept"], F.size(x["kept"]) - 1)["byte_end"], F.lit(0))
        return F.array_join(F.concat(F.transform(x["kept"], piece), F.array(between(x["raw"], last, F.octet_length(x["raw"])))), "")

    return F.when(F.size(resolved) > 0, F.element_at(F.transform(F.array(bound), rewritten), 1)).otherwise(text)


def replace_longest_first(text: Column, replacements: Column) -> Column:
    """Substitute whole values (``map<value,replacement>``), longest value first, then by value."""
    entries = F.filter(F.map_entries(replacements), lambda e: e["key"] != e["value"])
    keyed = F.transform(
        entries,
        lambda e: F.struct((-F.octet_length(e["key"])).alias("a"), e["key"].alias("key"), e["value"].alias("value")),
    )
    return F.aggregate(F.array_sort(keyed), text, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def judge(detected: DataFrame, caller: Column, direction: Column, text: str = "text",
          tokenizer: Tokenizer | None = None) -> DataFrame:
    """From findings to ``resolved``, ``decision`` and ``redacted`` on the same row."""
    return (
        detected.withColumn("resolved", P.resolve(F.col("findings"), caller, direction))
        .withColumn("decision", P.decide(F.col("resolved")))
        .withColumn("redacted", redact_text(F.col(text), F.col("resolved"), tokenizer))
        .drop("findings")
    )


def scrub(df: DataFrame, config: Detection, text: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """One-call scrub of a plain text column for a caller nobody vouches for."""
    detected = D.detect(df, config, text, pointer=F.lit("/"))
    return judge(detected, P.local_principal(), F.lit("request"), text, tokenizer)
