"""Detection: spans of every rule in every text, in one narrow pass.

A text column goes to the Python workers once, as Arrow batches.  There RE2 tests the whole batch
against all rules together; only texts that hit are read again, rule by rule, for exact spans.  The
result is a small array column; everything after it (metadata, policy, rewriting, audit) is column
expressions on the same row, so detection never shuffles and its cost follows the bytes scanned.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.config import Detection
from shroudline.functions import ranks, regex, text as T
from shroudline.operators import skew

SPANS = "array<struct<rule:int,start:int,end:int,byte_start:int,byte_end:int,matched:string>>"
FINDING_FIELDS = (
    "ord int, rule_name string, label string, severity string, authorized_action string,"
    "unauthorized_action string, min_clearance string, masking string, start int, `end` int,"
    "byte_start int, byte_end int, matched string, matched_sha256 string, matched_len int, pointer string"
)
FINDINGS = f"array<struct<{FINDING_FIELDS.replace(' string', ':string').replace(' int', ':int').replace('`', '')}>>"

_SPAN_TYPE = pa.list_(
    pa.struct(
        [("rule", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
         ("byte_start", pa.int32()), ("byte_end", pa.int32()), ("matched", pa.string())]
    )
)


def _entropy(token: str) -> float:
    size = len(token)
    return -sum(n / size * math.log2(n / size) for n in Counter(token).values())


def _run_pattern(min_length: int) -> str:
    return f"{T.TOKEN_CLASS}{{{min_length},}}"


@lru_cache(maxsize=64)
def _matchers(patterns: tuple[str, ...], min_length: int | None):
    """Per rule: (RE2 test or None, compiled pattern, group); last the entropy runs."""
    found = [(regex.to_re2(p), regex.compiled(p), 1 if regex.has_group(p) else 0) for p in patterns]
    if min_length is not None:
        run = _run_pattern(min_length)
        found.append((run, regex.compiled(run), 0))
    tests = [test for test, _, _ in found]
    together = None if None in tests or not tests else "|".join(f"(?:{test})" for test in tests)
    return found, together


def _locate(text: str, hits: list[int], matchers, min_entropy: float, n_rules: int) -> list[dict]:
    spans = []
    for rule in hits:
        _, pattern, group = matchers[rule]
        for match in pattern.finditer(text):
            found = group if group and match.group(group) is not None else 0
            token = match.group(found)
            if rule == n_rules and _entropy(token) < min_entropy:
                continue
            spans.append({"rule": rule, "start": match.start(found), "end": match.end(found), "matched": token})
    if text.isascii():
        for span in spans:
            span["byte_start"], span["byte_end"] = span["start"], span["end"]
    else:
        # one walk over the text for all boundaries
        at, size, bytes_at = 0, 0, {}
        for position in sorted({p for span in spans for p in (span["start"], span["end"])}):
            size += len(text[at:position].encode())
            at, bytes_at[position] = position, size
        for span in spans:
            span["byte_start"], span["byte_end"] = bytes_at[span["start"]], bytes_at[span["end"]]
    return spans


def scan_batch(texts: pa.Array, patterns: tuple[str, ...], min_length: int | None, min_entropy: float) -> pa.Array:
    """Spans for one Arrow batch of texts, in rule order and left to right within a rule."""
    matchers, together = _matchers(patterns, min_length)
    if not matchers or len(texts) == 0:
        return pa.array([[]] * len(texts), _SPAN_TYPE)
    keep = pc.fill_null(pc.match_substring_regex(texts, together) if together else pc.is_valid(texts), False)
    rows = pc.indices_nonzero(keep)
    hit_texts = texts.take(rows)
    by_rule = [
        pc.fill_null(pc.match_substring_regex(hit_texts, test), False).to_pylist() if test else [True] * len(rows)
        for test, _, _ in matchers
    ]
    spans: list = [[]] * len(texts)
    for i, (row, text) in enumerate(zip(rows.to_pylist(), hit_texts.to_pylist())):
        hits = [rule for rule, flags in enumerate(by_rule) if flags[i]]
        spans[row] = _locate(text, hits, matchers, min_entropy, len(patterns))
    return pa.array(spans, _SPAN_TYPE)


def scan_spans(text: Column, config: Detection) -> Column:
    """``array<struct<rule,start,end,byte_start,byte_end,matched>>`` of a text column."""
    patterns = tuple(rule.pattern for rule in config.rules)
    entropy = config.high_entropy
    min_length = entropy.min_length if entropy else None
    min_entropy = entropy.min_entropy if entropy else 0.0

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return scan_batch(texts, patterns, min_length, min_entropy)

    return spans(text)


def _metadata(rules) -> Column:
    names = ("name", "label", "severity", "authorized_action", "unauthorized_action", "min_clearance", "masking")
    rows = [", ".join(f"'{n}', {ranks.literal(getattr(rule, n))}" for n in names) for rule in rules]
    return F.expr(f"array({', '.join(f'named_struct({row})' for row in rows)})")


def _finding(ord_: Column, meta: Column, span: Column, pointer: Column) -> Column:
    return F.struct(
        ord_.cast("int").alias("ord"),
        meta["name"].alias("rule_name"),
        *[meta[n].alias(n) for n in ("label", "severity", "authorized_action", "unauthorized_action", "min_clearance", "masking")],
        *[span[n].alias(n) for n in ("start", "end", "byte_start", "byte_end", "matched")],
        F.sha2(span["matched"], 256).alias("matched_sha256"),
        F.octet_length(span["matched"]).alias("matched_len"),
        pointer.alias("pointer"),
    )


def findings_of(spans: Column, pointer: Column, config: Detection) -> Column:
    """Spans with the metadata of their rule, numbered in finding order."""
    if not config.scored:
        return F.array().cast(FINDINGS)
    meta = _metadata(config.scored)
    return F.transform(spans, lambda s, i: _finding(i, F.element_at(meta, s["rule"] + 1), s, pointer))


def detect(leaves: DataFrame, config: Detection, text: str = "text", pointer: Column | None = None,
           ner: Column | None = None) -> DataFrame:
    """Add ``findings`` to text rows; findings of an outside recogniser (``ner``) come last."""
    where = F.col("pointer") if pointer is None else pointer
    found = findings_of(F.col("_spans"), where, config)
    scanned = leaves.withColumn("_spans", scan_spans(F.col(text), config))
    if ner is None:
        return scanned.withColumn("findings", skew.bound(found)).drop("_spans")
    outside = F.coalesce(ner, F.array().cast(FINDINGS))
    renumbered = F.transform(outside, lambda f: f.withField("ord", f["ord"] + F.size("_spans")))
    return scanned.withColumn("findings", skew.bound(F.concat(found, renumbered))).drop("_spans")


def drop_ignored(leaves: DataFrame, config: Detection) -> DataFrame:
    """Leave out leaves at ignored pointers before anything scans them."""
    if not config.ignore_json_pointers:
        return leaves
    return leaves.where(~F.col("pointer").isin(*config.ignore_json_pointers))


def prefilter_batch(texts: pa.Array, patterns: tuple[str, ...], names: tuple[str, ...]) -> pa.Array:
    """Names of the rules that match somewhere in each text, without looking for spans."""
    matchers, together = _matchers(patterns, None)
    if not matchers or len(texts) == 0:
        return pa.array([[]] * len(texts), pa.list_(pa.string()))
    keep = pc.fill_null(pc.match_substring_regex(texts, together) if together else pc.is_valid(texts), False)
    rows = pc.indices_nonzero(keep)
    hit_texts = texts.take(rows)
    found: list = [[]] * len(texts)
    hits: list[list[str]] = [[] for _ in range(len(rows))]
    as_python = hit_texts.to_pylist()
    for name, (test, pattern, _) in zip(names, matchers):
        flags = pc.fill_null(pc.match_substring_regex(hit_texts, test), False).to_pylist() if test else [True] * len(rows)
        for i, flag in enumerate(flags):
            # the batch test may be wider than the rule
            if flag and pattern.search(as_python[i]):
                hits[i].append(name)
    for row, names_hit in zip(rows.to_pylist(), hits):
        found[row] = names_hit
    return pa.array(found, pa.list_(pa.string()))


def prefilter(text: Column, config: Detection) -> Column:
    """Names of the rules that can match a text at all, in rule order."""
    patterns = tuple(rule.pattern for rule in config.rules)
    names = tuple(rule.name for rule in config.rules)

    @F.arrow_udf("array<string>")
    def matching(texts: pa.Array) -> pa.Array:
        return prefilter_batch(texts, patterns, names)

    return matching(text)


def extract_values(text: Column, config: Detection) -> Column:
    """Matched values of every rule without offsets, as column expressions: ``array<struct<rule,matched>>``."""

    def numbered(found: Column, rule: int) -> Column:
        return F.transform(found, lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("matched")))

    parts = []
    for i, rule in enumerate(config.rules):
        group = 1 if regex.has_group(rule.pattern) else 0
        parts.append(numbered(F.regexp_extract_all(text, F.lit(regex.to_java(rule.pattern)), F.lit(group)), i))
    if config.high_entropy:
        tokens = T.entropy_tokens(text, config.high_entropy.min_length, config.high_entropy.min_entropy)
        parts.append(numbered(tokens, len(config.rules)))
    return F.concat(*parts)


def ner_findings(leaves: DataFrame, annotations: DataFrame, config: Detection, text: str = "text",
                 keys: tuple[str, ...] = ("request_id", "pointer")) -> DataFrame:
    """Findings of an outside recogniser per leaf, from an annotation table.

    Only mapped entity types at or above their minimum score count; character offsets are clamped to
    the text and empty spans dropped.  The annotations of one leaf lie within one text, so the array
    gathered per leaf is bounded by it; the join key is the leaf, which no two rows share.
    """
    if not config.entities:
        return leaves.withColumn("ner", F.array().cast(FINDINGS))
    types = [entity.entity_type for entity in config.entities]
    meta = _metadata(config.entities)
    floors = F.array(*[F.lit(entity.min_score) for entity in config.entities])
    names = F.array(*[F.lit(name) for name in types])
    kept = (
        annotations.where(F.col("entity_type").isin(*types))
        .withColumn("_entity", F.array_position(names, F.col("entity_type")).cast("int"))
        .where(F.col("score") >= F.element_at(floors, F.col("_entity")))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "_entity", "score"))).alias("_ner"))
    )
    size = F.char_length(F.col(text))

    def finding(a: Column, i: Column) -> Column:
        start, end = F.least(a["start"], size), F.least(a["end"], size)
        span = F.struct(
            start.alias("start"), end.alias("end"),
            T.char_to_byte(F.col(text), start).alias("byte_start"),
            T.char_to_byte(F.col(text), end).alias("byte_end"),
            F.substring(F.col(text), start + 1, end - start).alias("matched"),
        )
        return _finding(i, F.element_at(meta, a["_entity"]), span, F.col("pointer"))

    nonempty = F.filter(F.col("_ner"), lambda a: F.least(a["start"], size) < F.least(a["end"], size))
    blank = F.trim(F.regexp_replace(F.col(text), r"(?U)\s", "")) == ""
    ner = F.when(~blank & F.col("_ner").isNotNull(), F.transform(nonempty, finding))
    return (
        leaves.join(kept, list(keys), "left")
        .withColumn("ner", F.coalesce(ner, F.array().cast(FINDINGS)))
        .drop("_ner")
    )


def explode_findings(df: DataFrame, *keep: str) -> DataFrame:
    """One row per finding, for analytics."""
    return df.select(*keep, F.explode("findings").alias("f")).select(*keep, "f.*")
