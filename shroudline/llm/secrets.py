"""Credentials in texts, in parts: found by pattern, linked by distance.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.llm.work import body, settle

# The base kinds with their patterns, the group whose length counts, and the least length.  A run of 16 hex digits or
# more starts where any run starts, and the same holds for the access pattern, so their least lengths stand in the pattern.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
# Weak candidates: each alone says little.
WEAK = {
    "ident": (r"""((?i:client_id|account_id|username|user|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    "key": (r"[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24),
    "endpoint": (r"""[a-z][a-z0-9+]{1,11}://[^\x00-\x20"'<>]+""", 0, 8),
}
KINDS = BASE | WEAK
RANK = {kind: i for i, kind in enumerate(KINDS)}


def matches(text: Column, kind: str) -> Column:
    """array<struct<kind, i, gap, len, good>>: leftmost matches and the code points between them."""
    pattern, group, least = KINDS[kind]
    gaps = F.transform(F.split(text, pattern, -1), lambda piece: F.length(piece))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    several = F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), sized.alias("part")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x["gap"].cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("len"),
            (F.length(x["part"]) >= least).alias("good"), good_key(x["hit"]).alias("mixed"),
        ),
    )
    return F.when(text.rlike(pattern), several).otherwise(F.array().cast(SHAPE))


SHAPE = "array<struct<kind:string,i:int,gap:bigint,len:bigint,good:boolean,mixed:boolean>>"


def good_key(token: Column) -> Column:
    """Letters of both cases and digits: a word or a number is no key."""
    return token.rlike("[A-Z]") & token.rlike("[a-z]") & token.rlike("[0-9]")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 200) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base (list of spans) and spans (base and linked ones).

    Spans are structs (start, rank, kind, end), end exclusive, in code points and in order.  Base kinds count by
    themselves.  Weak candidates are reported only beside what completes them, at most ``scope`` code points from start to start
    in the same text: a key or an identifier beside the other (or beside a base span that plays the part), an endpoint
    beside both.  The join is on the text and a bin ``scope`` wide, so what meets is bounded by what fits into three bins;
    positions come from running sums over the pieces between matches, linear in the matches.

    Not reported: a weak key without upper case, lower case and digit, whatever stands beside it, and what begins more than ``scope``
    after the start of a longer span, even directly behind its end.

    Null text counts as empty: no spans.  Null and repeated ids are rows like any other; an empty table gives
    an empty result.
    """
    whole = body(text)
    parts = F.flatten(F.array(*(matches(whole, kind) for kind in KINDS)))
    rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), parts.alias("parts")), "secrets")
    each = rows.filter(F.size("parts") > 0).select("row", F.inline("parts"))
    order = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair)), F.col("kind"))
    placed = each.withColumn("end", end).filter("good and (kind <> 'key' or mixed)")
    placed = settle(placed.select("row", (F.col("end") - F.col("len")).alias("start"), rank.alias("rank"), "kind", "end"), "spans")

    base = placed.filter(F.col("kind").isin(*BASE))
    weak = placed.filter(F.col("kind").isin(*WEAK))
    near = weak.withColumn("bin", F.explode(F.array(*(F.floor(F.col("start") / scope) + d for d in (-1, 0, 1)))))
    part = F.when(F.col("kind").isin("access", "ident"), "name").when(F.col("kind").isin("assign", "hex", "key"), "secret")
    other = placed.select("row", F.col("start").alias("at"), F.col("end").alias("until"), part.alias("part"), F.floor(F.col("start") / scope).alias("bin")).filter("part is not null")
    met = near.join(other, ["row", "bin"]).filter(F.abs(F.col("at") - F.col("start")) <= scope).filter("at >= end or until <= start")
    sides = met.groupBy("row", "start", "rank", "kind", "end").agg(F.max(F.col("part") == "name").alias("named"), F.max(F.col("part") == "secret").alias("keyed"))
    linked = sides.filter("(kind = 'key' and named) or (kind = 'ident' and keyed) or (kind = 'endpoint' and named and keyed)")
    every = base.unionByName(linked.select("row", "start", "rank", "kind", "end"))
    lists = every.groupBy("row").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE),
        F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"),
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    spans = F.coalesce("spans", none)
    return rows.select("row", "doc_id").join(lists, "row", "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        F.filter(spans, lambda s: s["rank"] < len(BASE)).alias("base"), spans.alias("spans"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
