"""Approval workflow: tickets folded from an event log, and the overrides they leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.operators import skew
from shroudline.operators.sessions import MICROS, micros

# How many tickets are listed unless a limit is given.
LIST_DEFAULT = 50
STATUSES = ("pending", "approved", "rejected")

# Bins are grouped by RADIX into nodes, and those again, LEVELS deep: with bins of 900 seconds the top holds 478 years.
RADIX, LEVELS = 16, 7


def fingerprint(tenant: Column, path: Column, body_sha256: Column) -> Column:
    return F.sha2(F.concat_ws("|", tenant, path, body_sha256), 256)


def open_tickets(candidates: DataFrame, tickets: DataFrame, ts: str = "ts", request_id: str = "request_id") -> DataFrame:
    """The requests of a batch that open a ticket: the first per fingerprint, unless one is pending."""
    columns = [c for c in candidates.columns if c != "fingerprint"]
    ordered = F.struct(ts, request_id, *[c for c in columns if c not in (ts, request_id)])
    pending = tickets.where(F.col("status") == "pending").select("fingerprint").distinct()
    firsts = candidates.groupBy("fingerprint").agg(F.min_by(ordered, F.struct(ts, request_id)).alias("_first"))
    return firsts.join(pending, "fingerprint", "left_anti").select("fingerprint", "_first.*").select(*candidates.columns)


def open_history(candidates: DataFrame, resolutions: DataFrame, opened: DataFrame | None = None, bin_secs: int = 900, ts: str = "ts", request_id: str = "request_id") -> DataFrame:
    """The requests of a history that open a ticket: those whose fingerprint has no ticket pending at their time.

    A ticket goes by the id of its request and is pending until the first of its ``resolutions`` (ticket_id, resolved_at) that is not
    before it; a request of the same time finds it resolved.  Resolutions of requests that opened none change nothing.  ``opened`` are
    tickets from before: each fingerprint goes on from its latest one, and requests up to that one open nothing.

    Each request points to the request that would open the next ticket, found inside its bin or through one row per later bin;
    those reached from the first of their fingerprint are found in rounds that double the reach, so no fingerprint is walked in one task.
    """
    held = F.struct(*candidates.columns)
    named = (F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), micros(F.col(ts)).alias("_us"), F.coalesce(F.col(request_id).cast("string"), F.lit("")).alias("_id"))
    rows = candidates.select(*named, held.alias("_row"), F.lit(1).alias("_new"))
    if opened is not None:
        before = opened.select(*named)
        before = before.groupBy("fingerprint").agg(F.max(F.struct("_us", "_id")).alias("_last")).select("fingerprint", "_last.*")
        seeds = before.select("*", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_new"))
        floor = before.select("fingerprint", F.struct("_us", "_id").alias("_floor"))
        rows = rows.join(floor, "fingerprint", "left").where(F.col("_floor").isNull() | (F.struct("_us", "_id") > F.col("_floor"))).drop("_floor").unionByName(seeds)
    rows = rows.groupBy("fingerprint", "_id").agg(F.min_by(F.struct("_us", "_row", "_new"), F.struct("_us")).alias("_x")).select("fingerprint", "_id", "_x.*")
    closing = resolutions.select(F.col("ticket_id").cast("string").alias("_id"), micros(F.col("resolved_at")).alias("_at"))
    closing = rows.select("fingerprint", "_id", "_us").join(closing, "_id").where("_at >= _us").groupBy("fingerprint", "_id").agg(F.min("_at").alias("_done"))
    rows = skew.settle(rows.join(closing, ["fingerprint", "_id"], "left"))

    # places of requests, and places after which the next one opens; at equal times requests are in order of id
    asked = rows.select("fingerprint", F.struct(F.col("_us").alias("us"), F.lit(1).alias("k"), F.col("_id").alias("id"), F.lit(0).alias("probe")).alias("_at"), F.col("_id").alias("_target"), F.lit(None).cast("string").alias("_from"))
    same = F.col("_done") == F.col("_us")
    place = F.struct(F.col("_done").alias("us"), F.when(same, 1).otherwise(0).alias("k"), F.when(same, F.col("_id")).otherwise("").alias("id"), F.lit(1).alias("probe"))
    probes = rows.where("_done is not null").select("fingerprint", place.alias("_at"), F.lit(None).cast("string").alias("_target"), F.col("_id").alias("_from"))
    both = asked.unionByName(probes).withColumn("_bin", F.floor(F.col("_at.us") / (bin_secs * MICROS)).cast("bigint"))
    firsts = both.groupBy("fingerprint", "_bin").agg(F.min(F.when(F.col("_target").isNotNull(), F.struct("_at", "_target"))).alias("_first"))
    after = Window.partitionBy("fingerprint").orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("fingerprint", "_bin", F.first("_first._target", ignorenulls=True).over(after).alias("_later"))
    inside = Window.partitionBy("fingerprint", "_bin").orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("_inside", F.first("_target", ignorenulls=True).over(inside)).where("_from is not null").join(firsts, ["fingerprint", "_bin"])
    jumps = found.select("fingerprint", F.col("_from").alias("_id"), F.coalesce("_inside", "_later").alias("_to")).where("_to is not null")

    reached = rows.groupBy("fingerprint").agg(F.min(F.struct("_us", "_id")).alias("_x")).select("fingerprint", "_x._id")
    jumps, reached = skew.settle(jumps), skew.settle(reached)
    while not jumps.isEmpty():
        ahead = reached.join(jumps, ["fingerprint", "_id"]).select("fingerprint", F.col("_to").alias("_id"))
        reached = skew.settle(reached.unionByName(ahead).distinct())
        second = jumps.select("fingerprint", F.col("_id").alias("_to"), F.col("_to").alias("_next"))
        jumps = skew.settle(jumps.join(second, ["fingerprint", "_to"]).select("fingerprint", "_id", F.col("_next").alias("_to")))
    return rows.join(reached, ["fingerprint", "_id"], "left_semi").where("_new = 1").select("_row.*")


def fold_tickets(log: DataFrame) -> DataFrame:
    """Current state per ticket from ``created`` / ``resolved`` events; the latest resolution holds.

    Resolutions of unknown tickets, and those before the ticket existed, change nothing.
    """
    created = F.max(F.when(F.col("type") == "created", F.col("ticket"))).alias("_ticket")
    outcome = F.struct("resolved_at", "status", "resolved_by", "note", "expires_at")
    resolved = F.max(F.when(F.col("type") == "resolved", outcome)).alias("_resolution")
    key = F.coalesce(F.col("ticket.id"), F.col("ticket_id")).alias("ticket_id")
    rows = log.groupBy(key).agg(created, resolved).where(F.col("_ticket").isNotNull())
    applies = F.coalesce(F.col("_resolution.resolved_at") >= F.col("_ticket.created_at"), F.lit(False))
    kept = [c for c in log.schema["ticket"].dataType.names if c not in ("id", "status", "updated_at", "resolution")]
    return rows.select(
        "ticket_id",
        *[F.col(f"_ticket.{c}").alias(c) for c in kept],
        F.when(applies, F.col("_resolution.status")).otherwise(F.col("_ticket.status")).alias("status"),
        F.when(applies, F.col("_resolution.resolved_at")).otherwise(F.col("_ticket.created_at")).alias("updated_at"),
        *[F.when(applies, F.col(f"_resolution.{c}")).alias(c) for c in ("resolved_at", "resolved_by", "note", "expires_at")],
    )


def overrides_asof(tickets: DataFrame, at: Column) -> DataFrame:
    """Live override per fingerprint: its latest resolution, if that has not expired.

    An expired newer resolution hides an older one.
    """
    resolved = tickets.where((F.col("status") != "pending") & (F.col("resolved_at") <= at))
    latest = F.max(F.struct("resolved_at", "ticket_id", "status", "post_approval_action", "expires_at")).alias("o")
    return resolved.groupBy("fingerprint").agg(latest).where(F.col("o.expires_at") > at).select("fingerprint", "o.*")


def cover(first: Column, last: Column) -> Column:
    """The fewest nodes that hold the bins ``first`` to ``last`` and no other: ``array<struct<level,node>>``.

    A node of level k stands for RADIX ** k bins side by side.  There are less than 2 * RADIX nodes a level, so a span of any length
    has a number of nodes that grows with its logarithm.
    """
    def nodes(level: int) -> Column:
        size = F.lit(RADIX**level).cast("bigint")
        low, high = -F.floor(-first / size).cast("bigint"), F.floor((last + 1) / size).cast("bigint")  # of whole nodes, end exclusive
        inner_low, inner_high = -F.floor(-low / RADIX).cast("bigint") * RADIX, F.floor(high / RADIX).cast("bigint") * RADIX
        none = F.array().cast("array<bigint>")

        def span(start: Column, end: Column) -> Column:
            return F.when(start < end, F.sequence(start, end - 1)).otherwise(none)

        split = inner_low < inner_high if level + 1 < LEVELS else F.lit(False)
        taken = F.when(split, F.concat(span(low, inner_low), span(inner_high, high))).otherwise(span(low, high))
        return F.transform(taken, lambda node: F.struct(F.lit(level).alias("level"), node.alias("node")))

    return F.concat(*(nodes(level) for level in range(LEVELS)))


def above(bin_: Column) -> Column:
    """The node of each level that holds a bin."""
    return F.array(*(F.struct(F.lit(level).alias("level"), F.floor(bin_ / F.lit(RADIX**level).cast("bigint")).cast("bigint").alias("node")) for level in range(LEVELS)))


def override_periods(tickets: DataFrame, bin_secs: int) -> DataFrame:
    """When each resolution is in force, ``[from_us, until_us)``, once for each node of the cover of its bins.

    It ends when it expires or the next resolution of the fingerprint comes.  The next one is looked
    up inside the bin, else through one row per later bin, so a fingerprint is never sorted whole.
    """
    width = bin_secs * MICROS
    resolved = (
        tickets.where(F.col("status") != "pending")
        .withColumn("_from", micros(F.col("resolved_at"))).withColumn("_expires", micros(F.col("expires_at")))
        .withColumn("_home", F.floor(F.col("_from") / width).cast("bigint"))
    )
    per_bin = resolved.groupBy("fingerprint", "_home").agg(F.min("_from").alias("_low"))
    later = per_bin.withColumn("_next_bin", F.lead("_low").over(Window.partitionBy("fingerprint").orderBy("_home"))).drop("_low")
    inside = Window.partitionBy("fingerprint", "_home").orderBy("_from", "ticket_id")
    timed = resolved.withColumn("_next", F.lead("_from").over(inside)).join(later, ["fingerprint", "_home"])
    until = F.least(F.coalesce("_next", "_next_bin"), F.col("_expires"))
    cut = timed.withColumn("until_us", until).where(F.col("until_us") > F.col("_from"))
    last_bin = F.floor((F.col("until_us") - 1) / width).cast("bigint")
    return cut.select(
        "fingerprint", F.explode(cover(F.col("_home"), last_bin)).alias("_at"), F.col("_from").alias("from_us"), "until_us",
        F.struct("ticket_id", "status", "post_approval_action").alias("override"),
    ).select("fingerprint", F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node"), "from_us", "until_us", "override")


def apply_overrides(traffic: DataFrame, tickets: DataFrame, bin_secs: int = 900, ts: str = "ts", row_id: str = "request_id") -> DataFrame:
    """Replace the decision where a review settled it: first by the ticket a request names, then by fingerprint.

    A named ticket must be resolved and agree on principal, path and body, whatever its age; a
    fingerprint override must be in force at the time of the request.
    """
    # the folded tickets and the requests that can meet one are each worked out once
    columns = ("ticket_id", "status", "post_approval_action", "principal", "path", "request_sha256", "resolved_at", "expires_at", "fingerprint")
    tickets = skew.settle(tickets.where(F.col("status") != "pending").select(*columns))
    named = tickets.select(
        F.col("ticket_id").alias("review_ticket"),
        F.struct("ticket_id", "status", "post_approval_action", "principal", "path", "request_sha256", "resolved_at").alias("_named"),
    )
    at = micros(F.col(ts))
    # a request meets a period at the one node of its bin's path that the period's cover has; only keys and times take part
    periods = skew.settle(override_periods(tickets, bin_secs))
    asked = traffic.select(row_id, "fingerprint", at.alias("_us")).join(periods.select("fingerprint").distinct(), "fingerprint", "left_semi")
    probes = skew.settle(asked).withColumn("_at", F.explode(above(F.floor(F.col("_us") / (bin_secs * MICROS)).cast("bigint"))))
    probes = probes.select(row_id, "fingerprint", "_us", F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node"))
    during = (F.col("from_us") <= F.col("_us")) & (F.col("_us") < F.col("until_us"))
    matched = skew.lookup(probes, periods, ["fingerprint", "_level", "_node"], row_id, "inner", on=during).select(row_id, "override")
    rows = skew.lookup(traffic, named, ["review_ticket"], row_id).join(matched, row_id, "left")
    agrees = (
        (F.col("_named.principal") == F.col("principal")) & (F.col("_named.path") == F.col("path"))
        & (F.col("_named.request_sha256") == F.col("request_sha256")) & (F.col("_named.resolved_at") <= F.col(ts))
    )
    by_ticket = F.coalesce(agrees, F.lit(False))
    status = F.when(by_ticket, F.col("_named.status")).otherwise(F.col("override.status"))
    approved = F.when(by_ticket, F.col("_named.post_approval_action")).otherwise(F.col("override.post_approval_action"))
    why = F.when(
        by_ticket, F.concat(F.lit("request "), status, F.lit(" via review ticket "), F.col("_named.ticket_id"))
    ).otherwise(F.concat(F.lit("request previously "), status, F.lit(" by admin review")))
    return (
        rows.withColumn("_status", status)
        .withColumn("decision", F.when(F.col("_status") == "approved", approved).when(F.col("_status") == "rejected", "block").otherwise(F.col("decision")))
        .withColumn("source", F.when(F.col("_status").isNotNull(), F.concat(F.lit("review_override_"), F.col("_status"))).otherwise(F.col("source")))
        .withColumn("reason", F.when(F.col("_status").isNotNull(), why).otherwise(F.col("reason")))
        .drop("_status", "_named", "override")
    )


def resolve(requests: DataFrame, tickets: DataFrame, ttl_secs: int, row_id: str = "event_id") -> DataFrame:
    """Outcome of each resolve request: the first per pending ticket takes effect, with an expiry.

    ``requests``: ticket_id, status, resolved_by, note, requested_at and a unique ``row_id``.
    """
    order = F.struct("requested_at", row_id)
    firsts = requests.groupBy("ticket_id").agg(F.min(order).alias("_first"), F.count("*").alias("n"))
    state = firsts.join(tickets.select("ticket_id", F.col("status").alias("_was")), "ticket_id", "left")
    rows = skew.lookup(requests, state.drop("n"), ["ticket_id"], row_id, counts=firsts.select("ticket_id", "n"))
    wins = (F.col("_was") == "pending") & (order == F.col("_first"))
    outcome = (
        F.when(F.col("_was").isNull(), F.lit("not_found")).when(wins, F.lit("resolved")).otherwise(F.lit("already_resolved"))
    )
    expiry = F.col("requested_at") + F.make_dt_interval(secs=F.lit(ttl_secs).cast("decimal(18,6)"))
    return (
        rows.withColumn("outcome", outcome)
        .withColumn("expires_at", F.when(F.col("outcome") == "resolved", expiry))
        .drop("_first", "_was")
    )


def list_tickets(tickets: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest tickets of a status; an unknown status means pending, ``all`` means any."""
    wanted = status if status in ("approved", "rejected", "all") else "pending"
    rows = tickets if wanted == "all" else tickets.where(F.col("status") == wanted)
    n = LIST_DEFAULT if limit is None else limit
    return rows.orderBy(F.col("created_at").desc(), F.col("ticket_id").desc()).limit(n)


def pending_count(tickets: DataFrame) -> DataFrame:
    return tickets.where(F.col("status") == "pending").agg(F.count("*").alias("pending"))


def trim_tickets(tickets: DataFrame, capacity: int) -> DataFrame:
    """The newest ``capacity`` tickets; ``entry_live`` tells whether their fingerprint entry survived.

    Dropping a ticket drops the pending and override entry of its fingerprint, even one a newer
    ticket had set.
    """
    kept = skew.top(tickets, max(capacity, 1), [("created_at", True), ("ticket_id", True)])
    kept_by = kept.groupBy("fingerprint").agg(F.count("*").alias("_kept"))
    total_by = (
        tickets.join(kept_by.select("fingerprint"), "fingerprint", "left_semi").groupBy("fingerprint").agg(F.count("*").alias("_all"))
    )
    live = kept_by.join(total_by, "fingerprint").select("fingerprint", (F.col("_kept") == F.col("_all")).alias("entry_live"))
    return kept.join(live, "fingerprint")


def block_reason(reason: Column, ticket_id: Column) -> Column:
    """What the audit says about a request waiting for approval."""
    return F.concat(F.coalesce(reason, F.lit("admin approval required")), F.lit("; review_ticket_id="), ticket_id)
