"""Sessions: sliding time-to-live, running label sets, marks that expire.

Time is cut into bins one TTL wide.  Two rows of one session in one bin are never further apart than
the TTL, so a session can only break between bins: minimum and maximum per (session, bin) say all
that is needed, they combine before the shuffle, and no task ever sorts the rows of a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.functions import ranks
from shroudline.operators import skew

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _binned(df: DataFrame, ts: str, ttl_secs: int) -> DataFrame:
    at = micros(F.col(ts))
    return df.withColumn("_us", at).withColumn("_bin", F.floor(at / (ttl_secs * MICROS)).cast("bigint"))


def _segments(per_bin: DataFrame, key: str, ttl_secs: int, *keep: str) -> DataFrame:
    """(session, bin, segment, n) and the columns to keep: which stretch of its session a bin belongs to.

    ``per_bin`` has one row per bin that holds something, so a session has at most as many rows as
    TTLs fit into the time covered.
    """
    by_bin = Window.partitionBy(key).orderBy("_bin")
    broken = F.coalesce(F.col("_first") - F.lag("_last").over(by_bin) > ttl_secs * MICROS, F.lit(False))
    return (
        per_bin.withColumn("_broken", broken.cast("int"))
        .withColumn("segment", F.sum("_broken").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
        .select(key, "_bin", "segment", "n", *keep)
    )


def sessionize(df: DataFrame, ttl_secs: int, key: str = "session_id", ts: str = "ts", row_id: str = "request_id") -> DataFrame:
    """Add ``segment``: a gap longer than the TTL starts the next one (a gap of exactly the TTL does not)."""
    binned = _binned(df, ts, ttl_secs)
    per_bin = binned.groupBy(key, "_bin").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count("*").alias("n"))
    segments = skew.settle(_segments(per_bin, key, ttl_secs))
    counts = segments.select(key, "_bin", "n")
    return skew.lookup(binned, segments.drop("n"), [key, "_bin"], row_id, "inner", counts=counts).drop("_bin", "_us")


def correlate(df: DataFrame, ttl_secs: int, threshold: int, key: str = "session_id", ts: str = "ts",
              row_id: str = "request_id", labels: str = "labels") -> DataFrame:
    """Add ``segment`` and ``escalated``: the labels seen so far in the segment reached the threshold.

    A label counts from its first occurrence, so the row where a segment escalates is the
    threshold-th smallest first occurrence; every row from there on is escalated, also one that
    found nothing itself.
    """
    binned = _binned(df, ts, ttl_secs)
    point = F.struct(F.col("_us").alias("us"), F.col(row_id).alias("id"))
    # one pass over the rows, and then one row per session and bin with the first occurrence of each of its labels; a row without
    # labels still counts for its bin, and n, which only guides the splitting of hot bins, counts a row once per label
    found = (
        binned.select(key, "_bin", "_us", point.alias("_at"), F.explode_outer(labels).alias("_label"))
        .groupBy(key, "_bin", "_label")
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count("*").alias("n"), F.min("_at").alias("_at"))
    )
    first = F.when(F.col("_label").isNotNull(), F.struct("_label", "_at"))
    per_bin = found.groupBy(key, "_bin").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("n").alias("n"), F.collect_list(first).alias("_labels")
    )
    segments = skew.settle(_segments(per_bin, key, ttl_secs, "_labels"))
    firsts = segments.select(key, "segment", F.explode("_labels").alias("f")).groupBy(key, "segment", F.col("f._label").alias("_label")).agg(F.min("f._at").alias("_at"))
    nth = Window.partitionBy(key, "segment").orderBy("_at")
    points = (
        firsts.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") == threshold)
        .select(key, "segment", F.col("_at").alias("_point"))
    )
    summary = segments.select(key, "_bin", "segment").join(points, [key, "segment"], "left")
    joined = skew.lookup(binned, summary, [key, "_bin"], row_id, "inner", counts=segments.select(key, "_bin", "n"))
    return joined.withColumn("escalated", F.coalesce(point >= F.col("_point"), F.lit(False))).drop("_us", "_bin", "_point")


def escalate(decision: Column, escalated: Column, trigger: str) -> Column:
    return F.when(escalated, ranks.stricter(decision, F.lit(trigger))).otherwise(decision)


def active_sessions(df: DataFrame, at: Column, ttl_secs: int, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """How many sessions are alive at a moment: those with a row at most one TTL before it."""
    oldest = at - F.make_dt_interval(secs=F.lit(ttl_secs).cast("decimal(18,6)"))
    recent = df.where((F.col(ts) >= oldest) & (F.col(ts) <= at))
    return recent.select(key).distinct().agg(F.count("*").alias("active_sessions"))


def cap_sessions(df: DataFrame, n: int, key: str = "session_id", ts: str = "ts") -> DataFrame:
    """The ``n`` most recently updated sessions (a capacity, so a top-n)."""
    return skew.top(df.groupBy(key).agg(F.max(ts).alias("updated_at")), n, [("updated_at", True), (key, False)])


def flag_marked(rows: DataFrame, marks: DataFrame, ttl_secs: int, key: str, ts: str = "ts", row_id: str = "request_id") -> DataFrame:
    """Add ``marked``: a mark of the same key lies less than one TTL back (or at the same time).

    In the row's own bin the earliest mark decides, in the bin before the latest one.
    """
    own = _binned(marks.select(key, ts), ts, ttl_secs)
    shares = own.groupBy(key, "_bin").agg(F.min("_us").alias("_low"), F.max("_us").alias("_high"))
    none = F.lit(None).cast("bigint")
    table = (
        shares.select(key, "_bin", F.col("_low"), none.alias("_before"))
        .unionByName(shares.select(key, (F.col("_bin") + 1).alias("_bin"), none.alias("_low"), F.col("_high").alias("_before")))
        .groupBy(key, "_bin")
        .agg(F.min("_low").alias("_low"), F.max("_before").alias("_before"))
    )
    joined = skew.lookup(_binned(rows, ts, ttl_secs), table, [key, "_bin"], row_id)
    here = F.col("_low") <= F.col("_us")
    carried = F.col("_us") - F.col("_before") < ttl_secs * MICROS
    return joined.withColumn("marked", F.coalesce(here, F.lit(False)) | F.coalesce(carried, F.lit(False))).drop("_us", "_bin", "_low", "_before")
