"""Joins and prefix sums that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroudline.session import shared_dir

# Rows of one key a task should get at most.  A key with more is split; there are at most
# (rows / this) such keys, which bounds the list of them that is broadcast.
ROWS_PER_TASK = 4_000_000
BLOCK = 4096


def bound(column: Column) -> Column:
    """A column evaluated once, whatever later filters and projections refer to it.

    Filters on a derived column are otherwise pushed below it together with a copy of its expression,
    Python stage included.  They stop at a generator, while filters on other columns still pass.
    """
    return F.explode(F.array(column))


def settle(summary: DataFrame) -> DataFrame:
    """A summary written once to the checkpoint folder and read from there by every later step.

    For small results of large scans that a plan refers to several times: each reference would scan
    again.  The copy is in shared storage, so losing executors costs nothing.
    """
    folder = shared_dir(summary.sparkSession)
    context = summary.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return summary.checkpoint()


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], row_id: str | list[str], how: str = "left",
           on: Column | None = None, counts: DataFrame | None = None, target: int = ROWS_PER_TASK, grown: bool = False) -> DataFrame:
    """``rows`` joined to ``table``, whose rows match each left row at most once.

    Keys with more than ``target`` rows on the left are dealt out over several tasks by a hash of
    ``row_id`` (columns that tell rows apart) and their table rows repeated as often; other keys join as they are.  ``counts`` (keys
    and ``n``) saves counting where the caller has it already.  NULL keys match nothing and are
    spread by row instead of meeting in one task.  ``grown`` says that the rows are many more than were read: Spark guesses their size from the
    files and would send them all through the driver as a broadcast, so both sides shuffle.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / target).cast("int").alias("_parts")
    hot = counts.where(F.col("n") > target).select(*keys, parts)
    any_null = None
    for key in keys:
        any_null = F.col(key).isNull() if any_null is None else any_null | F.col(key).isNull()
    mixed = F.xxhash64(*([row_id] if isinstance(row_id, str) else row_id))
    spread = F.when(any_null, F.pmod(mixed, F.lit(1 << 20)).cast("int")).when(
        F.col("_parts").isNotNull(), F.pmod(mixed, F.col("_parts")).cast("int")
    ).otherwise(0)
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", spread).drop("_parts")
    repeated = (
        table.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    right = repeated.select(*[F.col(c).alias(f"_r_{c}") if c in (*keys, "_salt") else F.col(c) for c in repeated.columns])
    match = F.col("_salt") == F.col("_r__salt")
    for key in keys:
        match = match & (F.col(key) == F.col(f"_r_{key}"))
    if on is not None:
        match = match & on
    return (left.hint("merge") if grown else left).join(right, match, how).drop("_salt", "_r__salt", *[f"_r_{key}" for key in keys])


def dense_order(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``rows`` with their number within ``key``, from 0 without gaps, by ``order``: whole numbers that may lie far apart; equal ones share a number.

    Key and order alone are range-partitioned and sorted, so a key of any size lies in neighbouring partitions; a row's number is its place
    there and what the partitions before hold of its key, one row per partition and key.
    """
    ranged = rows.select(key, F.col(order).alias("_order")).repartitionByRange(key, "_order").dropDuplicates([key, "_order"]).sortWithinPartitions(key, "_order")
    placed = settle(ranged.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    held = placed.groupBy(key, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_held"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select(key, "_part", (F.coalesce(F.sum("_held").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    numbers = placed.join(base, [key, "_part"]).select(key, F.col("_order").alias(order), (F.col("_place") + F.col("_base")).alias(name))
    return rows.join(numbers, [key, order])


def rising(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with a number ``name`` that rises with ``order`` within ``key``, the first of ``order`` telling a key's rows apart; later ones settle ties.

    Numbers leap from one range partition to the next, each beginning at a multiple of 2 ** 33, so no row needs to know how many lie before it.  Range
    borders are sampled, which reads ``rows`` once more than sorting does: rows are settled first and should be narrow.
    """
    ranged = settle(rows).repartitionByRange(key, order[0]).sortWithinPartitions(key, *order)
    return ranged.withColumn(name, F.monotonically_increasing_id())


def prefix_sum(rows: DataFrame, key: str, order: str, value: Column, name: str, block: int = BLOCK, dense: bool = False) -> DataFrame:
    """Sum of ``value`` over earlier rows of the same key, ``order`` being unique whole numbers.

    Rows are numbered without gaps (``dense`` says that they are), summed in blocks of ``block``, and blocks in blocks of blocks, so no
    task sorts a whole key: up to block ** 3 rows of a key no window is longer than a block.
    """
    numbered = rows.withColumn("_pos", F.col(order)) if dense else dense_order(rows, key, order, "_pos")
    blocked = numbered.withColumn("_value", value).withColumn("_block", F.floor(F.col("_pos") / block).cast("bigint"))
    totals = blocked.groupBy(key, "_block").agg(F.sum("_value").alias("_total")).withColumn("_over", F.floor(F.col("_block") / block).cast("bigint"))
    larger = totals.groupBy(key, "_over").agg(F.sum("_total").alias("_sum"))

    def earlier(by: str, *within: str) -> Window:
        return Window.partitionBy(key, *within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)

    base = larger.select(key, "_over", F.coalesce(F.sum("_sum").over(earlier("_over")), F.lit(0)).alias("_base"))
    inner = totals.select(key, "_block", "_over", F.coalesce(F.sum("_total").over(earlier("_block", "_over")), F.lit(0)).alias("_inner"))
    before = inner.join(base, [key, "_over"]).select(key, "_block", (F.col("_base") + F.col("_inner")).alias("_before"))
    return (
        blocked.withColumn("_inside", F.coalesce(F.sum("_value").over(earlier("_pos", "_block")), F.lit(0)))
        .join(before, [key, "_block"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_value", "_block", "_before", "_inside", "_pos")
    )


# More rows than this are not taken by one task's heap but by the value of the last one.
TAKEN = 10_000


def top(rows: DataFrame, n: int, order: list[tuple[str, bool]], taken: int = TAKEN) -> DataFrame:
    """The first ``n`` rows by ``order``: (column, whether descending); NULL is least.

    For a large ``n`` the order columns alone are range-partitioned and sorted; counts per partition tell where the n-th row lies, and
    rows are filtered by its values where they are, so no task sees ``n`` rows.  Rows equal to the n-th in all columns are cut to the number left.
    """
    sort = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]
    if n <= taken:
        return rows.orderBy(*sort).limit(n)
    names = [c for c, _ in order]
    ranged = rows.select(*names).repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = settle(ranged.withColumn("_place", F.monotonically_increasing_id()))
    held = sorted((r[0], r[1]) for r in placed.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count("*").alias("n")).collect())  # one per partition
    before = 0
    for part, count in held:
        if before + count >= n:
            break
        before += count
    else:
        return rows
    edge = placed.where(F.col("_place") == (part << 33) + n - before - 1).first()
    earlier, same = F.lit(False), F.lit(True)
    for name, down in order:
        value = F.lit(edge[name]).cast(rows.schema[name].dataType)
        column = F.col(name)
        if edge[name] is None:
            ahead = column.isNotNull() if down else F.lit(False)
        else:
            ahead = F.coalesce(column > value if down else column < value, F.lit(not down))
        earlier = earlier | (same & ahead)
        same = same & column.eqNullSafe(value)
    first = rows.where(earlier)
    return first.unionByName(rows.where(same).limit(n - placed.where(earlier).count()))
