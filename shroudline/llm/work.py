"""What the corpus operators share: written intermediate tables, fresh names, lookups that stand skew."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.session import shared_dir

# A key with more rows than this is looked up by broadcast, so the list of such keys has at most rows / HOT_ROWS entries.
HOT_ROWS = 10_000

# The ASCII white space of the contracts, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, safe when executors go.

    The folder is the one named by ``spark.checkpoint.dir``; files stay there until :func:`clear`.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; results not yet written must not be needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names close to ``names`` that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def body(text: str | Column) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` rows: what Python holds of a batch at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_held: list[tuple[object, object]] = []


def held(key: object, make: Callable[[], object]) -> object:
    """What a Python worker remembers between tasks, one thing at a time: another key lets the one before go."""
    if not _held or _held[0][0] != key:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held.append((key, make()))
    return _held[0][1]


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], count: str, how: str = "left") -> DataFrame:
    """Join ``rows`` with ``table``, which has each key once and in ``count`` the number of rows that carry it.

    Keys above HOT_ROWS would all meet in one task, so they are joined by broadcast; there are at most
    rows / HOT_ROWS of them.  The other keys shuffle.  Both inputs are read twice: settle what is dear.
    """
    hot = F.broadcast(table.filter(F.col(count) > HOT_ROWS))
    cold = table.filter(F.col(count) <= HOT_ROWS)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(cold, keys, how))


def dense_ranks(rows: DataFrame, group: list[str], order: list[str], out: str, bucket_rows: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, a group being of any size.

    Rows are dealt to hashed buckets, numbered inside each, and moved up by what the buckets before hold.
    The table of bucket counts has one row per ``bucket_rows`` rows and group, and is joined by broadcast only
    where Spark finds it small.  ``rows`` is read twice: settle it first.
    """
    from pyspark.sql import Window

    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    bucket, base = fresh(rows, "bucket", "base")
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*group, bucket).agg(F.count("*").alias(base))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    numbered = dealt.withColumn(out, F.row_number().over(inside).cast("long") - 1)
    return numbered.join(counts, [*group, bucket]).withColumn(out, F.col(out) + F.col(base)).drop(bucket, base)
