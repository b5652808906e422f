"""Session settings the jobs are written for.

Nothing here creates state at import time: worker processes import the package too.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# What a job needs whatever the cluster: adaptive re-planning (coalescing, skewed sort-merge
# joins, runtime broadcast decisions), UTC, and small Arrow batches: a Python worker holds a batch several
# times over, as bytes, as objects and as what it gives back, and an executor runs up to three workers a core.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    **ARROW_CONF,
    "spark.sql.files.maxPartitionBytes": "134217728",
    # no call-site capture per column expression: plans here are built from many small ones
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str, master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**JOB_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def bound_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches no larger than the jobs are written for, in a session that came from elsewhere; smaller ones stay."""
    for key, most in ARROW_CONF.items():
        held = (spark.conf.get(key, None) or "").rstrip("bB")
        if not (held.isdigit() and 0 < int(held) <= int(most)):
            spark.conf.set(key, most)
    return spark


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a new local one only where all executors are this very machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not is_local(master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    folder = tempfile.mkdtemp(prefix="shroudline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="shroudline-code-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as code:
            for source in sorted(root.rglob("*.py")):
                code.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark
