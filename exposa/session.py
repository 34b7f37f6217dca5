"""Spark session defaults used by tests, bench and the examples.

On a cluster the session already exists; ``get_spark`` only fills settings
that are unset, so cluster-wide values (shuffle partitions, checkpoint dir)
always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings we want everywhere; applied only when the key is unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "exposa") -> SparkSession:
    """Return the active session, or a local one for tests and bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("EXPOSA_DRIVER_MEM", "16g"))
        .config("spark.sql.shuffle.partitions", str(partitions or int(cpus)))
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def app_id(spark: SparkSession) -> str:
    """Id of the running Spark application (stages are scoped to it)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - e.g. a Connect session has no SparkContext
        return spark.conf.get("spark.app.id", None) or "app"


TASK_ROWS = 250_000      # rows of a task that sorts wide rows: about 150 MB a sort


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt out by ``by`` in partitions of about ``TASK_ROWS`` of its ``rows``, so that what a
    task sorts does not grow with the table, whatever the session's number of shuffle partitions;
    a table of one task's rows is left to that number."""
    if rows <= TASK_ROWS:
        return df.repartition(*by)
    try:
        least = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - Connect
        least = 1
    return df.repartition(max(-(-rows // TASK_ROWS), least), *by)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session (the cluster's shared
    folder).  Only when nothing is configured AND the master is local (tests) a
    scratch folder is created and registered with the SparkContext; elsewhere a
    folder of one machine would be missing on the others, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect: the server owns the context
        if not d:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return d
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    d = sc.getCheckpointDir()
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        global _LOCAL_CKPT
        if _LOCAL_CKPT is None:
            _LOCAL_CKPT = tempfile.mkdtemp(prefix="exposa-ckpt-")
        sc.setCheckpointDir(_LOCAL_CKPT)
        d = _LOCAL_CKPT
    return d


_LOCAL_CKPT: str | None = None
