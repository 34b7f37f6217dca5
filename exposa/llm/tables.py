"""Reading the driver's tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` of the session; a scratch folder only where it is unset."""
    global _scratch
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _scratch = _scratch or tempfile.mkdtemp(prefix="exposa-llm-")
        shared = _scratch
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan restarts from files that survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Working column names that no column of ``df`` has (extra columns may clash)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def read_from_files(df: DataFrame) -> bool:
    """Whether ``df`` is made of files without a shuffle, so its partitions are the same whenever it runs again."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "FileScan" in plan and "Exchange" not in plan and "ExistingRDD" not in plan


def with_row_key(df: DataFrame, to: str) -> DataFrame:
    """``df`` with a column that tells its rows apart, the same whenever the plan runs again.

    Rows read from files are known by file and place in it; others by a number given once."""
    from pyspark.errors import AnalysisException
    if to in df.columns:
        raise ValueError(f"column {to} is there already")
    try:
        return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(to))
    except AnalysisException:
        return cut(df.withColumn(to, F.monotonically_increasing_id()))
