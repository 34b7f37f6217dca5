"""Readers and writers.

* ``read_table``     one driver table (Parquet) - column pruning and filter
                     pushdown reach the scan because nothing is collected.
* ``read_claims``    monthly claims extract (CSV with header) by explicit schema.
* ``read_postcodes`` postcode dimension; ``postcode`` left-padded to 6.
* ``read_policies``  consolidated policy table, loss-of-income covered subset.
* ``snapshot``       stage save / reload (Parquet in a shared folder).
* ``save_model``     writes a fitted Spark ML model (and a grid frame).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposa.sources import schema as S


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_claims(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Monthly policy/claim extract with the fixed schema (never inferred)."""
    reader = spark.read.schema(S.CLAIMS_MONTHLY)
    if fmt == "csv":
        return reader.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return reader.format(fmt).load(path)


def pad_postcode(col):
    return F.lpad(col.cast("string"), 6, "0")


def read_postcodes(spark: SparkSession, path: str | None = None,
                   df: DataFrame | None = None, fmt: str = "csv") -> DataFrame:
    """Postcode dimension with ``postcode`` left-padded to width 6."""
    if df is None:
        reader = spark.read.schema(S.POSTCODES)
        df = (reader.option("header", True).csv(path) if fmt == "csv"
              else reader.format(fmt).load(path))
    return df.withColumn("postcode", pad_postcode(F.col("postcode")))


def read_policies(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema=None) -> DataFrame:
    """Consolidated policy table, loss-of-income covered rows only."""
    if fmt == "csv":
        r = spark.read.option("header", True)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        df = r.csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    cover = F.col("LossofIncome_cover")
    if dict(df.dtypes).get("LossofIncome_cover") != "boolean":
        cover = F.lower(cover.cast("string")).isin("true", "y")
    return df.filter(cover)


def snapshot(df: DataFrame, path: str, reload: bool = False,
             partition_by: list[str] | None = None) -> DataFrame:
    """Save a stage and hand back the saved copy (or just reload it).

    Reading the written Parquet back cuts the lineage, so a lost executor
    recomputes from the snapshot and not from the raw extract.
    """
    spark = df.sparkSession
    if not reload:
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
    return spark.read.parquet(path)


def save_model(model, path: str, grid: DataFrame | None = None) -> None:
    """Persist a fitted Spark ML model and, optionally, its score grid."""
    model.write().overwrite().save(path)
    if grid is not None:
        grid.write.mode("overwrite").parquet(path.rstrip("/") + "_grid")
