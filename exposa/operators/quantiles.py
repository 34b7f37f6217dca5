"""Exact quantiles of groups of any size.

Groups are counted first.  A group of at most ``most`` rows is sorted in one
buffer of a keyed aggregation; that is one shuffle on the group, however many
groups there are.  Only the groups measured larger take the split path: their
rows are counted per (group, value), the counts are range-partitioned on
(group, value), each partition's running counts start from the totals of the
partitions before it, and the rows that hold the wanted ranks are picked by a
partial aggregation, so no buffer or window ever holds such a group whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposa.functions.expr import join_null_safe
from exposa.session import checkpoint_dir

MOST = 20_000


def exact_quantiles(df: DataFrame, by: Sequence[str], x: str, probs: Sequence[float],
                    out: str = "quantiles", count: str | None = None, most: int = MOST) -> DataFrame:
    """(by..., out): array of the linearly interpolated quantiles of ``x`` per
    group; NULL values do not count, and groups without a value do not appear.
    ``count``: a column that says how often each row counts."""
    group = list(by) or ["_all"]
    d = df.filter(F.col(x).isNotNull())
    d = d if by else d.withColumn("_all", F.lit(1))
    d = d.select(*group, F.col(x).alias("_x"), (F.col(count) if count else F.lit(1)).cast("bigint").alias("_c"))
    large = d.groupBy(*group).agg(F.sum("_c").alias("_n")).filter(F.col("_n") > most).select(*group)
    if large.isEmpty():
        return _small(d, group, probs).select(*by, F.col("_q").alias(out))
    flag = large.withColumn("_large", F.lit(True))
    d = join_null_safe(d, flag, group, "left")
    got = _small(d.filter("_large IS NULL"), group, probs).unionByName(_large(d.filter("_large"), group, probs))
    return got.select(*by, F.col("_q").alias(out))


def _small(d: DataFrame, group: list[str], probs: Sequence[float]) -> DataFrame:
    """(group..., _q) by sorting each group's values in one aggregation buffer."""
    values = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_x", "_c"))),
                                   lambda s: F.array_repeat(s["_x"], s["_c"].cast("int"))))
    rows = d.groupBy(*group).agg(values.alias("_v"))
    place = [F.lit(float(p)) * (F.size("_v") - 1) for p in probs]
    at = lambda rank: F.get("_v", rank.cast("int"))
    return rows.select(*group, F.array(*[at(F.floor(h)) + (h - F.floor(h)) * (at(F.ceil(h)) - at(F.floor(h)))
                                         for h in place]).alias("_q"))


def _large(d: DataFrame, group: list[str], probs: Sequence[float]) -> DataFrame:
    """(group..., _q) by running counts over range partitions of (group, value)."""
    spark = d.sparkSession
    checkpoint_dir(spark)
    counts = d.groupBy(*group, "_x").agg(F.sum("_c").alias("_c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # checkpoint: both branches below must see the same range partitioning
    counts = counts.repartitionByRange(parts, *group, "_x").withColumn("_pid", F.spark_partition_id()).checkpoint()
    across = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.groupBy(*group, "_pid").agg(F.sum("_c").alias("_pc")).withColumns({
        "_before": F.coalesce(F.sum("_pc").over(across), F.lit(0)),
        "_n": F.sum("_pc").over(Window.partitionBy(*group))})
    inside = Window.partitionBy(*group, "_pid").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = join_null_safe(counts, slices.drop("_pc"), [*group, "_pid"]).withColumn(
        "_from", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))

    def at(rank):
        here = (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_c"))
        return F.max(F.when(here, F.col("_x")))

    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    picks = ranked.groupBy(*group).agg(F.max("_n").alias("_n"), *[
        c for i, h in enumerate(place) for c in (at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"))])
    q = F.array(*[F.col(f"_lo{i}") + (h - F.floor(h)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
                  for i, h in enumerate(place)])
    return picks.select(*group, q.alias("_q"))
