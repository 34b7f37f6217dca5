"""Scale guards on physical plans: no raw-row window or single-partition
exchange where a key (or a stratum) may hold a third of the rows."""

import datetime as dt

from pyspark.sql import functions as F

from exposa.operators import consolidate as C
from exposa.operators import sampling as SM
from exposa.operators import windows as W


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _monthly(spark):
    e, x = dt.date(2020, 1, 1), dt.date(2021, 1, 1)
    rows = [("p1", 1, e, x, 2020, m, "A" if m % 2 else "B", "x") for m in range(1, 13)]
    return spark.createDataFrame(rows, "policyno string, situation_num int, effectdate date, "
                                       "expirydate date, ym int, xm int, a string, b string")


def test_representative_has_no_window(spark):
    plan = _plan(C.representative(_monthly(spark), ["a", "b"]))
    assert "Window" not in plan
    assert "HashAggregate" in plan or "ObjectHashAggregate" in plan or "SortAggregate" in plan


def test_pick_row_has_no_window(spark):
    plan = _plan(W.last_row(_monthly(spark), ["policyno"], ["ym", "xm"], ["a"]))
    assert "Window" not in plan


def test_exact_rank_never_single_partition(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("s"))
    plan = _plan(SM.exact_rank(df, ["s"], ["k"], 1))
    assert "SinglePartition" not in plan
    # the raw-row window is partitioned by (stratum, hash prefix)
    assert "_b" in plan


def test_consolidate_is_one_aggregate(spark):
    df = _monthly(spark).withColumns({
        "epy": F.lit(0.5), "date_weights": F.lit(1.0), "grossincurred_prop": F.lit(0.0),
        "grossincurred_lossofinc": F.lit(None).cast("double"), "LossofIncome_cover": F.lit(True)})
    plan = _plan(C.consolidate(df))
    assert "Window" not in plan and plan.count("Exchange") <= 1


def test_statistics_read_their_data_once(spark):
    """Bounds on scans and exchanges of the statistics that once took hundreds (density) or a dozen (box plots)."""
    from exposa.plans.catalog import QUERIES
    for name, exchanges in (("density_claim_type", 12), ("box_stats_occupation", 8), ("situation_history", 8),
                            ("geo_grid", 16)):
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert plan.count("FileScan") <= 2 and plan.count("Exchange") <= exchanges, \
            (name, plan.count("FileScan"), plan.count("Exchange"))
        assert plan.count("ScalarSubquery") <= 2
