"""Steps that must not move or rank all rows: splits, policy versions, and the sums behind the fits."""

import datetime as dt
import random
import re

import numpy as np
from pyspark.sql import functions as F

from exposa import session
from exposa.models import cells as CL
from exposa.models import tweedie as TW
from exposa.models.design import base_first_by, bases_first_by
from exposa.operators import consolidate as C
from exposa.operators import postcode as PC
from exposa.operators import sampling as SM
from exposa.plans import stages as S
from exposa.sources import fixtures
from exposa.sources.schema import VERSION_KEYS

SF = "/root/testdata/sf0.001"


def _exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (?:hash|range)partitioning|Exchange Single", plan))


def _keyed(spark, n=4000):
    rows = [(str(i % 700) if i % 50 else None, i, i % 3 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v int, s boolean")


def test_split_and_folds_equal_full_ranking(spark):
    df = _keyed(spark)
    ranked = SM.exact_rank(df, ["s"], ["k", "v"], 7)
    want = {(r["v"]): (r["_rank"] <= int(r["_n"] * 0.8), r["fold"]) for r in ranked.withColumn(
        "fold", SM.ntile_of(F.col("_rank"), F.col("_n"), 10)).collect()}
    split = {r["v"]: r["split"] == "train" for r in SM.stratified_split(df, 0.8, ["s"], ["k", "v"], 7).collect()}
    folds = {r["v"]: r["fold"] for r in SM.stratified_folds(df, 10, ["s"], ["k", "v"], 7).collect()}
    assert {v: (split[v], folds[v]) for v in want} == want
    assert len(split) == len(folds) == 4000


def test_split_is_exact_with_equal_keys(spark):
    df = spark.createDataFrame([("same", i) for i in range(10)] + [(None, 10 + i) for i in range(3)], "k string, v int")
    got = SM.stratified_split(df.withColumn("s", F.lit(1)), 0.5, ["s"], ["k"], 1)
    assert got.filter("split = 'train'").count() == 6 and got.count() == 13


def test_split_moves_no_rows(spark):
    # before: every row was shuffled and sorted to be ranked
    assert _exchanges(SM.stratified_split(_keyed(spark), 0.8, ["s"], ["k", "v"], 7)) == 0


def _monthly(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        y, m = rng.choice([1995, 1996]), rng.randint(1, 12)
        start = None if i % 97 == 0 else dt.date(y, m, 1)
        year = None if start is None else dt.date(y, 1, 1)
        cover = rng.random() < 0.6
        rows.append(("hot" if i % 3 == 0 else str(rng.randint(1, 80)), rng.choice([1, 2]), year,
                     None if year is None else dt.date(y + 1, 1, 1), None if year is None else y,
                     None if year is None else m, start, rng.randint(1, 50) / 50, cover,
                     float(rng.randint(1, 3)), rng.choice([None, 1.0, 2.0]) if cover else None,
                     float(rng.choice([0, 0, 50])), rng.choice([None, 0.0, 70.0]),
                     rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice(["i", None])))
    return spark.createDataFrame(
        rows, "policyno string, situation_num int, effectdate date, expirydate date, ym int, xm int, start date, epy double, "
              "LossofIncome_cover boolean, suminsured_prop double, suminsured_lossofinc double, grossincurred_prop double, "
              "grossincurred_lossofinc double, state string, building_type string, indem_per_grp string")


_PICKS = [C.Pick(("state", "building_type")), C.Pick(("suminsured_prop", "suminsured_lossofinc", "indem_per_grp"), "literal")]


def _rows(df):
    d = df.withColumn("date_weights", F.round("date_weights", 9))
    return sorted(map(repr, d.select(*sorted(d.columns)).collect()))


def test_versions_equal_joined_operators(spark):
    df = C.recency_weight(_monthly(spark), "start")
    want = C.consolidate(df).join(C.representative(df, ["state", "building_type"]), VERSION_KEYS, "left") \
        .join(C.representative_sums(df, mode="literal"), VERSION_KEYS, "left")
    assert _rows(C.versions(df, _PICKS)) == _rows(want)
    assert _rows(C.versions(df, _PICKS, most=60)) == _rows(want)          # "hot" takes the aggregated path


def test_versions_pick_over_covered_rows(spark):
    df = C.recency_weight(_monthly(spark), "start")
    own = C.representative(df.filter("LossofIncome_cover"), ["suminsured_lossofinc", "indem_per_grp"])
    want = C.consolidate(df).join(own, VERSION_KEYS, "left")
    picks = [C.Pick(("suminsured_lossofinc", "indem_per_grp"), where="LossofIncome_cover")]
    for most in (C.HOT, 60):
        assert _rows(C.versions(df, picks, most=most)) == _rows(want)


def test_versions_move_rows_once(spark):
    # before: three aggregations and their joins moved the rows six times, and the version number once more
    df = _monthly(spark).withColumn("date_weights", F.lit(1.0))
    assert _exchanges(C.policy_version(C.versions(df, _PICKS))) == 1


def test_tasks_follow_the_rows(spark, monkeypatch):
    # before: the session's number of shuffle partitions, so that what a task sorts grew with the table
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    df = C.recency_weight(_monthly(spark), "start")
    got = C.versions(df, _PICKS)
    assert got.rdd.getNumPartitions() == 30
    lines = fixtures.read_table(spark, SF, "lineitem").count()
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    dealt = fixtures.claims_monthly(spark, SF)
    assert dealt.rdd.getNumPartitions() == -(-lines // 500)
    monkeypatch.setattr(fixtures, "SENT_PARTS", 0)                       # the parts are dealt out too
    both = fixtures.claims_monthly(spark, SF)
    monkeypatch.setattr(session, "TASK_ROWS", 1 << 40)
    want = fixtures.claims_monthly(spark, SF)
    assert want.exceptAll(dealt).isEmpty() and want.exceptAll(both).isEmpty() and dealt.count() == both.count() == lines
    assert _rows(C.versions(df, _PICKS)) == _rows(got)


def test_levels_of_all_factors_at_once(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", "x", 3.0), ("a", "y", 1.0), ("c", "x", None)],
                               "f string, g string, e double")
    assert bases_first_by(df, ["f", "g"], "e") == {"f": ["b", "a", "c"], "g": ["x", "y"]}
    assert base_first_by(df, "f", None) == ["a", "b", "c"]


def test_tweedie_series_shares_gamma_functions(monkeypatch):
    # before: two gamma functions a row and term
    asked = []
    real = TW.lgamma_np
    monkeypatch.setattr(TW, "lgamma_np", lambda x: asked.append(np.size(x)) or real(x))
    y = np.linspace(10, 20_000, 2000)
    got = TW.tweedie_logpdf(y, np.full(2000, 600.0), 300.0, 1.5)
    assert sum(asked) < 2000
    monkeypatch.undo()
    one = [TW.tweedie_logpdf(y[i:i + 1], np.array([600.0]), 300.0, 1.5)[0] for i in range(0, 2000, 97)]
    np.testing.assert_allclose(got[::97], one, rtol=1e-12)


def test_versions_move_numbers_for_texts(spark, monkeypatch):
    # before: every detail of a row was moved as text (score_geo_grid: 95 bytes a row)
    df = C.recency_weight(_monthly(spark), "start")
    picks = [C.Pick(("state", "building_type")), C.Pick(("suminsured_prop",)),
             C.Pick(("suminsured_lossofinc", "indem_per_grp"), where="LossofIncome_cover")]
    runs = C._runs(df, picks, VERSION_KEYS)
    assert [r.cols for r in runs.values()] == [("state", "building_type"), ("indem_per_grp",)]
    packed = C._pack(df, runs)
    assert [c for c, t in packed.dtypes if t == "string"] == ["policyno"]
    back = packed.select(*[v for c in packed.columns for v in (runs[c].unpacked() if c in runs else [F.col(c)])])
    assert _rows(back) == _rows(df)
    got = {}
    for how in (picks, _PICKS):
        for levels, codes in ((C.MOST_LEVELS, C.MOST_CODES), (C.MOST_LEVELS, 6), (2, C.MOST_CODES), (-1, C.MOST_CODES)):
            monkeypatch.setattr(C, "MOST_LEVELS", levels)
            monkeypatch.setattr(C, "MOST_CODES", codes)
            out = C.versions(df, how)
            got[levels, codes] = out.columns, _rows(out)
        assert all(v == got[-1, 1 << 62] for v in got.values())
        monkeypatch.undo()


def test_packed_numbers_are_ordered_as_their_values(spark):
    rows = [(a, b) for a in ("", "b", "B", "\u00e9", None) for b in ("x", "\U0001f600", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    runs = C._runs(df, [C.Pick(("a", "b"))], [])
    both = C._pack(df, runs).select("_r0", *runs["_r0"].unpacked())
    by_number = [(r.a, r.b) for r in both.orderBy("_r0").collect()]
    assert by_number == [tuple(r) for r in df.orderBy(*[F.col(c).asc_nulls_last() for c in "ab"]).collect()]
    assert both.select("_r0").distinct().count() == len(rows)


def _versions(spark):
    days = [None, *[dt.date(1990 + k, 1, 1) for k in range(6)]]
    rows = [(None if p == 7 else str(p), s, day, day and dt.date(day.year + 1, 1, 1), ["1", "2", "3", None][(p + k) % 4],
             "NS"[k % 2], k % 3 > 0, 5.0, "i", "age" if k % 2 else None)
            for p in range(20) for s in (1, 2) for k, day in enumerate(days) if (p + s + k) % 5]
    return spark.createDataFrame(rows, "policyno string, situation_num int, effectdate date, expirydate date, riskpostcode string, "
                                 "state string, LossofIncome_cover boolean, suminsured_lossofinc double, indem_per_grp string, "
                                 "building_age string")


def test_second_path_numbers_versions_in_place(spark, tmp_path):
    # before: the versions were moved and sorted again to be numbered
    v = _versions(spark)
    dim = spark.createDataFrame([("1", "N", "a", "A", "Safe"), ("1", "S", "b", "B", None), ("2", "N", "c", "C", "Safe")],
                                "postcode string, state string, sa3name string, sa4name string, electoraterating string")
    fixes = spark.createDataFrame([("2", "N")], "riskpostcode string, dim_state string")
    want = C.policy_version(PC.attach_postcode(PC.apply_state_fixes(v, fixes), dim)).drop("effectdate", "expirydate")
    stages = {"v": S.by_situation(v), "dim": dim, "fixes": fixes, "pairs": v.select("riskpostcode", "state").distinct()}
    for name, df in stages.items():
        df.write.parquet(f"{tmp_path}/{name}")
    got = S.finish_second(*[spark.read.parquet(f"{tmp_path}/{name}") for name in stages])
    own = lambda df: sorted(map(repr, df.select(
        "policyno", "situation_num", "policy_version", "riskpostcode", "state", "sa3name", "building_age").collect()))
    assert own(got) == own(want) and 0 < got.count() < v.count()
    assert got.columns == [*want.columns, "building_info_na"]
    assert _exchanges(got) == 0
    df = _monthly(spark).withColumn("date_weights", F.lit(1.0)).withColumn("riskpostcode", F.lit("1"))
    assert _exchanges(S.by_situation(C.versions(df, _PICKS))) == 1


def test_cells_are_moved_once_and_coded(spark, monkeypatch):
    # before: rows were grouped with their levels as text, written, moved and written again
    df = _monthly(spark).withColumn("y", (F.col("grossincurred_prop") > 0).cast("double"))
    want = CL.fit(CL.build(df, "y", ["building_type"], ["suminsured_prop"]), [CL.Spec("m", "poisson")])["m"]
    written, real = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **b: written.append(self) or real(self, *a, **b))
    monkeypatch.setattr(CL, "TASK_ROWS", 50)
    cells = CL.build(df, "y", ["building_type"], ["suminsured_prop"])
    assert len(written) == 1 and _exchanges(written[0].select("*")) == 1 and dict(written[0].dtypes)["f0"] == "int"
    assert written[0].rdd.getNumPartitions() == 30 and cells.table.rdd.getNumPartitions() == cells.parts
    got = CL.fit(cells, [CL.Spec("m", "poisson")])["m"]
    assert got.names == want.names and got.rows == want.rows
    np.testing.assert_allclose(got.beta, want.beta, rtol=1e-9)
