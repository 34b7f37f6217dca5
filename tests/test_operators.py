"""Hand-made edge cases (FIXTURES.md) for the operators."""

import datetime as dt

from pyspark.sql import functions as F

from exposa.functions import expr as E
from exposa.operators import consolidate as C
from exposa.operators import geo as G
from exposa.operators import grouping as GR
from exposa.operators import postcode as P
from exposa.operators import sampling as SM


def test_sprinkler_level(spark):
    df = spark.createDataFrame([("None",), ("Type 2",), ("no digit",), (None,), ("3 and 4",)], "s string")
    got = [r[0] for r in df.select(E.sprinkler_level("s")).collect()]
    assert got == [0.0, 2.0, None, None, 3.0]


def test_floor_small(spark):
    df = spark.createDataFrame([(-1.0,), (9.99,), (10.0,), (None,)], "a double")
    got = [r[0] for r in E.floor_small(df, ["a"]).collect()]
    assert got == [0.0, 0.0, 10.0, None]


def test_patch_sees_original(spark):
    df = spark.createDataFrame([("004375", "NSW"), ("002309", "NSW")], "riskpostcode string, state string")
    rules = [("riskpostcode", "004375", "state", "QLD"), ("riskpostcode", "002309", "riskpostcode", "002083"),
             ("riskpostcode", "002309", "state", "X")]
    got = sorted(tuple(r) for r in E.patch_codes(df, rules).collect())
    assert got == [("002083", "X"), ("004375", "QLD")]


def _monthly(spark, rows):
    return spark.createDataFrame(rows, "policyno string, situation_num int, effectdate date, "
                                       "expirydate date, ym int, xm int, a string, b string")


def test_representative_mode_and_ties(spark):
    e, x = dt.date(2020, 1, 1), dt.date(2021, 1, 1)
    rows = [
        ("p1", 1, e, x, 2020, 1, "A", "x"),            # single combination
        ("p2", 1, e, x, 2020, 1, "A", "x"), ("p2", 1, e, x, 2020, 2, "B", "x"),
        ("p2", 1, e, x, 2020, 3, "B", "x"),            # clear mode B
        ("p3", 1, e, x, 2020, 1, "A", "x"), ("p3", 1, e, x, 2020, 5, "B", "x"),  # tie -> latest B
        ("p4", 1, e, x, 2020, 5, "C", "x"), ("p4", 1, e, x, 2020, 5, "B", "x"),  # full tie -> B
        ("p5", 1, e, x, 2020, 5, None, "x"), ("p5", 1, e, x, 2020, 5, "Z", "x"),  # NULL last
    ]
    got = {r["policyno"]: r["a"] for r in C.representative(_monthly(spark, rows), ["a", "b"]).collect()}
    assert got == {"p1": "A", "p2": "B", "p3": "B", "p4": "B", "p5": "Z"}


def test_unique_mode(spark):
    df = spark.createDataFrame([("g1", "A"), ("g1", "A"), ("g1", "B"), ("g2", "A"), ("g2", "B"),
                                ("g3", None), ("g3", None)], "g string, v string")
    got = {r[0]: r[1] for r in P.unique_mode(df, "g", "v").collect()}
    assert got == {"g1": "A"}


def test_lump_n_ties_kept(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 3.0), ("d", 1.0), (None, 9.0)], "k string, w double")
    got = {r[0] for r in GR.lump_n(df, "k", "w", 2).select("k").collect()}
    assert got == {"a", "b", "c", "Other", None}


def test_lump_min_threshold_inclusive(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 4.99), (None, 1.0)], "k string, w double")
    got = {r[0] for r in GR.lump_min(df, "k", "w", 5.0).select("k").collect()}
    assert got == {"a", "NEW", None}


def test_geo_rollup_levels(spark):
    rows = [("S", "A4", "A3", "000001", 100.0), ("S", "A4", "A3", "000002", 1.0),   # SA3 merged
            ("S", "A4", "B3", "000003", 500.0),                                     # stays
            ("S", "C4", "C3", "000004", 10.0), ("S", "C4", "C3", "000005", 10.0)]   # -> SA4
    df = spark.createDataFrame(rows, "state string, sa4name string, sa3name string, riskpostcode string, epy double")
    got = {r["riskpostcode"]: (r["geo_code"], r["origin"]) for r in G.geo_rollup(df, 5.0, "epy", 4.0).collect()}
    assert got["000001"] == ("A3", "sa3name") and got["000002"] == ("A3", "sa3name")
    assert got["000003"] == ("000003", "riskpostcode")
    assert got["000004"] == ("C4", "sa4name")


def test_exact_rank_matches_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("s"))
    r = SM.exact_rank(df, ["s"], ["k"], 7, prefix=2)
    w = Window.partitionBy("s").orderBy(SM.hash_key(["k"], 7))
    ref = df.withColumn("rn", F.row_number().over(w))
    j = r.join(ref, ["k", "s"])
    assert j.filter(F.col("_rank") != F.col("rn")).count() == 0


def test_ntile_formula(spark):
    from pyspark.sql import Window
    for n in (1, 7, 10, 23):
        df = spark.range(n).withColumn("r", F.col("id") + 1)
        got = df.select(SM.ntile_of(F.col("r"), F.lit(n), 10).alias("a"),
                        F.ntile(10).over(Window.orderBy("id")).alias("b"))
        assert got.filter(F.col("a") != F.col("b")).count() == 0


def test_claim_type_null_bi(spark):
    df = spark.createDataFrame([(5.0, None), (0.0, None), (5.0, 3.0), (0.0, 2.0)], "p double, b double")
    got = [r[0] for r in df.select(E.claim_type("p", "b")).collect()]
    assert got == ["Only Prop", "No Claim", "Both", "Only BI"]


def test_exact_rank_keeps_null_stratum(spark):
    df = spark.createDataFrame([(str(i), None if i % 3 == 0 else i % 2) for i in range(60)],
                               "k string, s int")
    r = SM.exact_rank(df, ["s"], ["k"], 5)
    assert r.count() == 60
    got = sorted(x["_rank"] for x in r.filter(F.col("s").isNull()).collect())
    assert got == list(range(1, 21))


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(str(i), i % 2 == 0 if i % 5 else None) for i in range(100)],
                               "k string, c boolean")
    out = SM.stratified_split(df, 0.8, ["c"], ["k"], 123)
    assert out.count() == 100
    counts = {(r["c"], r["split"]): r["count"] for r in out.groupBy("c", "split").count().collect()}
    assert counts[(None, "train")] == 16 and counts[(None, "test")] == 4


def test_occupation_map_severity_exclusions(spark):
    rows = []
    # 14 occupations; A1 and B1 have the highest mean property claim
    for i, (occ, w, amt) in enumerate([("A1", 1.0, 900.0), ("B1", 1.0, 800.0), ("C1", 50.0, 10.0)]
                                      + [(f"D{j}", 40.0 - j, 5.0) for j in range(11)]):
        rows.append((occ, w, amt, 0.0))
    df = spark.createDataFrame(rows, "occupation string, epy double, grossincurred_prop double, "
                                     "grossincurred_lossofinc double")
    m = {r[0]: r[1] for r in GR.occupation_map(df, excluded=["Unknown"], top_keep=10, top_n=13,
                                               severity_top=2, severity_cols=["grossincurred_prop"]
                                               ).collect()}
    assert m["A1"] == "A1" and m["B1"] == "B1"          # excluded: kept as themselves
    assert m["C1"] == "C1"                              # heaviest of the rest
    assert m["D10"] == "D_General" and m["D9"] == "D_General"
    assert len(m) == 14


def test_prefix_for_scales():
    assert SM.prefix_for(1000) == 2
    assert SM.prefix_for(10 ** 12) == 6          # 16^6 windows of ~60k rows, worst case
    assert SM.prefix_for(10 ** 15) == 9


def test_hash_normal_moments(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    z = df.select(SM.hash_normal(["k"], 9).alias("z"))
    m, sd = z.agg(F.avg("z"), F.stddev("z")).first()
    assert abs(m) < 0.03 and abs(sd - 1) < 0.03
    again = df.select(SM.hash_normal(["k"], 9).alias("z"))
    assert z.exceptAll(again).count() == 0


def test_second_path_encoding_rules(spark):
    from exposa.plans import stages as S
    e, x = dt.date(2020, 1, 1), dt.date(2021, 1, 1)
    base = ("p1", 1, e, x, 2020, 1, e, 1.0, "Y")
    rows = [
        base + ("Y", 100.0, None, 0.0, None, "002000", "S", None, "High rise", "Glass", "Timber",
                "Type 2", "A_x", None),                       # covered, NULL BI amounts
        base + ("N", 100.0, None, 50.0, None, "002000", "S", "Before 1960", None, None, None,
                "None", "A_x", None),                         # uncovered
    ]
    from exposa.sources.schema import CLAIMS_MONTHLY
    df = spark.createDataFrame(rows, CLAIMS_MONTHLY)
    out = {r["LossofIncome_cover"]: r for r in S.encode_second(S.clean_second(df)).collect()}
    cov, unc = out[True], out[False]
    assert cov["suminsured_lossofinc"] == 0.0 and cov["grossincurred_lossofinc"] == 0.0
    assert cov["indem_per_grp"] == "Unknown" and unc["indem_per_grp"] == "LoI_NULL"
    assert unc["suminsured_lossofinc"] is None                       # uncovered: stays NULL
    assert cov["building_type"] == "Mid-High rise" and cov["construction_walls"] == "Other"
    assert cov["construction_floor"] == "Other" and cov["sprinkler_type"] == ">0"
    assert unc["building_age"] == "Before 1980" and unc["building_type"] == "Unknown"
    assert unc["sprinkler_type"] == "0" and cov["building_age"] == "Unknown"


def test_geo_rollup3_levels_and_state_only(spark):
    rows = [("NSW", "A4", "A3", "000001", 60.0), ("NSW", "A4", "A3", "000002", 10.0),   # -> state
            ("ACT", "C4", "C3", "000003", 1000.0),                                       # ACT -> state
            ("VIC", "V4", "V3", "000004", 500.0),                 # big, but its SA4 has small codes
            ("VIC", "V4", "W3", "000005", 60.0), ("VIC", "V4", "W3", "000006", 60.0),
            ("QLD", "Q4", "Q3", "000007", 500.0)]                 # stays a postcode
    df = spark.createDataFrame(rows, "state string, sa4name string, sa3name string, riskpostcode string, exposure double")
    got = {r["riskpostcode"]: r["geo_code"] for r in G.geo_rollup3(df, 50, 100, 200).collect()}
    assert got["000001"] == "NSW" and got["000002"] == "NSW"
    assert got["000003"] == "ACT"
    # SA3 step: codes 000005 / 000006 (60 < 100) move their WHOLE SA4 V4
    assert got["000004"] == "V4" and got["000005"] == "V4" and got["000006"] == "V4"
    assert got["000007"] == "000007"
