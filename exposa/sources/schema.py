"""Explicit schemas so a reload never changes types (no inference)."""

from pyspark.sql import types as T

CLAIMS_MONTHLY = T.StructType([
    T.StructField("policyno", T.StringType()),
    T.StructField("situation_num", T.IntegerType()),
    T.StructField("effectdate", T.DateType()),
    T.StructField("expirydate", T.DateType()),
    T.StructField("ym", T.IntegerType()),
    T.StructField("xm", T.IntegerType()),
    T.StructField("start", T.DateType()),
    T.StructField("epy", T.DoubleType()),
    T.StructField("property_cover", T.StringType()),
    T.StructField("LossofIncome_cover", T.StringType()),
    T.StructField("suminsured_prop", T.DoubleType()),
    T.StructField("suminsured_lossofinc", T.DoubleType()),
    T.StructField("grossincurred_prop", T.DoubleType()),
    T.StructField("grossincurred_lossofinc", T.DoubleType()),
    T.StructField("riskpostcode", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("building_age", T.StringType()),
    T.StructField("building_type", T.StringType()),
    T.StructField("construction_walls", T.StringType()),
    T.StructField("construction_floor", T.StringType()),
    T.StructField("sprinkler_type", T.StringType()),
    T.StructField("occupation", T.StringType()),
    T.StructField("indem_per_grp", T.StringType()),
])

POSTCODES = T.StructType([
    T.StructField("postcode", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("sa3name", T.StringType()),
    T.StructField("sa4name", T.StringType()),
    T.StructField("sa4", T.IntegerType()),
    T.StructField("electoraterating", T.StringType()),
    T.StructField("Lat_precise", T.DoubleType()),
    T.StructField("Long_precise", T.DoubleType()),
])

# Columns that describe the insured building / risk; they are the
# "details" of a policy version.
DETAIL_COLS = [
    "geo_code", "state", "building_age", "building_type",
    "construction_walls", "construction_floor", "sprinkler_type",
    "occupation_risk",
]
VERSION_KEYS = ["policyno", "situation_num", "effectdate", "expirydate"]
AMOUNT_COLS = [
    "suminsured_lossofinc", "suminsured_prop",
    "grossincurred_lossofinc", "grossincurred_prop",
]
BUILDING_COLS = ["building_type", "building_age", "construction_walls",
                 "construction_floor"]
