"""Stand-in inputs built from the driver's TPC-H-like tables.

The pricing operators expect a monthly policy/claim extract and a postcode
dimension.  These functions only shape driver rows into those schemas (the
fixed mapping documented in FIXTURES.md); every cleaning, grouping and
modelling step runs later through the library's own operators.

Join plan: customers join the orders (a quarter of the lineitems), what a
lineitem says is reduced to a few narrow columns first, and its rows then meet
part and the orders, one shuffle each where these are too large to broadcast, in as
many partitions as the lineitems need for each to be sorted in memory;
nation and region have a fixed size (25 / 5 rows) and are broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exposa.session import dealt
from exposa.sources.tables import read_table

# Fixed values of the stand-in mapping (not taken from any data).
# Some source values stand for values that the study's rules name, so every
# rule meets rows: walls and occupations by brand, floors by the part name's
# first word, the state of two nations, three postcodes of one nation.
AGE_BANDS = [(12, "Less than 2 Years"), (25, "Less Than 20 Years"), (37, "1960 - 1980")]
AGE_BAND_LAST = "Before 1960"
WALLS = {"Brand#11": "Polystyrene", "Brand#12": "Glass",
         "Brand#13": "Aluminum/Fibro/Iron/Steel (on Steel Frame)"}
FLOORS = {"small": "Timber", "hot": "Other"}
OCCUPATIONS = {"Brand#21": "Unknown", "Brand#22": "O_Other Community Services",
               "Brand#23": "D- Electricity, Gas & Water"}
STATES = {"NATION_3": "ACT", "NATION_8": "NT"}
POSTCODES = {"002080": "004375", "002081": "002309", "002082": "002304"}
# The second area that the study's hand fix of postcode 002304 chooses.
AREA_FIX = ("002304", "Shoalhaven", "Southern Highlands and Shoalhaven")
INDEMNITY_BY_LINE = ["12 mths", "24 mths", "<12 mths"]
INDEMNITY_UNKNOWN = "UNKNOWN"       # every seventh line number
SENT_PARTS = 2_000_000      # parts beyond which lineitems are dealt out to meet them; fewer may be broadcast
ELECTORATE_LABELS = ["Safe", "Fairly Safe", "Marginal", "Very Marginal"]


def _named(value: Column, names: dict[str, str], default: Column | None = None) -> Column:
    e = F.lit(None).cast("string")
    for k, v in reversed(list(names.items())):
        e = F.when(value == k, v).otherwise(e)
    return F.coalesce(e, value if default is None else default)


def _named_sql(value: str, names: dict[str, str], default: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {value} {whens} ELSE {default or value} END"


def _age_band(size: Column) -> Column:
    e = None
    for upper, label in AGE_BANDS:
        e = (F.when(size <= upper, label) if e is None
             else e.when(size <= upper, label))
    return e.otherwise(AGE_BAND_LAST)


def _geo(spark: SparkSession, sf_dir: str, customers: DataFrame) -> DataFrame:
    """Rows with c_custkey and c_nationkey, and the areas of that customer."""
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    k = F.col("c_custkey") % (F.lit(2) + (F.col("c_nationkey") % 5) * 6)
    return (customers.withColumn("k", k)
            .join(F.broadcast(n.select("n_nationkey", "n_name", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(r.select("r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumns({
                "state": _named(F.col("n_name"), STATES, F.col("r_name")),
                "sa4name": F.col("n_name"),
                "sa3name": F.concat(F.col("n_name"), F.lit("/"), (F.col("k") % 2).cast("string")),
                "riskpostcode": _named(F.lpad((F.lit(2000) + F.col("c_nationkey") * 40 + F.col("k")).cast("string"), 6, "0"),
                                       POSTCODES)}))


def _customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return _geo(spark, sf_dir, c).select("c_custkey", "c_mktsegment", "state", "sa4name", "sa3name", "riskpostcode")


def claims_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem in the monthly claims schema (raw, uncleaned)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.year("l_shipdate").alias("ym"), F.month("l_shipdate").alias("xm"),
        (F.col("l_quantity") / 50).alias("epy"),
        F.when(F.col("l_tax") == 0.0, "N").otherwise("Y").alias("property_cover"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.08),
               F.col("l_extendedprice") * F.col("l_discount"))
        .when((F.col("l_returnflag") == "N") & (F.round("l_discount", 2) == 0.01), F.lit(5.0))
        .otherwise(F.lit(0.0)).alias("grossincurred_prop"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") >= 0.07), F.col("l_extendedprice") * F.col("l_tax"))
        .otherwise(F.lit(0.0)).alias("bi_amount"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                   "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    p = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_type", "p_brand", F.substring_index("p_name", " ", 1).alias("p_word"))
    lines, parts = li.count(), p.count()                          # from the files' footers
    insured = dealt(o.join(c, F.col("o_custkey") == F.col("c_custkey")), lines, "o_orderkey")
    if parts > SENT_PARTS:
        li, p = dealt(li, lines, "l_partkey"), dealt(p, lines, "p_partkey")
    df = _geo(spark, sf_dir, dealt(li.join(p, F.col("l_partkey") == F.col("p_partkey")), lines, "l_orderkey")
              .join(insured, F.col("l_orderkey") == F.col("o_orderkey")))
    no_bi = F.col("o_orderstatus") == "F"
    bad_building = F.col("p_size") % 10 == 0
    line = F.col("l_linenumber")
    indem = F.when(line % 7 == 0, INDEMNITY_UNKNOWN).when(line % 3 == 0, INDEMNITY_BY_LINE[0]).when(
        line % 3 == 1, INDEMNITY_BY_LINE[1]).otherwise(INDEMNITY_BY_LINE[2])
    return df.select(
        F.col("o_custkey").cast("string").alias("policyno"),
        (F.lit(1) + line % 2).cast("int").alias("situation_num"),
        F.make_date(F.col("ym"), F.lit(1), F.lit(1)).alias("effectdate"),
        F.make_date(F.col("ym") + 1, F.lit(1), F.lit(1)).alias("expirydate"),
        "ym", "xm",
        F.make_date(F.col("ym"), F.col("xm"), F.lit(1)).alias("start"),
        "epy", "property_cover",
        F.when(no_bi, "N").otherwise("Y").alias("LossofIncome_cover"),
        F.col("o_totalprice").alias("suminsured_prop"),
        F.when(no_bi, F.lit(None).cast("double"))
        .otherwise(F.round(F.col("o_totalprice") * 0.2, 2)).alias("suminsured_lossofinc"),
        "grossincurred_prop",
        F.when(no_bi, F.lit(None).cast("double")).otherwise(F.col("bi_amount")).alias("grossincurred_lossofinc"),
        "riskpostcode", "state",
        F.when(~bad_building, _age_band(F.col("p_size"))).alias("building_age"),
        F.when(~bad_building, F.when(F.col("p_size") % 10 == 1, "Medium rise")
               .when(F.col("p_size") % 10 == 2, "High rise").otherwise(F.col("p_type"))).alias("building_type"),
        F.when(~bad_building, _named(F.col("p_brand"), WALLS)).alias("construction_walls"),
        F.when(~bad_building, _named(F.col("p_word"), FLOORS)).alias("construction_floor"),
        F.when(F.col("o_orderpriority") == "5-LOW", "None")
        .otherwise(F.col("o_orderpriority")).alias("sprinkler_type"),
        _named(F.col("p_brand"), OCCUPATIONS, F.concat(F.col("c_mktsegment"), F.lit("_"), F.col("p_brand")))
        .alias("occupation"),
        F.when(~no_bi, indem).alias("indem_per_grp"),
    )


def postcodes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postcode dimension with the documented faults.

    Distinct (postcode, state, sa3, sa4) of the customers; state 'ASIA' where
    number % 97 == 0, electorate NULL where number % 7 == 0, rows with
    number % 211 == 0 removed, one extra row with NULL sa3name where
    number % 50 == 0.  ``postcode`` is left unpadded (the reader pads it).
    """
    geo = _customer_geo(spark, sf_dir).select(
        "riskpostcode", "state", "sa3name", "sa4name").distinct()
    num = F.col("riskpostcode").cast("int")
    rating = F.when(num % 4 == 0, ELECTORATE_LABELS[0]).when(
        num % 4 == 1, ELECTORATE_LABELS[1]).when(
        num % 4 == 2, ELECTORATE_LABELS[2]).otherwise(ELECTORATE_LABELS[3])
    base = geo.filter(num % 211 != 0).select(
        num.cast("string").alias("postcode"),
        F.when(num % 97 == 0, "ASIA").otherwise(F.col("state")).alias("state"),
        "sa3name", "sa4name",
        (F.lit(100) + F.floor((num - 2000) / 40)).cast("int").alias("sa4"),
        F.when(num % 7 != 0, rating).alias("electoraterating"),
        (F.lit(-10.0) - num / 100.0).alias("Lat_precise"),
        (F.lit(110.0) + num / 50.0).alias("Long_precise"),
    )
    extra = base.filter(F.col("postcode").cast("int") % 50 == 0).withColumn(
        "sa3name", F.lit(None).cast("string"))
    code, sa3, sa4 = AREA_FIX
    second = base.filter(F.lpad("postcode", 6, "0") == code).withColumns({"sa3name": F.lit(sa3), "sa4name": F.lit(sa4)})
    return base.unionByName(extra).unionByName(second)


# ---------------------------------------------------------------------------
# The same stand-in tables in DuckDB SQL (used by the oracle strings).
# ---------------------------------------------------------------------------

CUSTOMER_GEO_SQL = f"""
SELECT c_custkey, c_mktsegment, {_named_sql("n_name", STATES, "r_name")} AS state, n_name AS sa4name,
       n_name || '/' || CAST(k % 2 AS VARCHAR) AS sa3name,
       {_named_sql("lpad(CAST(2000 + c_nationkey * 40 + k AS VARCHAR), 6, '0')", POSTCODES)} AS riskpostcode
FROM (SELECT c_custkey, c_nationkey, c_mktsegment,
             c_custkey % (2 + (c_nationkey % 5) * 6) AS k FROM customer) c
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
"""

CLAIMS_MONTHLY_SQL = f"""
SELECT CAST(o_custkey AS VARCHAR) AS policyno,
       CAST(1 + l_linenumber % 2 AS INTEGER) AS situation_num,
       make_date(CAST(year(l_shipdate) AS BIGINT), 1, 1) AS effectdate,
       make_date(CAST(year(l_shipdate) + 1 AS BIGINT), 1, 1) AS expirydate,
       CAST(year(l_shipdate) AS INTEGER) AS ym,
       CAST(month(l_shipdate) AS INTEGER) AS xm,
       make_date(CAST(year(l_shipdate) AS BIGINT), CAST(month(l_shipdate) AS BIGINT), 1) AS start,
       l_quantity / 50 AS epy,
       CASE WHEN l_tax = 0.0 THEN 'N' ELSE 'Y' END AS property_cover,
       CASE WHEN o_orderstatus = 'F' THEN 'N' ELSE 'Y' END AS LossofIncome_cover,
       o_totalprice AS suminsured_prop,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE round(o_totalprice * 0.2, 2) END
         AS suminsured_lossofinc,
       CASE WHEN l_returnflag = 'R' AND l_discount >= 0.08 THEN l_extendedprice * l_discount
            WHEN l_returnflag = 'N' AND round(l_discount, 2) = 0.01 THEN 5.0
            ELSE 0.0 END AS grossincurred_prop,
       CASE WHEN o_orderstatus = 'F' THEN NULL
            WHEN l_linestatus = 'O' AND l_tax >= 0.07 THEN l_extendedprice * l_tax
            ELSE 0.0 END AS grossincurred_lossofinc,
       g.riskpostcode, g.state,
       CASE WHEN p_size % 10 = 0 THEN NULL {" ".join(f"WHEN p_size <= {n} THEN '{v}'" for n, v in AGE_BANDS)}
            ELSE '{AGE_BAND_LAST}' END AS building_age,
       CASE p_size % 10 WHEN 0 THEN NULL WHEN 1 THEN 'Medium rise' WHEN 2 THEN 'High rise'
            ELSE p_type END AS building_type,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE {_named_sql("p_brand", WALLS)} END AS construction_walls,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE {_named_sql("split_part(p_name, ' ', 1)", FLOORS)} END
         AS construction_floor,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'None' ELSE o_orderpriority END
         AS sprinkler_type,
       {_named_sql("p_brand", OCCUPATIONS, "g.c_mktsegment || '_' || p_brand")} AS occupation,
       CASE WHEN o_orderstatus = 'F' THEN NULL
            WHEN l_linenumber % 7 = 0 THEN '{INDEMNITY_UNKNOWN}'
            WHEN l_linenumber % 3 = 0 THEN '12 mths'
            WHEN l_linenumber % 3 = 1 THEN '24 mths' ELSE '<12 mths' END AS indem_per_grp
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer_geo g ON o_custkey = g.c_custkey
JOIN part ON l_partkey = p_partkey
"""

POSTCODES_RAW_SQL = f"""
WITH geo AS (
  SELECT DISTINCT riskpostcode, state, sa3name, sa4name,
         CAST(riskpostcode AS INTEGER) AS num
  FROM customer_geo),
base AS (
  SELECT CAST(num AS VARCHAR) AS postcode,
         CASE WHEN num % 97 = 0 THEN 'ASIA' ELSE state END AS state,
         sa3name, sa4name,
         CAST(100 + floor((num - 2000) / 40) AS INTEGER) AS sa4,
         CASE WHEN num % 7 = 0 THEN NULL
              WHEN num % 4 = 0 THEN 'Safe' WHEN num % 4 = 1 THEN 'Fairly Safe'
              WHEN num % 4 = 2 THEN 'Marginal' ELSE 'Very Marginal' END AS electoraterating,
         -10.0 - num / 100.0 AS Lat_precise,
         110.0 + num / 50.0 AS Long_precise
  FROM geo WHERE num % 211 <> 0)
SELECT * FROM base
UNION ALL
SELECT postcode, state, CAST(NULL AS VARCHAR) AS sa3name, sa4name, sa4,
       electoraterating, Lat_precise, Long_precise
FROM base WHERE CAST(postcode AS INTEGER) % 50 = 0
UNION ALL
SELECT postcode, state, '{AREA_FIX[1]}' AS sa3name, '{AREA_FIX[2]}' AS sa4name, sa4,
       electoraterating, Lat_precise, Long_precise
FROM base WHERE lpad(postcode, 6, '0') = '{AREA_FIX[0]}'
"""
