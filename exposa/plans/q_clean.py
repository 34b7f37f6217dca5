"""Registered queries: sources/sinks, scalar rules, data-quality gates."""

from __future__ import annotations

from exposa.session import app_id

from pyspark.sql import functions as F

from exposa.functions import expr as E
from exposa.operators import consolidate as C
from exposa.operators import gates as Q
from exposa.operators import grouping as GR
from exposa.plans import stages as S
from exposa.plans.registry import register
from exposa.sources import fixtures, tables
from exposa.sources.schema import AMOUNT_COLS, BUILDING_COLS


def _scratch(spark, name: str) -> str:
    from exposa.session import checkpoint_dir
    return (f"{checkpoint_dir(spark).rstrip('/')}/exposa-io/"
            f"{app_id(spark)}/{name}")


def _round(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


_PC_ROUND = ["exposure", "grossincurred_prop", "grossincurred_lossofinc"]
_PC_SQL_SELECT = """* EXCLUDE (exposure, date_weights, grossincurred_prop, grossincurred_lossofinc),
       round(exposure, 6) AS exposure, round(date_weights, 9) AS date_weights,
       round(grossincurred_prop, 6) AS grossincurred_prop,
       round(grossincurred_lossofinc, 6) AS grossincurred_lossofinc"""


def _pc_rounded(df):
    return _round(_round(df, _PC_ROUND), ["date_weights"], 9)


# --- sources and sinks ------------------------------------------------------

@register("source_claims_csv", "SELECT * FROM claims_monthly", ("claims_monthly",))
def source_claims_csv(spark, sf_dir):
    """Monthly extract written as CSV with a header and read back with the
    fixed schema (no inference)."""
    path = _scratch(spark, "claims_csv")
    S.claims_monthly(spark, sf_dir).write.mode("overwrite").option("header", True).csv(path)
    return tables.read_claims(spark, path)


@register("source_postcodes", "SELECT * FROM postcodes", ("postcodes",))
def source_postcodes(spark, sf_dir):
    """Postcode dimension CSV read with its schema; postcode padded to 6."""
    path = _scratch(spark, "postcodes_csv")
    fixtures.postcodes_raw(spark, sf_dir).write.mode("overwrite").option("header", True).csv(path)
    return tables.read_postcodes(spark, path)


@register("source_policies_csv",
          f"SELECT {_PC_SQL_SELECT} FROM policy_claims WHERE LossofIncome_cover",
          ("policy_claims",))
def source_policies_csv(spark, sf_dir):
    """Policy table round trip through CSV, loss-of-income covered subset."""
    pc = S.policy_claims(spark, sf_dir)
    path = _scratch(spark, "policies_csv")
    pc.write.mode("overwrite").option("header", True).csv(path)
    return _pc_rounded(tables.read_policies(spark, path, "csv", schema=pc.schema))


@register("stage_snapshot", "SELECT * FROM claims_clean", ("claims_clean",))
def stage_snapshot(spark, sf_dir):
    """Stage save then reload (Parquet) of the cleaned claims."""
    path = _scratch(spark, "snapshot_claims_clean")
    tables.snapshot(S.claims_clean(spark, sf_dir), path)
    return spark.read.parquet(path)


# --- scalar rules -----------------------------------------------------------

@register("sprinkler_level", """
SELECT sprinkler_type AS sprinkler_raw,
       CASE WHEN sprinkler_type = 'None' THEN 0.0
            ELSE CAST(NULLIF(regexp_extract(sprinkler_type, '[0-9]', 0), '') AS DOUBLE) END
         AS sprinkler_level,
       count(*) AS n_rows
FROM claims_monthly GROUP BY ALL""", ("claims_monthly",))
def sprinkler_level(spark, sf_dir):
    """'None' -> 0, else first digit of the text, per raw value."""
    df = S.claims_monthly(spark, sf_dir)
    return df.groupBy(F.col("sprinkler_type").alias("sprinkler_raw"),
                      E.sprinkler_level("sprinkler_type").alias("sprinkler_level")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@register("cover_flags", """
SELECT property_cover AS property_raw, LossofIncome_cover AS loi_raw,
       property_cover = 'Y' AS property_flag, LossofIncome_cover = 'Y' AS loi_flag,
       count(*) AS n_rows
FROM claims_monthly GROUP BY ALL""", ("claims_monthly",))
def cover_flags(spark, sf_dir):
    """Y/N cover text to booleans."""
    df = S.claims_monthly(spark, sf_dir)
    return df.groupBy(F.col("property_cover").alias("property_raw"),
                      F.col("LossofIncome_cover").alias("loi_raw"),
                      E.yn_flag("property_cover").alias("property_flag"),
                      E.yn_flag("LossofIncome_cover").alias("loi_flag")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@register("covered_only",
          "SELECT * EXCLUDE (property_cover) FROM claims_monthly WHERE property_cover = 'Y'",
          ("claims_monthly",))
def covered_only(spark, sf_dir):
    """Rows with property cover; the flag column is dropped."""
    df = S.claims_monthly(spark, sf_dir).withColumn("property_cover", E.yn_flag("property_cover"))
    return df.filter("property_cover").drop("property_cover")


@register("floor_small_amounts", """
SELECT policyno, situation_num, ym, xm,
       CASE WHEN suminsured_lossofinc < 10 THEN 0.0 ELSE suminsured_lossofinc END AS suminsured_lossofinc,
       CASE WHEN suminsured_prop < 10 THEN 0.0 ELSE suminsured_prop END AS suminsured_prop,
       CASE WHEN grossincurred_lossofinc < 10 THEN 0.0 ELSE grossincurred_lossofinc END AS grossincurred_lossofinc,
       CASE WHEN grossincurred_prop < 10 THEN 0.0 ELSE grossincurred_prop END AS grossincurred_prop
FROM claims_monthly""", ("claims_monthly",))
def floor_small_amounts(spark, sf_dir):
    """Amounts below 10 (incl. negatives) to 0; NULL kept; 10 kept."""
    df = S.claims_monthly(spark, sf_dir).select("policyno", "situation_num", "ym", "xm", *AMOUNT_COLS)
    return E.floor_small(df, AMOUNT_COLS, 10.0)


_PATCH_RULES = [("riskpostcode", "002001", "state", "PATCHED"),
                ("riskpostcode", "002001", "riskpostcode", "002083")]


@register("patch_codes", """
SELECT CASE WHEN riskpostcode = '002001' THEN '002083' ELSE riskpostcode END AS riskpostcode,
       CASE WHEN riskpostcode = '002001' THEN 'PATCHED' ELSE state END AS state,
       count(*) AS n_rows
FROM claims_monthly GROUP BY ALL""", ("claims_monthly",))
def patch_codes(spark, sf_dir):
    """Postcode / state patch rules; the state rule sees the original code."""
    df = E.patch_codes(S.claims_monthly(spark, sf_dir), _PATCH_RULES)
    return df.groupBy("riskpostcode", "state").agg(F.count(F.lit(1)).alias("n_rows"))


_WALLS = {"Brand#1": "Other", "Brand#2": "Other"}


@register("recode_walls", """
SELECT CASE WHEN construction_walls IN ('Brand#1', 'Brand#2') THEN 'Other'
            ELSE construction_walls END AS construction_walls,
       count(*) AS n_rows, round(sum(epy), 6) AS exposure
FROM claims_geo GROUP BY ALL""", ("claims_geo",))
def recode_walls(spark, sf_dir):
    """Dictionary recode keeping unknown values (walls)."""
    df = GR.recode(S.claims_geo(spark, sf_dir), "construction_walls", _WALLS)
    return df.groupBy("construction_walls").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("epy"), 6).alias("exposure"))


@register("recode_occupation_strict", """
SELECT o.occupation_risk, count(*) AS n_rows, round(sum(g.epy), 6) AS exposure
FROM claims_geo g LEFT JOIN enc_occupation o ON o.occupation = g.occupation
GROUP BY ALL""", ("claims_geo", "enc_occupation"))
def recode_occupation_strict(spark, sf_dir):
    """Strict lookup of the occupation map built from data (miss -> NULL)."""
    geo = S.claims_geo(spark, sf_dir)
    m = GR.occupation_map(geo)
    df = GR.recode(geo, "occupation", m, out="occupation_risk", strict=True)
    return df.groupBy("occupation_risk").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("epy"), 6).alias("exposure"))


@register("fill_unknown_building", """
SELECT coalesce(building_type, 'Unknown') AS building_type,
       coalesce(building_age, 'Unknown') AS building_age,
       coalesce(construction_walls, 'Unknown') AS construction_walls,
       coalesce(construction_floor, 'Unknown') AS construction_floor,
       count(*) AS n_rows
FROM claims_geo GROUP BY ALL""", ("claims_geo",))
def fill_unknown_building(spark, sf_dir):
    """NULL building details become the level 'Unknown'."""
    df = E.fill_unknown(S.claims_geo(spark, sf_dir), BUILDING_COLS)
    return df.groupBy(*BUILDING_COLS).agg(F.count(F.lit(1)).alias("n_rows"))


@register("lossofinc_nulls_main", """
SELECT LossofIncome_cover, indem_per_grp, count(*) AS n_rows,
       round(sum(suminsured_lossofinc), 2) AS suminsured_lossofinc
FROM (SELECT LossofIncome_cover,
             CASE WHEN NOT LossofIncome_cover THEN 'LoI_NULL' ELSE indem_per_grp END AS indem_per_grp,
             CASE WHEN NOT LossofIncome_cover THEN 0.0 ELSE suminsured_lossofinc END AS suminsured_lossofinc
      FROM policy_claims_hasna WHERE suminsured_prop <> 0)
WHERE suminsured_lossofinc IS NOT NULL GROUP BY ALL""", ("policy_claims_hasna",))
def lossofinc_nulls_main(spark, sf_dir):
    """Main-path loss-of-income NULL rules (uncovered -> 0 / 'LoI_NULL',
    remaining NULL sums removed)."""
    df = C.with_sum_insured(S.policy_claims_hasna(spark, sf_dir), "nonzero")
    df = C.lossofinc_nulls(df, "main")
    return df.groupBy("LossofIncome_cover", "indem_per_grp").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.sum("suminsured_lossofinc"), 2).alias("suminsured_lossofinc"))


@register("lossofinc_nulls_second", """
SELECT LossofIncome_cover,
       CASE WHEN NOT LossofIncome_cover THEN 'LoI_NULL' ELSE indem_per_grp END AS indem_per_grp,
       count(*) AS n_rows,
       count(CASE WHEN LossofIncome_cover THEN coalesce(suminsured_lossofinc, 0.0)
                  ELSE suminsured_lossofinc END) AS n_sums,
       count(CASE WHEN LossofIncome_cover THEN coalesce(grossincurred_lossofinc, 0.0)
                  ELSE grossincurred_lossofinc END) AS n_incurred,
       round(sum(suminsured_lossofinc), 2) AS suminsured_lossofinc
FROM claims_clean GROUP BY 1, 2""", ("claims_clean",))
def lossofinc_nulls_second(spark, sf_dir):
    """Second-path rules on the monthly rows: covered rows with a NULL sum or
    incurred amount -> 0 (uncovered rows keep NULLs), uncovered 'LoI_NULL'."""
    df = C.lossofinc_nulls(S.claims_clean(spark, sf_dir), "second")
    return df.groupBy("LossofIncome_cover", "indem_per_grp").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("suminsured_lossofinc").alias("n_sums"),
        F.count("grossincurred_lossofinc").alias("n_incurred"),
        F.round(F.sum("suminsured_lossofinc"), 2).alias("suminsured_lossofinc"))


@register("with_sum_insured", """
SELECT 'prop' AS line, count(*) AS n_rows FROM policy_claims WHERE suminsured_prop > 0
UNION ALL
SELECT 'loi', count(*) FROM policy_claims WHERE suminsured_prop > 0 AND suminsured_lossofinc > 0
UNION ALL
SELECT 'nonzero', count(*) FROM policy_claims WHERE suminsured_prop <> 0""", ("policy_claims",))
def with_sum_insured(spark, sf_dir):
    """Sum-insured row filters per cover line."""
    pc = S.policy_claims(spark, sf_dir)
    parts = [C.with_sum_insured(pc, ln).select(F.lit(ln).alias("line"), F.lit(1).alias("_o"))
             for ln in ("prop", "loi", "nonzero")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("line").agg(F.count(F.lit(1)).alias("n_rows"))


@register("split_by_cover_loi", f"""
SELECT {_PC_SQL_SELECT}, claimcount_lossofinc > 0 AS has_claim FROM policy_claims
WHERE suminsured_prop > 0 AND suminsured_lossofinc > 0""", ("policy_claims",))
def split_by_cover_loi(spark, sf_dir):
    """Loss-of-income view: both sums > 0, has_claim flag."""
    return _pc_rounded(C.split_by_cover(S.policy_claims(spark, sf_dir), True))


@register("split_by_cover_prop", """
SELECT * EXCLUDE (exposure, date_weights, grossincurred_prop, grossincurred_lossofinc,
                  suminsured_lossofinc, claimcount_lossofinc, LossofIncome_cover, indem_per_grp),
       round(exposure, 6) AS exposure, round(date_weights, 9) AS date_weights,
       round(grossincurred_prop, 6) AS grossincurred_prop, claimcount_prop > 0 AS has_claim
FROM policy_claims WHERE suminsured_prop > 0""", ("policy_claims",))
def split_by_cover_prop(spark, sf_dir):
    """Property view: loss-of-income columns dropped by name, sum > 0."""
    df = C.split_by_cover(S.policy_claims(spark, sf_dir), False)
    return _round(_round(df, ["exposure", "grossincurred_prop"]), ["date_weights"], 9)


@register("recency_weight", """
SELECT DISTINCT start,
       round(pow(0.9996, date_diff('day', start, (SELECT max(start) FROM claims_encoded))), 12)
         AS date_weights
FROM claims_encoded""", ("claims_encoded",))
def recency_weight(spark, sf_dir):
    """0.9996 ** days since the latest month, per month."""
    df = C.recency_weight(S.claims_encoded(spark, sf_dir), "start", S.WEIGHT_BASE_MAIN)
    return df.select("start", F.round("date_weights", 12).alias("date_weights")).distinct()


_BASES = [0.99, 0.999, 0.9992, 0.9994, 0.9996, 0.9998]


@register("weight_curves", f"""
SELECT CAST(b.base AS DOUBLE) AS base, CAST(d.days AS INTEGER) AS days,
       round(pow(CAST(b.base AS DOUBLE), d.days), 12) AS value
FROM (SELECT unnest([{", ".join(str(b) for b in _BASES)}]) AS base) b,
     (SELECT unnest(generate_series(0, (SELECT date_diff('day', min(start), max(start))
                                        FROM claims_encoded))) AS days) d""",
          ("claims_encoded",))
def weight_curves(spark, sf_dir):
    """Candidate recency curves base ** day over the data's day range."""
    df = C.weight_curves(S.claims_encoded(spark, sf_dir), _BASES)
    return df.withColumn("value", F.round("value", 12))


@register("weighted_exposure", """
SELECT policyno, situation_num, ym, xm, epy,
       round(epy * pow(0.9996, date_diff('day', start, (SELECT max(start) FROM claims_encoded))), 12)
         AS exposure
FROM claims_encoded""", ("claims_encoded",))
def weighted_exposure(spark, sf_dir):
    """exposure = epy * recency weight per monthly row."""
    df = S.policy_claims_monthly(spark, sf_dir)
    return df.select("policyno", "situation_num", "ym", "xm", "epy",
                     F.round("exposure", 12).alias("exposure"))


def _freq_sev_sql():
    parts = []
    for ln in ("prop", "lossofinc"):
        n, a = f"claimcount_{ln}", f"grossincurred_{ln}"
        parts += [
            f"round(coalesce({n} / nullif(exposure, 0), 0.0), 9) AS freq_{ln}",
            f"round(coalesce({a} / nullif({n}, 0), 0.0), 9) AS sev_{ln}",
            f"round(ln(nullif({a}, 0.0)), 9) AS log_incurred_{ln}",
            f"round(ln({a} / nullif({n}, 0)), 9) AS log_severity_{ln}",
        ]
    return ("SELECT policyno, situation_num, policy_version, " + ", ".join(parts)
            + " FROM policy_claims")


@register("freq_sev", _freq_sev_sql(), ("policy_claims",))
def freq_sev(spark, sf_dir):
    """Frequency, severity and log amounts per policy version."""
    cols = E.freq_sev_cols()
    df = S.policy_claims(spark, sf_dir).select(
        "policyno", "situation_num", "policy_version", *[v.alias(k) for k, v in cols.items()])
    return _round(df, list(cols), 9)


@register("cancelled_flag", """
SELECT ym, date_diff('day', make_date(ym, xm, 1), expirydate) > 61 AS cancelled,
       count(*) AS n_rows
FROM claims_monthly GROUP BY ALL""", ("claims_monthly",))
def cancelled_flag(spark, sf_dir):
    """Version ends > 61 days after the row's month start."""
    df = S.claims_monthly(spark, sf_dir)
    return df.groupBy("ym", E.cancelled().alias("cancelled")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("claim_type", """
SELECT CASE WHEN grossincurred_prop > 0 AND coalesce(grossincurred_lossofinc, 0) > 0 THEN 'Both'
            WHEN grossincurred_prop > 0 AND coalesce(grossincurred_lossofinc, 0) = 0 THEN 'Only Prop'
            WHEN grossincurred_prop = 0 AND coalesce(grossincurred_lossofinc, 0) > 0 THEN 'Only BI'
            WHEN grossincurred_prop = 0 AND coalesce(grossincurred_lossofinc, 0) = 0 THEN 'No Claim'
       END AS claim_type, count(*) AS n_rows
FROM policy_claims GROUP BY ALL""", ("policy_claims",))
def claim_type(spark, sf_dir):
    """Both / Only Prop / Only BI / No Claim per policy version."""
    df = S.policy_claims(spark, sf_dir)
    return df.groupBy(E.claim_type().alias("claim_type")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("building_info_na", """
SELECT building_age IS NULL AS building_info_na, count(*) AS n_rows
FROM claims_geo GROUP BY ALL""", ("claims_geo",))
def building_info_na(spark, sf_dir):
    """Missing-building flag kept as a feature."""
    df = S.claims_geo(spark, sf_dir)
    return df.groupBy(E.building_info_na().alias("building_info_na")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@register("occupation_prefix", """
SELECT DISTINCT occupation, substr(occupation, 1, 1) AS occupation_letter,
       substr(occupation, 1, 1) || '_General' AS occupation_general
FROM claims_geo""", ("claims_geo",))
def occupation_prefix(spark, sf_dir):
    """First letter of the occupation and its '<letter>_General' group."""
    df = S.claims_geo(spark, sf_dir)
    return df.select("occupation", E.occupation_prefix("occupation").alias("occupation_letter"),
                     E.occupation_prefix("occupation", True).alias("occupation_general")).distinct()


@register("column_ops", """
SELECT policyno, situation_num, policy_version, geo_code,
       round(grossincurred_prop, 6) AS incurred_prop, claimcount_prop AS claims_prop
FROM policy_claims""", ("policy_claims",))
def column_ops(spark, sf_dir):
    """Select / rename / reorder columns of the policy table."""
    df = S.policy_claims(spark, sf_dir)
    df = (df.withColumnRenamed("grossincurred_prop", "incurred_prop")
          .withColumnRenamed("claimcount_prop", "claims_prop"))
    return df.select("policyno", "situation_num", "policy_version", "geo_code",
                     F.round("incurred_prop", 6).alias("incurred_prop"), "claims_prop")


# --- data-quality gates -----------------------------------------------------

_GEO_COLS = ["policyno", "situation_num", "effectdate", "expirydate", "ym", "xm", "start", "epy",
             "LossofIncome_cover", "suminsured_prop", "suminsured_lossofinc",
             "grossincurred_prop", "grossincurred_lossofinc", "riskpostcode", "state",
             "building_age", "building_type", "construction_walls", "construction_floor",
             "sprinkler_type", "occupation", "indem_per_grp", "sa3name", "sa4name",
             "electoraterating"]


def _null_union(src, cols, where="TRUE", label=None):
    lab = "" if label is None else f"'{label}' AS rule, "
    return " UNION ALL ".join(
        f"SELECT {lab}'{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL AND ({where})) AS bad_rows FROM {src}"
        for c in cols)


@register("null_audit", _null_union("claims_geo", _GEO_COLS), ("claims_geo",))
def null_audit(spark, sf_dir):
    """NULL count of every column in one pass (no-NULL gate's audit)."""
    return Q.null_audit(S.claims_geo(spark, sf_dir), _GEO_COLS)


_ALLOWED = ["suminsured_lossofinc", "grossincurred_lossofinc", "indem_per_grp"]
_CLEAN_COLS = [c for c in _GEO_COLS if c not in ("sa3name", "sa4name", "electoraterating",
                                                 "LossofIncome_cover")]


@register("conditional_null_audit", " UNION ALL ".join([
    _null_union("claims_clean", _CLEAN_COLS, "LossofIncome_cover", "covered"),
    _null_union("claims_clean", [c for c in _CLEAN_COLS if c not in _ALLOWED],
                "NOT LossofIncome_cover", "uncovered"),
    "SELECT 'cover_null', 'LossofIncome_cover', count(*) FILTER (WHERE LossofIncome_cover IS NULL) FROM claims_clean",
]), ("claims_clean",))
def conditional_null_audit(spark, sf_dir):
    """Covered rows: no NULL; uncovered: NULL only in the BI columns."""
    return Q.conditional_null_audit(S.claims_clean(spark, sf_dir), _ALLOWED)


@register("join_loss_audit", """
SELECT (SELECT count(*) FROM claims_clean) AS rows_before,
       (SELECT count(*) FROM claims_geo) AS rows_after,
       (SELECT count(*) FROM claims_clean WHERE riskpostcode NOT IN (SELECT postcode FROM pc_dim2))
         AS rows_unknown,
       abs((SELECT count(*) FROM claims_clean) - (SELECT count(*) FROM claims_geo)
           - (SELECT count(*) FROM claims_clean
              WHERE riskpostcode NOT IN (SELECT postcode FROM pc_dim2))) AS bad_rows""",
          ("claims_clean", "claims_geo", "pc_dim2"))
def join_loss_audit(spark, sf_dir):
    """Rows lost by the postcode join == rows with an unknown postcode."""
    return Q.join_loss_audit(S.claims_clean(spark, sf_dir), S.claims_geo(spark, sf_dir),
                             S.postcode_dimension(spark, sf_dir))


_MAPS = {"construction_walls": {"Brand#1": "Other", "Polystyrene": "Other"},
         "occupation": {"HOUSEHOLD_Brand#1": "H_General", "Unknown": "Unknown"}}


@register("mapping_audit", """
SELECT m."column", m.key FROM (VALUES ('construction_walls', 'Brand#1'),
                                    ('construction_walls', 'Polystyrene'),
                                    ('occupation', 'HOUSEHOLD_Brand#1'),
                                    ('occupation', 'Unknown')) m("column", key)
WHERE NOT EXISTS (SELECT 1 FROM claims_geo g WHERE
   (m."column" = 'construction_walls' AND g.construction_walls = m.key) OR
   (m."column" = 'occupation' AND g.occupation = m.key))""", ("claims_geo",))
def mapping_audit(spark, sf_dir):
    """Recode keys that are not existing levels of their column."""
    return Q.mapping_audit(S.claims_geo(spark, sf_dir), _MAPS)


_NA7 = ["building_age", "building_type", "construction_floor", "construction_walls",
        "grossincurred_lossofinc", "indem_per_grp", "suminsured_lossofinc"]


@register("missing_patterns", "SELECT " + ", ".join(f"{c} IS NULL AS na_{c}" for c in _NA7)
          + ", count(*) AS n_rows FROM claims_clean GROUP BY ALL", ("claims_clean",))
def missing_patterns(spark, sf_dir):
    """Rows per combination of NULL columns (up to 7 columns)."""
    return Q.missing_patterns(S.claims_clean(spark, sf_dir), n=7)


@register("dimension_audit", """
SELECT postcode, state, bool_or(sa3name IS NOT NULL) AS has_sa3,
       bool_or(sa4name IS NOT NULL) AS has_sa4,
       bool_or(electoraterating IS NOT NULL) AS has_rating, count(*) AS n_rows
FROM postcodes GROUP BY postcode, state""", ("postcodes",))
def dimension_audit(spark, sf_dir):
    """Per (postcode, state): any SA3 / SA4 / rating present."""
    from exposa.operators.postcode import dimension_audit as audit
    return audit(S.postcodes(spark, sf_dir))
