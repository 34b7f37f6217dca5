"""Registered queries: joins, aggregations, windows, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposa.functions import expr as E
from exposa.operators import consolidate as C
from exposa.operators import eda as D
from exposa.operators import grouping as GR
from exposa.operators import postcode as P
from exposa.operators import rating as R
from exposa.operators import windows as W
from exposa.plans import stages as S
from exposa.plans.oracle_ctes import representative_sql
from exposa.plans.registry import register
from exposa.sources.schema import DETAIL_COLS, VERSION_KEYS

_KEYS = "policyno, situation_num, effectdate, expirydate"


def _round(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


def _rsql(cols, d=6):
    return ", ".join(f"round({c}, {d}) AS {c}" for c in cols)


# --- joins -------------------------------------------------------------------

@register("attach_geo_codes", """
SELECT e.geo_code, count(*) AS n_rows, round(sum(g.epy), 6) AS exposure
FROM claims_geo g JOIN (SELECT DISTINCT state, riskpostcode, geo_code FROM enc_geo) e
  ON e.riskpostcode = g.riskpostcode AND e.state = g.state
GROUP BY e.geo_code""", ("claims_geo", "enc_geo"))
def attach_geo_codes(spark, sf_dir):
    """Inner join of monthly rows to their geo code on (postcode, state)."""
    geo = S.claims_geo(spark, sf_dir)
    gm = S.encodings(geo)["geo_code"]
    j = geo.join(gm.select("state", "riskpostcode", "geo_code").distinct(),
                 ["riskpostcode", "state"])
    return j.groupBy("geo_code").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.round(F.sum("epy"), 6).alias("exposure"))


_CONS_ROUND = ["exposure", "grossincurred_prop", "grossincurred_lossofinc"]


@register("attach_details", f"""
SELECT c.* EXCLUDE (exposure, date_weights, grossincurred_prop, grossincurred_lossofinc),
       1 AS one,
       round(c.exposure, 6) AS exposure, round(c.date_weights, 9) AS date_weights,
       round(c.grossincurred_prop, 6) AS grossincurred_prop,
       round(c.grossincurred_lossofinc, 6) AS grossincurred_lossofinc,
       {", ".join("d." + x for x in DETAIL_COLS)}
FROM std_consolidated c LEFT JOIN std_details d USING ({_KEYS})""",
          ("std_consolidated", "std_details"))
def attach_details(spark, sf_dir):
    """Consolidated versions left-joined to their representative details."""
    rf = S.claims_encoded(spark, sf_dir)
    cons = C.consolidate(C.recency_weight(rf, "start", S.WEIGHT_BASE_MAIN))
    j = cons.join(C.representative(rf, DETAIL_COLS), VERSION_KEYS, "left")
    return _round(_round(j, _CONS_ROUND), ["date_weights"], 9).withColumn("one", F.lit(1))


@register("postcode_dim", "SELECT * FROM pc_dim", ("pc_dim",))
def postcode_dim(spark, sf_dir):
    """Postcode dimension: restricted, patched, one SA3 / SA4 per pair,
    electorate rating imputed from SA3 then SA4 modes."""
    return P.postcode_dim(S.postcodes(spark, sf_dir), S.claims_clean(spark, sf_dir))


@register("unmatched_dim_pairs", """
SELECT d.* FROM pc_dim d WHERE NOT EXISTS (
  SELECT 1 FROM claims_clean c WHERE c.riskpostcode = d.postcode AND c.state = d.state)""",
          ("pc_dim", "claims_clean"))
def unmatched_dim_pairs(spark, sf_dir):
    """Dimension pairs with no claim (left anti join)."""
    cc = S.claims_clean(spark, sf_dir)
    dim = P.postcode_dim(S.postcodes(spark, sf_dir), cc)
    pairs = cc.select(F.col("riskpostcode").alias("postcode"), "state").distinct()
    return P.unmatched(dim, pairs, ["postcode", "state"])


@register("restrict_postcodes", """
SELECT * FROM postcodes WHERE postcode IN (SELECT riskpostcode FROM claims_clean)""",
          ("postcodes", "claims_clean"))
def restrict_postcodes(spark, sf_dir):
    """Dimension rows whose postcode is in use (left semi join)."""
    cc = S.claims_clean(spark, sf_dir).select(F.col("riskpostcode").alias("postcode"))
    return P.restrict_to(S.postcodes(spark, sf_dir), cc, "postcode")


@register("reconcile_state", "SELECT * FROM pc_dim2", ("pc_dim2",))
def reconcile_state(spark, sf_dir):
    """Dimension after state reconciliation with the claims."""
    return S.postcode_dimension(spark, sf_dir)


@register("small_member_groups", """
SELECT state, sa4name, sa3name, riskpostcode, round(w, 6) AS exposure FROM (
  SELECT *, min(w) OVER (PARTITION BY state, sa4name, sa3name) AS mw
  FROM (SELECT state, sa4name, sa3name, riskpostcode, sum(epy) AS w FROM claims_geo
        GROUP BY ALL)) WHERE mw < 30""", ("claims_geo",))
def small_member_groups(spark, sf_dir):
    """All postcodes of an SA3 that has a member below 30 exposure
    (window min over the group instead of a self join)."""
    from pyspark.sql import Window
    pe = S.claims_geo(spark, sf_dir).groupBy("state", "sa4name", "sa3name", "riskpostcode").agg(
        F.sum("epy").alias("w"))
    mw = F.min("w").over(Window.partitionBy("state", "sa4name", "sa3name"))
    return pe.withColumn("mw", mw).filter(F.col("mw") < S.POSTCODE_THRESHOLD).select(
        "state", "sa4name", "sa3name", "riskpostcode", F.round("w", 6).alias("exposure"))


# --- aggregations --------------------------------------------------------------

@register("consolidate", f"""
SELECT * EXCLUDE (exposure, date_weights, grossincurred_prop, grossincurred_lossofinc),
       round(exposure, 6) AS exposure, round(date_weights, 9) AS date_weights,
       round(grossincurred_prop, 6) AS grossincurred_prop,
       round(grossincurred_lossofinc, 6) AS grossincurred_lossofinc
FROM std_consolidated""", ("std_consolidated",))
def consolidate(spark, sf_dir):
    """Monthly rows to policy versions: sums, mean weight, claim counts,
    any cover."""
    rf = S.claims_encoded(spark, sf_dir)
    cons = C.consolidate(C.recency_weight(rf, "start", S.WEIGHT_BASE_MAIN))
    return _round(_round(cons, _CONS_ROUND), ["date_weights"], 9)


_SIT_COLS = ["expirydate", "riskpostcode", "state", "building_type", "sprinkler_type", "occupation"]


@register("situation_history", f"""
WITH h AS (
  SELECT policyno, situation_num,
         count(*) FILTER (WHERE grossincurred_lossofinc > 0) AS n_claims_lossofinc,
         coalesce(sum(grossincurred_lossofinc), 0.0) AS total_grossincurred_lossofinc,
         median(suminsured_lossofinc) AS median_SI_lossofinc,
         count(*) FILTER (WHERE grossincurred_prop > 0) AS n_claims_prop,
         coalesce(sum(grossincurred_prop), 0.0) AS total_grossincurred_prop,
         median(suminsured_prop) AS median_SI_prop
  FROM claims_clean GROUP BY policyno, situation_num),
a AS (SELECT policyno, situation_num, bool_or(LossofIncome_cover) AS LossofIncome_cover,
             min(effectdate) AS effectdate FROM claims_clean GROUP BY policyno, situation_num),
l AS (SELECT policyno, situation_num, {", ".join(_SIT_COLS)} FROM (
        SELECT *, row_number() OVER (PARTITION BY policyno, situation_num
          ORDER BY effectdate DESC, expirydate DESC, ym DESC, xm DESC,
                   {", ".join(c + " ASC NULLS LAST" for c in _SIT_COLS)}) AS rn
        FROM claims_clean) WHERE rn = 1)
SELECT h.policyno, h.situation_num, n_claims_lossofinc, n_claims_prop,
       round(total_grossincurred_lossofinc, 6) AS total_grossincurred_lossofinc,
       round(total_grossincurred_prop, 6) AS total_grossincurred_prop,
       round(median_SI_lossofinc, 6) AS median_SI_lossofinc,
       round(median_SI_prop, 6) AS median_SI_prop,
       round(total_grossincurred_lossofinc / nullif(n_claims_lossofinc, 0), 6) AS avgincurred_lossofinc,
       round(total_grossincurred_prop / nullif(n_claims_prop, 0), 6) AS avgincurred_prop,
       a.LossofIncome_cover, a.effectdate, {", ".join("l." + c for c in _SIT_COLS)}
FROM h LEFT JOIN a USING (policyno, situation_num) LEFT JOIN l USING (policyno, situation_num)""",
          ("claims_clean",))
def situation_history(spark, sf_dir):
    """Claim history per situation with its latest details."""
    h = D.situation_history(S.claims_clean(spark, sf_dir))
    return _round(h, [c for c in h.columns if c.startswith(("total_", "median_", "avgincurred_"))])


@register("exposure_by_occupation", """
SELECT occupation, round(sum(epy), 6) AS exposure FROM claims_geo GROUP BY occupation""",
          ("claims_geo",))
def exposure_by_occupation(spark, sf_dir):
    """Sum of exposure per occupation level."""
    t = GR.exposure_by(S.claims_geo(spark, sf_dir), "occupation")
    return t.withColumn("exposure", F.round("exposure", 6))


@register("top_severity_occupation", """
SELECT occupation, round(avg(grossincurred_prop), 6) AS mean_amount, count(*) AS n_claims
FROM claims_geo WHERE grossincurred_prop > 0 GROUP BY occupation
ORDER BY avg(grossincurred_prop) DESC, occupation LIMIT 2""", ("claims_geo",))
def top_severity_occupation(spark, sf_dir):
    """Two occupations with the highest mean property claim (top-k)."""
    t = GR.top_severity(S.claims_geo(spark, sf_dir), "occupation", "grossincurred_prop", 2)
    return t.withColumn("mean_amount", F.round("mean_amount", 6))


_FACTORS = ["building_age", "building_type", "construction_walls", "construction_floor",
            "sprinkler_type"]


@register("factor_experience", " UNION ALL ".join(f"""
SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS level, count(*) AS n_obs,
       round(avg(grossincurred_prop / nullif(claimcount_prop, 0)), 6) AS avg_prop_claim,
       round(avg(grossincurred_lossofinc / nullif(claimcount_lossofinc, 0)), 6) AS avg_lossofinc_claim,
       round(avg(claimcount_prop), 6) AS avg_prop_no,
       round(avg(claimcount_lossofinc), 6) AS avg_lossofinc_no
FROM policy_claims GROUP BY {f}""" for f in _FACTORS), ("policy_claims",))
def factor_experience(spark, sf_dir):
    """Claim experience by building factor, all factors in one scan."""
    t = D.factor_experience(S.policy_claims(spark, sf_dir), _FACTORS)
    return _round(t, ["avg_prop_claim", "avg_lossofinc_claim", "avg_prop_no", "avg_lossofinc_no"])


_LOC_SQL = """
SELECT p.*, l.riskpostcode, s.sa4name, s.sa4, s.Lat_precise, s.Long_precise
FROM policy_claims p
LEFT JOIN (SELECT policyno, situation_num, riskpostcode FROM (
             SELECT policyno, situation_num, riskpostcode,
                    row_number() OVER (PARTITION BY policyno, situation_num
                      ORDER BY ym DESC, xm DESC, CAST(riskpostcode AS INTEGER) DESC,
                               riskpostcode ASC NULLS LAST) AS rn
             FROM claims_encoded) WHERE rn = 1) l USING (policyno, situation_num)
LEFT JOIN (SELECT postcode, sa4name, sa4, Lat_precise, Long_precise FROM (
             SELECT *, row_number() OVER (PARTITION BY postcode
               ORDER BY sa4name ASC NULLS LAST, sa4 ASC NULLS LAST,
                        Lat_precise ASC NULLS LAST, Long_precise ASC NULLS LAST) AS rn
             FROM postcodes) WHERE rn = 1) s ON s.postcode = l.riskpostcode"""

_AREA_AGG = """count(*) AS n_policies,
       round(CASE WHEN count(Lat_precise) = count(*) THEN avg(Lat_precise) END, 6) AS lat,
       round(CASE WHEN count(Long_precise) = count(*) THEN avg(Long_precise) END, 6) AS long,
       sum(CAST(round(suminsured_prop * 100) AS BIGINT)) / count(suminsured_prop) / 100.0
         AS mean_prop_SI,
       sum(CAST(round(suminsured_lossofinc * 100) AS BIGINT)) / count(suminsured_lossofinc) / 100.0
         AS mean_lossofinc_SI,
       round(avg(ln(nullif(grossincurred_prop, 0))), 6) AS mean_prop_grossincurred,
       round(avg(ln(nullif(grossincurred_lossofinc, 0))), 6) AS mean_lossofinc_grossincurred,
       round(avg(claimcount_prop), 6) AS mean_prop_claims,
       round(avg(claimcount_lossofinc), 6) AS mean_lossofinc_claims"""
_AREA_OUT = ["lat", "long", "mean_prop_grossincurred",
             "mean_lossofinc_grossincurred", "mean_prop_claims", "mean_lossofinc_claims"]


def _area(spark, sf_dir, level):
    loc = D.policy_locations(S.policy_claims(spark, sf_dir), S.claims_encoded(spark, sf_dir),
                             S.postcodes(spark, sf_dir))
    return _round(D.area_summary(loc, level), _AREA_OUT)


for _name, _lvl in (("area_summary_state", ["state"]), ("area_summary_sa4", ["sa4name", "sa4"]),
                    ("area_summary_postcode", ["riskpostcode"])):
    register(_name, f"SELECT {', '.join(_lvl)}, {_AREA_AGG} FROM ({_LOC_SQL}) GROUP BY {', '.join(_lvl)}",
             ("policy_claims", "claims_encoded", "postcodes"))(
        (lambda lvl: lambda spark, sf_dir: _area(spark, sf_dir, lvl))(_lvl))


@register("claim_cooccurrence", """
SELECT count(*) FILTER (WHERE grossincurred_prop > 0 AND grossincurred_lossofinc > 0) AS both,
       count(*) FILTER (WHERE grossincurred_prop > 0 AND grossincurred_lossofinc = 0) AS only_prop,
       count(*) FILTER (WHERE grossincurred_prop = 0 AND grossincurred_lossofinc > 0) AS only_lossofinc,
       count(*) FILTER (WHERE grossincurred_prop = 0 AND grossincurred_lossofinc = 0) AS no_claim
FROM claims_encoded""", ("claims_encoded",))
def claim_cooccurrence(spark, sf_dir):
    """Monthly rows with both / only one / no claim (NULL never counts)."""
    return D.claim_cooccurrence(S.claims_encoded(spark, sf_dir))


# --- windows -----------------------------------------------------------------

@register("representative_details", "SELECT * FROM std_details", ("std_details",))
def representative_details(spark, sf_dir):
    """Most frequent detail combination per version (ties: latest month,
    then smallest values)."""
    return C.representative(S.claims_encoded(spark, sf_dir), DETAIL_COLS)


@register("representative_sums_literal", "SELECT * FROM std_sums", ("std_sums",))
def representative_sums_literal(spark, sf_dir):
    """Sums insured per version, the study's literal rule."""
    return C.representative_sums(S.claims_encoded(spark, sf_dir), mode="literal")


@register("representative_sums_by_cover", f"""
WITH p AS ({representative_sql("claims_encoded", ["suminsured_prop"])}),
     b AS ({representative_sql("(SELECT * FROM claims_encoded WHERE LossofIncome_cover)",
                               ["suminsured_lossofinc", "indem_per_grp"])})
SELECT p.*, b.suminsured_lossofinc, b.indem_per_grp FROM p LEFT JOIN b USING ({_KEYS})""",
          ("claims_encoded",))
def representative_sums_by_cover(spark, sf_dir):
    """Sums insured per version: property mode; BI mode over covered rows."""
    return C.representative_sums(S.claims_encoded(spark, sf_dir), mode="by_cover")


@register("group_stats", f"""
SELECT {_KEYS}, count(*) AS row_count, max(n) AS max_n FROM (
  SELECT {_KEYS}, {", ".join(DETAIL_COLS)}, count(*) AS n FROM claims_encoded GROUP BY ALL)
GROUP BY ALL""", ("claims_encoded",))
def group_stats(spark, sf_dir):
    """Per version: number of detail combinations and the top count."""
    combos = S.claims_encoded(spark, sf_dir).groupBy(*VERSION_KEYS, *DETAIL_COLS).agg(
        F.count(F.lit(1)).alias("n"))
    return W.with_group_stats(combos, VERSION_KEYS).select(
        *VERSION_KEYS, "row_count", "max_n").distinct()


@register("unique_mode_sa3", "SELECT * FROM pc_m3", ("pc_m3",))
def unique_mode_sa3(spark, sf_dir):
    """Unambiguous most frequent electorate rating per SA3."""
    post = P.restricted_dim(S.postcodes(spark, sf_dir), S.claims_clean(spark, sf_dir))
    return P.unique_mode(post, "sa3name", "electoraterating", "sa3_rating")


@register("unique_mode_sa4", "SELECT * FROM pc_m4", ("pc_m4",))
def unique_mode_sa4(spark, sf_dir):
    """Unambiguous most frequent electorate rating per SA4."""
    post = P.restricted_dim(S.postcodes(spark, sf_dir), S.claims_clean(spark, sf_dir))
    return P.unique_mode(post, "sa4name", "electoraterating", "sa4_rating")


@register("policy_version", """
SELECT policyno, situation_num, policy_version, round(exposure, 6) AS exposure
FROM policy_claims_hasna""", ("policy_claims_hasna",))
def policy_version(spark, sf_dir):
    """dense_rank of (effectdate, expirydate) inside each situation."""
    rf = S.claims_encoded(spark, sf_dir)
    cons = C.policy_version(C.consolidate(C.recency_weight(rf, "start", S.WEIGHT_BASE_MAIN)))
    return cons.select("policyno", "situation_num", "policy_version",
                       F.round("exposure", 6).alias("exposure"))


@register("latest_situation", f"""
SELECT a.*, {", ".join("l." + c for c in _SIT_COLS)}
FROM (SELECT policyno, situation_num, bool_or(LossofIncome_cover) AS LossofIncome_cover,
             min(effectdate) AS effectdate FROM claims_clean GROUP BY ALL) a
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policyno, situation_num
        ORDER BY effectdate DESC, expirydate DESC, ym DESC, xm DESC,
                 {", ".join(c + " ASC NULLS LAST" for c in _SIT_COLS)}) AS rn
      FROM claims_clean) WHERE rn = 1) l USING (policyno, situation_num)""", ("claims_clean",))
def latest_situation(spark, sf_dir):
    """Per situation: any cover, earliest start, latest row's details."""
    return D.latest_situation(S.claims_clean(spark, sf_dir))


@register("last_row_postcode", """
SELECT policyno, situation_num, riskpostcode FROM (
  SELECT policyno, situation_num, riskpostcode,
         row_number() OVER (PARTITION BY policyno, situation_num
           ORDER BY ym DESC, xm DESC, CAST(riskpostcode AS INTEGER) DESC) AS rn
  FROM claims_encoded) WHERE rn = 1""", ("claims_encoded",))
def last_row_postcode(spark, sf_dir):
    """Last postcode of each situation in (ym, xm, postcode) order."""
    df = S.claims_encoded(spark, sf_dir).withColumn("_pc", F.col("riskpostcode").cast("int"))
    return W.last_row(df, ["policyno", "situation_num"], ["ym", "xm", "_pc"], ["riskpostcode"])


@register("first_row_sa4", """
SELECT postcode, sa4name, sa4 FROM (
  SELECT postcode, sa4name, sa4, row_number() OVER (PARTITION BY postcode
           ORDER BY sa4name ASC NULLS LAST, sa4 ASC NULLS LAST) AS rn
  FROM postcodes) WHERE rn = 1""", ("postcodes",))
def first_row_sa4(spark, sf_dir):
    """First SA4 per postcode by name, NULLs last."""
    return W.first_row(S.postcodes(spark, sf_dir), ["postcode"], ["sa4name"], ["sa4name", "sa4"])


@register("group_mean_log_incurred", """
SELECT policyno, situation_num, policy_version, occupation_risk,
       round(avg(ln(nullif(grossincurred_prop, 0))) OVER (PARTITION BY occupation_risk), 6)
         AS mean_log_incurred_prop
FROM policy_claims""", ("policy_claims",))
def group_mean_log_incurred(spark, sf_dir):
    """Mean log property incurred of the row's occupation on each row."""
    df = S.policy_claims(spark, sf_dir).withColumn(
        "log_incurred_prop", F.log(F.nullif(F.col("grossincurred_prop"), F.lit(0.0))))
    out = W.with_group_mean(df, "occupation_risk", "log_incurred_prop", "mean_log_incurred_prop")
    return out.select("policyno", "situation_num", "policy_version", "occupation_risk",
                      F.round("mean_log_incurred_prop", 6).alias("mean_log_incurred_prop"))


@register("occupation_map", "SELECT * FROM enc_occupation", ("enc_occupation",))
def occupation_map(spark, sf_dir):
    """Occupation grouping: top 10 kept, '<letter>_General', top 15, Other."""
    return GR.occupation_map(S.claims_geo(spark, sf_dir))


# --- sorts, limits, distinct -------------------------------------------------

def _top_claims_sql(col, k):
    return f"""
SELECT policyno, situation_num, ym, xm, {col} FROM claims_clean
ORDER BY {col} DESC NULLS LAST, policyno, situation_num, ym, xm LIMIT {k}"""


def _top_claims(spark, sf_dir, col, k):
    df = S.claims_clean(spark, sf_dir).select("policyno", "situation_num", "ym", "xm", col)
    return df.orderBy(F.col(col).desc_nulls_last(), "policyno", "situation_num", "ym", "xm").limit(k)


register("top_claims_prop", _top_claims_sql("grossincurred_prop", 30), ("claims_clean",))(
    lambda spark, sf_dir: _top_claims(spark, sf_dir, "grossincurred_prop", 30))
register("top_claims_lossofinc", _top_claims_sql("grossincurred_lossofinc", 20), ("claims_clean",))(
    lambda spark, sf_dir: _top_claims(spark, sf_dir, "grossincurred_lossofinc", 20))


@register("distinct_by_version", f"""
SELECT {_KEYS}, ym, xm, riskpostcode, state FROM (
  SELECT *, row_number() OVER (PARTITION BY {_KEYS}
    ORDER BY ym, xm, riskpostcode ASC NULLS LAST, state ASC NULLS LAST) AS rn
  FROM claims_clean) WHERE rn = 1""", ("claims_clean",))
def distinct_by_version(spark, sf_dir):
    """First month row per version with its columns kept (deterministic)."""
    return W.pick_row(S.claims_clean(spark, sf_dir), VERSION_KEYS, [("ym", "asc"), ("xm", "asc")],
                      ["ym", "xm", "riskpostcode", "state"])


@register("hot_levels", """
SELECT * FROM (
  SELECT occupation_risk, CAST(sum(claimcount_prop) AS DOUBLE) AS nclaims,
         round(sum(exposure), 6) AS exposure, CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) AS amount,
         round(sum(claimcount_prop) / nullif(sum(exposure), 0), 6) AS frequency,
         CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) / nullif(sum(claimcount_prop), 0) AS average_severity,
         round(CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) / nullif(sum(exposure), 0), 6) AS risk_premium
  FROM policy_claims GROUP BY occupation_risk)
WHERE average_severity > 3000 AND exposure > 5""", ("policy_claims",))
def hot_levels(spark, sf_dir):
    """Occupations with mean severity above 3000 and exposure above 5."""
    t = R.univariate(S.policy_claims(spark, sf_dir), "occupation_risk", "claimcount_prop",
                     "exposure", severity="grossincurred_prop")
    t = _round(t, ["exposure", "frequency", "risk_premium"])
    return R.hot_levels(t, "occupation_risk", "average_severity", 3000.0, 5.0)
