"""Registered queries: exploratory statistics, rating tables, sampling,
feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposa.functions import expr as E
from exposa.operators import consolidate as C
from exposa.operators import eda as D
from exposa.operators import gates as Q
from exposa.operators import grouping as GR
from exposa.operators import prep as PR
from exposa.operators import rating as R
from exposa.operators import sampling as SM
from exposa.plans import stages as S
from exposa.plans.q_geo import _KEY, _SPLIT_KEY, _split_sql
from exposa.plans.registry import register


def _round(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


_FS = ["freq_prop", "freq_lossofinc", "sev_prop", "sev_lossofinc"]
_FS_SQL = """(SELECT *, coalesce(claimcount_prop / nullif(exposure, 0), 0.0) AS freq_prop,
       coalesce(claimcount_lossofinc / nullif(exposure, 0), 0.0) AS freq_lossofinc,
       coalesce(grossincurred_prop / nullif(claimcount_prop, 0), 0.0) AS sev_prop,
       coalesce(grossincurred_lossofinc / nullif(claimcount_lossofinc, 0), 0.0) AS sev_lossofinc
FROM policy_claims)"""


def _fs(spark, sf_dir):
    cols = E.freq_sev_cols()
    return S.policy_claims(spark, sf_dir).withColumns({c: cols[c] for c in _FS})


@register("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 9) AS corr FROM {_FS_SQL}"
    for i, a in enumerate(_FS) for b in _FS[:i]), ("policy_claims",))
def corr_matrix(spark, sf_dir):
    """Pearson correlations of frequency / severity, lower triangle."""
    return D.corr_matrix(_fs(spark, sf_dir), _FS).withColumn("corr", F.round("corr", 9))


@register("linear_trend_cost", """
SELECT LossofIncome_cover, round(regr_slope(y, x), 9) AS slope,
       round(regr_intercept(y, x), 9) AS intercept, round(regr_r2(y, x), 9) AS r2,
       CAST(regr_count(y, x) AS BIGINT) AS n
FROM (SELECT LossofIncome_cover, ln(grossincurred_prop) AS y, ln(suminsured_prop) AS x
      FROM policy_claims WHERE grossincurred_prop > 0) GROUP BY LossofIncome_cover""",
          ("policy_claims",))
def linear_trend_cost(spark, sf_dir):
    """Slope of log property cost on log sum insured, by BI cover."""
    df = S.policy_claims(spark, sf_dir).filter(F.col("grossincurred_prop") > 0).select(
        "LossofIncome_cover", F.log("grossincurred_prop").alias("y"),
        F.log("suminsured_prop").alias("x"))
    return _round(D.linear_trend(df, "x", "y", ["LossofIncome_cover"]),
                  ["slope", "intercept", "r2"], 9)


@register("linear_trend_bi_on_prop", """
SELECT round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept,
       round(regr_r2(y, x), 9) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n
FROM (SELECT ln(grossincurred_lossofinc / claimcount_lossofinc) AS y,
             ln(grossincurred_prop / claimcount_prop) AS x
      FROM policy_claims WHERE grossincurred_prop > 0 AND grossincurred_lossofinc > 0)""",
          ("policy_claims",))
def linear_trend_bi_on_prop(spark, sf_dir):
    """Mean log BI claim cost on mean log property cost (both claims)."""
    df = S.policy_claims(spark, sf_dir).filter(
        (F.col("grossincurred_prop") > 0) & (F.col("grossincurred_lossofinc") > 0)).select(
        F.log(F.col("grossincurred_lossofinc") / F.col("claimcount_lossofinc")).alias("y"),
        F.log(F.col("grossincurred_prop") / F.col("claimcount_prop")).alias("x"))
    return _round(D.linear_trend(df, "x", "y"), ["slope", "intercept", "r2"], 9)


_BOX_COLS = ["min", "q1", "median", "q3", "max", "lower_fence", "upper_fence", "whisker_low",
             "whisker_high"]


@register("box_stats_occupation", """
WITH d AS (SELECT occupation_risk, ln(grossincurred_prop) AS x FROM policy_claims
           WHERE grossincurred_prop > 0),
s AS (SELECT occupation_risk, min(x) AS min, quantile_cont(x, 0.25) AS q1,
             quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max,
             count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM s)
SELECT f.occupation_risk, round(f.min, 9) AS min, round(f.q1, 9) AS q1,
       round(f.median, 9) AS median, round(f.q3, 9) AS q3, round(f.max, 9) AS max, f.n,
       round(f.lower_fence, 9) AS lower_fence, round(f.upper_fence, 9) AS upper_fence,
       count(*) FILTER (WHERE d.x < f.lower_fence) AS n_low_outliers,
       count(*) FILTER (WHERE d.x > f.upper_fence) AS n_high_outliers,
       round(min(CASE WHEN d.x >= f.lower_fence THEN d.x END), 9) AS whisker_low,
       round(max(CASE WHEN d.x <= f.upper_fence THEN d.x END), 9) AS whisker_high
FROM f JOIN d USING (occupation_risk)
GROUP BY f.occupation_risk, f.min, f.q1, f.median, f.q3, f.max, f.n, f.lower_fence, f.upper_fence""",
          ("policy_claims",))
def box_stats_occupation(spark, sf_dir):
    """Box-plot numbers of log property cost per occupation group."""
    df = S.policy_claims(spark, sf_dir).filter(F.col("grossincurred_prop") > 0).select(
        "occupation_risk", F.log("grossincurred_prop").alias("x"))
    return _round(D.box_stats(df, ["occupation_risk"], "x"), _BOX_COLS, 9)


@register("median_by_claims", """
SELECT claimcount_prop, round(median(ln(suminsured_prop)), 9) AS median_log_si, count(*) AS n
FROM policy_claims GROUP BY claimcount_prop""", ("policy_claims",))
def median_by_claims(spark, sf_dir):
    """Median log sum insured by number of property claims."""
    df = S.policy_claims(spark, sf_dir).withColumn("log_si", F.log("suminsured_prop"))
    t = D.median_by(df, ["claimcount_prop"], "log_si")
    return t.select("claimcount_prop", F.round("median_log_si", 9).alias("median_log_si"), "n")


_CT_SQL = """CASE WHEN grossincurred_prop > 0 AND coalesce(grossincurred_lossofinc, 0) > 0 THEN 'Both'
            WHEN grossincurred_prop > 0 AND coalesce(grossincurred_lossofinc, 0) = 0 THEN 'Only Prop'
            WHEN grossincurred_prop = 0 AND coalesce(grossincurred_lossofinc, 0) > 0 THEN 'Only BI'
            WHEN grossincurred_prop = 0 AND coalesce(grossincurred_lossofinc, 0) = 0 THEN 'No Claim' END"""


@register("density_claim_type", f"""
WITH d AS (SELECT {_CT_SQL} AS claim_type, ln(grossincurred_prop) AS x
           FROM claims_encoded WHERE grossincurred_prop > 0),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
s AS (SELECT claim_type, count(*) AS n,
             0.9 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34)
               * pow(count(*), -0.2) AS bw
      FROM d GROUP BY ALL),
v AS (SELECT claim_type, x, count(*) AS c FROM d GROUP BY ALL),
g AS (SELECT CAST(unnest(generate_series(0, 31)) AS INTEGER) AS g)
SELECT v.claim_type, g.g, round(b.lo + g.g * (b.hi - b.lo) / 31, 9) AS grid_x,
       round(sum(v.c * exp(-0.5 * pow((b.lo + g.g * (b.hi - b.lo) / 31 - v.x) / s.bw, 2))
                 / (s.bw * sqrt(2 * pi()))) / max(s.n), 9) AS density
FROM v JOIN s USING (claim_type), b, g WHERE s.bw > 0
GROUP BY v.claim_type, g.g, b.lo, b.hi""", ("claims_encoded",))
def density_claim_type(spark, sf_dir):
    """Gaussian density of log property claim size per claim type."""
    df = S.claims_encoded(spark, sf_dir).filter(F.col("grossincurred_prop") > 0).select(
        E.claim_type().alias("claim_type"), F.log("grossincurred_prop").alias("x"))
    t = D.density(df, "claim_type", "x", 32)
    return t.select("claim_type", F.col("g").cast("int").alias("g"),
                    F.round("grid_x", 9).alias("grid_x"), F.round("density", 9).alias("density"))


@register("histbin_amount", """
SELECT CAST(least(floor(least(grossincurred_prop, 20000.0) / 1000.0), 19) AS INTEGER) AS bin,
       count(*) AS n,
       CAST(CAST(least(floor(least(grossincurred_prop, 20000.0) / 1000.0), 19) AS INTEGER) * 1000.0
            AS DOUBLE) AS bin_lo,
       CAST((CAST(least(floor(least(grossincurred_prop, 20000.0) / 1000.0), 19) AS INTEGER) + 1) * 1000.0
            AS DOUBLE) AS bin_hi
FROM claims_encoded WHERE grossincurred_prop > 0 GROUP BY 1""", ("claims_encoded",))
def histbin_amount(spark, sf_dir):
    """Claim sizes in 20 equal bins up to 20,000, the rest in the last bin."""
    df = S.claims_encoded(spark, sf_dir).filter(F.col("grossincurred_prop") > 0)
    return D.histbin(df, "grossincurred_prop", 20000.0, 20)


# --- rating ------------------------------------------------------------------

_UNI_FACTORS = ["geo_code", "occupation_risk", "building_type", "sprinkler_type"]
_UNI_ROUND = ["exposure", "frequency", "risk_premium"]


@register("univariate_all", " UNION ALL ".join(f"""
SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS level,
       CAST(sum(claimcount_prop) AS DOUBLE) AS nclaims, round(sum(exposure), 6) AS exposure,
       CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) AS amount,
       round(sum(claimcount_prop) / nullif(sum(exposure), 0), 6) AS frequency,
       CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) / nullif(sum(claimcount_prop), 0) AS average_severity,
       round(CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) / nullif(sum(exposure), 0), 6) AS risk_premium
FROM policy_claims GROUP BY {f}""" for f in _UNI_FACTORS), ("policy_claims",))
def univariate_all(spark, sf_dir):
    """Univariate risk tables of four factors in one scan (long form)."""
    t = R.univariate_all(S.policy_claims(spark, sf_dir), _UNI_FACTORS, "claimcount_prop",
                         "exposure", severity="grossincurred_prop")
    return _round(t, _UNI_ROUND)


@register("univariate_by_year", """
SELECT building_type, ym, CAST(count(*) FILTER (WHERE grossincurred_prop > 0) AS DOUBLE) AS nclaims,
       round(sum(epy), 6) AS exposure,
       CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) AS amount,
       round(count(*) FILTER (WHERE grossincurred_prop > 0) / nullif(sum(epy), 0), 6) AS frequency,
       CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE)
         / nullif(count(*) FILTER (WHERE grossincurred_prop > 0), 0) AS average_severity,
       round(CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) / nullif(sum(epy), 0), 6)
         AS risk_premium
FROM claims_encoded GROUP BY building_type, ym""", ("claims_encoded",))
def univariate_by_year(spark, sf_dir):
    """Univariate table of building type split by year."""
    df = S.claims_encoded(spark, sf_dir).withColumn(
        "n_claim", (F.col("grossincurred_prop") > 0).cast("int"))
    t = R.univariate(df, "building_type", "n_claim", "epy", severity="grossincurred_prop", by="ym")
    return _round(t, _UNI_ROUND)


@register("overdispersion", """
WITH r AS (SELECT geo_code, sum(claimcount_prop) / sum(exposure) AS rate FROM policy_claims
           GROUP BY geo_code),
m AS (SELECT p.claimcount_prop AS y, p.exposure * r.rate AS mu FROM policy_claims p
      LEFT JOIN r USING (geo_code))
SELECT round(sum(pow(y - mu, 2) / mu), 6) AS chi2, count(*) - (SELECT count(*) FROM r) AS df,
       round(sum(pow(y - mu, 2) / mu) / (count(*) - (SELECT count(*) FROM r)), 9) AS ratio,
       sum(pow(y - mu, 2) / mu) / (count(*) - (SELECT count(*) FROM r)) > 1 AS overdispersed
FROM m WHERE mu > 0""", ("policy_claims",))
def overdispersion(spark, sf_dir):
    """Pearson over-dispersion check of the one-factor (geo code) Poisson
    frequency fit (closed-form fitted means)."""
    pc = S.policy_claims(spark, sf_dir)
    k = pc.select(F.count_distinct("geo_code")).first()[0]
    mu = R.level_rate_predictions(pc, "geo_code", "claimcount_prop", "exposure")
    t = R.check_overdispersion(mu, "claimcount_prop", "mu", k)
    return t.select(F.round("chi2", 6).alias("chi2"), F.col("df").cast("long").alias("df"),
                    F.round("ratio", 9).alias("ratio"), "overdispersed")


@register("pure_premium_one_factor", """
WITH f AS (SELECT geo_code, sum(claimcount_prop) / sum(exposure) AS fr,
                  CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE)
                    / nullif(sum(claimcount_prop), 0) AS sv
           FROM policy_claims GROUP BY geo_code)
SELECT p.policyno, p.situation_num, p.policy_version,
       round(p.exposure * f.fr, 9) AS pred_freq, f.sv AS pred_sev,
       floor(p.exposure * f.fr * f.sv * 1e4 + 0.5) / 1e4 AS pure_premium
FROM policy_claims p JOIN f USING (geo_code)""", ("policy_claims",))
def pure_premium_one_factor(spark, sf_dir):
    """Expected claims x expected severity per version, from one-factor
    (geo code) Poisson and Gamma fits in closed form (level ratios)."""
    pc = S.policy_claims(spark, sf_dir)
    fr = R.level_rate_predictions(pc, "geo_code", "claimcount_prop", "exposure", "pred_freq")
    sv = pc.groupBy("geo_code").agg(
        E.safe_div(E.money_sum("grossincurred_prop"), F.sum("claimcount_prop")).alias("pred_sev"))
    out = R.pure_premium(fr.join(sv, "geo_code"))
    return out.select("policyno", "situation_num", "policy_version",
                      F.round("pred_freq", 9).alias("pred_freq"),
                      "pred_sev",
                      (F.floor(F.col("pure_premium") * 1e4 + 0.5) / 1e4).alias("pure_premium"))


# --- sampling ----------------------------------------------------------------

@register("stratified_split", f"""
SELECT policyno, situation_num, policy_version, LossofIncome_cover, split
FROM ({_split_sql("policy_claims", "LossofIncome_cover", 0.8, 123)})""", ("policy_claims",))
def stratified_split(spark, sf_dir):
    """80/20 split stratified by BI cover, md5-seeded, exact per stratum."""
    pc = S.policy_claims(spark, sf_dir)
    return SM.stratified_split(pc, 0.8, ["LossofIncome_cover"], _KEY, 123).select(
        *_KEY, "LossofIncome_cover", "split")


@register("validation_split", f"""
WITH s1 AS ({_split_sql("policy_claims", "LossofIncome_cover", 0.8, 123)}),
t AS (SELECT * EXCLUDE (split) FROM s1 WHERE split = 'train'),
s2 AS ({_split_sql("t", "LossofIncome_cover", 0.8, 124)})
SELECT policyno, situation_num, policy_version, LossofIncome_cover, split AS valid_split
FROM s2""", ("policy_claims",))
def validation_split(spark, sf_dir):
    """Second 80/20 split (seed 124) inside the training part."""
    pc = S.policy_claims(spark, sf_dir)
    tr = SM.stratified_split(pc, 0.8, ["LossofIncome_cover"], _KEY, 123).filter(
        F.col("split") == "train").drop("split")
    v = SM.stratified_split(tr, 0.8, ["LossofIncome_cover"], _KEY, 124, out="valid_split")
    return v.select(*_KEY, "LossofIncome_cover", "valid_split")


@register("stratified_folds", f"""
SELECT policyno, situation_num, policy_version, LossofIncome_cover,
       CAST(ntile(10) OVER (PARTITION BY LossofIncome_cover ORDER BY {_SPLIT_KEY.format(seed=123)})
            AS INTEGER) AS fold
FROM policy_claims""", ("policy_claims",))
def stratified_folds(spark, sf_dir):
    """10 folds stratified by BI cover (ntile over md5 order)."""
    pc = S.policy_claims(spark, sf_dir)
    return SM.stratified_folds(pc, 10, ["LossofIncome_cover"], _KEY, 123).select(
        *_KEY, "LossofIncome_cover", "fold")


_LOI_VIEW = "(SELECT *, claimcount_lossofinc > 0 AS has_claim FROM policy_claims WHERE suminsured_prop > 0 AND suminsured_lossofinc > 0)"


@register("downsample", f"""
SELECT policyno, situation_num, policy_version, has_claim FROM (
  SELECT *, row_number() OVER (PARTITION BY has_claim ORDER BY {_SPLIT_KEY.format(seed=123)}) AS rn
  FROM {_LOI_VIEW})
WHERE rn <= floor((SELECT min(n) FROM (SELECT count(*) AS n FROM {_LOI_VIEW} GROUP BY has_claim))
                  * CAST(10 AS DOUBLE))""", ("policy_claims",))
def downsample(spark, sf_dir):
    """Majority class cut to 10x the minority (loss-of-income claims)."""
    v = C.split_by_cover(S.policy_claims(spark, sf_dir), True)
    return SM.downsample(v, "has_claim", _KEY, 10.0, 123).select(*_KEY, "has_claim")


@register("upsample", f"""
WITH v AS (SELECT *, row_number() OVER (PARTITION BY has_claim ORDER BY {_SPLIT_KEY.format(seed=123)}) AS rn,
                  count(*) OVER (PARTITION BY has_claim) AS n FROM {_LOI_VIEW}),
t AS (SELECT floor(max(n) * CAST(0.5 AS DOUBLE)) AS target FROM v),
c AS (SELECT v.*, unnest(generate_series(0, CAST(greatest(ceil(t.target / v.n), 1) AS BIGINT) - 1)) AS copy, t.target
      FROM v, t)
SELECT policyno, situation_num, policy_version, has_claim, CAST(copy AS INTEGER) AS copy FROM c
WHERE copy = 0 OR copy * n + rn <= target""", ("policy_claims",))
def upsample(spark, sf_dir):
    """Minority class replicated up to half the majority size."""
    v = C.split_by_cover(S.policy_claims(spark, sf_dir), True)
    return SM.upsample(v, "has_claim", _KEY, 0.5, 123).select(*_KEY, "has_claim", "copy")


# --- feature preparation -----------------------------------------------------

_BT = ["ECONOMY", "High rise", "LARGE", "MEDIUM", "Medium rise", "PROMO", "SMALL", "STANDARD", "Unknown"]


@register("dummies_building_type", "SELECT policyno, situation_num, policy_version, "
          + ", ".join(f"CAST(building_type = '{v}' AS INTEGER) AS \"building_type_{v}\""
                      for v in _BT[1:]) + " FROM policy_claims", ("policy_claims",))
def dummies_building_type(spark, sf_dir):
    """k-1 indicator columns of building type (first level is the base)."""
    pc = S.policy_claims(spark, sf_dir)
    out = PR.dummies(pc, ["building_type"])
    return out.select(*_KEY, *[c for c in out.columns if c.startswith("building_type_")])


@register("ordinal_building_type", """
SELECT policyno, situation_num, policy_version, building_type,
       CAST(dense_rank() OVER (ORDER BY building_type) - 1 AS DOUBLE) AS building_type_code
FROM policy_claims""", ("policy_claims",))
def ordinal_building_type(spark, sf_dir):
    """Integer codes of building type in alphabetical order."""
    out = PR.ordinal(S.policy_claims(spark, sf_dir), ["building_type"])
    return out.select(*_KEY, "building_type", "building_type_code")


@register("minmax_scale", f"""
WITH s AS ({_split_sql("policy_claims", "LossofIncome_cover", 0.8, 123)}),
b AS (SELECT min(suminsured_prop) AS lo, max(suminsured_prop) AS hi FROM s WHERE split = 'train')
SELECT policyno, situation_num, policy_version,
       round((suminsured_prop - lo) / (hi - lo), 9) AS suminsured_prop
FROM s, b WHERE split = 'test'""", ("policy_claims",))
def minmax_scale(spark, sf_dir):
    """Test rows scaled with the TRAINING min / max."""
    sp = S.policy_split(spark, sf_dir)
    mm = PR.MinMax(["suminsured_prop"]).fit(sp.filter(F.col("split") == "train"))
    out = mm.transform(sp.filter(F.col("split") == "test"))
    return out.select(*_KEY, F.round("suminsured_prop", 9).alias("suminsured_prop"))


_CONST_COLS = ["state", "geo_code", "building_type", "sprinkler_type", "occupation_risk",
               "LossofIncome_cover", "indem_per_grp", "building_info_na"]


@register("constant_audit", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 1 AS constant FROM policy_claims"
    for c in _CONST_COLS), ("policy_claims",))
def constant_audit(spark, sf_dir):
    """Distinct counts of predictors; one value -> dropped as constant."""
    pc = S.policy_claims(spark, sf_dir)
    one = pc.agg(*[F.count_distinct(c).alias(c) for c in _CONST_COLS])
    long = one.unpivot([], _CONST_COLS, "column", "n_distinct")
    return long.withColumn("constant", F.col("n_distinct") <= 1)


@register("novel_levels", f"""
WITH s AS ({_split_sql("policy_claims", "LossofIncome_cover", 0.8, 123)})
SELECT occupation_risk NOT IN (SELECT occupation_risk FROM s WHERE split = 'train') AS novel_level,
       count(*) AS n_rows
FROM s WHERE split = 'test' GROUP BY 1""", ("policy_claims",))
def novel_levels(spark, sf_dir):
    """Test rows whose occupation group is unseen in training."""
    sp = S.policy_split(spark, sf_dir)
    out = GR.novel_levels(sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test"),
                          "occupation_risk")
    return out.groupBy("novel_level").agg(F.count(F.lit(1)).alias("n_rows"))


@register("drop_unused_levels", f"""
WITH s AS ({_split_sql("policy_claims", "LossofIncome_cover", 0.8, 123)})
SELECT geo_code, round(sum(exposure), 6) AS exposure FROM s WHERE split = 'train'
  AND geo_code IN (SELECT geo_code FROM s WHERE split = 'test')
GROUP BY geo_code""", ("policy_claims",))
def drop_unused_levels(spark, sf_dir):
    """Training level table of geo codes restricted to levels with test rows."""
    sp = S.policy_split(spark, sf_dir)
    lv = GR.level_weights(sp.filter(F.col("split") == "train"), "geo_code", "exposure")
    out = PR.drop_unused_levels(lv, sp.filter(F.col("split") == "test"), "geo_code")
    return out.withColumn("exposure", F.round("exposure", 6))
