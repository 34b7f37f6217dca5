"""Fits with a closed form: the iterative library fit on one factor against SQL.

With one factor and a log link the maximum-likelihood mean of a level is its
weighted mean, whatever the variance function (Poisson with an exposure
offset: claims over exposure), so these queries hold the library's iterative
solvers to an exact answer on the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from exposa.models import glm as M
from exposa.plans import stages as S
from exposa.plans.registry import register

_FACTOR = "building_type"


def _level_means(spark, fit):
    """(level, mean): exp(intercept + level coefficient), rounded to 6 significant digits' worth."""
    c = fit.coefficients
    rows = [(lv, c["(Intercept)"] + (0.0 if i == 0 else c[f"{_FACTOR}_{lv}"]))
            for i, lv in enumerate(fit.design.labels[_FACTOR])]
    t = spark.createDataFrame(rows, "level string, eta double")
    return t.select("level", F.round("eta", 5).alias("log_mean"))


@register("fit_poisson_one_factor", f"""
SELECT {_FACTOR} AS level, round(ln(sum(date_weights * claimcount_prop) / sum(date_weights * exposure)), 5) AS log_mean
FROM policy_claims GROUP BY 1""", ("policy_claims",))
def fit_poisson_one_factor(spark, sf_dir):
    """Log claim rate per level of the Poisson GLM (offset, prior weights)."""
    return _level_means(spark, M.fit_poisson(S.policy_claims(spark, sf_dir), "claimcount_prop", [_FACTOR],
                                             weight="date_weights"))


_SEV = """(SELECT *, grossincurred_prop / claimcount_prop AS sev FROM policy_claims
           WHERE claimcount_prop > 0 AND grossincurred_prop > 0)"""


def _severity(spark, sf_dir):
    return S.policy_claims(spark, sf_dir).filter("claimcount_prop > 0 AND grossincurred_prop > 0").withColumn(
        "sev", F.col("grossincurred_prop") / F.col("claimcount_prop"))


@register("fit_gamma_one_factor", f"""
SELECT {_FACTOR} AS level, round(ln(sum(claimcount_prop * sev) / sum(claimcount_prop)), 5) AS log_mean
FROM {_SEV} GROUP BY 1""", ("policy_claims",))
def fit_gamma_one_factor(spark, sf_dir):
    """Log mean severity per level of the Gamma GLM weighted by claims."""
    return _level_means(spark, M.fit_gamma(_severity(spark, sf_dir), "sev", [_FACTOR], weight="claimcount_prop"))


@register("fit_tweedie_one_factor", f"""
SELECT {_FACTOR} AS level, round(ln(sum(exposure * grossincurred_prop) / sum(exposure)), 5) AS log_mean
FROM policy_claims GROUP BY 1""", ("policy_claims",))
def fit_tweedie_one_factor(spark, sf_dir):
    """Log mean cost per level of the Tweedie GLM (p = 1.5) weighted by exposure."""
    return _level_means(spark, M.fit_tweedie(S.policy_claims(spark, sf_dir), "grossincurred_prop", [_FACTOR],
                                             power=1.5, weight="exposure"))


@register("drop_constant", """
SELECT 'all' AS kept, count(DISTINCT policyno) AS n_policies, count(*) AS n_rows FROM policy_claims""",
          ("policy_claims",))
def drop_constant(spark, sf_dir):
    """Zero-variance removal: a made constant goes, every real predictor stays."""
    from exposa.operators.gates import drop_constant as drop
    pc = S.policy_claims(spark, sf_dir).withColumn("made_constant", F.lit("x"))
    kept, gone = drop(pc, ["made_constant", "state", "building_type", "LossofIncome_cover"])
    label = "all" if gone == ["made_constant"] and "made_constant" not in kept.columns else str(gone)
    return kept.agg(F.count_distinct("policyno").alias("n_policies"), F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(label).alias("kept"), "n_policies", "n_rows")


@register("poisson_aic_one_factor", f"""
WITH f AS (SELECT {_FACTOR}, sum(claimcount_prop) / sum(exposure) AS r, count(*) OVER () AS k
           FROM policy_claims GROUP BY 1),
p AS (SELECT p.claimcount_prop AS y, p.exposure * f.r AS mu, f.k FROM policy_claims p JOIN f USING ({_FACTOR}))
SELECT 'poisson' AS model, round(-2 * sum(y * ln(mu) - mu - lgamma(y + 1)) + 2 * max(k), 4) AS aic,
       round(-2 * sum(y * ln(mu) - mu - lgamma(y + 1)) + max(k) * ln(count(*)), 4) AS bic
FROM p""", ("policy_claims",))
def poisson_aic_one_factor(spark, sf_dir):
    """AIC and BIC of the iterative Poisson fit on one factor."""
    fit = M.fit_poisson(S.policy_claims(spark, sf_dir), "claimcount_prop", [_FACTOR])
    return M.model_performance(spark, {"poisson": fit}).select(
        "model", F.round("aic", 4).alias("aic"), F.round("bic", 4).alias("bic"))


@register("logistic_one_factor", f"""
SELECT {_FACTOR} AS level, round(ln(avg(y) / (1 - avg(y))), 4) AS log_odds
FROM (SELECT {_FACTOR}, CAST(claimcount_prop > 0 AS DOUBLE) AS y FROM policy_claims) GROUP BY 1""", ("policy_claims",))
def logistic_one_factor(spark, sf_dir):
    """Log odds of a property claim per level, from the iterative logistic fit."""
    from pyspark.ml.classification import LogisticRegression

    from exposa.models.design import build_design
    pc = S.policy_claims(spark, sf_dir).withColumn("_label", (F.col("claimcount_prop") > 0).cast("double"))
    d = build_design(pc, [_FACTOR])
    m = LogisticRegression(featuresCol="features", labelCol="_label", maxIter=200, tol=1e-12,
                           standardization=False).fit(d.transform(pc))
    beta = dict(zip(d.names, map(float, m.coefficients)))
    rows = [(lv, float(m.intercept) + (beta[f"{_FACTOR}_{lv}"] if i else 0.0))
            for i, lv in enumerate(d.labels[_FACTOR])]
    return spark.createDataFrame(rows, "level string, eta double").select("level", F.round("eta", 4).alias("log_odds"))


@register("interaction_slope_one_factor", """
WITH f AS (SELECT geo_code, sum(claimcount_prop) / sum(exposure) AS fp, sum(grossincurred_prop) / sum(claimcount_prop) AS sp
           FROM policy_claims GROUP BY 1),
g AS (SELECT geo_code, sum(claimcount_lossofinc) / sum(exposure) AS fl,
             sum(grossincurred_lossofinc) / nullif(sum(claimcount_lossofinc), 0) AS sl
      FROM policy_claims WHERE LossofIncome_cover GROUP BY 1),
p AS (SELECT fp * fl AS x, grossincurred_prop + grossincurred_lossofinc - fp * sp - fl * coalesce(sl, 0.0) AS y
      FROM policy_claims JOIN f USING (geo_code) JOIN g USING (geo_code) WHERE LossofIncome_cover)
SELECT round(regr_slope(y, x), 3) AS slope, round(regr_intercept(y, x), 5) AS intercept, count(*) AS n FROM p""",
          ("policy_claims",))
def interaction_slope_one_factor(spark, sf_dir):
    """Residual total loss on the product of both lines' frequencies (one-factor
    predictions), over covered versions: slope and intercept."""
    from exposa.plans.q_models import _premium_frame
    p = _premium_frame(spark, sf_dir).filter("LossofIncome_cover").select(
        (F.col("pred_freq_prop") * F.col("pred_freq_loi")).alias("x"),
        (F.col("grossincurred_prop") + F.col("grossincurred_lossofinc") - F.col("pred_freq_prop") * F.col("pred_sev_prop")
         - F.col("pred_freq_loi") * F.coalesce("pred_sev_loi", F.lit(0.0))).alias("y"))
    return p.agg(F.round(F.regr_slope("y", "x"), 3).alias("slope"), F.round(F.regr_intercept("y", "x"), 5)
                 .alias("intercept"), F.count(F.lit(1)).alias("n"))
