"""Registered queries: models and their metrics.

Metric queries score with one-factor fits whose fitted values have a closed
form (level ratios), so they are checked exactly against SQL; the GLM query
``rating_factors_one_factor`` checks Spark's IRLS fit against that closed
form.  Multi-factor fits (Poisson, NB, Gamma, Tweedie, trees...) get the
driver's rows-only check and numeric tests in tests/test_models.py.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from exposa.functions import expr as E
from exposa.models import glm as M
from exposa.models import metrics as MT
from exposa.operators import rating as R
from exposa.operators import sampling as SM
from exposa.operators.quantiles import exact_quantiles
from exposa.plans import stages as S
from exposa.plans.q_geo import _KEY, _split_sql
from exposa.plans.registry import register

_FACTORS = ["geo_code", "occupation_risk", "building_type", "sprinkler_type"]


def _one_factor_preds(pc, factors=("geo_code", "occupation_risk", "building_type")):
    """pred_<factor short> = exposure x level claim rate (one-factor Poisson)."""
    out = pc
    for f in factors:
        out = R.level_rate_predictions(out, f, "claimcount_prop", "exposure", f"pred_{f.split('_')[0]}")
    return out


def _rate_sql(f):
    return (f"(SELECT {f}, sum(claimcount_prop) / sum(exposure) AS r FROM policy_claims "
            f"GROUP BY {f})")


_PRED_SQL = f"""(SELECT p.*, p.exposure * g.r AS pred_geo, p.exposure * o.r AS pred_occupation,
        p.exposure * b.r AS pred_building
 FROM policy_claims p JOIN {_rate_sql("geo_code")} g USING (geo_code)
 JOIN {_rate_sql("occupation_risk")} o USING (occupation_risk)
 JOIN {_rate_sql("building_type")} b USING (building_type))"""


@register("rating_factors_one_factor", """
WITH r AS (SELECT geo_code, sum(claimcount_prop) / sum(exposure) AS rate, sum(exposure) AS ex
           FROM policy_claims GROUP BY geo_code),
b AS (SELECT rate AS base_rate FROM r ORDER BY ex DESC, geo_code LIMIT 1)
SELECT 'geo_code' AS factor, geo_code AS level, round(rate / base_rate, 6) AS rf_poisson,
       round(ex, 6) AS exposure
FROM r, b""", ("policy_claims",))
def rating_factors_one_factor(spark, sf_dir):
    """Poisson GLM (log link, log exposure offset) on geo code, fitted by
    Spark IRLS; rating factors exp(coef) against the biggest level."""
    pc = S.policy_claims(spark, sf_dir)
    fit = M.fit_poisson(pc, "claimcount_prop", ["geo_code"])
    t = M.rating_factors(spark, {"poisson": fit}, pc)
    return t.select("factor", "level", F.round("rf_poisson", 6).alias("rf_poisson"),
                    F.round("exposure", 6).alias("exposure"))


@register("error_metrics", " UNION ALL ".join(f"""
SELECT '{m}' AS model, count(*) AS n, round(avg(pow(claimcount_prop - {m}, 2)), 9) AS mse,
       round(sqrt(avg(pow(claimcount_prop - {m}, 2))), 9) AS rmse,
       round(1 - avg(pow(claimcount_prop - {m}, 2)) / var_pop(claimcount_prop), 9) AS r2
FROM {_PRED_SQL}""" for m in ("pred_geo", "pred_occupation", "pred_building")), ("policy_claims",))
def error_metrics(spark, sf_dir):
    """MSE, RMSE, R^2 of three one-factor frequency predictions."""
    p = _one_factor_preds(S.policy_claims(spark, sf_dir))
    t = MT.error_metrics(p, "claimcount_prop", ["pred_geo", "pred_occupation", "pred_building"])
    return t.select("model", "n", F.round("mse", 9).alias("mse"), F.round("rmse", 9).alias("rmse"),
                    F.round("r2", 9).alias("r2"))


@register("rank_models", f"""
SELECT model, rmse, row_number() OVER (ORDER BY rmse, model) = 1 AS best FROM (
  SELECT regexp_extract(m, '([^_]*)$', 1) AS model, round(rmse, 9) AS rmse FROM (
    {" UNION ALL ".join(f"SELECT '{m}' AS m, sqrt(avg(pow(claimcount_prop - {m}, 2))) AS rmse FROM {_PRED_SQL}"
                        for m in ("pred_geo", "pred_occupation", "pred_building"))}))""",
          ("policy_claims",))
def rank_models(spark, sf_dir):
    """Wide predictions to (model, rmse), sorted, best flagged."""
    p = _one_factor_preds(S.policy_claims(spark, sf_dir))
    t = MT.rank_models(p, "claimcount_prop", ["pred_geo", "pred_occupation", "pred_building"])
    return t.select("model", F.round("rmse", 9).alias("rmse"), "best")


_AUC_SQL = f"""
WITH s AS (SELECT round(pred_geo / exposure, 12) AS score, claimcount_prop > 0 AS y FROM {_PRED_SQL}),
g AS (SELECT score, sum(CAST(y AS BIGINT)) AS n_pos, count(*) - sum(CAST(y AS BIGINT)) AS n_neg
      FROM s GROUP BY score),
c AS (SELECT *, coalesce(sum(n_neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                           AND 1 PRECEDING), 0) AS neg_below FROM g)
SELECT round(sum(n_pos * (neg_below + 0.5 * n_neg)) / (sum(n_pos) * sum(n_neg)), 12) AS auc,
       CAST(sum(n_pos) AS BIGINT) AS n_pos, CAST(sum(n_neg) AS BIGINT) AS n_neg FROM c"""


@register("roc_auc", _AUC_SQL, ("policy_claims",))
def roc_auc(spark, sf_dir):
    """ROC AUC (mid-rank formula, ties averaged) of the geo-code claim rate
    as a score for 'has a property claim'."""
    p = _one_factor_preds(S.policy_claims(spark, sf_dir), ("geo_code",))
    s = p.select(F.round(F.col("pred_geo") / F.col("exposure"), 12).alias("score"),
                 (F.col("claimcount_prop") > 0).alias("y"))
    t = MT.roc_auc(s, "score", "y")
    return t.select(F.round("auc", 12).alias("auc"), F.col("n_pos").cast("decimal(38,0)").cast("long").alias("n_pos"),
                    F.col("n_neg").cast("long").alias("n_neg"))


@register("sensitivity", f"""
SELECT count(*) FILTER (WHERE y AND score > 0.19) / count(*) FILTER (WHERE y) AS sensitivity
FROM (SELECT pred_geo / exposure AS score, claimcount_prop > 0 AS y FROM {_PRED_SQL})""",
          ("policy_claims",))
def sensitivity(spark, sf_dir):
    """Share of versions with a claim whose score is above 0.19."""
    p = _one_factor_preds(S.policy_claims(spark, sf_dir), ("geo_code",))
    s = p.select((F.col("pred_geo") / F.col("exposure")).alias("score"),
                 (F.col("claimcount_prop") > 0).alias("y"))
    return MT.sensitivity(s, "score", "y", 0.19)


_PREMIUM_SQL = """(
SELECT p.policyno, p.situation_num, p.policy_version, p.LossofIncome_cover,
       fp.r AS pred_freq_prop, p.claimcount_prop / p.exposure AS actual_freq_prop,
       sp.s AS pred_sev_prop,
       coalesce(p.grossincurred_prop / nullif(p.claimcount_prop, 0), 0.0) AS actual_sev_prop,
       CASE WHEN p.LossofIncome_cover THEN fl.r ELSE 0.0 END AS pred_freq_loi,
       CASE WHEN p.LossofIncome_cover THEN sl.s ELSE 0.0 END AS pred_sev_loi
FROM policy_claims p
JOIN (SELECT geo_code, sum(claimcount_prop) / sum(exposure) AS r FROM policy_claims GROUP BY ALL) fp USING (geo_code)
JOIN (SELECT geo_code, CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) / nullif(sum(claimcount_prop), 0) AS s
      FROM policy_claims GROUP BY ALL) sp USING (geo_code)
LEFT JOIN (SELECT geo_code, sum(claimcount_lossofinc) / sum(exposure) AS r FROM policy_claims
           WHERE LossofIncome_cover GROUP BY ALL) fl USING (geo_code)
LEFT JOIN (SELECT geo_code, CAST(sum(CAST(grossincurred_lossofinc AS DECIMAL(38,4))) AS DOUBLE) / nullif(sum(claimcount_lossofinc), 0) AS s
           FROM policy_claims WHERE LossofIncome_cover GROUP BY ALL) sl USING (geo_code))"""


def _premium_frame(spark, sf_dir):
    """One-factor (geo code) frequency (claims per unit of exposure) and severity predictions per line;
    loss-of-income predictions only on covered versions, 0 otherwise."""
    pc = S.policy_claims(spark, sf_dir)
    fp = R.level_rate_predictions(pc, "geo_code", "claimcount_prop", "exposure", "pred_freq_prop") \
        .withColumn("pred_freq_prop", F.col("pred_freq_prop") / F.col("exposure"))
    sp = pc.groupBy("geo_code").agg(E.safe_div(E.money_sum("grossincurred_prop"),
                                               F.sum("claimcount_prop")).alias("pred_sev_prop"))
    cov = pc.filter("LossofIncome_cover")
    fl = cov.groupBy("geo_code").agg((F.sum("claimcount_lossofinc") / F.sum("exposure")).alias("_rl"))
    sl = cov.groupBy("geo_code").agg(E.safe_div(E.money_sum("grossincurred_lossofinc"),
                                                F.sum("claimcount_lossofinc")).alias("_sl"))
    c = F.col("LossofIncome_cover")
    return (fp.join(sp, "geo_code").join(fl, "geo_code", "left").join(sl, "geo_code", "left")
            .withColumns({
                "actual_freq_prop": F.col("claimcount_prop") / F.col("exposure"),
                "actual_sev_prop": F.coalesce(E.safe_div("grossincurred_prop", "claimcount_prop"), F.lit(0.0)),
                "pred_freq_loi": F.when(c, F.col("_rl")).otherwise(F.lit(0.0)),
                "pred_sev_loi": F.when(c, F.col("_sl")).otherwise(F.lit(0.0))}))


@register("count_by_interaction", f"""
SELECT LossofIncome_cover, (pred_freq_prop * pred_freq_loi) <> 0 AS has_interaction, count(*) AS n_rows
FROM {_PREMIUM_SQL} GROUP BY ALL""", ("policy_claims",))
def count_by_interaction(spark, sf_dir):
    """Rows by (cover, interaction term != 0); uncovered rows carry 0."""
    p = _premium_frame(spark, sf_dir)
    return p.groupBy("LossofIncome_cover", ((F.col("pred_freq_prop") * F.col("pred_freq_loi")) != 0)
                     .alias("has_interaction")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("union_scores", f"""
SELECT policyno, situation_num, policy_version, 0.0 AS interaction FROM {_PREMIUM_SQL}
WHERE NOT LossofIncome_cover
UNION
SELECT policyno, situation_num, policy_version, round(pred_freq_prop * pred_freq_loi, 9)
FROM {_PREMIUM_SQL} WHERE LossofIncome_cover""", ("policy_claims",))
def union_scores(spark, sf_dir):
    """Uncovered rows with interaction 0 UNION covered rows with the
    predicted interaction (duplicates removed)."""
    p = _premium_frame(spark, sf_dir)
    a = p.filter(~F.col("LossofIncome_cover")).select(*_KEY, F.lit(0.0).alias("interaction"))
    b = p.filter("LossofIncome_cover").select(
        *_KEY, F.round(F.col("pred_freq_prop") * F.col("pred_freq_loi"), 9).alias("interaction"))
    return a.unionByName(b).distinct()


_REPORT_COLS = ["pred_freq_prop", "actual_freq_prop", "pred_sev_prop", "actual_sev_prop",
                "pred_freq_loi", "actual_freq_loi", "pred_sev_loi", "actual_sev_loi",
                "pred_premium_prop", "actual_premium_prop", "residual_prop",
                "freq_residual_prop", "sev_residual_prop",
                "pred_premium_loi", "actual_premium_loi", "residual_loi",
                "freq_residual_loi", "sev_residual_loi",
                "pred_premium_total", "actual_premium_total"]


@register("premium_report", f"""
WITH p AS {_PREMIUM_SQL},
l AS (SELECT policyno, situation_num, policy_version, pred_freq_loi, pred_sev_loi,
             claimcount_lossofinc / exposure AS actual_freq_loi,
             coalesce(grossincurred_lossofinc / nullif(claimcount_lossofinc, 0), 0.0) AS actual_sev_loi
      FROM p JOIN policy_claims USING (policyno, situation_num, policy_version)
      WHERE p.LossofIncome_cover),
j AS (SELECT p.policyno, p.situation_num, p.policy_version, p.pred_freq_prop, p.actual_freq_prop,
             p.pred_sev_prop, p.actual_sev_prop,
             coalesce(l.pred_freq_loi, 0.0) AS pred_freq_loi, coalesce(l.actual_freq_loi, 0.0) AS actual_freq_loi,
             coalesce(l.pred_sev_loi, 0.0) AS pred_sev_loi, coalesce(l.actual_sev_loi, 0.0) AS actual_sev_loi
      FROM p LEFT JOIN l USING (policyno, situation_num, policy_version)),
k AS (SELECT *, pred_freq_prop * pred_sev_prop AS pred_premium_prop,
             actual_freq_prop * actual_sev_prop AS actual_premium_prop,
             pred_freq_loi * pred_sev_loi AS pred_premium_loi,
             actual_freq_loi * actual_sev_loi AS actual_premium_loi FROM j)
SELECT policyno, situation_num, policy_version,
       {", ".join(f"floor({c} * 1e6 + 0.5) / 1e6 AS {c}" for c in _REPORT_COLS)}
FROM (SELECT *, pred_premium_prop - actual_premium_prop AS residual_prop,
             pred_premium_loi - actual_premium_loi AS residual_loi,
             pred_freq_prop - actual_freq_prop AS freq_residual_prop,
             pred_sev_prop - actual_sev_prop AS sev_residual_prop,
             pred_freq_loi - actual_freq_loi AS freq_residual_loi,
             pred_sev_loi - actual_sev_loi AS sev_residual_loi,
             pred_premium_prop + pred_premium_loi AS pred_premium_total,
             actual_premium_prop + actual_premium_loi AS actual_premium_total FROM k)""",
          ("policy_claims",))
def premium_report(spark, sf_dir):
    """Predicted vs actual frequency, severity and pure premium per line, with
    their residuals (predicted minus actual) (loss-of-income scores joined, missing -> 0) and the total premium."""
    p = _premium_frame(spark, sf_dir)
    prop = p.select(*_KEY, "pred_freq_prop", "actual_freq_prop", "pred_sev_prop", "actual_sev_prop")
    prop = prop.toDF(*_KEY, "pred_freq", "actual_freq", "pred_sev", "actual_sev")
    loi = p.filter("LossofIncome_cover").select(
        *_KEY, "pred_freq_loi", (F.col("claimcount_lossofinc") / F.col("exposure")).alias("a_f"),
        "pred_sev_loi", F.coalesce(E.safe_div("grossincurred_lossofinc", "claimcount_lossofinc"),
                                   F.lit(0.0)).alias("a_s"))
    loi = loi.toDF(*_KEY, "pred_freq", "actual_freq", "pred_sev", "actual_sev")
    rep = MT.premium_report(prop, loi, _KEY)
    # same arithmetic rounding on both engines (round() differs at exact ties)
    return rep.select(*_KEY, *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in _REPORT_COLS])


def _cdf_list(mu: float = 1.0, kmax: int = 20):
    cdf, out = 0.0, []
    for k in range(kmax):
        cdf += math.exp(-mu) * mu ** k / math.factorial(k)
        out.append(cdf)
    return out


_U_SQL = ("(CAST(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', policyno, "
          "CAST(situation_num AS VARCHAR), CAST(policy_version AS VARCHAR){extra})), {start}, 13)) "
          "AS BIGINT) AS DOUBLE) / 4503599627370496.0)")


@register("bootstrap_rmse_one_factor", f"""
WITH p AS (SELECT p.policyno, p.situation_num, p.policy_version, p.claimcount_prop AS y,
                  p.exposure * g.r AS mu
           FROM policy_claims p JOIN {_rate_sql("geo_code")} g USING (geo_code)),
b AS (SELECT p.*, CAST(unnest(generate_series(1, 20)) AS INTEGER) AS replicate FROM p),
w AS (SELECT replicate, y, mu, {" + ".join(f"CAST(u > {c!r} AS INTEGER)" for c in _cdf_list())} AS w
      FROM (SELECT *, CAST({_U_SQL.format(seed=123, extra=", CAST(replicate AS VARCHAR)", start=1)}
            AS DOUBLE) AS u FROM b))
SELECT replicate, round(sqrt(sum(w * pow(y - mu, 2)) / sum(w)), 9) AS rmse,
       CAST(sum(w) AS BIGINT) AS n_resampled
FROM w GROUP BY replicate""", ("policy_claims",))
def bootstrap_rmse_one_factor(spark, sf_dir):
    """RMSE of the one-factor (geo code) Poisson frequency fit on 20
    Poisson(1)-weight bootstrap resamples (seeded hash draws)."""
    p = _one_factor_preds(S.policy_claims(spark, sf_dir), ("geo_code",))
    t = MT.bootstrap_rmse(p, "claimcount_prop", "pred_geo", _KEY, 20, seed=123)
    return t.select(F.col("replicate").cast("int").alias("replicate"),
                    F.round("rmse", 9).alias("rmse"), F.col("n_resampled").cast("long"))


_PROBS = [(i + 0.5) / 20 for i in range(20)]


@register("simulated_residuals_one_factor", f"""
WITH p AS (SELECT p.policyno, p.situation_num, p.policy_version, p.claimcount_prop AS y,
                  p.exposure * g.r AS mu
           FROM policy_claims p JOIN {_rate_sql("geo_code")} g USING (geo_code)),
u AS (SELECT *, {_U_SQL.format(seed=7, extra="", start=1)} AS v FROM p),
f AS (SELECT *,
        list_sum(list_transform(range(0, CAST(y AS BIGINT)),
          lambda k: exp(-mu + k * ln(mu) - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: ln(j))), 0.0))))
          AS below,
        exp(-mu + y * ln(mu) - coalesce(list_sum(list_transform(range(1, CAST(y AS BIGINT) + 1),
          lambda j: ln(j))), 0.0)) AS pmf
      FROM u)
SELECT CAST(i AS INTEGER) AS i, round(q, 9) AS empirical, CAST((i + 0.5) / 20 AS DOUBLE) AS theoretical
FROM (SELECT unnest(range(0, 20)) AS i,
             unnest(quantile_cont(coalesce(below, 0.0) + v * pmf, {_PROBS})) AS q FROM f)""",
          ("policy_claims",))
def simulated_residuals_one_factor(spark, sf_dir):
    """Exact quantiles of randomised quantile residuals (Poisson PIT) of the
    one-factor frequency fit against uniform quantiles."""
    p = _one_factor_preds(S.policy_claims(spark, sf_dir), ("geo_code",))
    pit = MT.poisson_pit(p, "claimcount_prop", "pred_geo", _KEY, seed=7)
    q = exact_quantiles(pit, [], "pit", _PROBS).select(F.posexplode("quantiles").alias("i", "empirical"))
    return q.select(F.col("i").cast("int").alias("i"), F.round("empirical", 9).alias("empirical"),
                    ((F.col("i") + 0.5) / 20).alias("theoretical"))
