"""Registered queries: multi-factor model fits and model checks.

These have no SQL oracle (iterative fits); the driver checks rows, and
tests/test_models.py checks the numbers against numpy IRLS / closed forms.
"""

from __future__ import annotations

from exposa.session import app_id

import math

from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from exposa.models import cells as CL
from exposa.models import glm as M
from exposa.models import interaction as IA
from exposa.models import metrics as MT
from exposa.models import negbin as NB
from exposa.models import smooth as SP
from exposa.models import tweedie as TW
from exposa.operators import consolidate as C
from exposa.operators import geo as G
from exposa.operators import sampling as SM
from exposa.plans import stages as S
from exposa.plans.q_geo import _KEY, _PE_GRID, _grid_rows, _split_sql, rollup3_sql
from exposa.plans.registry import register

FREQ_FACTORS = ["geo_code", "occupation_risk", "building_type", "sprinkler_type"]


def _split(spark, sf_dir):
    return S.policy_split(spark, sf_dir)


def _coef_table(spark, fit, model_name):
    rows = [(model_name, k, float(v)) for k, v in fit.coefficients.items()]
    return spark.createDataFrame(rows, "model string, term string, estimate double")


@register("fit_poisson_freq")
def fit_poisson_freq(spark, sf_dir):
    """Poisson frequency GLM (log link, log exposure offset, recency prior
    weights) on four factors; rating factors with exposure."""
    pc = S.policy_claims(spark, sf_dir)
    fit = M.fit_poisson(pc, "claimcount_prop", FREQ_FACTORS, weight="date_weights")
    return M.rating_factors(spark, {"poisson": fit}, pc)


@register("fit_negbin_freq")
def fit_negbin_freq(spark, sf_dir):
    """Negative-binomial frequency GLM (theta by ML); coefficients + theta."""
    pc = S.policy_claims(spark, sf_dir)
    nb = NB.fit_negbin(pc, "claimcount_lossofinc", ["geo_code", "indem_per_grp"])
    rows = [("negbin", k, float(v)) for k, v in nb.coefficients.items()]
    rows.append(("negbin", "theta", float(nb.theta)))
    return spark.createDataFrame(rows, "model string, term string, estimate double")


def _sev_rows(pc):
    return pc.filter(F.col("claimcount_prop") > 0).withColumn(
        "severity", F.col("grossincurred_prop") / F.col("claimcount_prop"))


@register("fit_gamma_severity")
def fit_gamma_severity(spark, sf_dir):
    """Gamma severity GLM (log link) on versions with claims, weighted by
    the claim count; rating factors."""
    pc = S.policy_claims(spark, sf_dir)
    fit = M.fit_gamma(_sev_rows(pc), "severity", ["geo_code", "building_type"],
                      weight="claimcount_prop")
    return M.rating_factors(spark, {"gamma": fit})


@register("add_predictions")
def add_predictions(spark, sf_dir):
    """Test rows with pred_<response>_<model> of Poisson and NB fits trained
    on the training split."""
    sp = _split(spark, sf_dir)
    tr, te = sp.filter("split = 'train'"), sp.filter("split = 'test'")
    pois = M.fit_poisson(tr, "claimcount_prop", ["geo_code", "building_type"])
    nb = NB.fit_negbin(tr, "claimcount_prop", ["geo_code", "building_type"])
    out = M.add_prediction(te.select(*_KEY, "geo_code", "building_type", "exposure",
                                     "claimcount_prop"), {"poisson": pois})
    return nb.predict(out, "pred_claimcount_prop_negbin")


@register("model_performance")
def model_performance(spark, sf_dir):
    """AIC, BIC and test RMSE of Poisson, negative-binomial, Gamma and Tweedie fits."""
    sp = _split(spark, sf_dir)
    tr, te = sp.filter("split = 'train'"), sp.filter("split = 'test'")
    fits = {"poisson": M.fit_poisson(tr, "claimcount_prop", ["geo_code", "building_type"])}
    rmse = {"poisson": MT.error_metrics(fits["poisson"].predict(te, "p"), "claimcount_prop",
                                        ["p"]).first()["rmse"]}
    fits["gamma"] = M.fit_gamma(_sev_rows(tr), "severity", ["building_type"])
    rmse["gamma"] = MT.error_metrics(fits["gamma"].predict(_sev_rows(te), "p"), "severity",
                                     ["p"]).first()["rmse"]
    nb = NB.fit_negbin(tr, "claimcount_prop", ["geo_code", "building_type"])
    tw = M.fit_tweedie(tr, "grossincurred_prop", ["building_type"], power=1.5)
    fits |= {"negbin": nb, "tweedie": tw}
    rmse["negbin"] = MT.error_metrics(nb.predict(te, "p"), "claimcount_prop", ["p"]).first()["rmse"]
    rmse["tweedie"] = MT.error_metrics(tw.predict(te, "p"), "grossincurred_prop", ["p"]).first()["rmse"]
    ll, _, k = TW.loglik(tr, tw, 1.5)
    return M.model_performance(spark, fits, rmse, {
        "negbin": (nb.loglik, len(nb.coef) + 2, nb.n), "tweedie": (ll, k, nb.n)})


@register("glm_importance")
def glm_importance(spark, sf_dir):
    """Top 10 coefficients of the Poisson frequency fit by |t value|."""
    pc = S.policy_claims(spark, sf_dir)
    fit = M.fit_poisson(pc, "claimcount_prop", ["geo_code", "building_type", "sprinkler_type"])
    return M.glm_importance(spark, fit, 10)


def _pois_pred(spark, sf_dir):
    pc = S.policy_claims(spark, sf_dir)
    fit = M.fit_poisson(pc, "claimcount_prop", ["geo_code", "building_type"])
    return fit.predict(pc, "mu")


@register("bootstrap_rmse")
def bootstrap_rmse(spark, sf_dir):
    """RMSE of the Poisson fit on 20 Poisson(1)-weight bootstrap resamples."""
    return MT.bootstrap_rmse(_pois_pred(spark, sf_dir), "claimcount_prop", "mu", _KEY, 20)


@register("overdispersion_test")
def overdispersion_test(spark, sf_dir):
    """Pearson over-dispersion test of the two-factor Poisson fit with its
    chi-square p-value (one number from the driver-side gamma function)."""
    from exposa.operators.rating import check_overdispersion, chi2_sf
    p = _pois_pred(spark, sf_dir)
    k = p.select(F.count_distinct("geo_code") + F.count_distinct("building_type") - 1).first()[0]
    t = check_overdispersion(p, "claimcount_prop", "mu", k)
    chi2, df = t.select("chi2", "df").first()
    return t.withColumn("p_value", F.lit(chi2_sf(chi2, df))).withColumn(
        "significant", F.col("p_value") < 0.05)


@register("simulated_residuals")
def simulated_residuals(spark, sf_dir):
    """QQ table of randomised quantile residuals of the Poisson fit."""
    pit = MT.poisson_pit(_pois_pred(spark, sf_dir), "claimcount_prop", "mu", _KEY)
    return MT.qq_uniform(pit, "pit", 20)


@register("residual_diagnostics")
def residual_diagnostics(spark, sf_dir):
    """Residuals of the Tweedie fit by ventile of the fitted value: mean linear
    score and fitted value, mean observed, mean deviance and standardised
    (Pearson over the root of phi) residual, with the normal quantile of the
    ventile and the standardised residuals' own quantile (QQ data)."""
    from statistics import NormalDist

    from exposa.operators.quantiles import exact_quantiles
    pc, power, n = S.policy_claims(spark, sf_dir), 1.5, 20
    fit = M.fit_tweedie(pc, "grossincurred_prop", ["geo_code", "building_type"], power=power)
    _, phi, _ = TW.loglik(pc, fit, power)
    y, mu = F.col("grossincurred_prop"), F.col("fitted")
    dev = 2 * (F.when(y > 0, F.pow(y, 2 - power) / ((1 - power) * (2 - power))).otherwise(F.lit(0.0))
               - y * F.pow(mu, 1 - power) / (1 - power) + F.pow(mu, 2 - power) / (2 - power))
    r = fit.predict(pc, "fitted").select(
        y.alias("observed"), mu.alias("fitted"), F.log(mu).alias("score"),
        (F.signum(y - mu) * F.sqrt(F.greatest(dev, F.lit(0.0)))).alias("deviance"),
        ((y - mu) / F.sqrt(F.lit(phi) * F.pow(mu, power))).alias("standardised"))
    probs = [(i + 0.5) / n for i in range(n)]
    cuts = exact_quantiles(r, [], "fitted", [i / n for i in range(1, n)]).first()
    edges = F.array(*[F.lit(float(c)) for c in (cuts["quantiles"] if cuts else [])]).cast("array<double>")
    by = r.withColumn("ventile", F.size(F.filter(edges, lambda e: e < F.col("fitted")))).groupBy("ventile").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(f"mean_{c}") for c in r.columns])
    qq = exact_quantiles(r, [], "standardised", probs).select(F.posexplode("quantiles").alias("ventile", "quantile"))
    normal = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in probs])
    return qq.join(by, "ventile", "left").withColumn("normal", normal[F.col("ventile")])


# The study's formulas: log(sum insured) and these factors (severity takes the state
# instead of the geo code; the BI severity leaves the walls out).
_RISK = ["building_age", "building_type", "construction_walls", "construction_floor", "sprinkler_type",
         "occupation_risk"]
# The four pairs of (BI, property) frequency models.
_PAIRS = {f"{b}_{p}": (f"freq_lossofinc_{b}", f"freq_prop_{p}") for b in ("pois", "nb") for p in ("pois", "nb")}


def _line_fits(tr, ln):
    """Poisson, NB and Gamma fits of one line on its training rows."""
    x = f"log_suminsured_{ln}"
    rows = tr.filter(F.col(f"suminsured_{ln}") > 0).withColumn(x, F.log(f"suminsured_{ln}"))
    sev = rows.filter((F.col(f"grossincurred_{ln}") > 0) & (F.col(f"claimcount_{ln}") > 0)).withColumn(
        "sev", F.col(f"grossincurred_{ln}") / F.col(f"claimcount_{ln}"))
    y, factors = f"claimcount_{ln}", ["geo_code", *_RISK]
    sev_factors = ["state", *[c for c in _RISK if ln == "prop" or c != "construction_walls"]]
    return {"pois": M.fit_poisson(rows, y, factors, numeric=[x], weight="date_weights"),
            "nb": NB.fit_negbin(rows, y, factors, numeric=[x], weight="date_weights"),
            "sev": M.fit_gamma(sev, "sev", sev_factors, numeric=[x], weight="date_weights")}


def _scored_test(spark, sf_dir):
    """All test rows with both lines' frequency (Poisson and NB) and severity predictions.

    BI predictions are 0 outside the BI cover (and where its sum insured is not positive).
    The fits are made once per application: their scores are a stage."""
    def build():
        sp = _split(spark, sf_dir)
        tr, out = sp.filter("split = 'train'"), sp.filter("split = 'test'").filter("suminsured_prop > 0")
        out = out.withColumns({f"log_suminsured_{ln}": F.log(F.greatest(f"suminsured_{ln}", F.lit(1.0)))
                               for ln in ("prop", "lossofinc")})
        for ln in ("prop", "lossofinc"):
            fits = _line_fits(tr if ln == "prop" else tr.filter("LossofIncome_cover"), ln)
            for m in ("pois", "nb"):
                out = fits[m].predict(out, f"freq_{ln}_{m}")
            out = fits["sev"].predict(out, f"sev_{ln}")
        covered = F.col("LossofIncome_cover") & (F.col("suminsured_lossofinc") > 0)
        bi = ["freq_lossofinc_pois", "freq_lossofinc_nb", "sev_lossofinc"]
        out = out.withColumns({c: F.when(covered, F.col(c)).otherwise(F.lit(0.0)) for c in bi})
        return out.withColumn("total", F.col("grossincurred_prop") + F.col("grossincurred_lossofinc")).select(
            *_KEY, "LossofIncome_cover", "grossincurred_prop", "grossincurred_lossofinc", "total",
            "freq_prop_pois", "freq_prop_nb", "sev_prop", *bi)
    return S.stage(spark, sf_dir, "ensemble_scored", build)


def _cv(spark, sf_dir):
    """pair -> (moments by fold, cross-validated errors), and the pair with the least error."""
    covered = _scored_test(spark, sf_dir).filter("LossofIncome_cover")
    folds = SM.stratified_folds(covered, 10, ["LossofIncome_cover"], _KEY, 123)
    sums = IA.moments(folds, _PAIRS, "fold")
    errors = {p: IA.cross_validated(m) for p, m in sums.items()}
    return sums, errors, min(errors, key=lambda p: (errors[p]["mse_adjusted"], p))


@register("interaction_model")
def interaction_model(spark, sf_dir):
    """Gaussian models of the residual loss on the freq x freq, sev x sev and
    four-way products, for the four pairs of frequency models; the pair with
    the least cross-validated error is flagged."""
    sums, _, best = _cv(spark, sf_dir)
    rows = [(p, t, float(e), p == best) for p, m in sums.items()
            for t, e in zip(IA.TERMS, IA.solve(sum(m.values())))]
    return spark.createDataFrame(rows, "pair string, term string, estimate double, chosen boolean")


@register("cv_error")
def cv_error(spark, sf_dir):
    """10-fold cross-validated MSE of the four interaction models, plain and
    bias-adjusted (cv + full - mean full-data error of the fold fits), with
    RMSE and R^2; the best pair is flagged."""
    _, errors, best = _cv(spark, sf_dir)
    rows = [(p, m, float(v), p == best) for p, e in errors.items() for m, v in e.items()]
    return spark.createDataFrame(rows, "pair string, measure string, value double, chosen boolean")


@register("ensemble_error")
def ensemble_error(spark, sf_dir):
    """Test RMSE of total loss with and without the interaction term of the
    chosen pair, and per line, over ALL evaluated rows: those outside the BI
    cover count with interaction 0.  The interaction is fitted on one half of
    the covered rows; errors are taken on the other half and all uncovered rows."""
    _, _, best = _cv(spark, sf_dir)
    halves = SM.stratified_split(_scored_test(spark, sf_dir), 0.5, ["LossofIncome_cover"], _KEY, 321)
    part = IA.moments(halves.filter("LossofIncome_cover AND split = 'train'"), {best: _PAIRS[best]}, "split")
    b = IA.solve(part[best]["train"])
    x, _ = IA.regressors(*_PAIRS[best])
    inter = sum((F.lit(float(c)) * v for c, v in zip(b, x)), F.lit(0.0))
    bi, prop = _PAIRS[best]
    ev = halves.filter("split = 'test' OR NOT LossofIncome_cover").withColumns({
        "prem_prop": F.col(prop) * F.col("sev_prop"), "prem_loi": F.col(bi) * F.col("sev_lossofinc"),
        "interaction": F.when(F.col("LossofIncome_cover"), inter).otherwise(F.lit(0.0))})
    ev = ev.withColumn("base", F.col("prem_prop") + F.col("prem_loi"))
    ev = ev.withColumn("with_interaction", F.col("base") + F.col("interaction"))
    a = MT.error_metrics(ev, "total", ["base", "with_interaction"])
    b = MT.error_metrics(ev, "grossincurred_prop", ["prem_prop"])
    c = MT.error_metrics(ev, "grossincurred_lossofinc", ["prem_loi"])
    return a.unionByName(b).unionByName(c)


_SCORE_GRID_SQL = f"""
WITH maps AS (
  SELECT DISTINCT grid_id, state, riskpostcode,
         CASE WHEN state IN ('ACT', 'NT') THEN state ELSE geo_code END AS geo_code
  FROM {rollup3_sql(_PE_GRID, ("t_riskpostcode", "t_sa3name", "t_sa4name"), part="grid_id")}),
c AS (SELECT grid_id, count(DISTINCT geo_code) AS n_geo_code FROM maps GROUP BY grid_id),
keep AS (SELECT n_geo_code, min(grid_id) AS grid_id FROM c GROUP BY n_geo_code),
last_pc AS (SELECT policyno, situation_num, riskpostcode FROM (
  SELECT policyno, situation_num, riskpostcode, row_number() OVER (
    PARTITION BY policyno, situation_num ORDER BY ym DESC, xm DESC, riskpostcode DESC) AS rn
  FROM claims_geo) WHERE rn = 1),
pcl AS (SELECT p.*, l.riskpostcode FROM policy_claims p JOIN last_pc l USING (policyno, situation_num)),
sp AS ({_split_sql("pcl", "LossofIncome_cover", 0.8, 123)}),
grain AS (SELECT riskpostcode, state, split, sum(CAST(claimcount_prop AS DOUBLE)) AS sy,
                 sum(exposure) AS se, sum(CAST(claimcount_prop AS DOUBLE) * claimcount_prop) AS syy,
                 sum(claimcount_prop * exposure) AS sye, sum(exposure * exposure) AS see,
                 count(*) AS n
          FROM sp GROUP BY ALL),
g AS (SELECT grain.*, m.grid_id, m.geo_code FROM grain
      JOIN (SELECT grid_id, riskpostcode, min(geo_code) AS geo_code FROM maps GROUP BY ALL) m USING (riskpostcode)
      WHERE m.grid_id IN (SELECT grid_id FROM keep)),
r AS (SELECT grid_id, geo_code, sum(sy) / sum(se) AS r FROM g WHERE split = 'train' GROUP BY ALL),
rs AS (SELECT grid_id, state, sum(sy) / sum(se) AS rs FROM g WHERE split = 'train' GROUP BY ALL),
ro AS (SELECT grid_id, sum(sy) / sum(se) AS ro FROM g WHERE split = 'train' GROUP BY ALL),
te AS (SELECT g.*, coalesce(r.r, rs.rs, ro.ro) AS rate FROM g
       LEFT JOIN r USING (grid_id, geo_code) LEFT JOIN rs USING (grid_id, state)
       LEFT JOIN ro USING (grid_id) WHERE g.split = 'test')
SELECT e.grid_id, k.n_geo_code, round(e.rmse, 9) AS rmse
FROM (SELECT grid_id, sqrt(sum(syy - 2 * rate * sye + rate * rate * see) / sum(n)) AS rmse
      FROM te GROUP BY grid_id) e JOIN keep k USING (grid_id)"""


@register("score_geo_grid_rates", _SCORE_GRID_SQL, ("claims_geo", "policy_claims"))
def score_geo_grid_rates(spark, sf_dir):
    """Screening of the geo encodings by the code alone, in ONE job (the fits with all
    factors are ``score_geo_grid``).

    The one-factor Poisson frequency fit of an encoding is the claim rate of
    each code (its maximum-likelihood solution) on the training rows, and the
    test squared error of rate r on a postcode is
    sum(y^2) - 2 r sum(y e) + r^2 sum(e^2).  So policies are reduced ONCE to
    postcode-grain sums per split; the per-encoding maps (one row per grid id
    and postcode) join that small table - no per-encoding pass over rows.
    Codes unseen in training fall back to the state rate, then the overall.
    """
    from exposa.session import checkpoint_dir
    checkpoint_dir(spark)
    geo = S.claims_geo(spark, sf_dir)
    # grid x postcode maps: small (80 x postcodes); checkpointed so the
    # branches below do not recompute the 80-way roll-up
    maps_all = G.geo_grid_maps(geo, _grid_rows(), weight="epy").checkpoint()
    counts = maps_all.groupBy("grid_id").agg(F.count_distinct("geo_code").alias("n_geo_code"))
    first = counts.groupBy("n_geo_code").agg(F.min("grid_id").alias("grid_id"))
    keep = counts.join(first, ["n_geo_code", "grid_id"], "left_semi")
    maps = maps_all.join(keep.select("grid_id"), "grid_id", "left_semi")
    last_pc = geo.groupBy("policyno", "situation_num").agg(
        F.max(F.struct("ym", "xm", "riskpostcode")).alias("_l")).select(
        "policyno", "situation_num", F.col("_l.riskpostcode").alias("riskpostcode"))
    pc = S.policy_claims(spark, sf_dir).join(last_pc, ["policyno", "situation_num"])
    sp = SM.stratified_split(pc, 0.8, ["LossofIncome_cover"], _KEY, 123)
    y, e = F.col("claimcount_prop").cast("double"), F.col("exposure")
    grain = sp.groupBy("riskpostcode", "state", "split").agg(
        F.sum(y).alias("sy"), F.sum(e).alias("se"), F.sum(y * y).alias("syy"),
        F.sum(y * e).alias("sye"), F.sum(e * e).alias("see"),
        F.count(F.lit(1)).alias("n")).checkpoint()              # postcode grain: small
    g = grain.join(G.one_code(maps, ["grid_id"]), "riskpostcode")        # postcodes x encodings
    tr = g.filter("split = 'train'")
    rates = tr.groupBy("grid_id", "geo_code").agg((F.sum("sy") / F.sum("se")).alias("_r"))
    state_rates = tr.groupBy("grid_id", "state").agg((F.sum("sy") / F.sum("se")).alias("_rs"))
    overall = tr.groupBy("grid_id").agg((F.sum("sy") / F.sum("se")).alias("_ro"))
    te = (g.filter("split = 'test'").join(rates, ["grid_id", "geo_code"], "left")
          .join(state_rates, ["grid_id", "state"], "left").join(overall, "grid_id", "left"))
    r = F.coalesce("_r", "_rs", "_ro")
    sse = F.col("syy") - 2 * r * F.col("sye") + r * r * F.col("see")
    err = te.groupBy("grid_id").agg(F.sqrt(F.sum(sse) / F.sum("n")).alias("rmse"))
    return err.join(keep, "grid_id").select("grid_id", "n_geo_code", F.round("rmse", 9).alias("rmse")) \
        .orderBy("rmse", "grid_id")


def _curve_data(spark, sf_dir, knots=4, band=0.1, line="prop"):
    """Per band of log sum insured: claims, exposure and incurred, with
    truncated-power spline columns at quantiles.

    ``band`` is the width that values are rounded to before the fit (0: distinct
    values); a band is one row of the fit, so it bounds the curve's rows."""
    x = F.log(f"suminsured_{line}")
    pc = S.policy_claims(spark, sf_dir).filter(F.col(f"suminsured_{line}") > 0).withColumn(
        "x", F.round(F.round(x / band) * band, 9) if band else x)
    agg = pc.groupBy("x").agg(F.sum(f"claimcount_{line}").alias("n"), F.sum("exposure").alias("exposure"),
                              F.sum(f"grossincurred_{line}").alias("incurred"))
    from exposa.operators.quantiles import exact_quantiles
    qs = exact_quantiles(pc, [], "x", [(i + 1) / (knots + 1) for i in range(knots)]).first()[0]
    at = sorted(set(qs))
    u = F.col("x") - F.lit(at[len(at) // 2])                 # powers about the middle knot
    cols = {"u": u, "u2": u * u, "u3": u * u * u}
    for i, q in enumerate(at):
        cols[f"k{i}"] = F.pow(F.greatest(F.col("x") - F.lit(q), F.lit(0.0)), 3)
    return agg.withColumns(cols), list(cols)


def _smooth(spark, sf_dir, what):
    """(bands, smooth) of the frequency or severity curve; knot coefficients shrink by a penalty from GCV."""
    agg, numeric = _curve_data(spark, sf_dir)
    if what == "frequency":
        rows, cells = agg, CL.build(agg, "n", [], numeric, exposure="exposure")
    else:
        rows = agg.filter("n > 0 AND incurred > 0").withColumn("severity", F.col("incurred") / F.col("n"))
        cells = CL.build(rows, "severity", [], numeric, weight="n")
    return rows, SP.fit_smooth(cells, "poisson" if what == "frequency" else "gamma", [c for c in numeric if c[0] == "k"])


@register("curve_bands", """
SELECT round(round(ln(suminsured_prop) / 0.1) * 0.1, 9) AS x, sum(claimcount_prop)::BIGINT AS n,
       round(sum(exposure), 6) AS exposure
FROM policy_claims WHERE suminsured_prop > 0 GROUP BY 1""", ("policy_claims",))
def curve_bands(spark, sf_dir):
    """The bands of log sum insured that the smooth curves are fitted on."""
    return _curve_data(spark, sf_dir)[0].select("x", F.col("n").cast("long").alias("n"),
                                                F.round("exposure", 6).alias("exposure"))


@register("fit_curve")
def fit_curve(spark, sf_dir):
    """Smooth frequency curve over log sum insured: cubic regression spline
    (knots at quantiles) in a Poisson GLM with log exposure offset, the penalty of
    the knots by GCV; fitted frequency per band.  An approximation of a GAM."""
    rows, smooth = _smooth(spark, sf_dir, "frequency")
    out = smooth.fit.predict(rows, "fitted_n")
    return out.select("x", "n", "exposure", (F.col("fitted_n") / F.col("exposure")).alias("fitted_freq"))


@register("fit_curve_severity")
def fit_curve_severity(spark, sf_dir):
    """Smooth severity curve over log sum insured: the same spline in a Gamma
    GLM (log link) of the mean claim of each band, weighted by its claims."""
    rows, smooth = _smooth(spark, sf_dir, "severity")
    return smooth.fit.predict(rows, "fitted_severity").select("x", "n", "severity", "fitted_severity")


@register("curve_penalties")
def curve_penalties(spark, sf_dir):
    """Penalties tried for both curves: effective parameters, GCV and which is chosen."""
    rows = []
    for what in ("frequency", "severity"):
        _, smooth = _smooth(spark, sf_dir, what)
        rows += [(what, *r, r[0] == smooth.penalty) for r in smooth.table]
    return spark.createDataFrame(rows, "curve string, penalty double, parameters double, gcv double, chosen boolean")


@register("tariff_classes")
def tariff_classes(spark, sf_dir):
    """Tariff classes of log sum insured: an exposure-weighted regression
    tree on the smoothed frequency gives the split points; classes (a, b]."""
    curve = fit_curve(spark, sf_dir)
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=["x"], outputCol="f").transform(curve)
    bands = curve.count()                             # one row a band: every one may be a split
    dt = DecisionTreeRegressor(featuresCol="f", labelCol="fitted_freq", weightCol="exposure",
                               maxDepth=3, minInstancesPerNode=2, maxBins=max(32, bands)).fit(x)
    splits = sorted({float(s) for s in _thresholds(dt._call_java("rootNode"))})
    bounds = [-math.inf] + splits + [math.inf]
    from pyspark.ml.feature import Bucketizer
    b = Bucketizer(splits=bounds, inputCol="x", outputCol="cls").transform(curve)
    labels = F.array(*[F.lit(f"({bounds[i]:.2f}, {bounds[i + 1]:.2f}]") for i in range(len(bounds) - 1)])
    return b.groupBy("cls").agg(F.sum("exposure").alias("exposure"), F.sum("n").alias("n"),
                                F.min("x").alias("x_min"), F.max("x").alias("x_max")).withColumn(
        "interval", labels[F.col("cls").cast("int")])


def _thresholds(node):
    out = []
    if node.getClass().getSimpleName() == "InternalNode":
        out.append(node.split().threshold())
        out += _thresholds(node.leftChild()) + _thresholds(node.rightChild())
    return out


@register("burning_model")
def burning_model(spark, sf_dir):
    """Burning model: a Gamma GLM (log link, exposure weights) of the PREDICTED
    premium (fitted claims x fitted severity) on all versions; rating factors."""
    pc = S.policy_claims(spark, sf_dir)
    freq = M.fit_poisson(pc, "claimcount_prop", ["geo_code", "building_type", "sprinkler_type"])
    sev = M.fit_gamma(_sev_rows(pc), "severity", ["state", "building_type"], weight="claimcount_prop")
    scored = sev.predict(freq.predict(pc, "pred_claims"), "pred_severity").withColumn(
        "premium", F.col("pred_claims") * F.col("pred_severity"))
    fit = M.fit_gamma(scored, "premium", ["building_type", "sprinkler_type"], weight="exposure")
    return M.rating_factors(spark, {"burning": fit}, pc)


@register("save_model")
def save_model(spark, sf_dir):
    """Fitted Poisson model and its design written to the shared folder and
    read back; the reloaded model scores the same as the original."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import GeneralizedLinearRegressionModel
    from exposa.session import checkpoint_dir
    from exposa.sources.tables import save_model as save
    pc = S.policy_claims(spark, sf_dir)
    fit = M.fit_poisson(pc, "claimcount_prop", ["geo_code"])
    path = f"{checkpoint_dir(spark).rstrip('/')}/exposa-models/{app_id(spark)}/poisson"
    save(fit.model, path)
    fit.design.model.write().overwrite().save(path + "_design")
    m2 = GeneralizedLinearRegressionModel.load(path)
    d2 = PipelineModel.load(path + "_design")
    x = d2.transform(pc).withColumn("_log_exposure", F.log("exposure"))
    a = m2.transform(x).select(F.sum("prediction").alias("reloaded_sum"))
    b = fit.predict(pc, "p").select(F.sum("p").alias("original_sum"))
    return a.select("reloaded_sum", b.select("original_sum").scalar().alias("original_sum"),
                    F.lit(path).alias("path"))


@register("geo_grid_params", f"""
WITH c AS (
  SELECT grid_id, t_riskpostcode, t_sa3name, t_sa4name,
         count(DISTINCT CASE WHEN state IN ('ACT', 'NT') THEN state ELSE geo_code END) AS n_geo_code
  FROM {rollup3_sql(_PE_GRID, ("t_riskpostcode", "t_sa3name", "t_sa4name"), part="grid_id")}
  GROUP BY ALL)
SELECT c.n_geo_code, c.grid_id, c.t_riskpostcode AS first_threshold, c.t_sa4name AS last_threshold
FROM c JOIN (SELECT n_geo_code, min(grid_id) AS grid_id FROM c GROUP BY ALL) f
  USING (n_geo_code, grid_id)""", ("claims_geo",))
def geo_grid_params(spark, sf_dir):
    """Geo grid with its three thresholds nested into one struct column, and
    the first and last read back from it."""
    g = G.geo_grid(S.claims_geo(spark, sf_dir), _grid_rows(), weight="epy")
    p = G.pack_params(g, ["t_riskpostcode", "t_sa3name", "t_sa4name"])
    return p.select("n_geo_code", "grid_id", F.col("geo_code_param.t_riskpostcode").alias("first_threshold"),
                    F.col("geo_code_param.t_sa4name").alias("last_threshold"))


def _noise_sql(c):
    """Box-Muller normal from md5 of (seed, column, key, copy), as ``sampling.hash_normal``."""
    h = (f"md5(concat_ws('|', '123|{c}', policyno, CAST(situation_num AS VARCHAR), "
         "CAST(policy_version AS VARCHAR), CAST(copy AS VARCHAR)))")
    u = [f"CAST(CAST('0x' || substr({h}, {a}, 13) AS BIGINT) AS DOUBLE)" for a in (1, 14)]
    return (f"sqrt(-2.0 * ln(({u[0]} + 0.5) / 4503599627370496.0)) * "
            f"cos(2.0 * 3.141592653589793 * ({u[1]} / 4503599627370496.0))")


@register("rose_balance", f"""
WITH v AS (SELECT *, claimcount_lossofinc > 0 AS has_claim FROM policy_claims
           WHERE suminsured_prop > 0 AND suminsured_lossofinc > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY has_claim ORDER BY
               md5(concat_ws('|', '123', policyno, CAST(situation_num AS VARCHAR), CAST(policy_version AS VARCHAR)))) AS rk,
             count(*) OVER (PARTITION BY has_claim) AS n, floor(count(*) OVER () / 2) AS half,
             stddev_samp(exposure) OVER (PARTITION BY has_claim) AS sd_e,
             stddev_samp(suminsured_prop) OVER (PARTITION BY has_claim) AS sd_s FROM v),
c AS (SELECT *, unnest(generate_series(0, greatest(CAST(ceil(half / n) AS BIGINT), 1) - 1)) AS copy FROM r),
k AS (SELECT * FROM c WHERE copy * n + rk <= half)
SELECT has_claim, count(*) AS n_rows,
       round(avg(exposure + {_noise_sql("exposure")} * pow(4.0 / (4 * n), 1.0 / 6) * sd_e), 6) AS mean_exposure,
       round(avg(suminsured_prop + {_noise_sql("suminsured_prop")} * pow(4.0 / (4 * n), 1.0 / 6) * sd_s), 3)
         AS mean_suminsured_prop
FROM k GROUP BY has_claim""", ("policy_claims",))
def rose_balance(spark, sf_dir):
    """ROSE-style smoothed bootstrap of the loss-of-income claim classes
    (balanced sample; numeric columns jittered); class counts and means."""
    v = C.split_by_cover(S.policy_claims(spark, sf_dir), True)
    r = SM.rose(v, "has_claim", ["exposure", "suminsured_prop"], _KEY, seed=123)
    return r.groupBy("has_claim").agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.round(F.avg("exposure"), 6).alias("mean_exposure"),
                                      F.round(F.avg("suminsured_prop"), 3).alias("mean_suminsured_prop"))


@register("minmax_invert", f"""
WITH s AS ({_split_sql("policy_claims", "LossofIncome_cover", 0.8, 123)}),
b AS (SELECT min(suminsured_prop) AS lo, max(suminsured_prop) AS hi FROM s WHERE split = 'train')
SELECT policyno, situation_num, policy_version,
       round((suminsured_prop - lo) / (hi - lo) * (hi - lo) + lo, 4) AS pred_original_scale
FROM s, b WHERE split = 'test'""", ("policy_claims",))
def minmax_invert(spark, sf_dir):
    """Predictions made on the min-max scale (scaled test sums insured used as
    a stand-in prediction) mapped back with the TRAINING bounds."""
    from exposa.operators.prep import MinMax
    sp = _split(spark, sf_dir)
    mm = MinMax(["suminsured_prop"]).fit(sp.filter("split = 'train'"))
    te = mm.transform(sp.filter("split = 'test'")).withColumn("pred_scaled", F.col("suminsured_prop"))
    back = mm.invert(te, "pred_scaled", "suminsured_prop")
    return back.select(*_KEY, F.round("pred_scaled", 4).alias("pred_original_scale"))


@register("coef_smoothing")
def coef_smoothing(spark, sf_dir, step=0.5):
    """Rating factors of the tariff classes of log sum insured smoothed by an
    exposure-weighted quadratic in the class midpoints, read off at new breaks
    (every ``step``); the smoothed factors become a fixed offset (added to the
    log exposure) of a refit on the other factors.  Rows: the old classes with
    estimate and smooth value, the new ones with the smooth value, and the
    refit's factors."""
    from pyspark.ml.feature import Bucketizer, VectorAssembler
    classes = tariff_classes(spark, sf_dir).select("cls", "x_min", "x_max").collect()
    bounds = sorted({r["x_min"] for r in classes})[1:]
    pc = S.policy_claims(spark, sf_dir).filter("suminsured_prop > 0").withColumn("x", F.log("suminsured_prop"))
    pc = Bucketizer(splits=[-math.inf] + bounds + [math.inf], inputCol="x", outputCol="cls").transform(pc) \
        .withColumn("cls", F.col("cls").cast("int").cast("string"))
    fit = M.fit_poisson(pc, "claimcount_prop", ["cls", "building_type"])
    rf = M.rating_factors(spark, {"glm": fit}, pc).filter("factor = 'cls'")
    mid = pc.groupBy("cls").agg(F.avg("x").alias("mid"))
    t = rf.join(mid, F.col("level") == F.col("cls")).withColumns({
        "log_rf": F.log("rf_glm"), "mid2": F.col("mid") ** 2})
    lr = LinearRegression(featuresCol="v", labelCol="log_rf", weightCol="exposure", solver="normal")
    m = lr.fit(VectorAssembler(inputCols=["mid", "mid2"], outputCol="v").transform(t))
    (b1, b2), b0 = map(float, m.coefficients), float(m.intercept)
    smooth = lambda x: F.exp(F.lit(b0) + b1 * x + b2 * x * x)
    low = F.floor(F.col("x") / step) * step                         # new breaks
    again = pc.withColumn("new_mid", low + step / 2).withColumn(
        "exposure_smooth", F.col("exposure") * smooth(F.col("new_mid")))
    refit = M.fit_poisson(again, "claimcount_prop", ["building_type"], exposure="exposure_smooth")
    old = t.select(F.lit("class").alias("part"), "level", "mid", F.col("rf_glm").alias("rf"),
                   smooth(F.col("mid")).alias("rf_smooth"), "exposure")
    new = again.groupBy("new_mid").agg(F.sum("exposure").alias("exposure")).select(
        F.lit("new class").alias("part"), F.col("new_mid").cast("string").alias("level"),
        F.col("new_mid").alias("mid"), F.lit(None).cast("double").alias("rf"),
        smooth(F.col("new_mid")).alias("rf_smooth"), "exposure")
    rest = M.rating_factors(spark, {"refit": refit}, pc).select(
        F.lit("refit").alias("part"), "level", F.lit(None).cast("double").alias("mid"),
        F.col("rf_refit").alias("rf"), F.lit(None).cast("double").alias("rf_smooth"), "exposure")
    return old.unionByName(new).unionByName(rest)
