"""Registered queries: the study's GLMs fitted many at a time on design cells.

The model grid over geo encodings, Tweedie premiums with the power from the
profile, their interaction, and the logistic model of a BI claim.  The fits
are iterative, so they have no SQL oracle; tests/test_cells.py and
tests/test_study_fits.py hold their numbers against numpy and single fits.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from exposa.models import cells as CL
from exposa.models import interaction as IA
from exposa.models import metrics as MT
from exposa.operators import geo as G
from exposa.operators import grouping as GR
from exposa.operators import sampling as SM
from exposa.plans import stages as S
from exposa.plans.q_geo import _KEY, _grid_rows
from exposa.plans.registry import register
from exposa.session import app_id

# The study's formulas: log(sum insured) and these factors, and a geo code.
RISK = ["building_age", "building_type", "construction_walls", "construction_floor", "sprinkler_type",
        "occupation_risk"]
POWERS = (1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9)

_FITS: dict = {}


def _once(spark, sf_dir, name, build):
    """Coefficients of a fit are made once per (application, data)."""
    key = (app_id(spark), sf_dir.rstrip("/"), name)
    if key not in _FITS:
        _FITS[key] = build()
    return _FITS[key]


# ---- model grid over geo encodings (second path)

# line -> (factors, rows, claim indicator)
_GRID_LINES = {
    "prop": (RISK, "suminsured_prop > 0", "claimcount_prop > 0"),
    "lossofinc": (["occupation_risk"], "LossofIncome_cover AND suminsured_lossofinc > 0", "grossincurred_lossofinc > 0")}


def grid_encodings(policies, grid_rows) -> tuple[dict[str, dict[str, str]], dict[str, int]]:
    """Encoding name -> (postcode -> code), and -> number of codes: every distinct map of the grid, named by its
    first grid row.  A line a postcode and encoding reaches the driver, whatever the policies."""
    maps = G.geo_grid_maps(policies, grid_rows, weight="exposure").checkpoint()
    codes = G.one_code(maps, ["grid_id"])
    counts = maps.groupBy("grid_id").agg(F.count_distinct("geo_code").alias("n_geo_code"))
    line = F.to_json(F.struct("riskpostcode", "geo_code"))
    digests = codes.groupBy("grid_id").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("map"))
    first = counts.join(digests, "grid_id").groupBy("n_geo_code", "map").agg(F.min("grid_id").alias("grid_id"))
    sizes = {str(r["grid_id"]): r["n_geo_code"] for r in first.collect()}
    levels: dict[str, dict[str, str]] = {g: {} for g in sizes}
    for r in codes.filter(F.col("grid_id").isin([int(g) for g in sizes])).collect():
        levels[str(r["grid_id"])][r["riskpostcode"]] = r["geo_code"]
    return levels, sizes


def grid_parts(policies, rows: str, claim: str):
    """Policies of a line as parts analysis / assess / test: 80 % for training, and 80 % of that
    for the fits, both stratified by whether there is a claim."""
    own = policies.filter(rows).withColumn("has_claim", F.expr(claim))
    split = SM.stratified_split(own, 0.8, ["has_claim"], _KEY, 123)
    inner = SM.stratified_split(split.filter("split = 'train'").drop("split"), 0.8, ["has_claim"], _KEY, 321)
    return inner.withColumn("part", F.when(F.col("split") == "train", "analysis").otherwise("assess")).drop("split") \
        .unionByName(split.filter("split = 'test'").withColumn("part", F.col("split")).drop("split"))


def score_encodings(policies, encodings, line: str):
    """(encoding, family) -> (fit, assessment error, test error, rows): Poisson and NB per encoding,
    all advanced in the same passes over the design cells."""
    factors, rows, claim = _GRID_LINES[line]
    x = f"log_suminsured_{line}"
    own = grid_parts(policies, rows, claim).withColumn(x, F.log(f"suminsured_{line}"))
    cells = CL.build(own, f"claimcount_{line}", factors, [x], exposure="exposure", weight="date_weights", part="part",
                     fit_part="analysis", key=["riskpostcode", "state"], encodings=encodings, base=F.col("exposure"))
    specs = [CL.Spec(f"{e}|{fam}", fam, encoding=e) for e in encodings for fam in ("poisson", "negbin")]
    fits = CL.fit(cells, specs)
    errors = {part: CL.squared_errors(cells, fits, part) for part in ("assess", "test")}
    rmse = lambda part, name: math.sqrt(errors[part][name][0] / errors[part][name][1]) \
        if name in errors[part] else None
    return {(s.encoding, s.family): (fits[s.name], rmse("assess", s.name), rmse("test", s.name)) for s in specs}


@register("score_geo_grid")
def score_geo_grid(spark, sf_dir):
    """Poisson and negative-binomial frequency models of every distinct geo encoding, both
    lines, with the study's factors, recency weights and exposure offset; the family with
    the lesser assessment RMSE, and its RMSE on the untouched test rows.  Fits are not rebalanced:
    that would bias the level of a count model.

    One row a line and number of codes, of the first grid row with that number (the study's choice);
    ``encodings`` holds the scores of every distinct encoding with that number, the least RMSE first."""
    policies = S.policy_claims_second(spark, sf_dir)
    encodings, sizes = grid_encodings(policies, _grid_rows())
    out = []
    for line in _GRID_LINES:
        scored = score_encodings(policies, encodings, line)
        rows: dict[int, list] = {}
        for e in sorted(encodings, key=int):
            by = {fam: scored[e, fam] for fam in ("poisson", "negbin")}
            known = [fam for fam in by if by[fam][1] is not None]
            best = min(known, key=lambda fam: (by[fam][1], fam), default=None)
            rows.setdefault(sizes[e], []).append(
                (int(e), best, by[best][1] if best else None, by["poisson"][1], by["negbin"][1],
                 by[best][2] if best else None, float(by["negbin"][0].theta),
                 by["poisson"][0].converged and by["negbin"][0].converged))
        for n, of in rows.items():
            ranked = sorted(of, key=lambda r: (math.inf if r[2] is None else r[2], r[0]))
            out.append((line, of[0][0], n, *of[0][1:], ranked))
    scores = "family string, rmse double, rmse_poisson double, rmse_negbin double, test_rmse double, theta double, " \
             "converged boolean"
    grid = spark.createDataFrame(out, f"line string, grid_id int, n_geo_code bigint, {scores}, "
                                      f"encodings array<struct<grid_id int, {scores}>>")
    return grid.orderBy("line", "rmse", "grid_id")


@register("fit_severity_second")
def fit_severity_second(spark, sf_dir):
    """Gamma severity model of the second path: incurred amounts of property versions with a claim,
    log exposure offset, state and risk factors with levels under a quarter of the rows pooled."""
    own = S.policy_claims_second(spark, sf_dir).filter("suminsured_prop > 0 AND grossincurred_prop > 0")
    split = SM.stratified_split(own.withColumn("all", F.lit(1)), 0.8, ["all"], _KEY, 123)
    factors = ["state", *RISK]
    pooled = GR.pool_rare(split.filter("split = 'train'"), factors, 0.25)
    for c, levels in pooled.items():
        split = GR.recode(split, c, levels)
    x = "log_suminsured_prop"
    cells = CL.build(split.withColumn(x, F.log("suminsured_prop")), "grossincurred_prop", factors, [x],
                     exposure="exposure", weight="date_weights", part="split", fit_part="train")
    return _coefficients(spark, {"gamma": CL.fit(cells, [CL.Spec("gamma", "gamma")])["gamma"]})


def _coefficients(spark, fits: dict):
    """(model, term, estimate, std_error) of every coefficient."""
    rows = []
    for name, f in fits.items():
        error = f.covariance().diagonal()
        rows += [(name, t, float(b), math.sqrt(max(v, 0.0))) for t, b, v in zip(f.names, f.beta, error, strict=True)]
    return spark.createDataFrame(rows, "model string, term string, estimate double, std_error double")


# ---- Tweedie premiums

_TWEEDIE_COLS = ["covered", "total", "grossincurred_prop", "grossincurred_lossofinc", "log_suminsured_prop",
                 "log_suminsured_lossofinc", "date_weights", "exposure", "geo_code", *RISK]


def tweedie_split(policies):
    """Test rows (a fifth) and the others, stratified by the BI cover; regressors and total loss on each."""
    own = policies.filter("suminsured_prop > 0")
    return SM.stratified_split(own, 0.8, ["LossofIncome_cover"], _KEY, 123).withColumns({
        "log_suminsured_prop": F.log("suminsured_prop"),
        "log_suminsured_lossofinc": F.log(F.greatest("suminsured_lossofinc", F.lit(1.0))),
        "covered": F.col("LossofIncome_cover") & (F.col("suminsured_lossofinc") > 0),
        "total": F.col("grossincurred_prop") + F.col("grossincurred_lossofinc")}) \
        .select("split", *_KEY, "LossofIncome_cover", *_TWEEDIE_COLS)


def tweedie_parts(split):
    """Parts of the rows of a ``tweedie_split``: test, rows kept back for the interaction (a quarter of the rest)
    and training rows, stratified by the BI cover."""
    inner = SM.stratified_split(split.filter("split = 'train'").drop("split"), 0.75, ["LossofIncome_cover"], _KEY, 321)
    both = inner.withColumn("part", F.when(F.col("split") == "train", "train").otherwise("interaction")) \
        .unionByName(split.filter("split = 'test'").withColumn("part", F.lit("test")))
    return both.select("part", *_TWEEDIE_COLS)


def tweedie_line(rows, line: str, exposure: str | None = None, powers=POWERS) -> dict:
    """Profile of one line's training rows (unweighted, as the study runs it) and the fit at its best
    power with recency weights.  ``exposure``: offset of both, none by default."""
    own = rows.filter("part = 'train'").filter("covered" if line == "lossofinc" else "true")
    cells = CL.build(own, f"grossincurred_{line}", ["geo_code", *RISK], [f"log_suminsured_{line}"], exposure=exposure,
                     weight="date_weights")
    with cells.held():
        profile = CL.tweedie_profile(cells, powers)
        best = max(profile, key=lambda r: (r["loglik"], -r["power"]))["power"]
        return {"profile": profile, "power": best,
                "fit": CL.fit(cells, [CL.Spec("tweedie", "tweedie", power=best)])["tweedie"]}


def _tweedie(spark, sf_dir):
    def build():
        # each split is written before the next reads it, in the columns that the fits need
        split = S.stage(spark, sf_dir, "tweedie_split", lambda: tweedie_split(S.policy_claims(spark, sf_dir)))
        rows = S.stage(spark, sf_dir, "tweedie_parts", lambda: tweedie_parts(split))
        return rows, {line: tweedie_line(rows, line) for line in ("prop", "lossofinc")}
    return _once(spark, sf_dir, "tweedie", build)


@register("tweedie_profile")
def tweedie_profile(spark, sf_dir):
    """Profile log-likelihood of the Tweedie power over 1.1 .. 1.9 for both lines, study formula."""
    _, lines = _tweedie(spark, sf_dir)
    rows = [(line, r["power"], r["phi"], r["loglik"], r["aic"], r["power"] == t["power"])
            for line, t in lines.items() for r in t["profile"]]
    return spark.createDataFrame(rows, "line string, power double, phi double, loglik double, aic double, best boolean")


@register("fit_tweedie_premium")
def fit_tweedie_premium(spark, sf_dir):
    """Tweedie premium models of both lines at the power that their profile chooses: coefficients,
    standard errors and rating factors."""
    _, lines = _tweedie(spark, sf_dir)
    power = F.create_map(*[F.lit(v) for line, t in lines.items() for v in (line, t["power"])])
    return _coefficients(spark, {line: t["fit"] for line, t in lines.items()}).withColumnRenamed("model", "line") \
        .withColumns({"rf": F.exp("estimate"), "power": power[F.col("line")]})


def tweedie_interaction(rows, lines: dict) -> dict:
    """Interaction of the two premiums, fitted on the rows kept back, with errors on the test rows."""
    scored = lines["lossofinc"]["fit"].predict(lines["prop"]["fit"].predict(rows.filter("part <> 'train'"), "prop"), "bi")
    scored = scored.withColumn("bi", F.when(F.col("covered"), F.col("bi")).otherwise(F.lit(0.0)))
    return IA.premium_interaction(IA.premium_moments(scored, "prop", "bi", "total", "part", "covered"),
                                  "interaction", "test")


@register("interaction_tweedie")
def interaction_tweedie(spark, sf_dir):
    """total ~ prop + bi + prop:bi, and total - prop - bi ~ bi:prop on covered rows, of out-of-sample
    Tweedie premiums (BI 0 outside its cover); all from one table of moments."""
    got = _once(spark, sf_dir, "interaction", lambda: tweedie_interaction(*_tweedie(spark, sf_dir)))
    rows = [("total", t, float(b)) for t, b in zip(("(Intercept)", "prop", "bi", "prop:bi"), got["total"], strict=True)]
    rows += [("residual", t, float(b)) for t, b in zip(("(Intercept)", "bi:prop"), got["residual"], strict=True)]
    return spark.createDataFrame(rows, "model string, term string, estimate double")


@register("tweedie_error")
def tweedie_error(spark, sf_dir):
    """Test RMSE of total loss: both premiums alone, with the interaction, and the joint model."""
    got = _once(spark, sf_dir, "interaction", lambda: tweedie_interaction(*_tweedie(spark, sf_dir)))
    return spark.createDataFrame([(m, got["n"], v) for m, v in got["rmse"].items()],
                                 "prediction string, n bigint, rmse double")


# ---- logistic model of a BI claim (second path)

def logistic_parts(policies, ratio: float = 10.0):
    """(training rows down-sampled to ``ratio`` without a claim per claim, untouched test rows)."""
    own = policies.filter("LossofIncome_cover AND suminsured_lossofinc > 0").withColumns({
        "has_claim": F.col("grossincurred_lossofinc") > 0, "log_suminsured_lossofinc": F.log("suminsured_lossofinc")})
    split = SM.stratified_split(own, 0.8, ["has_claim"], _KEY, 123)
    train = SM.downsample(split.filter("split = 'train'").drop("split"), "has_claim", _KEY, ratio)
    return train, split.filter("split = 'test'")


def logistic_fit(train) -> CL.Fit:
    """Chance of a claim by log sum insured and occupation (base: the one with most exposure)."""
    cells = CL.build(train.withColumn("y", F.col("has_claim").cast("double")), "y", ["occupation_risk"],
                     ["log_suminsured_lossofinc"], weight="date_weights", base=F.col("exposure"))
    return CL.fit(cells, [CL.Spec("logit", "binomial")])["logit"]


def _logistic(spark, sf_dir):
    def build():
        train, test = logistic_parts(S.policy_claims_second(spark, sf_dir))
        return logistic_fit(train), test
    return _once(spark, sf_dir, "logistic", build)


@register("logistic_claim")
def logistic_claim(spark, sf_dir):
    """AUC and sensitivity of the logistic BI claim model on untouched test rows."""
    fit, test = _logistic(spark, sf_dir)
    scored = fit.predict(test, "score").select("score", F.col("has_claim").alias("y"))
    sens = MT.sensitivity(scored, "score", "y", 0.5)
    return MT.roc_auc(scored, "score", "y").select(
        "auc", "n_pos", "n_neg", sens.select("sensitivity").scalar().alias("sensitivity"))


@register("logistic_coefficients")
def logistic_coefficients(spark, sf_dir):
    """Estimates with standard errors, z and two-sided p of the logistic BI claim model."""
    fit, _ = _logistic(spark, sf_dir)
    z = F.col("estimate") / F.col("std_error")
    rows = [(float(abs(b)) / math.sqrt(v) if v > 0 else math.nan) for b, v in
            zip(fit.beta, fit.covariance().diagonal(), strict=True)]
    p = dict(zip(fit.names, [math.erfc(v / math.sqrt(2)) for v in rows], strict=True))
    of = F.create_map(*[F.lit(v) for kv in p.items() for v in kv])
    return _coefficients(spark, {"logit": fit}).drop("model").withColumns({"z": z, "p_value": of[F.col("term")]})
