"""GLMs on Spark ML: Poisson / Gamma / Tweedie / Gaussian with log link,
offsets and prior weights; predictions, rating factors, importance, fit
statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposa.models.design import Design, build_design


@dataclass
class GLMFit:
    family: str
    response: str
    design: Design
    model: object                    # GeneralizedLinearRegressionModel or own
    offset: str | None = None
    weight: str | None = None
    variance_power: float | None = None
    n: int | None = None
    scale: float = 1.0               # response was fitted as y / scale

    @property
    def coefficients(self) -> dict[str, float]:
        out = {"(Intercept)": float(self.model.intercept) + math.log(self.scale)}
        out.update(zip(self.design.names, map(float, self.model.coefficients)))
        return out

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Response-scale prediction (offset included)."""
        keep = [c for c in df.columns if c != self.offset]
        if self.offset and self.offset not in df.columns:
            df = df.withColumn(self.offset, F.log(F.col(self._exposure)))
        res = self.model.transform(self.design.transform(df))
        return res.select(*keep, (F.col(self.model.getPredictionCol()) * F.lit(self.scale)).alias(out))


def _with_offset(df: DataFrame, exposure: str | None, offset_col: str = "_log_exposure"):
    if exposure is None:
        return df, None
    return df.withColumn(offset_col, F.log(F.col(exposure))), offset_col


def fit_glm(df: DataFrame, response: str, factors: Sequence[str], family: str = "poisson",
            numeric: Sequence[str] = (), exposure: str | None = None, weight: str | None = None,
            variance_power: float | None = None, link: str = "log", reg: float = 0.0,
            max_iter: int = 50, level_weight: str | None = None) -> GLMFit:
    """IRLS fit by Spark's GeneralizedLinearRegression (normal equations are
    a distributed tree-aggregate of X'WX; fine up to 4096 features)."""
    d, off = _with_offset(df, exposure)
    design = build_design(d, factors, numeric, weight=level_weight or exposure)
    x = design.transform(d)
    scale = 1.0
    label = response
    if family in ("tweedie", "gamma"):
        # Large money responses make Spark's IRLS weights underflow; a log
        # link is scale-equivariant, so fit y / mean(y) and shift back.
        m = x.select(F.avg(F.col(response))).first()[0]
        scale = float(m) if m and m > 0 else 1.0
        label = "_y_scaled"
        x = x.withColumn(label, F.col(response) / F.lit(scale))
    kw = dict(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=reg,
              tol=1e-8)
    if family == "tweedie":
        glr = GeneralizedLinearRegression(family="tweedie", variancePower=variance_power or 1.5,
                                          linkPower=0.0, **kw)
    else:
        glr = GeneralizedLinearRegression(family=family, link=link, **kw)
    if off:
        glr.setOffsetCol(off)
    if weight:
        glr.setWeightCol(weight)
    # the solver reads its rows once a step: keep what it reads, and not the rows' whole making
    used = [c for c in ("features", label, off, weight) if c]
    rows = x.select(*dict.fromkeys(used)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = glr.fit(rows)
    finally:
        rows.unpersist()
    fit = GLMFit(family, response, design, model, off, weight, variance_power, scale=scale)
    fit._exposure = exposure
    return fit


def fit_poisson(df, response, factors, exposure="exposure", weight=None, **kw) -> GLMFit:
    """Frequency: log link, offset log(exposure), prior weight (recency)."""
    return fit_glm(df, response, factors, "poisson", exposure=exposure, weight=weight, **kw)


def fit_gamma(df, response, factors, weight=None, **kw) -> GLMFit:
    """Severity: log link on rows with claims only."""
    return fit_glm(df, response, factors, "gamma", weight=weight, **kw)


def fit_tweedie(df, response, factors, power: float = 1.5, exposure=None, weight=None,
                **kw) -> GLMFit:
    """Pure premium: log link (linkPower 0), variance power ``power``."""
    return fit_glm(df, response, factors, "tweedie", exposure=exposure, weight=weight,
                   variance_power=power, **kw)


def add_prediction(df: DataFrame, fits: dict[str, GLMFit]) -> DataFrame:
    """Append pred_<response>_<name> for every fit (response scale)."""
    out = df
    for name, fit in fits.items():
        if fit._exposure and "_log_exposure" not in out.columns:
            out = out.withColumn("_log_exposure", F.log(F.col(fit._exposure)))
        out = fit.predict(out, f"pred_{fit.response}_{name}")
    return out.drop("_log_exposure") if "_log_exposure" in out.columns else out


def rating_factors(spark: SparkSession, fits: dict[str, GLMFit],
                   exposure_df: DataFrame | None = None, exposure: str = "exposure") -> DataFrame:
    """(factor, level, rf_<model>...): exp(coefficient); base level = 1.
    Small table built from coefficients; exposure per level joined on."""
    rows = {}
    for name, fit in fits.items():
        coef = fit.coefficients
        for f in fit.design.factors:
            lv = fit.design.labels[f]
            for i, v in enumerate(lv):
                key = (f, v)
                rows.setdefault(key, {})[name] = 1.0 if i == 0 else math.exp(coef[f"{f}_{v}"])
    names = list(fits)
    data = [(f, v, *[rows[(f, v)].get(n) for n in names]) for (f, v) in rows]
    schema = "factor string, level string, " + ", ".join(f"rf_{n} double" for n in names)
    tab = spark.createDataFrame(data, schema)
    if exposure_df is not None:
        factors = sorted({f for f, _ in rows})
        pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level"))
                          for f in factors])
        ex = (exposure_df.select(F.explode(pairs).alias("p"), exposure).select("p.*", exposure)
              .groupBy("factor", "level").agg(F.sum(exposure).alias("exposure")))
        tab = tab.join(ex, ["factor", "level"], "left")
    return tab


def glm_importance(spark: SparkSession, fit: GLMFit, top: int | None = 10) -> DataFrame:
    """|t value| per coefficient, largest first (top n)."""
    s = fit.model.summary
    names = ["(Intercept)"] + fit.design.names if fit.model.getFitIntercept() else fit.design.names
    tv = list(s.tValues)
    # Spark lists the intercept LAST in summary arrays.
    if fit.model.getFitIntercept():
        tv = [tv[-1]] + tv[:-1]
    rows = [(n, abs(float(t))) for n, t in zip(names, tv) if n != "(Intercept)"]
    df = spark.createDataFrame(rows, "term string, importance double").orderBy(
        F.desc("importance"), "term")
    return df.limit(top) if top else df


def model_performance(spark: SparkSession, fits: dict, rmse: dict[str, float] | None = None,
                      likelihoods: dict[str, tuple[float, int, int]] | None = None) -> DataFrame:
    """AIC, BIC and RMSE.  ``likelihoods``: (log-likelihood, parameters, rows) of the models
    that Spark's summary has none for (Tweedie, negative binomial)."""
    rows = []
    for name, fit in fits.items():
        if name in (likelihoods or {}):
            ll, k, n = likelihoods[name]
            rows.append((name, -2 * ll + 2 * k, -2 * ll + k * math.log(n), (rmse or {}).get(name)))
            continue
        s = fit.model.summary
        k = s.rank + (1 if fit.family in ("gamma", "gaussian") else 0)
        aic, n = float(s.aic), s.numInstances
        bic = aic - 2 * k + k * math.log(n)
        rows.append((name, aic, bic, (rmse or {}).get(name)))
    return spark.createDataFrame(rows, "model string, aic double, bic double, rmse double")
