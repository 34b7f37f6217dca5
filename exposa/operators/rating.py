"""Rating tables: univariate risk statistics per level (one scan each)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.functions.expr import money_sum, safe_div


def _ratios(nclaims: bool, severity: bool, premium: bool) -> dict[str, Column]:
    out = {"frequency": safe_div("nclaims", "exposure")}
    if severity:
        out["average_severity"] = safe_div("amount", "nclaims")
        out["risk_premium"] = safe_div("amount", "exposure")
    if premium:
        if severity:
            out["loss_ratio"] = safe_div("amount", "premium")
        out["average_premium"] = safe_div("premium", "exposure")
    return out


def univariate(df: DataFrame, x: str | Sequence[str], nclaims: str, exposure: str,
               severity: str | None = None, premium: str | None = None,
               by: str | None = None) -> DataFrame:
    """Per level of ``x`` (and ``by``): sums and ratios.

    Columns: nclaims, exposure, [amount], [premium], frequency,
    [average_severity, risk_premium], [loss_ratio], [average_premium].
    """
    keys = [x] if isinstance(x, str) else list(x)
    if by:
        keys.append(by)
    aggs = [F.sum(nclaims).cast("double").alias("nclaims"),
            F.sum(exposure).alias("exposure")]
    if severity:
        aggs.append(money_sum(severity).alias("amount"))
    if premium:
        aggs.append(money_sum(premium).alias("premium"))
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumns(_ratios(True, severity is not None, premium is not None))


def univariate_all(df: DataFrame, factors: Sequence[str], nclaims: str, exposure: str,
                   severity: str | None = None, premium: str | None = None) -> DataFrame:
    """Univariate tables of many factors in ONE scan, long form
    (factor, level, ...): each row is expanded to one (factor, level) per
    factor and aggregated once (grouping-sets style, map-side combined)."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level"))
                      for f in factors])
    vals = [nclaims, exposure] + [c for c in (severity, premium) if c]
    long = df.select(F.explode(pairs).alias("_p"), *vals).select("_p.*", *vals)
    return univariate(long, ["factor", "level"], nclaims, exposure, severity, premium)


def hot_levels(table: DataFrame, level: str, stat: str, min_stat: float = 50000.0,
               min_exposure: float = 5.0) -> DataFrame:
    """Levels with ``stat`` above ``min_stat`` and exposure above the floor."""
    return (table.filter((F.col(stat) > min_stat) & (F.col("exposure") > min_exposure))
            .orderBy(F.desc(stat), level))


def level_rate_predictions(df: DataFrame, factor: str, y: str, exposure: str,
                           out: str = "mu") -> DataFrame:
    """Fitted mean of a one-factor log-link Poisson GLM with log(exposure)
    offset, in closed form: mu = exposure * sum(y) / sum(exposure) of the
    level.  (Aggregate per level, then equi-join back.)"""
    rate = df.groupBy(factor).agg((F.sum(y) / F.sum(exposure)).alias("_rate"))
    return df.join(rate, factor, "left").withColumn(out, F.col(exposure) * F.col("_rate")).drop("_rate")


def check_overdispersion(df: DataFrame, y: str, mu: str, n_params: int) -> DataFrame:
    """Pearson chi-square of a Poisson fit: chi2, residual df, ratio and the
    flag ratio > 1 (one aggregation)."""
    one = df.filter(F.col(mu) > 0).agg(
        F.sum(F.pow(F.col(y) - F.col(mu), 2) / F.col(mu)).alias("chi2"),
        F.count(F.lit(1)).alias("n"))
    return one.select("chi2", (F.col("n") - n_params).alias("df")).withColumns({
        "ratio": F.col("chi2") / F.col("df")}).withColumn("overdispersed", F.col("ratio") > 1)


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution (regularised gamma Q(k/2, x/2)).
    One number on the driver: Spark SQL has no gamma CDF."""
    import math
    a, z = k / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    if z < a + 1:  # series for P
        term = s = 1.0 / a
        n = a
        for _ in range(10000):
            n += 1
            term *= z / n
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b, c, d = z + 1 - a, 1e300, 1.0 / (z + 1 - a)  # continued fraction for Q
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h


def pure_premium(df: DataFrame, freq: str = "pred_freq", sev: str = "pred_sev",
                 out: str = "pure_premium") -> DataFrame:
    """Pure premium = predicted frequency x predicted severity."""
    return df.withColumn(out, F.col(freq) * F.col(sev))
