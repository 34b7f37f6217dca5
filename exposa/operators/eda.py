"""Exploratory statistics as aggregate tables (what the study's charts show).

Every table is a few partial aggregations; quantiles are exact and split large
groups over partitions (``exact_quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.functions.expr import count_if, join_null_safe, mean_strict, safe_div
from exposa.operators.quantiles import exact_quantiles
from exposa.operators.windows import first_row, last_row
from exposa.session import checkpoint_dir


_LATEST = ["expirydate", "riskpostcode", "state", "building_type", "sprinkler_type", "occupation"]


def _situation_aggs():
    """Any cover, earliest effect date, and the details of the latest row
    (latest version dates, then month; of rows equal in these, the least
    details): all partial aggregates on the situation key."""
    rank = [(-F.coalesce(c.cast("long"), F.lit(-(1 << 40)))) for c in
            (F.unix_date("effectdate"), F.unix_date("expirydate"), F.col("ym"), F.col("xm"))]
    details = [x for c in _LATEST for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c).alias(c))]
    latest = F.min(F.struct(*[r.alias(f"_r{i}") for i, r in enumerate(rank)], *details))
    return [F.bool_or("LossofIncome_cover").alias("LossofIncome_cover"),
            F.min("effectdate").alias("effectdate"), latest.alias("_latest")]


def latest_situation(df: DataFrame) -> DataFrame:
    """Per (policyno, situation_num): any cover, earliest effect date, and
    the details of the latest row (latest version dates, then month)."""
    keys = ["policyno", "situation_num"]
    return df.groupBy(*keys).agg(*_situation_aggs()).select(
        *keys, "LossofIncome_cover", "effectdate", *[F.col(f"_latest.{c}").alias(c) for c in _LATEST])


def situation_history(df: DataFrame) -> DataFrame:
    """Per (policyno, situation_num): claim count, total, average (NULL if
    no claim) and median sum insured per line, plus the latest situation.
    One aggregation, and one pass for the medians of both lines."""
    keys = ["policyno", "situation_num"]
    aggs = []
    for ln in ("lossofinc", "prop"):
        a = F.col(f"grossincurred_{ln}")
        aggs += [count_if(a > 0).alias(f"n_claims_{ln}"),
                 F.coalesce(F.sum(a), F.lit(0.0)).alias(f"total_grossincurred_{ln}")]
    h = df.groupBy(*keys).agg(*aggs, *_situation_aggs())
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(ln).alias("line"), F.col(f"suminsured_{ln}").alias("si"))
        for ln in ("lossofinc", "prop")])).alias("s")).select(*keys, "s.*")
    m = exact_quantiles(long, [*keys, "line"], "si", [0.5]).groupBy(*keys).agg(*[
        F.max(F.when(F.col("line") == ln, F.col("quantiles")[0])).alias(f"median_SI_{ln}")
        for ln in ("lossofinc", "prop")])
    h = join_null_safe(h, m, keys, "left")
    out = []
    for ln in ("lossofinc", "prop"):
        out += [f"n_claims_{ln}", f"total_grossincurred_{ln}", f"median_SI_{ln}"]
    avg = [safe_div(f"total_grossincurred_{ln}", f"n_claims_{ln}").alias(f"avgincurred_{ln}")
           for ln in ("lossofinc", "prop")]
    return h.select(*keys, *out, *avg, "LossofIncome_cover", "effectdate",
                    *[F.col(f"_latest.{c}").alias(c) for c in _LATEST])


def factor_experience(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(factor, level): n_obs, mean claim size per line over versions with a
    claim, mean claim count per line.  All factors in ONE scan."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level"))
                      for f in factors])
    vals = ["grossincurred_prop", "claimcount_prop", "grossincurred_lossofinc",
            "claimcount_lossofinc"]
    long = df.select(F.explode(pairs).alias("_p"), *vals).select("_p.*", *vals)
    return long.groupBy("factor", "level").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.avg(safe_div("grossincurred_prop", "claimcount_prop")).alias("avg_prop_claim"),
        F.avg(safe_div("grossincurred_lossofinc", "claimcount_lossofinc")).alias("avg_lossofinc_claim"),
        F.avg("claimcount_prop").alias("avg_prop_no"),
        F.avg("claimcount_lossofinc").alias("avg_lossofinc_no"))


def policy_locations(policies: DataFrame, monthly: DataFrame, postcodes: DataFrame) -> DataFrame:
    """Policies with their last postcode (latest month) and the postcode's
    first SA4 (by name, NULLs last) with coordinates."""
    keys = ["policyno", "situation_num"]
    last_pc = last_row(monthly.withColumn("_pc", F.col("riskpostcode").cast("int")),
                       keys, ["ym", "xm", "_pc"], ["riskpostcode"])
    sa4 = first_row(postcodes.select("postcode", "sa4name", "sa4", "Lat_precise", "Long_precise"),
                    ["postcode"], ["sa4name"], ["sa4name", "sa4", "Lat_precise", "Long_precise"])
    return (policies.join(last_pc, keys, "left")
            .join(sa4.withColumnRenamed("postcode", "riskpostcode"), "riskpostcode", "left"))


def area_summary(located: DataFrame, level: Sequence[str]) -> DataFrame:
    """Per area: n policies, mean lat / long (NULL if any is NULL), mean sums
    insured, mean log incurred per line (zeros excluded), mean counts."""
    li = {ln: F.log(F.nullif(F.col(f"grossincurred_{ln}"), F.lit(0.0)))
          for ln in ("prop", "lossofinc")}
    return located.groupBy(*level).agg(
        F.count(F.lit(1)).alias("n_policies"),
        mean_strict("Lat_precise").alias("lat"),
        mean_strict("Long_precise").alias("long"),
        mean_cents("suminsured_prop").alias("mean_prop_SI"),
        mean_cents("suminsured_lossofinc").alias("mean_lossofinc_SI"),
        F.avg(li["prop"]).alias("mean_prop_grossincurred"),
        F.avg(li["lossofinc"]).alias("mean_lossofinc_grossincurred"),
        F.avg("claimcount_prop").alias("mean_prop_claims"),
        F.avg("claimcount_lossofinc").alias("mean_lossofinc_claims"))


def mean_cents(c: str):
    """Mean of a money column from an exact integer-cent sum (so the result
    does not depend on summation order)."""
    cents = F.sum(F.round(F.col(c) * 100).cast("long"))
    return cents / F.count(c) / F.lit(100.0)


def claim_cooccurrence(df: DataFrame, prop: str = "grossincurred_prop",
                       bi: str = "grossincurred_lossofinc") -> DataFrame:
    p, b = F.col(prop), F.col(bi)
    return df.agg(count_if((p > 0) & (b > 0)).alias("both"),
                  count_if((p > 0) & (b == 0)).alias("only_prop"),
                  count_if((p == 0) & (b > 0)).alias("only_lossofinc"),
                  count_if((p == 0) & (b == 0)).alias("no_claim"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lower triangle of Pearson correlations, long form (var1, var2, corr)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], one.columns, "pair", "corr")
    return long.select(F.split("pair", r"\|")[0].alias("var1"),
                       F.split("pair", r"\|")[1].alias("var2"), "corr")


def linear_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope / intercept / R^2 of y on x (per group)."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                 F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def _value_counts(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """(by..., x, _c): how often each value stands in its group; the one scan of ``df`` that the
    statistics below need, kept so that each of them reads the counts."""
    checkpoint_dir(df.sparkSession)
    return df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_c")).checkpoint()


def box_stats(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Five numbers, 1.5 IQR whiskers and outlier counts per group."""
    d = _value_counts(df, by, x)
    s = exact_quantiles(d, by, x, [0.25, 0.5, 0.75], "_q", count="_c")
    s = s.select(*by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    s = s.withColumns({"lower_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                       "upper_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    low, high = F.col(x) < F.col("lower_fence"), F.col(x) > F.col("upper_fence")
    of = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    outliers = lambda here: F.coalesce(F.sum(F.when(here, F.col("_c"))), F.lit(0))
    out = join_null_safe(d, s, list(by)).groupBy(*by, *of).agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.sum("_c").alias("n"),
        outliers(low).alias("n_low_outliers"), outliers(high).alias("n_high_outliers"),
        F.min(F.when(~low, F.col(x))).alias("whisker_low"), F.max(F.when(~high, F.col(x))).alias("whisker_high"))
    return out.select(*by, "min", "q1", "median", "q3", "max", "n", "lower_fence", "upper_fence",
                      "n_low_outliers", "n_high_outliers", "whisker_low", "whisker_high")


def median_by(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    n = df.groupBy(*by).agg(F.count(x).alias("n"))
    m = exact_quantiles(df, by, x, [0.5]).select(*by, F.col("quantiles")[0].alias(f"median_{x}"))
    return join_null_safe(n, m, list(by), "left").select(*by, f"median_{x}", "n")


def density(df: DataFrame, by: str, x: str, n_grid: int = 32) -> DataFrame:
    """Gaussian kernel density of ``x`` per group on a shared grid.

    Bandwidth per group: Silverman's rule 0.9 * min(sd, IQR/1.34) * n^-1/5.
    Grid: n_grid points from the overall min to max.  The claims are read once
    for the (group, value, count) table; every grid point is a column of ONE
    aggregation over it, with the two bounds as numbers.
    """
    d = _value_counts(df, [by], x)
    bounds = d.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = (float(bounds["lo"] or 0), float(bounds["hi"] or 0))
    means = d.groupBy(by).agg(F.sum("_c").alias("n"), (F.sum(F.col("_c") * F.col(x)) / F.sum("_c")).alias("_m"))
    spread = join_null_safe(d, means, [by]).groupBy(by, "n").agg(
        F.sum(F.col("_c") * (F.col(x) - F.col("_m")) * (F.col(x) - F.col("_m"))).alias("_s"))
    stats = join_null_safe(spread, exact_quantiles(d, [by], x, [0.25, 0.75], "_q", count="_c"), [by])
    sd = F.sqrt(F.col("_s") / F.nullif(F.col("n") - 1, F.lit(0)))
    bw = F.lit(0.9) * F.least(sd, (F.col("_q")[1] - F.col("_q")[0]) / 1.34) * F.pow(F.col("n"), F.lit(-0.2))
    stats = stats.select(by, "n", bw.alias("bw")).filter(F.col("bw") > 0)
    vals = join_null_safe(d, stats, [by])
    step = (hi - lo) / (n_grid - 1)
    grid = [lo + g * step for g in range(n_grid)]

    def kernel(at):
        z = (F.lit(at) - F.col(x)) / F.col("bw")
        return F.sum(F.col("_c") * F.exp(-0.5 * z * z)
                     / (F.col("bw") * F.lit((2 * 3.141592653589793) ** 0.5))) / F.max("n")

    wide = vals.groupBy(by).agg(*[kernel(at).alias(f"_d{g}") for g, at in enumerate(grid)])
    points = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(at).alias("grid_x"), F.col(f"_d{g}").alias("density"))
                       for g, at in enumerate(grid)])
    return wide.select(by, F.explode(points).alias("p")).select(by, "p.*")


def histbin(df: DataFrame, x: str, right: float, bins: int, left: float = 0.0) -> DataFrame:
    """Equal-width bins on [left, right]; values above ``right`` go to the
    last bin (the outlier bin)."""
    w = (right - left) / bins
    b = F.least(F.floor((F.least(F.col(x), F.lit(right)) - left) / w), F.lit(bins - 1))
    return (df.filter(F.col(x).isNotNull()).groupBy(b.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumns({"bin_lo": left + F.col("bin") * w, "bin_hi": left + (F.col("bin") + 1) * w}))
