"""Registered queries: sources, cleaning, consolidation (first slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposa.operators import rating as R
from exposa.plans import stages as S
from exposa.plans.registry import register

_UNI_SQL = """
SELECT building_type, CAST(sum(claimcount_prop) AS DOUBLE) AS nclaims,
       round(sum(exposure), 6) AS exposure, CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) AS amount,
       round(sum(claimcount_prop) / nullif(sum(exposure), 0), 6) AS frequency,
       CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) / nullif(sum(claimcount_prop), 0) AS average_severity,
       round(CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE) / nullif(sum(exposure), 0), 6) AS risk_premium
FROM policy_claims GROUP BY building_type"""


def _round(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


@register("univariate_building_type", _UNI_SQL, ("policy_claims",))
def univariate_building_type(spark, sf_dir):
    """Flagship: cleaned claims -> policy versions -> univariate risk table
    of property claims by building type."""
    pc = S.policy_claims(spark, sf_dir)
    t = R.univariate(pc, "building_type", "claimcount_prop", "exposure",
                     severity="grossincurred_prop")
    return _round(t, ["exposure", "frequency", "risk_premium"])


@register("claims_clean", "SELECT * FROM claims_clean", ("claims_clean",))
def claims_clean(spark, sf_dir):
    """Cleaning step: sprinkler level, flags, cover filter, floor, patches."""
    return S.claims_clean(spark, sf_dir)


@register("claims_geo", "SELECT * FROM claims_geo", ("claims_geo",))
def claims_geo(spark, sf_dir):
    """Postcode dimension built, states reconciled, inner joined."""
    return S.claims_geo(spark, sf_dir)


@register("claims_encoded", "SELECT * FROM claims_encoded", ("claims_encoded",))
def claims_encoded(spark, sf_dir):
    """Walls recode, strict occupation map, two-level geo codes applied."""
    return S.claims_encoded(spark, sf_dir)


@register("policy_claims", """
SELECT * EXCLUDE (exposure, date_weights, grossincurred_prop, grossincurred_lossofinc),
       round(exposure, 6) AS exposure, round(date_weights, 9) AS date_weights,
       round(grossincurred_prop, 6) AS grossincurred_prop,
       round(grossincurred_lossofinc, 6) AS grossincurred_lossofinc
FROM policy_claims""", ("policy_claims",))
def policy_claims(spark, sf_dir):
    """Consolidated policy versions (main path, literal sums rule)."""
    pc = S.policy_claims(spark, sf_dir)
    return pc.withColumns({
        "exposure": F.round("exposure", 6), "date_weights": F.round("date_weights", 9),
        "grossincurred_prop": F.round("grossincurred_prop", 6),
        "grossincurred_lossofinc": F.round("grossincurred_lossofinc", 6)})


@register("claims_second", "SELECT * EXCLUDE (occupation_risk), occupation_risk AS occupation FROM s2_tidy",
          ("s2_tidy",))
def claims_second(spark, sf_dir):
    """Second-path cleaning and encodings: fixed recodes, occupation map with
    top-severity exclusions, 'Unknown' levels, loss-of-income NULL rules."""
    return S.claims_second(spark, sf_dir)


@register("policy_claims_second", """
SELECT * EXCLUDE (exposure, date_weights, grossincurred_prop, grossincurred_lossofinc),
       round(exposure, 6) AS exposure, round(date_weights, 9) AS date_weights,
       round(grossincurred_prop, 6) AS grossincurred_prop,
       round(grossincurred_lossofinc, 6) AS grossincurred_lossofinc
FROM policy_claims_second""", ("policy_claims_second",))
def policy_claims_second(spark, sf_dir):
    """Second-path policy versions (base 0.9998, postcode join after
    consolidation, BI sums by mode over covered rows)."""
    pc = S.policy_claims_second(spark, sf_dir)
    return pc.withColumns({
        "exposure": F.round("exposure", 6), "date_weights": F.round("date_weights", 9),
        "grossincurred_prop": F.round("grossincurred_prop", 6),
        "grossincurred_lossofinc": F.round("grossincurred_lossofinc", 6)})
