"""Registered queries: category grouping, geography, exploratory statistics,
rating tables, sampling and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposa.functions import expr as E
from exposa.operators import consolidate as C
from exposa.operators import eda as D
from exposa.operators import geo as G
from exposa.operators import grouping as GR
from exposa.operators import postcode as P
from exposa.operators import prep as PR
from exposa.operators import rating as R
from exposa.operators import gates as Q
from exposa.plans import stages as S
from exposa.plans.registry import register


def _round(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


# --- category grouping ---------------------------------------------------------

@register("lump_min_occupation", """
SELECT CASE WHEN g.occupation IS NULL THEN NULL WHEN s.w < 5 THEN 'NEW' ELSE g.occupation END
         AS occupation,
       count(*) AS n_rows, round(sum(g.epy), 6) AS exposure
FROM claims_geo g LEFT JOIN (SELECT occupation, sum(epy) AS w FROM claims_geo GROUP BY ALL) s
  USING (occupation)
GROUP BY 1""", ("claims_geo",))
def lump_min_occupation(spark, sf_dir):
    """Occupations with exposure below 5 (the study's constant) merged into 'NEW'."""
    df = GR.lump_min(S.claims_geo(spark, sf_dir), "occupation", "epy",
                     S.LUMP_MIN_EXPOSURE, "NEW")
    return df.groupBy("occupation").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.round(F.sum("epy"), 6).alias("exposure"))


@register("lump_n_occupation", """
SELECT coalesce(m.to_, g.occupation) AS occupation, count(*) AS n_rows,
       round(sum(g.epy), 6) AS exposure
FROM claims_geo g LEFT JOIN (
  SELECT occupation, CASE WHEN rank() OVER (ORDER BY w DESC) <= 15 THEN occupation
                          ELSE 'Other' END AS to_
  FROM (SELECT occupation, sum(epy) AS w FROM claims_geo WHERE occupation IS NOT NULL
        GROUP BY ALL)) m USING (occupation)
GROUP BY 1""", ("claims_geo",))
def lump_n_occupation(spark, sf_dir):
    """Keep the 15 heaviest occupations (ties kept), the rest 'Other'."""
    df = GR.lump_n(S.claims_geo(spark, sf_dir), "occupation", "epy", 15)
    return df.groupBy("occupation").agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.round(F.sum("epy"), 6).alias("exposure"))


_SPLIT_KEY = "md5(concat_ws('|', '{seed}', policyno, CAST(situation_num AS VARCHAR), CAST(policy_version AS VARCHAR)))"


def _split_sql(src, strata, frac, seed, where="TRUE"):
    h = _SPLIT_KEY.format(seed=seed)
    return f"""
SELECT *, CASE WHEN row_number() OVER (PARTITION BY {strata} ORDER BY {h})
                    <= floor(count(*) OVER (PARTITION BY {strata}) * CAST({frac} AS DOUBLE))
               THEN 'train' ELSE 'test' END AS split
FROM {src} WHERE {where}"""


_KEY = ["policyno", "situation_num", "policy_version"]


def _train(spark, sf_dir):
    return S.policy_split(spark, sf_dir)


@register("pool_rare", f"""
WITH t AS (SELECT * FROM ({_split_sql("policy_claims", "LossofIncome_cover", 0.8, 123)})
           WHERE split = 'train')
SELECT 'indem_per_grp' AS factor, indem_per_grp AS level,
       CASE WHEN n / sum(n) OVER () < 0.25 THEN 'other_values' ELSE indem_per_grp END AS pooled
FROM (SELECT indem_per_grp, count(*) AS n FROM t GROUP BY ALL)
UNION ALL
SELECT 'building_age', building_age,
       CASE WHEN n / sum(n) OVER () < 0.25 THEN 'other_values' ELSE building_age END
FROM (SELECT building_age, count(*) AS n FROM t GROUP BY ALL)""", ("policy_claims",))
def pool_rare(spark, sf_dir):
    """Levels under 25 % of training rows pooled into 'other_values'."""
    tr = _train(spark, sf_dir).filter(F.col("split") == "train")
    tabs = GR.pool_rare(tr, ["indem_per_grp", "building_age"], 0.25)
    parts = [t.select(F.lit(c).alias("factor"), F.col(c).alias("level"), "pooled")
             for c, t in tabs.items()]
    return parts[0].unionByName(parts[1])


@register("level_order_median", """
SELECT geo_code, round(median(exposure), 6) AS stat,
       row_number() OVER (ORDER BY round(median(exposure), 6) ASC, geo_code ASC) AS level_rank
FROM policy_claims GROUP BY geo_code""", ("policy_claims",))
def level_order_median(spark, sf_dir):
    """Geo-code levels ordered by median exposure (base = last)."""
    t = GR.level_order(S.policy_claims(spark, sf_dir), "geo_code", "exposure", "median_asc")
    return t.withColumn("level_rank", F.col("level_rank").cast("long"))


@register("level_order_sum", """
SELECT occupation_risk, round(sum(exposure), 6) AS stat,
       row_number() OVER (ORDER BY round(sum(exposure), 6) DESC, occupation_risk ASC) AS level_rank
FROM policy_claims GROUP BY occupation_risk""", ("policy_claims",))
def level_order_sum(spark, sf_dir):
    """Occupation levels ordered by total exposure (base = first)."""
    pc = S.policy_claims(spark, sf_dir).withColumn("exposure", F.col("exposure"))
    t = GR.level_order(pc, "occupation_risk", "exposure", "sum_desc")
    return t.withColumns({"stat": F.round("stat", 6), "level_rank": F.col("level_rank").cast("long")})


@register("biggest_reference", """
SELECT geo_code, round(exposure, 6) AS exposure,
       row_number() OVER (ORDER BY top DESC, geo_code ASC) AS level_rank
FROM (SELECT geo_code, sum(exposure) AS exposure,
             row_number() OVER (ORDER BY sum(exposure) DESC, geo_code ASC) = 1 AS top
      FROM policy_claims GROUP BY geo_code)""", ("policy_claims",))
def biggest_reference(spark, sf_dir):
    """Base level = most exposure, the rest alphabetical."""
    t = GR.biggest_reference(S.policy_claims(spark, sf_dir), "geo_code", "exposure")
    return t.withColumns({"exposure": F.round("exposure", 6),
                          "level_rank": F.col("level_rank").cast("long")})


@register("impute_electorate", """
SELECT d.postcode, d.state, o.own_rating, m3.sa3_rating, m4.sa4_rating,
       coalesce(o.own_rating, m3.sa3_rating, m4.sa4_rating) AS electoraterating
FROM (SELECT postcode, state, sa3name, sa4name FROM pc_sa3 JOIN pc_sa4 USING (postcode, state)) d
LEFT JOIN pc_own o USING (postcode, state)
LEFT JOIN pc_m3 m3 USING (sa3name) LEFT JOIN pc_m4 m4 USING (sa4name)""",
          ("pc_sa3", "pc_sa4", "pc_own", "pc_m3", "pc_m4"))
def impute_electorate(spark, sf_dir):
    """Own rating, else SA3's unambiguous mode, else SA4's."""
    post = P.restricted_dim(S.postcodes(spark, sf_dir), S.claims_clean(spark, sf_dir))
    dim = P.postcode_dim(S.postcodes(spark, sf_dir), S.claims_clean(spark, sf_dir))
    own = (post.filter(F.col("electoraterating").isNotNull()).groupBy("postcode", "state")
           .agg(F.min("electoraterating").alias("own_rating")))
    base = dim.select("postcode", "state", "sa3name", "sa4name").join(own, ["postcode", "state"], "left")
    filled = P.impute_electorate(base.withColumnRenamed("own_rating", "electoraterating"), post)
    m3 = P.unique_mode(post, "sa3name", "electoraterating", "sa3_rating")
    m4 = P.unique_mode(post, "sa4name", "electoraterating", "sa4_rating")
    return (filled.join(own, ["postcode", "state"], "left").join(m3, "sa3name", "left")
            .join(m4, "sa4name", "left")
            .select("postcode", "state", "own_rating", "sa3_rating", "sa4_rating", "electoraterating"))


# --- geography ---------------------------------------------------------------

@register("geo_rollup", "SELECT * FROM enc_geo", ("enc_geo",))
def geo_rollup(spark, sf_dir):
    """Two-level roll-up (30 / 120): postcode -> SA3 -> SA4 with origin."""
    return G.geo_rollup(S.claims_geo(spark, sf_dir), S.POSTCODE_THRESHOLD)


def rollup3_sql(src: str, t: tuple, part: str = "", final: bool = True) -> str:
    """Three passes as nested window queries; ``t`` are SQL expressions."""
    pp = f"{part}, " if part else ""
    q = f"(SELECT *, riskpostcode AS geo_code FROM {src})"
    scopes = [("state, sa4name, sa3name", "sa3name", True),
              ("state, sa4name", "sa4name", True),
              ("state", "state", False)]
    for (upper, target, spread), th in zip(scopes, t):
        cw = f"sum(w) OVER (PARTITION BY {pp}{upper}, geo_code)"
        q = f"(SELECT *, CAST({cw} < {th} AS INT) AS small0 FROM {q})"
        if spread:
            q = f"(SELECT * EXCLUDE (small0), max(small0) OVER (PARTITION BY {pp}{upper}) AS small FROM {q})"
        else:
            q = f"(SELECT * EXCLUDE (small0), small0 AS small FROM {q})"
        q = (f"(SELECT * EXCLUDE (geo_code, small), CASE WHEN max(small) OVER "
             f"(PARTITION BY {pp}geo_code) = 1 THEN {target} ELSE geo_code END AS geo_code FROM {q})")
    return q


_PE = "(SELECT state, sa4name, sa3name, riskpostcode, sum(epy) AS w FROM claims_geo GROUP BY ALL)"


@register("geo_rollup3", f"""
SELECT DISTINCT riskpostcode,
       CASE WHEN state IN ('ACT', 'NT') THEN state ELSE geo_code END AS geo_code
FROM {rollup3_sql(_PE, ("30.0", "120.0", "500.0"))}""", ("claims_geo",))
def geo_rollup3(spark, sf_dir):
    """Three-level roll-up (30 / 120 / 500) to postcode, SA3, SA4 or state."""
    return G.geo_rollup3(S.claims_geo(spark, sf_dir), 30.0, 120.0, 500.0, weight="epy")


def _grid_rows():
    return G.threshold_grid()


_GRID_VALUES = ", ".join(f"({g}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))"
                         for g, a, b, c in _grid_rows())
_PE_GRID = (f"(SELECT p.*, g.* FROM {_PE} p, (VALUES {_GRID_VALUES}) "
            "g(grid_id, t_riskpostcode, t_sa3name, t_sa4name))")


@register("geo_grid", f"""
WITH c AS (
  SELECT grid_id, t_riskpostcode, t_sa3name, t_sa4name,
         count(DISTINCT CASE WHEN state IN ('ACT', 'NT') THEN state ELSE geo_code END) AS n_geo_code
  FROM {rollup3_sql(_PE_GRID, ("t_riskpostcode", "t_sa3name", "t_sa4name"), part="grid_id")}
  GROUP BY ALL)
SELECT c.* FROM c JOIN (SELECT n_geo_code, min(grid_id) AS grid_id FROM c GROUP BY ALL) f
  USING (n_geo_code, grid_id)""", ("claims_geo",))
def geo_grid(spark, sf_dir):
    """Number of geo codes for all 80 threshold triples in one job; first
    triple per distinct count."""
    return G.geo_grid(S.claims_geo(spark, sf_dir), _grid_rows(), weight="epy")


@register("attach_geo_fallback", f"""
WITH m AS (SELECT riskpostcode,
                  min(CASE WHEN state IN ('ACT', 'NT') THEN state ELSE geo_code END) AS gc
           FROM {rollup3_sql(_PE, ("30.0", "120.0", "500.0"))} GROUP BY riskpostcode),
seen AS (SELECT DISTINCT m.gc FROM claims_geo g JOIN m USING (riskpostcode) WHERE g.ym <= 1998)
SELECT coalesce(CASE WHEN m.gc IN (SELECT gc FROM seen) THEN m.gc END, g.state) AS geo_code,
       count(*) AS n_rows
FROM claims_geo g LEFT JOIN m USING (riskpostcode) GROUP BY 1""", ("claims_geo",))
def attach_geo_fallback(spark, sf_dir):
    """Geo code attached; codes unseen in training (ym <= 1998) fall back
    to the state."""
    geo = S.claims_geo(spark, sf_dir)
    m = G.geo_rollup3(geo, 30.0, 120.0, 500.0, weight="epy")
    seen = geo.filter(F.col("ym") <= 1998).join(G.one_code(m), "riskpostcode").select("geo_code")
    out = G.attach_geo(geo, m, train_levels=seen)
    return out.groupBy("geo_code").agg(F.count(F.lit(1)).alias("n_rows"))


@register("distinct_geo_codes", "SELECT count(DISTINCT geo_code) AS n_geo_code FROM enc_geo",
          ("enc_geo",))
def distinct_geo_codes(spark, sf_dir):
    """Number of distinct codes of the two-level map."""
    m = G.geo_rollup(S.claims_geo(spark, sf_dir), S.POSTCODE_THRESHOLD)
    return m.agg(F.count_distinct("geo_code").alias("n_geo_code"))


_PE2 = ("(SELECT state, sa4name, sa3name, riskpostcode, sum(exposure) AS w "
        "FROM policy_claims_second GROUP BY ALL)")
_PE2_GRID = (f"(SELECT p.*, g.* FROM {_PE2} p, (VALUES {_GRID_VALUES}) "
             "g(grid_id, t_riskpostcode, t_sa3name, t_sa4name))")


@register("geo_grid_policies", f"""
WITH c AS (
  SELECT grid_id, t_riskpostcode, t_sa3name, t_sa4name,
         count(DISTINCT CASE WHEN state IN ('ACT', 'NT') THEN state ELSE geo_code END) AS n_geo_code
  FROM {rollup3_sql(_PE2_GRID, ("t_riskpostcode", "t_sa3name", "t_sa4name"), part="grid_id")}
  GROUP BY ALL)
SELECT c.* FROM c JOIN (SELECT n_geo_code, min(grid_id) AS grid_id FROM c GROUP BY ALL) f
  USING (n_geo_code, grid_id)""", ("policy_claims_second",))
def geo_grid_policies(spark, sf_dir):
    """The 80-triple geo grid on the second-path policy table, weighted by
    policy exposure (as the study runs it)."""
    return G.geo_grid(S.policy_claims_second(spark, sf_dir), _grid_rows(), weight="exposure")


@register("geo_rollup3_policies", f"""
SELECT DISTINCT riskpostcode,
       CASE WHEN state IN ('ACT', 'NT') THEN state ELSE geo_code END AS geo_code
FROM {rollup3_sql(_PE2, ("50.0", "100.0", "200.0"))}""", ("policy_claims_second",))
def geo_rollup3_policies(spark, sf_dir):
    """Three-level roll-up with the study's default thresholds (50 / 100 /
    200) on policy exposure."""
    return G.geo_rollup3(S.policy_claims_second(spark, sf_dir), *G.ROLLUP3_DEFAULTS.values(), weight="exposure")
