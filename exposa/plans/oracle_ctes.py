"""DuckDB SQL of the stages, as named CTEs, for the correctness oracle.

``with_ctes(sql, *names)`` prefixes ``sql`` with the named CTEs and all the
CTEs they depend on, in dependency order.  The driver runs the resulting
strings on its pre-registered views of the Parquet tables.
"""

from __future__ import annotations

from exposa.sources.fixtures import CLAIMS_MONTHLY_SQL, CUSTOMER_GEO_SQL, POSTCODES_RAW_SQL

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql.strip(), deps)


def with_ctes(sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    sql = sql.strip()
    if not order:
        return sql
    body = ",\n".join(f"{n} AS (\n{CTES[n][0]}\n)" for n in order)
    if sql[:4].upper() == "WITH":
        return f"WITH {body},\n{sql[4:].lstrip()}"
    return f"WITH {body}\n{sql}"


cte("customer_geo", CUSTOMER_GEO_SQL)
cte("claims_monthly", CLAIMS_MONTHLY_SQL, "customer_geo")
cte("postcodes_raw", POSTCODES_RAW_SQL, "customer_geo")
cte("postcodes", """
SELECT lpad(postcode, 6, '0') AS postcode, state, sa3name, sa4name, sa4,
       electoraterating, Lat_precise, Long_precise
FROM postcodes_raw""", "postcodes_raw")

cte("claims_clean", """
SELECT policyno, situation_num, effectdate, expirydate, ym, xm, start, epy,
       LossofIncome_cover = 'Y' AS LossofIncome_cover,
       CASE WHEN suminsured_prop < 10 THEN 0.0 ELSE suminsured_prop END AS suminsured_prop,
       CASE WHEN suminsured_lossofinc < 10 THEN 0.0 ELSE suminsured_lossofinc END
         AS suminsured_lossofinc,
       CASE WHEN grossincurred_prop < 10 THEN 0.0 ELSE grossincurred_prop END AS grossincurred_prop,
       CASE WHEN grossincurred_lossofinc < 10 THEN 0.0 ELSE grossincurred_lossofinc END
         AS grossincurred_lossofinc,
       CASE WHEN riskpostcode = '002309' THEN '002083' ELSE riskpostcode END AS riskpostcode,
       CASE WHEN riskpostcode = '004375' THEN 'QLD' ELSE state END AS state,
       building_age, building_type, construction_walls, construction_floor,
       CASE WHEN sprinkler_type = 'None' THEN 0.0
            ELSE CAST(NULLIF(regexp_extract(sprinkler_type, '[0-9]', 0), '') AS DOUBLE) END
         AS sprinkler_type,
       occupation, indem_per_grp
FROM claims_monthly WHERE property_cover = 'Y'""", "claims_monthly")

# --- postcode dimension + state reconciliation + join, for any source ------

def postcode_ctes(p: str, src: str, joined: str) -> None:
    """Register the dimension / reconciliation / join CTEs for ``src`` (a
    table with riskpostcode and state) under prefix ``p``; the joined rows
    are CTE ``joined``."""
    cte(f"{p}pc_post", f"""
SELECT CASE WHEN postcode = '002309' THEN '002083' ELSE postcode END AS postcode,
       CASE WHEN postcode = '004375' THEN 'QLD' ELSE state END AS state,
       sa3name, sa4name, electoraterating
FROM postcodes WHERE postcode IN (SELECT riskpostcode FROM {src})""", "postcodes", src)
    cte(f"{p}pc_sa3", f"""
SELECT postcode, state, min(sa3name) AS sa3name
FROM (SELECT DISTINCT postcode, state, sa3name FROM {p}pc_post
      WHERE sa3name IS NOT NULL AND NOT (postcode = '002304' AND sa3name <> 'Shoalhaven'))
GROUP BY postcode, state""", f"{p}pc_post")
    cte(f"{p}pc_sa4", f"""
SELECT postcode, state, min(sa4name) AS sa4name
FROM (SELECT DISTINCT postcode, state, sa4name FROM {p}pc_post
      WHERE sa4name IS NOT NULL
        AND NOT (postcode = '002304' AND sa4name <> 'Southern Highlands and Shoalhaven'))
GROUP BY postcode, state""", f"{p}pc_post")
    cte(f"{p}pc_own", f"""
SELECT postcode, state, min(electoraterating) AS own_rating FROM {p}pc_post
WHERE electoraterating IS NOT NULL GROUP BY postcode, state""", f"{p}pc_post")
    for lvl in ("sa3", "sa4"):
        cte(f"{p}pc_m{lvl[-1]}", f"""
SELECT c.{lvl}name, min(c.electoraterating) AS {lvl}_rating
FROM (SELECT {lvl}name, electoraterating, count(*) AS n FROM {p}pc_post
      WHERE electoraterating IS NOT NULL GROUP BY {lvl}name, electoraterating) c
JOIN (SELECT {lvl}name, max(n) AS mx
      FROM (SELECT {lvl}name, electoraterating, count(*) AS n FROM {p}pc_post
            WHERE electoraterating IS NOT NULL GROUP BY {lvl}name, electoraterating)
      GROUP BY {lvl}name) m ON c.{lvl}name = m.{lvl}name AND c.n = m.mx
GROUP BY c.{lvl}name HAVING count(*) = 1""", f"{p}pc_post")
    cte(f"{p}pc_dim", f"""
SELECT postcode, state, sa3name, sa4name,
       coalesce(own_rating, sa3_rating, sa4_rating) AS electoraterating
FROM {p}pc_sa3 JOIN {p}pc_sa4 USING (postcode, state)
LEFT JOIN {p}pc_own USING (postcode, state)
LEFT JOIN {p}pc_m3 USING (sa3name)
LEFT JOIN {p}pc_m4 USING (sa4name)""", f"{p}pc_sa3", f"{p}pc_sa4", f"{p}pc_own", f"{p}pc_m3",
        f"{p}pc_m4")
    cte(f"{p}rc_claim_pairs", f"SELECT DISTINCT riskpostcode AS postcode, state FROM {src}", src)
    cte(f"{p}rc_claim_state", f"""
SELECT postcode, min(state) AS new_state FROM {p}rc_claim_pairs
WHERE postcode IN (SELECT d.postcode FROM {p}pc_dim d
                   WHERE NOT EXISTS (SELECT 1 FROM {p}rc_claim_pairs c
                                     WHERE c.postcode = d.postcode AND c.state = d.state))
GROUP BY postcode""", f"{p}rc_claim_pairs", f"{p}pc_dim")
    cte(f"{p}pc_dim2", f"""
SELECT postcode, state, sa3name, sa4name, electoraterating FROM (
  SELECT d.postcode, coalesce(cs.new_state, d.state) AS state, d.sa3name, d.sa4name,
         d.electoraterating,
         row_number() OVER (PARTITION BY d.postcode, coalesce(cs.new_state, d.state)
                            ORDER BY (d.state = coalesce(cs.new_state, d.state)) DESC,
                                     d.sa3name ASC NULLS LAST, d.sa4name ASC NULLS LAST,
                                     d.electoraterating ASC NULLS LAST) AS rn
  FROM {p}pc_dim d LEFT JOIN {p}rc_claim_state cs USING (postcode)) WHERE rn = 1""",
        f"{p}pc_dim", f"{p}rc_claim_state")
    cte(f"{p}rc_dim_state", f"""
SELECT postcode AS riskpostcode, min(state) AS dim_state FROM {p}pc_dim2
WHERE postcode IN (SELECT c.postcode FROM {p}rc_claim_pairs c
                   WHERE NOT EXISTS (SELECT 1 FROM {p}pc_dim2 d
                                     WHERE d.postcode = c.postcode AND d.state = c.state)
                     AND c.postcode IN (SELECT postcode FROM {p}pc_dim2))
GROUP BY postcode""", f"{p}pc_dim2", f"{p}rc_claim_pairs")
    cte(joined, f"""
SELECT c.* EXCLUDE (state), coalesce(s.dim_state, c.state) AS state,
       d.sa3name, d.sa4name, d.electoraterating
FROM {src} c
LEFT JOIN {p}rc_dim_state s USING (riskpostcode)
JOIN {p}pc_dim2 d ON d.postcode = c.riskpostcode AND d.state = coalesce(s.dim_state, c.state)""",
        src, f"{p}rc_dim_state", f"{p}pc_dim2")


postcode_ctes("", "claims_clean", "claims_geo")


def occupation_map_sql(src: str, excluded: list[str], top_keep: int = 10, top_n: int = 15) -> str:
    ex = ", ".join("'" + e.replace("'", "''") + "'" for e in excluded) or "NULL"
    return f"""
SELECT s.occupation, k.occupation_risk FROM (
  SELECT occupation, exposure,
         CASE WHEN row_number() OVER (ORDER BY exposure DESC, occupation ASC) > {top_keep}
              THEN substr(occupation, 1, 1) || '_General' ELSE occupation END AS grp
  FROM (SELECT occupation, sum(epy) AS exposure FROM {src}
        WHERE occupation IS NOT NULL GROUP BY occupation)
  WHERE occupation NOT IN ({ex})) s
JOIN (SELECT grp, CASE WHEN rank() OVER (ORDER BY gw DESC) <= {top_n} THEN grp ELSE 'Other' END
             AS occupation_risk
      FROM (SELECT grp, sum(exposure) AS gw FROM (
              SELECT occupation, exposure,
                     CASE WHEN row_number() OVER (ORDER BY exposure DESC, occupation ASC) > {top_keep}
                          THEN substr(occupation, 1, 1) || '_General' ELSE occupation END AS grp
              FROM (SELECT occupation, sum(epy) AS exposure FROM {src}
                    WHERE occupation IS NOT NULL GROUP BY occupation)
              WHERE occupation NOT IN ({ex})) GROUP BY grp)) k USING (grp)
UNION ALL
SELECT DISTINCT occupation, occupation FROM {src} WHERE occupation IN ({ex})"""


def geo_rollup_sql(src: str, t: float, sa4_factor: float = 4.0, weight: str = "epy") -> str:
    return f"""
SELECT DISTINCT state, riskpostcode, geo_code,
       CASE WHEN geo_code = riskpostcode THEN 'riskpostcode'
            WHEN geo_code = postcode_encoding THEN 'sa3name' ELSE 'sa4name' END AS origin
FROM (
  SELECT *, CASE WHEN max(CAST(sa4_hit AS INT)) OVER (PARTITION BY postcode_encoding) = 1
                 THEN sa4name ELSE postcode_encoding END AS geo_code
  FROM (
    SELECT *, max(CAST(enc_w < {t * sa4_factor} AS INT)) OVER (PARTITION BY state, sa4name) = 1
                AS sa4_hit
    FROM (
      SELECT *, sum(w) OVER (PARTITION BY state, sa4name, postcode_encoding) AS enc_w
      FROM (
        SELECT *, CASE WHEN max(CAST(sa3_hit AS INT)) OVER (PARTITION BY riskpostcode) = 1
                       THEN sa3name ELSE riskpostcode END AS postcode_encoding
        FROM (
          SELECT *, max(CAST(w < {t} AS INT)) OVER (PARTITION BY state, sa4name, sa3name) = 1
                      AS sa3_hit
          FROM (SELECT state, sa4name, sa3name, riskpostcode, sum({weight}) AS w
                FROM {src} GROUP BY state, sa4name, sa3name, riskpostcode))))))"""


cte("enc_occupation", occupation_map_sql(
    "claims_geo", ["Unknown", "O_Other Community Services", "D- Electricity, Gas & Water"]),
    "claims_geo")
cte("enc_geo", geo_rollup_sql("claims_geo", 30.0), "claims_geo")
cte("claims_encoded", """
SELECT g.* EXCLUDE (construction_walls, occupation, sa3name, sa4name, electoraterating),
       CASE WHEN g.construction_walls IN ('Polystyrene', 'Glass') THEN 'Other'
            ELSE g.construction_walls END AS construction_walls,
       o.occupation_risk, e.geo_code
FROM claims_geo g
LEFT JOIN enc_occupation o ON o.occupation = g.occupation
JOIN (SELECT DISTINCT state, riskpostcode, geo_code FROM enc_geo) e
  ON e.riskpostcode = g.riskpostcode AND e.state = g.state""",
    "claims_geo", "enc_occupation", "enc_geo")

# --- standardisation --------------------------------------------------------
_DET = ["geo_code", "state", "building_age", "building_type", "construction_walls",
        "construction_floor", "sprinkler_type", "occupation_risk"]
_KEYS = "policyno, situation_num, effectdate, expirydate"


def representative_sql(src: str, cols: list[str], keys: str = _KEYS) -> str:
    cl = ", ".join(cols)
    order = ", ".join(f"{c} ASC NULLS LAST" for c in cols)
    return f"""
SELECT {keys}, {cl} FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys}
                               ORDER BY n DESC, last_ym_xm DESC, {order}) AS rn
  FROM (SELECT {keys}, {cl}, count(*) AS n,
               max(ym * 100 + xm) AS last_ym_xm
        FROM {src} GROUP BY {keys}, {cl})) WHERE rn = 1"""


cte("std_details", representative_sql("claims_encoded", _DET), "claims_encoded")
cte("std_sums", f"""
SELECT {_KEYS}, suminsured_prop, suminsured_lossofinc, indem_per_grp FROM (
  SELECT *, row_number() OVER (PARTITION BY {_KEYS}
                               ORDER BY suminsured_prop ASC NULLS LAST,
                                        suminsured_lossofinc ASC NULLS LAST,
                                        indem_per_grp ASC NULLS LAST) AS rn
  FROM (SELECT *, count(*) OVER (PARTITION BY {_KEYS}) AS rows_,
               max(n) OVER (PARTITION BY {_KEYS}) AS max_n
        FROM (SELECT {_KEYS}, suminsured_prop, suminsured_lossofinc, indem_per_grp,
                     count(*) AS n
              FROM claims_encoded GROUP BY ALL))
  WHERE rows_ = 1 OR suminsured_lossofinc IS NOT NULL OR n = max_n) WHERE rn = 1""",
    "claims_encoded")
cte("std_monthly", """
SELECT *, pow(0.9996, date_diff('day', start, (SELECT max(start) FROM claims_encoded)))
          AS date_weights
FROM claims_encoded""", "claims_encoded")
cte("std_consolidated", f"""
SELECT {_KEYS}, CAST(sum(CAST(epy AS DECIMAL(38,12))) AS DOUBLE) AS exposure,
       avg(date_weights) AS date_weights,
       count(*) FILTER (WHERE grossincurred_prop > 0) AS claimcount_prop,
       count(*) FILTER (WHERE grossincurred_lossofinc > 0) AS claimcount_lossofinc,
       coalesce(CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE), 0.0) AS grossincurred_prop,
       coalesce(CAST(sum(CAST(grossincurred_lossofinc AS DECIMAL(38,4))) AS DOUBLE), 0.0)
         AS grossincurred_lossofinc,
       bool_or(LossofIncome_cover) AS LossofIncome_cover
FROM std_monthly GROUP BY {_KEYS}""", "std_monthly")
cte("policy_claims_hasna", f"""
SELECT c.* EXCLUDE (effectdate, expirydate),
       CAST(dense_rank() OVER (PARTITION BY c.policyno, c.situation_num
                               ORDER BY c.effectdate, c.expirydate) AS INTEGER) AS policy_version,
       {", ".join("d." + x for x in _DET)},
       s.suminsured_prop, s.suminsured_lossofinc, s.indem_per_grp,
       d.building_age IS NULL AS building_info_na
FROM std_consolidated c
LEFT JOIN std_details d USING ({_KEYS})
LEFT JOIN std_sums s USING ({_KEYS})""", "std_consolidated", "std_details", "std_sums")
cte("policy_claims", """
SELECT * EXCLUDE (suminsured_lossofinc, indem_per_grp, building_type, building_age,
                  construction_walls, construction_floor),
       CASE WHEN NOT LossofIncome_cover THEN 0.0 ELSE suminsured_lossofinc END
         AS suminsured_lossofinc,
       CASE WHEN NOT LossofIncome_cover THEN 'LoI_NULL' ELSE indem_per_grp END AS indem_per_grp,
       coalesce(building_type, 'Unknown') AS building_type,
       coalesce(building_age, 'Unknown') AS building_age,
       coalesce(construction_walls, 'Unknown') AS construction_walls,
       coalesce(construction_floor, 'Unknown') AS construction_floor
FROM policy_claims_hasna
WHERE suminsured_prop <> 0
  AND (CASE WHEN NOT LossofIncome_cover THEN 0.0 ELSE suminsured_lossofinc END) IS NOT NULL""",
    "policy_claims_hasna")
cte("policy_claims_monthly", """
SELECT *, epy * date_weights AS exposure FROM std_monthly""", "std_monthly")

# --- second path ---------------------------------------------------------------
cte("s2_clean", """
SELECT policyno, situation_num, effectdate, expirydate, ym, xm, start, epy,
       LossofIncome_cover = 'Y' AS LossofIncome_cover,
       CASE WHEN suminsured_prop < 10 THEN 0.0 ELSE suminsured_prop END AS suminsured_prop,
       CASE WHEN suminsured_lossofinc < 10 THEN 0.0 ELSE suminsured_lossofinc END
         AS suminsured_lossofinc,
       CASE WHEN grossincurred_prop < 10 THEN 0.0 ELSE grossincurred_prop END AS grossincurred_prop,
       CASE WHEN grossincurred_lossofinc < 10 THEN 0.0 ELSE grossincurred_lossofinc END
         AS grossincurred_lossofinc,
       riskpostcode, state, building_age, building_type, construction_walls, construction_floor,
       CAST(CAST(CASE WHEN sprinkler_type = 'None' THEN 0.0
            ELSE CAST(NULLIF(regexp_extract(sprinkler_type, '[0-9]', 0), '') AS DOUBLE) END
            AS INTEGER) AS VARCHAR) AS sprinkler_type,
       occupation, indem_per_grp
FROM claims_monthly WHERE property_cover = 'Y'""", "claims_monthly")


def _top_sev(col: str, n: int = 2) -> str:
    return (f"(SELECT occupation FROM s2_clean WHERE {col} > 0 GROUP BY occupation "
            f"ORDER BY avg({col}) DESC, occupation LIMIT {n})")


cte("s2_excl", f"""
SELECT 'Unknown' AS occupation UNION SELECT * FROM {_top_sev("grossincurred_prop")}
UNION SELECT * FROM {_top_sev("grossincurred_lossofinc")}""", "s2_clean")
cte("s2_occ_lv", """
SELECT occupation, sum(epy) AS exposure FROM s2_clean WHERE occupation IS NOT NULL
GROUP BY occupation""", "s2_clean")
cte("s2_occ_step1", """
SELECT occupation, exposure,
       CASE WHEN row_number() OVER (ORDER BY exposure DESC, occupation ASC) > 10
            THEN substr(occupation, 1, 1) || '_General' ELSE occupation END AS grp
FROM s2_occ_lv WHERE occupation NOT IN (SELECT occupation FROM s2_excl)""", "s2_occ_lv", "s2_excl")
cte("s2_occ", """
SELECT s.occupation, k.occupation_risk FROM s2_occ_step1 s
JOIN (SELECT grp, CASE WHEN rank() OVER (ORDER BY gw DESC) <= 13 THEN grp ELSE 'Other' END
             AS occupation_risk
      FROM (SELECT grp, sum(exposure) AS gw FROM s2_occ_step1 GROUP BY grp)) k USING (grp)
UNION ALL
SELECT occupation, occupation FROM s2_occ_lv WHERE occupation IN (SELECT occupation FROM s2_excl)""",
    "s2_occ_step1", "s2_occ_lv", "s2_excl")
cte("s2_tidy", """
SELECT * EXCLUDE (construction_walls, construction_floor, building_age, building_type,
                  sprinkler_type, indem_per_grp, occupation, suminsured_lossofinc,
                  grossincurred_lossofinc, to_),
       coalesce(CASE WHEN construction_walls IN ('Polystyrene', 'Glass',
                  'Aluminum/Fibro/Iron/Steel (on Steel Frame)') THEN 'Other'
                ELSE construction_walls END, 'Unknown') AS construction_walls,
       coalesce(CASE WHEN construction_floor IN ('Timber', 'Other') THEN 'Other'
                ELSE construction_floor END, 'Unknown') AS construction_floor,
       coalesce(CASE WHEN building_age = 'Less than 2 Years' THEN 'Less Than 20 Years'
                     WHEN building_age IN ('1960 - 1980', 'Before 1960') THEN 'Before 1980'
                ELSE building_age END, 'Unknown') AS building_age,
       coalesce(CASE WHEN building_type IN ('Medium rise', 'High rise') THEN 'Mid-High rise'
                ELSE building_type END, 'Unknown') AS building_type,
       coalesce(CASE WHEN sprinkler_type IN ('1', '2', '3') THEN '>0' ELSE sprinkler_type END,
                'Unknown') AS sprinkler_type,
       CASE WHEN NOT LossofIncome_cover THEN 'LoI_NULL'
            ELSE coalesce(CASE WHEN indem_per_grp = 'UNKNOWN' THEN '<12 mths'
                          ELSE indem_per_grp END, 'Unknown') END AS indem_per_grp,
       coalesce(coalesce(to_, occupation), 'Unknown') AS occupation_risk,
       CASE WHEN LossofIncome_cover AND suminsured_lossofinc IS NULL THEN 0.0
            ELSE suminsured_lossofinc END AS suminsured_lossofinc,
       CASE WHEN LossofIncome_cover AND grossincurred_lossofinc IS NULL THEN 0.0
            ELSE grossincurred_lossofinc END AS grossincurred_lossofinc
FROM (SELECT c.*, o.occupation_risk AS to_ FROM s2_clean c
      LEFT JOIN s2_occ o ON o.occupation = c.occupation)""", "s2_clean", "s2_occ")
_S2_DET = ["riskpostcode", "state", "building_age", "building_type", "construction_walls",
           "construction_floor", "sprinkler_type", "occupation_risk"]
cte("s2_details", representative_sql("s2_tidy", _S2_DET), "s2_tidy")
cte("s2_prop", representative_sql("s2_tidy", ["suminsured_prop"]), "s2_tidy")
cte("s2_loi", representative_sql("(SELECT * FROM s2_tidy WHERE LossofIncome_cover)",
                                 ["suminsured_lossofinc", "indem_per_grp"]), "s2_tidy")
cte("s2_cons", f"""
SELECT {_KEYS}, CAST(sum(CAST(epy AS DECIMAL(38,12))) AS DOUBLE) AS exposure,
       avg(pow(0.9998, date_diff('day', start, (SELECT max(start) FROM s2_tidy)))) AS date_weights,
       count(*) FILTER (WHERE grossincurred_prop > 0) AS claimcount_prop,
       count(*) FILTER (WHERE grossincurred_lossofinc > 0) AS claimcount_lossofinc,
       coalesce(CAST(sum(CAST(grossincurred_prop AS DECIMAL(38,4))) AS DOUBLE), 0.0) AS grossincurred_prop,
       coalesce(CAST(sum(CAST(grossincurred_lossofinc AS DECIMAL(38,4))) AS DOUBLE), 0.0)
         AS grossincurred_lossofinc,
       bool_or(LossofIncome_cover) AS LossofIncome_cover
FROM s2_tidy GROUP BY {_KEYS}""", "s2_tidy")
cte("s2_versions", f"""
SELECT c.*, d.* EXCLUDE (policyno, situation_num, effectdate, expirydate, riskpostcode, state),
       CASE WHEN d.riskpostcode = '002309' THEN '002083' ELSE d.riskpostcode END AS riskpostcode,
       CASE WHEN d.riskpostcode = '004375' THEN 'QLD' ELSE d.state END AS state,
       p.suminsured_prop, l.suminsured_lossofinc, l.indem_per_grp
FROM s2_cons c
LEFT JOIN s2_details d USING ({_KEYS})
LEFT JOIN s2_prop p USING ({_KEYS})
LEFT JOIN s2_loi l ON l.policyno = c.policyno AND l.situation_num = c.situation_num
  AND l.effectdate = c.effectdate AND l.expirydate = c.expirydate AND c.LossofIncome_cover""",
    "s2_cons", "s2_details", "s2_prop", "s2_loi")
postcode_ctes("s2_", "s2_versions", "s2_joined")
cte("policy_claims_second", """
SELECT * EXCLUDE (effectdate, expirydate, indem_per_grp, suminsured_lossofinc),
       CAST(dense_rank() OVER (PARTITION BY policyno, situation_num
                               ORDER BY effectdate, expirydate) AS INTEGER) AS policy_version,
       building_age IS NULL AS building_info_na,
       CASE WHEN NOT LossofIncome_cover THEN 'LoI_NULL' ELSE indem_per_grp END AS indem_per_grp,
       CASE WHEN NOT LossofIncome_cover THEN 0.0 ELSE suminsured_lossofinc END
         AS suminsured_lossofinc
FROM s2_joined""", "s2_joined")
