"""The study's stages as lazy DataFrame plans.

    claims_monthly (stand-in extract)
      -> claims_clean      types, cover filter, small-amount floor, patches
      -> claims_geo        postcode dimension built, states reconciled, joined
      -> claims_encoded    walls recode, occupation map, two-level geo codes
      -> policy_claims     representatives, recency weights, consolidation,
                           versions, loss-of-income NULL rules, Unknown levels

Each stage is a lazy plan; the four stage outputs that many queries read
(raw extract, claims_geo, claims_encoded, policy_claims) are written ONCE
per Spark application as Parquet under the session's shared checkpoint
folder and read back (``stage``).  That cuts the lineage - a lost executor
recomputes from the stage, not from the raw tables - and keeps every
downstream plan small, as the study's saved stages do.
"""

from __future__ import annotations

from exposa.session import app_id

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposa.functions.expr import (fill_unknown, floor_small, patch_codes,
                                   sprinkler_level, yn_flag)
from exposa.operators import consolidate as C
from exposa.operators import gates as Q
from exposa.operators import geo as G
from exposa.operators import grouping as GR
from exposa.operators import sampling as SM
from exposa.operators.postcode import CLAIM_PATCHES
from exposa.sources import fixtures
from exposa.sources.schema import AMOUNT_COLS, BUILDING_COLS, DETAIL_COLS, VERSION_KEYS
from exposa.sources.tables import read_postcodes

# Fixed values of the study.
SMALL_AMOUNT = 10.0
WEIGHT_BASE_MAIN = 0.9996
WEIGHT_BASE_SECOND = 0.9998
POSTCODE_THRESHOLD = 30.0
LUMP_MIN_EXPOSURE = 5.0


_MEMO: dict = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build, gate=None, rules=None, keep=None) -> DataFrame:
    """Materialise ``build()`` once per (application, sf_dir, stage name).

    ``rules(df)``: name -> count of bad rows, an aggregate that is observed while the stage
    is written, so the gate costs no pass of its own; ``keep(df)`` then chooses the rows and columns that
    are written.  ``gate(stage)`` is a check that reads the written stage.  Either raises where the
    study stops; a stage that fails is not used."""
    from pyspark.sql import Observation

    from exposa.session import checkpoint_dir
    app = app_id(spark)
    key = (app, sf_dir.rstrip("/"), name)
    path = _MEMO.get(key)
    if path is None:
        tag = re.sub(r"[^A-Za-z0-9_.-]", "_", sf_dir.strip("/"))
        path = f"{checkpoint_dir(spark).rstrip('/')}/exposa-stages/{app}/{tag}/{name}"
        df, seen = build(), None
        if rules is not None:
            seen = Observation()
            df = df.observe(seen, *[c.alias(n) for n, c in rules(df).items()])
        (keep(df) if keep else df).write.mode("overwrite").parquet(path)
        if seen is not None:
            Q.raise_if_counted(seen.get, name)
        if gate is not None:
            gate(spark.read.parquet(path))
        _MEMO[key] = path
    return spark.read.parquet(path)


def clean_claims(raw: DataFrame, patches=CLAIM_PATCHES) -> DataFrame:
    """Study step 2: sprinkler level, Y/N flags, property-cover filter,
    small-amount floor, postcode / state patches."""
    df = raw.withColumns({
        "sprinkler_type": sprinkler_level("sprinkler_type"),
        "property_cover": yn_flag("property_cover"),
        "LossofIncome_cover": yn_flag("LossofIncome_cover"),
    })
    df = df.filter(F.col("property_cover")).drop("property_cover")
    df = floor_small(df, AMOUNT_COLS, SMALL_AMOUNT)
    return patch_codes(df, patches)


def claims_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw monthly extract (stand-in built from the driver tables)."""
    return stage(spark, sf_dir, "claims_monthly",
                 lambda: fixtures.claims_monthly(spark, sf_dir))


def claims_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_claims(claims_monthly(spark, sf_dir))


def postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postcode dimension source (stand-in written once), padded on read."""
    raw = stage(spark, sf_dir, "postcodes_raw", lambda: fixtures.postcodes_raw(spark, sf_dir))
    return read_postcodes(spark, df=raw)


def claim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (riskpostcode, state) of the cleaned claims - everything the
    dimension build needs from the big table, read once (small stage)."""
    return stage(spark, sf_dir, "claim_pairs", lambda: claims_clean(spark, sf_dir).select(
        "riskpostcode", "state").distinct())


def postcode_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reconciled dimension the claims are joined to (small stage: one
    row per postcode and state), built from the claim pairs only."""
    from exposa.operators.postcode import postcode_dim, reconcile_dim
    pairs = claim_pairs(spark, sf_dir)
    return stage(spark, sf_dir, "postcode_dim", lambda: reconcile_dim(
        pairs, postcode_dim(postcodes(spark, sf_dir), pairs)))


def claims_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Study step 3: claims with reconciled states joined to the dimension.

    The dimension and the per-postcode state fixes are small stages, so the
    claim rows are read once and joined by broadcast hash joins."""
    from exposa.operators.postcode import apply_state_fixes, attach_postcode, claim_state_fixes

    def build():
        cc = claims_clean(spark, sf_dir)
        dim = postcode_dimension(spark, sf_dir)
        Q.raise_if_bad(dim.groupBy("postcode", "state").agg((F.count(F.lit(1)) - 1).alias("bad_rows")),
                       "postcode dimension")                 # a pair that stands twice would repeat claims
        fixes = stage(spark, sf_dir, "claim_state_fixes",
                      lambda: claim_state_fixes(claim_pairs(spark, sf_dir), dim))
        return attach_postcode(apply_state_fixes(cc, fixes), dim, mark=("_found", "_known"))

    # the join may lose only rows whose postcode the dimension does not know
    return stage(spark, sf_dir, "claims_geo", build,
                 rules=lambda df: {"lost": Q.count_bad(F.col("_found").isNull() & F.col("_known").isNotNull())},
                 keep=lambda df: df.filter("_found").drop("_found", "_known"))


def encodings(geo: DataFrame, threshold: float = POSTCODE_THRESHOLD,
              occupation_excluded=GR.OCCUPATION_EXCLUDED) -> dict:
    """(occupation map, geo map) built from the joined monthly rows."""
    return {
        "occupation_code": GR.occupation_map(geo, excluded=occupation_excluded),
        "geo_code": G.geo_rollup(geo, threshold),
    }


def apply_encodings(geo: DataFrame, enc: dict, walls=GR.WALL_RECODE) -> DataFrame:
    """Walls recode (unknown kept), strict occupation lookup, inner join of
    geo codes on (riskpostcode, state); area columns dropped."""
    df = GR.recode(geo, "construction_walls", walls)
    df = GR.recode(df, "occupation", enc["occupation_code"], out="occupation_risk", strict=True)
    gm = enc["geo_code"].select("state", "riskpostcode", "geo_code").distinct()
    df = df.join(gm, ["riskpostcode", "state"], "inner")
    return df.drop("occupation", "sa3name", "sa4name", "electoraterating")


def claims_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        geo = claims_geo(spark, sf_dir)
        # small stages: their written size is known, so the claims are not shuffled to join them
        enc = {name: stage(spark, sf_dir, f"encoding_{name}", lambda m=m: m) for name, m in encodings(geo).items()}
        return apply_encodings(geo, enc)
    return stage(spark, sf_dir, "claims_encoded", build)


def standardize_hasna(rf: DataFrame, base: float = WEIGHT_BASE_MAIN,
                      sums_mode: str = "literal") -> DataFrame:
    """Policy versions before the NULL rules (study's policy_claims_hasNA)."""
    sums = {"literal": [C.Pick(("suminsured_prop", "suminsured_lossofinc", "indem_per_grp"), "literal")],
            "by_cover": [C.Pick(("suminsured_prop",)),
                         C.Pick(("suminsured_lossofinc", "indem_per_grp"), where="LossofIncome_cover")]}
    monthly = C.recency_weight(rf, "start", base)
    pc = C.versions(monthly, [C.Pick(tuple(DETAIL_COLS)), *sums[sums_mode]])
    pc = C.policy_version(pc).drop("effectdate", "expirydate")
    return pc.withColumn("building_info_na", F.col("building_age").isNull())


def policy_claims_hasna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize_hasna(claims_encoded(spark, sf_dir))


def standardize(rf: DataFrame, base: float = WEIGHT_BASE_MAIN,
                sums_mode: str = "literal") -> DataFrame:
    """Study step 6-7: one row per policy version with its representative
    details and sums, recency-weighted, then NULL rules and Unknown levels.

    The monthly rows are shuffled once, by policy and situation: weights, picks, sums and
    version numbers all follow in that partitioning.
    """
    pc = standardize_hasna(rf, base, sums_mode)
    pc = pc.filter(F.col("suminsured_prop") != 0)
    pc = C.lossofinc_nulls(pc, "main")
    return fill_unknown(pc, BUILDING_COLS)


def policy_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "policy_claims",
                 lambda: standardize(claims_encoded(spark, sf_dir)), rules=Q.null_rules)


def policy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy versions with the study's split (80 % train in each cover group), written once: a fit
    reads its rows many times."""
    return stage(spark, sf_dir, "policy_split", lambda: SM.stratified_split(
        policy_claims(spark, sf_dir), 0.8, ["LossofIncome_cover"], ["policyno", "situation_num", "policy_version"], 123))


def policy_claims_monthly(spark: SparkSession, sf_dir: str,
                          base: float = WEIGHT_BASE_MAIN) -> DataFrame:
    """Monthly rows with recency weight and weighted exposure."""
    rf = claims_encoded(spark, sf_dir)
    return C.weighted_exposure(C.recency_weight(rf, "start", base))


# ---------------------------------------------------------------------------
# Second path (geo-code study): its own cleaning encodings and policy table.
# ---------------------------------------------------------------------------

# Fixed values of the study's second path: recode maps (unknown values kept).
SECOND_RECODES = {
    "construction_walls": {"Polystyrene": "Other", "Glass": "Other",
                           "Aluminum/Fibro/Iron/Steel (on Steel Frame)": "Other"},
    "construction_floor": {"Timber": "Other", "Other": "Other"},
    "building_age": {"Less than 2 Years": "Less Than 20 Years", "1960 - 1980": "Before 1980",
                     "Before 1960": "Before 1980"},
    "building_type": {"Medium rise": "Mid-High rise", "High rise": "Mid-High rise"},
    "sprinkler_type": {"1": ">0", "2": ">0", "3": ">0"},
    "indem_per_grp": {"UNKNOWN": "<12 mths"},
}
SECOND_DETAILS = ["riskpostcode", "state", "building_age", "building_type", "construction_walls",
                  "construction_floor", "sprinkler_type", "occupation_risk"]


def clean_second(raw: DataFrame) -> DataFrame:
    """Second-path cleaning: as the main path but without the code patches
    (applied at the postcode join) and the sprinkler level kept as text."""
    df = raw.withColumns({
        "sprinkler_type": sprinkler_level("sprinkler_type").cast("int").cast("string"),
        "property_cover": yn_flag("property_cover"),
        "LossofIncome_cover": yn_flag("LossofIncome_cover"),
    })
    df = df.filter(F.col("property_cover")).drop("property_cover")
    return floor_small(df, AMOUNT_COLS, SMALL_AMOUNT)


def occupation_map_second(clean: DataFrame) -> DataFrame:
    return GR.occupation_map(clean, excluded=["Unknown"], top_keep=10, top_n=13, severity_top=2)


def encode_second(clean: DataFrame, occupations: DataFrame | None = None) -> DataFrame:
    """Fixed recodes, occupation map (top-2 severity per line excluded, top
    10 kept, 13 groups), NULL -> 'Unknown', then loss-of-income NULL rules:
    covered rows with NULL amounts -> 0, uncovered indemnity 'LoI_NULL'."""
    occ = occupation_map_second(clean) if occupations is None else occupations
    df = clean
    for c, m in SECOND_RECODES.items():
        df = GR.recode(df, c, m)
    df = GR.recode(df, "occupation", occ, strict=False)
    df = fill_unknown(df, list(SECOND_RECODES) + ["occupation"])
    return C.lossofinc_nulls(df, "second")


def claims_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        clean = clean_second(claims_monthly(spark, sf_dir))
        return encode_second(clean, stage(spark, sf_dir, "occupations_second", lambda: occupation_map_second(clean)))
    return stage(spark, sf_dir, "claims_second", build,
                 rules=lambda df: Q.covered_rules(df, ["suminsured_lossofinc", "grossincurred_lossofinc"]))


def consolidate_second(enc: DataFrame, base: float = WEIGHT_BASE_SECOND) -> DataFrame:
    """Second-path versions: representative details (incl. postcode),
    property sum by mode, BI sum + indemnity by mode over covered rows (joined
    to covered versions only), recency-weighted consolidation; the claim-side
    code patches are applied to the version's postcode."""
    monthly = C.recency_weight(enc.withColumnRenamed("occupation", "occupation_risk"), "start", base)
    pc = C.versions(monthly, [C.Pick(tuple(SECOND_DETAILS)), C.Pick(("suminsured_prop",)),
                              C.Pick(("suminsured_lossofinc", "indem_per_grp"), where="LossofIncome_cover")])
    return patch_codes(pc, CLAIM_PATCHES)


_SITUATION = ["policyno", "situation_num"]


def by_situation(versions: DataFrame) -> DataFrame:
    """One row per situation: its versions in the order of their dates, as an array.  The versions of a
    situation lie together when they are made, so nothing moves, and read back they are numbered in place."""
    dates = ["effectdate", "expirydate"]
    rest = [c for c in versions.columns if c not in (*_SITUATION, *dates)]
    return versions.groupBy(*_SITUATION).agg(F.sort_array(F.collect_list(F.struct(*dates, *rest))).alias("versions"))


def _pair(postcode, state):
    return F.concat(F.length(postcode).cast("string"), F.lit("|"), postcode, state)


def finish_second(situations: DataFrame, dim: DataFrame, fixes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Postcode details joined AFTER consolidation, versions numbered, NULL rules for uncovered
    versions.  Only versions that the join keeps are numbered; which do is known from the distinct
    ``pairs`` (riskpostcode, state) of all versions, a line a pair of the dimension."""
    from exposa.operators.postcode import apply_state_fixes, attach_postcode
    own = pairs.withColumn("_pair", _pair(F.col("riskpostcode"), F.col("state")))
    kept = [r["_pair"] for r in attach_postcode(apply_state_fixes(own, fixes), dim).select("_pair").distinct().collect()]
    left = F.filter("versions", lambda v: _pair(v["riskpostcode"], v["state"]).isin(kept))
    pc = situations.select(*_SITUATION, F.posexplode(left).alias("policy_version", "_v")) \
        .select(*_SITUATION, "_v.*", (F.col("policy_version") + 1).alias("policy_version"))
    pc = attach_postcode(apply_state_fixes(pc, fixes), dim).drop("effectdate", "expirydate")
    pc = pc.select(*[c for c in pc.columns if c != "policy_version"], "policy_version")
    pc = pc.withColumn("building_info_na", F.col("building_age").isNull())
    cover = F.col("LossofIncome_cover")
    return pc.withColumns({
        "indem_per_grp": F.when(~cover, F.lit("LoI_NULL")).otherwise(F.col("indem_per_grp")),
        "suminsured_lossofinc": F.when(~cover, F.lit(0.0)).otherwise(F.col("suminsured_lossofinc"))})


def policy_claims_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-path policy table; versions, the small dimension and the state
    fixes are stages of their own, so the final join is one pass."""
    from exposa.operators.postcode import claim_state_fixes, postcode_dim, reconcile_dim

    def build():
        v = stage(spark, sf_dir, "versions_second",
                  lambda: by_situation(consolidate_second(claims_second(spark, sf_dir))))
        pairs = stage(spark, sf_dir, "version_pairs_second",
                      lambda: v.select(F.explode("versions").alias("v")).select("v.riskpostcode", "v.state").distinct())
        dim = stage(spark, sf_dir, "postcode_dim_second",
                    lambda: reconcile_dim(pairs, postcode_dim(postcodes(spark, sf_dir), pairs)))
        fixes = stage(spark, sf_dir, "state_fixes_second", lambda: claim_state_fixes(pairs, dim))
        return finish_second(v, dim, fixes, pairs)
    # the dimension may leave a rating open (its own audit lists them), nothing else
    return stage(spark, sf_dir, "policy_claims_second", build,
                 rules=lambda df: Q.null_rules(df, [c for c in df.columns if c != "electoraterating"]))
