"""Postcode dimension: build, reconcile states with the claims, attach.

Size: the dimension has one row per (postcode, state) - a few thousand rows
for a whole country, bounded by the postcode system and not by the claims.
All joins against it are equi-joins on (postcode, state); Spark (AQE) turns
them into broadcast hash joins from the measured runtime size, and the
claims side is never shuffled for them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the study: the two code fixes and the one duplicated area.
POSTCODE_PATCHES = [
    ("postcode", "004375", "state", "QLD"),
    ("postcode", "002309", "postcode", "002083"),
]
CLAIM_PATCHES = [
    ("riskpostcode", "004375", "state", "QLD"),
    ("riskpostcode", "002309", "riskpostcode", "002083"),
]
SA3_KEEP = {"002304": "Shoalhaven"}
SA4_KEEP = {"002304": "Southern Highlands and Shoalhaven"}


def _patch(df: DataFrame, rules) -> DataFrame:
    from exposa.functions.expr import patch_codes
    return patch_codes(df, rules)


def _one_area(dim: DataFrame, area: str, keep: Mapping[str, str]) -> DataFrame:
    """Distinct non-NULL (postcode, state, area); one area per pair.

    ``keep`` pins the named area for listed postcodes (the study's hand fix);
    any other pair with several areas keeps the smallest name.
    """
    d = dim.select("postcode", "state", area).filter(F.col(area).isNotNull()).distinct()
    for pc, name in keep.items():
        d = d.filter(~((F.col("postcode") == pc) & (F.col(area) != name)))
    return d.groupBy("postcode", "state").agg(F.min(area).alias(area))


def unique_mode(df: DataFrame, group: str, value: str, out: str | None = None) -> DataFrame:
    """Most frequent non-NULL ``value`` per ``group``; tied modes give no row.

    Counts per (group, value) are a partial aggregate; the mode test runs on
    that count table (one row per group and value) with group windows.
    """
    from pyspark.sql import Window
    out = out or value
    counts = (df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
              .groupBy(group, value).agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy(group)
    top = counts.withColumn("_max", F.max("_n").over(w)).filter(F.col("_n") == F.col("_max"))
    top = top.withColumn("_k", F.count(F.lit(1)).over(w)).filter(F.col("_k") == 1)
    return top.select(group, F.col(value).alias(out))


def restricted_dim(raw: DataFrame, used: DataFrame, patches: Sequence = POSTCODE_PATCHES) -> DataFrame:
    """Dimension rows of postcodes in use (semi join), then patched."""
    used_pc = used.select(F.col("riskpostcode").alias("postcode")).distinct()
    return _patch(raw.join(used_pc, "postcode", "left_semi"), patches)


def postcode_dim(raw: DataFrame, used: DataFrame,
                 patches: Sequence = POSTCODE_PATCHES,
                 sa3_keep: Mapping[str, str] = SA3_KEEP,
                 sa4_keep: Mapping[str, str] = SA4_KEEP) -> DataFrame:
    """(postcode, state, sa3name, sa4name, electoraterating), one row per pair.

    ``raw`` is the padded dimension; ``used`` holds a ``riskpostcode`` column
    (the claims) and restricts the dimension to postcodes in use.  Per pair:
    the SA3 and SA4 (NULLs dropped, the study's hand fix applied, smallest
    name if several) and the own rating come from ONE aggregation; pairs
    without both areas are dropped.  The electorate rating is the pair's
    own, else the unambiguous mode of its SA3, else of its SA4.
    """
    post = restricted_dim(raw, used, patches)

    def kept(area, keep):
        ok = F.col(area).isNotNull()
        for pc, name in keep.items():
            ok = ok & ~((F.col("postcode") == pc) & (F.col(area) != name))
        return F.min(F.when(ok, F.col(area)))

    pairs = (post.groupBy("postcode", "state")
             .agg(kept("sa3name", sa3_keep).alias("sa3name"), kept("sa4name", sa4_keep).alias("sa4name"),
                  F.min("electoraterating").alias("own_rating"))
             .filter(F.col("sa3name").isNotNull() & F.col("sa4name").isNotNull()))
    m3 = unique_mode(post, "sa3name", "electoraterating", "sa3_rating")
    m4 = unique_mode(post, "sa4name", "electoraterating", "sa4_rating")
    return (pairs.join(m3, "sa3name", "left").join(m4, "sa4name", "left")
            .select("postcode", "state", "sa3name", "sa4name",
                    F.coalesce("own_rating", "sa3_rating", "sa4_rating").alias("electoraterating")))


def impute_electorate(dim: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Fill a missing rating from the SA3 mode, then the SA4 mode."""
    source = dim if source is None else source
    m3 = unique_mode(source, "sa3name", "electoraterating", "sa3_rating")
    m4 = unique_mode(source, "sa4name", "electoraterating", "sa4_rating")
    cols = dim.columns
    return (dim.join(m3, "sa3name", "left").join(m4, "sa4name", "left")
            .withColumn("electoraterating",
                        F.coalesce("electoraterating", "sa3_rating", "sa4_rating"))
            .select(*cols))


def dimension_audit(dim: DataFrame) -> DataFrame:
    """Per (postcode, state): does any row carry an SA3 / SA4 / rating?"""
    return dim.groupBy("postcode", "state").agg(
        F.bool_or(F.col("sa3name").isNotNull()).alias("has_sa3"),
        F.bool_or(F.col("sa4name").isNotNull()).alias("has_sa4"),
        F.bool_or(F.col("electoraterating").isNotNull()).alias("has_rating"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def unmatched(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """Rows of ``a`` without a match in ``b`` (left anti join)."""
    return a.join(b, on, "left_anti")


def restrict_to(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys`` (left semi join)."""
    return df.join(keys, on, "left_semi")


def reconcile_dim(claims: DataFrame, dim: DataFrame) -> DataFrame:
    """Step 1 of the state reconciliation (dimension side).

    Dimension pairs with no claim: every dimension row of that postcode
    takes the claims' state for the postcode (smallest if several), then
    one row per (postcode, state) is kept (the row that already had that
    state first, then smallest areas).
    """
    claim_pairs = claims.select(F.col("riskpostcode").alias("postcode"), "state").distinct()
    dim_pairs = dim.select("postcode", "state").distinct()
    bad_dim_pc = unmatched(dim_pairs, claim_pairs, ["postcode", "state"]).select("postcode").distinct()
    claim_state = (claim_pairs.join(bad_dim_pc, "postcode", "left_semi")
                   .groupBy("postcode").agg(F.min("state").alias("_new_state")))
    d = dim.join(claim_state, "postcode", "left")
    d = d.withColumn("_had", F.col("state") == F.coalesce("_new_state", "state")).withColumn(
        "state", F.coalesce("_new_state", "state"))
    other = [c for c in dim.columns if c not in ("postcode", "state")]
    pick = F.struct((~F.col("_had")).alias("_not_had"), *_nulls_last_fields(other))
    return d.groupBy("postcode", "state").agg(F.min(pick).alias("_p")).select(
        "postcode", "state", *[F.col(f"_p.{c}").alias(c) for c in other])


def claim_state_fixes(claims: DataFrame, dim: DataFrame) -> DataFrame:
    """Step 2 (claims side): (riskpostcode, dim_state) for postcodes whose
    claim pair is unmatched although the postcode IS in the dimension; the
    dimension's state (smallest if several) replaces the claims' state."""
    claim_pairs = claims.select(F.col("riskpostcode").alias("postcode"), "state").distinct()
    pairs = dim.select("postcode", "state")
    known = dim.select("postcode").distinct()
    still_bad = (unmatched(claim_pairs, pairs, ["postcode", "state"])
                 .join(known, "postcode", "left_semi").select("postcode").distinct())
    return (pairs.join(still_bad, "postcode", "left_semi")
            .groupBy("postcode").agg(F.min("state").alias("dim_state"))
            .withColumnRenamed("postcode", "riskpostcode"))


def apply_state_fixes(claims: DataFrame, fixes: DataFrame) -> DataFrame:
    """Claims with the fixed states (fixes: one row per postcode, small)."""
    return (claims.join(fixes, "riskpostcode", "left")
            .withColumn("state", F.coalesce("dim_state", "state")).select(*claims.columns))


def reconcile_state(claims: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Make claim states and dimension states agree; returns (claims, dim).

    Postcodes unknown to the dimension stay as they are (dropped later by
    the inner join and counted by the join-loss gate).
    """
    d = reconcile_dim(claims, dim)
    return apply_state_fixes(claims, claim_state_fixes(claims, d)), d


def _nulls_last_fields(cols):
    out = []
    for c in cols:
        out += [F.col(c).isNull().alias(f"{c}__null"), F.col(c).alias(c)]
    return out


def attach_postcode(claims: DataFrame, dim: DataFrame,
                    cols: Sequence[str] = ("sa3name", "sa4name", "electoraterating"),
                    mark: tuple[str, str] | None = None) -> DataFrame:
    """Inner join claims to the dimension on (postcode, state).

    ``mark``: keep all claims and say in two columns (true or NULL) whether the pair was found and
    whether the dimension knows the postcode."""
    d = dim.select(F.col("postcode").alias("riskpostcode"), "state", *cols)
    if mark is None:
        return claims.join(d, ["riskpostcode", "state"], "inner")
    found, known = mark
    postcodes = d.select("riskpostcode").distinct().withColumn(known, F.lit(True))
    return claims.join(d.withColumn(found, F.lit(True)), ["riskpostcode", "state"], "left") \
        .join(postcodes, "riskpostcode", "left")
