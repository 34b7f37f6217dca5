"""Category grouping: lumps, recodes, level order, occupation map.

Pattern: aggregate the weight per level (a partial aggregate - skew-safe),
decide on that small level table, then apply the decision with an equi-join
on the level.  The level table has one row per distinct category value;
AQE broadcasts it from its measured size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposa.functions.expr import join_null_safe
from exposa.operators.quantiles import exact_quantiles

# Fixed values of the study.
WALL_RECODE = {"Polystyrene": "Other", "Glass": "Other"}
OCCUPATION_EXCLUDED = ["Unknown", "O_Other Community Services", "D- Electricity, Gas & Water"]


def level_weights(df: DataFrame, col: str, weight: str | None = "epy",
                  out: str = "exposure") -> DataFrame:
    """(level, exposure): sum of ``weight`` per level (count when None)."""
    agg = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    return df.groupBy(col).agg(agg.alias(out))


exposure_by = level_weights


def lump_min(df: DataFrame, col: str, weight: str = "epy", min_weight: float = 5.0,
             other: str = "NEW") -> DataFrame:
    """Levels with total weight < ``min_weight`` become ``other``; NULL kept."""
    small = (level_weights(df, col, weight, "_w").filter(F.col("_w") < min_weight)
             .select(col, F.lit(True).alias("_small")))
    return (df.join(small, col, "left")
            .withColumn(col, F.when(F.col("_small"), F.lit(other)).otherwise(F.col(col)))
            .drop("_small"))


def lump_n_levels(levels: DataFrame, col: str, weight: str, n: int,
                  other: str = "Other", out: str | None = None) -> DataFrame:
    """On a level table: keep the n heaviest (min rank, ties kept), rest ``other``.

    Window without partition on purpose: it runs on the level table (one row
    per category value), never on raw rows.
    """
    out = out or col
    w = Window.orderBy(F.desc(weight))
    return levels.withColumn("_rank", F.rank().over(w)).withColumn(
        out, F.when(F.col("_rank") <= n, F.col(col)).otherwise(F.lit(other))).drop("_rank")


def lump_n(df: DataFrame, col: str, weight: str = "epy", n: int = 15,
           other: str = "Other") -> DataFrame:
    lv = level_weights(df, col, weight, "_w").filter(F.col(col).isNotNull())
    m = lump_n_levels(lv, col, "_w", n, other, "_to").select(col, "_to")
    return (df.join(m, col, "left")
            .withColumn(col, F.coalesce("_to", col)).drop("_to"))


def recode(df: DataFrame, col: str, mapping: Mapping[str, str] | DataFrame,
           out: str | None = None, strict: bool = False) -> DataFrame:
    """Replace values found in ``mapping``; others kept (or NULL if strict).

    ``mapping`` may be a dict (becomes a literal map - fixed, small) or a
    two-column (from, to) DataFrame derived from data (equi-join).
    """
    out = out or col
    if isinstance(mapping, DataFrame):
        m = mapping.select(F.col(mapping.columns[0]).alias("_from"),
                           F.col(mapping.columns[1]).alias("_to"))
        j = df.join(m, F.col(col) == F.col("_from"), "left")
        val = F.col("_to") if strict else F.coalesce("_to", col)
        return j.withColumn(out, val).drop("_from", "_to")
    from exposa.functions.expr import recode_map_expr
    return df.withColumn(out, recode_map_expr(col, mapping, keep_unknown=not strict))


def occupation_map(df: DataFrame, col: str = "occupation", weight: str = "epy",
                   excluded: Sequence[str] = OCCUPATION_EXCLUDED, top_keep: int = 10,
                   top_n: int = 15, other: str = "Other", severity_top: int = 0,
                   severity_cols: Sequence[str] = ("grossincurred_prop", "grossincurred_lossofinc")
                   ) -> DataFrame:
    """(occupation, occupation_risk) map.

    Excluded names map to themselves; with ``severity_top`` > 0 the
    ``severity_top`` occupations of highest mean positive amount per line
    (name breaks ties) are excluded too (the second path).  The rest, by
    exposure desc (name breaks ties): the top ``top_keep`` stay, others
    become '<letter>_General'; then only the ``top_n`` heaviest resulting
    groups stay (ties kept), the rest 'Other'.  Built from the unmerged
    occupations, so every name has an entry.
    """
    # one aggregation: exposure and, per line, the mean positive amount of each level
    means = [F.avg(F.when(F.col(a) > 0, F.col(a))).alias(f"_m{i}") for i, a in enumerate(severity_cols)]
    lv = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.sum(weight).alias("exposure"), *means)
    out = F.col(col).isin(list(excluded)) if excluded else F.lit(False)
    for i in range(len(severity_cols) if severity_top else 0):
        top = Window.orderBy(F.desc_nulls_last(f"_m{i}"), F.asc(col))          # level table: one row a name
        lv = lv.withColumn(f"_s{i}", F.row_number().over(top))
        out = out | (F.col(f"_m{i}").isNotNull() & (F.col(f"_s{i}") <= severity_top))
    lv = lv.withColumn("_out", out)
    rest = lv.filter(~F.col("_out"))
    order = Window.orderBy(F.desc("exposure"), F.asc(col))
    step1 = rest.withColumn("_rn", F.row_number().over(order)).withColumn(
        "_grp", F.when(F.col("_rn") > top_keep,
                       F.concat(F.substring(col, 1, 1), F.lit("_General"))).otherwise(F.col(col)))
    grp_w = step1.groupBy("_grp").agg(F.sum("exposure").alias("_gw"))
    kept = lump_n_levels(grp_w, "_grp", "_gw", top_n, other, "occupation_risk")
    mapped = step1.join(kept.select("_grp", "occupation_risk"), "_grp").select(
        col, "occupation_risk")
    excl_map = lv.filter("_out").select(col, F.col(col).alias("occupation_risk"))
    return mapped.unionByName(excl_map)


def pool_rare(train: DataFrame, cols: Sequence[str], threshold: float = 0.25,
              other: str = "other_values") -> dict[str, DataFrame]:
    """Per column: (level, pooled) where levels with share < threshold pool.

    Fitted on training rows; apply with ``recode(df, col, table)``.
    """
    out = {}
    for c in cols:
        lv = train.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        share = F.col("_n") / F.sum("_n").over(Window.partitionBy())
        out[c] = lv.select(c, F.when(share < threshold, F.lit(other))
                           .otherwise(F.col(c)).alias("pooled"))
    return out


def level_order(df: DataFrame, col: str, weight: str = "exposure",
                how: str = "median_asc", digits: int | None = 6) -> DataFrame:
    """(level, stat, level_rank); rank 1 first.  The base level is the
    heaviest: last for ``median_asc`` (R fct_reorder), first for ``sum_desc``.
    """
    if how == "median_asc":
        q = exact_quantiles(df, [col], weight, [0.5]).select(col, F.col("quantiles")[0].alias("stat"))
        lv = join_null_safe(df.select(col).distinct(), q, [col], "left")
        w = Window.orderBy(F.asc("stat"), F.asc(col))
    elif how == "sum_desc":
        lv = df.groupBy(col).agg(F.sum(weight).alias("stat"))
        w = Window.orderBy(F.desc("stat"), F.asc(col))
    else:
        raise ValueError(how)
    if digits is not None:  # equal statistics must tie whatever the summation order
        lv = lv.withColumn("stat", F.round("stat", digits))
    return lv.withColumn("level_rank", F.row_number().over(w))


def biggest_reference(df: DataFrame, col: str, exposure: str = "exposure") -> DataFrame:
    """(level, exposure, level_rank): biggest exposure first, rest alphabetical."""
    lv = df.groupBy(col).agg(F.sum(exposure).alias("exposure"))
    top = Window.orderBy(F.desc("exposure"), F.asc(col))
    lv = lv.withColumn("_top", F.row_number().over(top) == 1)
    w = Window.orderBy(F.desc("_top"), F.asc(col))
    return lv.withColumn("level_rank", F.row_number().over(w)).drop("_top")


def top_severity(df: DataFrame, col: str, amount: str, n: int = 2) -> DataFrame:
    """Levels with the highest mean positive ``amount`` (top n, name ties)."""
    return (df.filter(F.col(amount) > 0).groupBy(col)
            .agg(F.avg(amount).alias("mean_amount"), F.count(F.lit(1)).alias("n_claims"))
            .orderBy(F.desc("mean_amount"), F.asc(col)).limit(n))


def novel_levels(train: DataFrame, test: DataFrame, col: str,
                 flag: str = "novel_level") -> DataFrame:
    """Test rows flagged when their level is not seen in training."""
    seen = train.select(col).distinct().withColumn("_seen", F.lit(True))
    return test.join(seen, col, "left").withColumn(
        flag, F.col("_seen").isNull()).drop("_seen")
