"""Column expressions: the scalar rules of the cleaning and feature steps.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "col_of", "sprinkler_level", "yn_flag", "floor_small_expr", "safe_div",
    "occupation_prefix", "cancelled", "claim_type", "building_info_na",
    "recency_weight_expr", "mean_strict", "count_if", "any_true",
    "recode_map_expr", "patch_codes", "floor_small", "fill_unknown", "freq_sev_cols",
    "money_sum", "join_null_safe",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sprinkler_level(c) -> Column:
    """'None' -> 0; otherwise the FIRST digit in the text; no digit -> NULL."""
    c = col_of(c)
    digit = F.regexp_extract(c, r"[0-9]", 0)
    return (F.when(c == "None", F.lit(0.0))
            .otherwise(F.nullif(digit, F.lit("")).cast("double")))


def yn_flag(c) -> Column:
    """'Y' -> true, any other text -> false, NULL stays NULL."""
    return col_of(c) == "Y"


def floor_small_expr(c, limit: float = 10.0) -> Column:
    """Amounts below ``limit`` (incl. negatives) become 0; NULL stays NULL."""
    c = col_of(c)
    return F.when(c < limit, F.lit(0.0)).otherwise(c)


def safe_div(num, den) -> Column:
    """num / den with 0 and NULL denominators giving NULL (ANSI-safe)."""
    return col_of(num) / F.nullif(col_of(den), F.lit(0))


def occupation_prefix(c, general: bool = False) -> Column:
    """First character of the occupation; or '<letter>_General'."""
    first = F.substring(col_of(c), 1, 1)
    return F.concat(first, F.lit("_General")) if general else first


def cancelled(expiry="expirydate", ym="ym", xm="xm", days: int = 61) -> Column:
    """Version ends more than ``days`` after the first day of the row's month."""
    start = F.make_date(col_of(ym), col_of(xm), F.lit(1))
    return F.datediff(col_of(expiry), start) > days


def claim_type(prop="grossincurred_prop", bi="grossincurred_lossofinc") -> Column:
    """Both / Only Prop / Only BI / No Claim; a NULL BI amount is no BI claim."""
    p, b = col_of(prop), F.coalesce(col_of(bi), F.lit(0.0))
    return (F.when((p > 0) & (b > 0), "Both")
            .when((p > 0) & (b == 0), "Only Prop")
            .when((p == 0) & (b > 0), "Only BI")
            .when((p == 0) & (b == 0), "No Claim"))


def building_info_na(c="building_age") -> Column:
    return col_of(c).isNull()


def recency_weight_expr(date_col, max_date, base: float) -> Column:
    """base ** days(max_date - date)."""
    return F.pow(F.lit(float(base)), F.datediff(col_of(max_date), col_of(date_col)))


def mean_strict(c) -> Column:
    """Mean WITHOUT dropping NULLs: any NULL in the group gives NULL."""
    c = col_of(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def count_if(cond: Column) -> Column:
    """Count of rows where ``cond`` is true (NULL counts as false)."""
    return F.count(F.when(cond, F.lit(1)))


def any_true(c) -> Column:
    return F.bool_or(col_of(c))


def recode_map_expr(c, mapping: Mapping[str, str], keep_unknown: bool = True) -> Column:
    """Dictionary lookup as a literal map (for maps with a fixed, small size)."""
    if not mapping:
        return col_of(c) if keep_unknown else F.lit(None).cast("string")
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = m[col_of(c)]
    return F.coalesce(hit, col_of(c)) if keep_unknown else hit


def patch_codes(df: DataFrame,
                rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Apply (match_col, match_value, target_col, new_value) rules at once.

    All rules test the ORIGINAL values (one projection), e.g. the state fix
    for a postcode sees the postcode before any postcode rule changes it.
    """
    new = {}
    for match_col, match_val, target, value in rules:
        prev = new.get(target, F.col(target))
        new[target] = F.when(F.col(match_col) == match_val, F.lit(value)).otherwise(prev)
    return df.withColumns(new) if new else df


def floor_small(df: DataFrame, cols: Iterable[str], limit: float = 10.0) -> DataFrame:
    return df.withColumns({c: floor_small_expr(c, limit) for c in cols})


def fill_unknown(df: DataFrame, cols: Iterable[str], label: str = "Unknown") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(label)) for c in cols})


def money_sum(c, scale: int = 4) -> Column:
    """Exact sum of a money column (values with <= ``scale`` decimals):
    summed as DECIMAL, returned as the nearest double - independent of the
    order rows arrive in, so every engine gets the same value."""
    return F.sum(col_of(c).cast(f"decimal(38,{scale})")).cast("double")


def freq_sev_cols(lines=("prop", "lossofinc")) -> dict[str, Column]:
    """freq = count/exposure, sev = incurred/count (NaN/NULL -> 0); logs of
    positive amounts (0 -> NULL first); log severity = log(incurred/count)."""
    out = {}
    for ln in lines:
        n, a = F.col(f"claimcount_{ln}"), F.col(f"grossincurred_{ln}")
        out[f"freq_{ln}"] = F.coalesce(safe_div(n, "exposure"), F.lit(0.0))
        out[f"sev_{ln}"] = F.coalesce(safe_div(a, n), F.lit(0.0))
        out[f"log_incurred_{ln}"] = F.log(F.nullif(a, F.lit(0.0)))
        out[f"log_severity_{ln}"] = F.log(safe_div(a, n))
    return out


def join_null_safe(a: DataFrame, b: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` treating NULL = NULL as a match (<=>), keeping
    one copy of each key column - so rows with a NULL key are never lost."""
    keys = list(keys)
    b2 = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                  *[c for c in b.columns if c not in keys])
    cond = None
    for k in keys:
        e = a[k].eqNullSafe(b2[f"__r_{k}"])
        cond = e if cond is None else cond & e
    return a.join(b2, cond, how).drop(*[f"__r_{k}" for k in keys])
