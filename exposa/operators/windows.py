"""Order-dependent picks made deterministic, and group statistics.

Picks ("first/last row per key") are ``min`` over an ordered struct: a
partial aggregate, so a hot key is combined map-side instead of being sorted
whole in one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sort_fields(order: Sequence[tuple[str, str]]) -> list[Column]:
    """(col, 'asc'|'desc') -> struct fields sorting ascending, NULLs last.

    'desc' needs a numeric column (it is negated)."""
    out = []
    for i, (c, how) in enumerate(order):
        v = F.col(c)
        if how == "desc":
            v = -v
        out += [F.col(c).isNull().alias(f"_n{i}"), v.alias(f"_v{i}")]
    return out


def pick_row(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, str]],
             cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first by ``order`` (later fields break ties).

    ``cols`` are the columns carried (default: all non-key columns); they
    also break remaining ties (ascending), so the pick is deterministic.
    """
    keys = list(keys)
    cols = [c for c in (cols or df.columns) if c not in keys]
    fields = _sort_fields(order) + [
        f for c in cols for f in (F.col(c).isNull().alias(f"{c}__null"), F.col(c).alias(c))]
    best = df.groupBy(*keys).agg(F.min(F.struct(*fields)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in cols])


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             cols: Sequence[str] | None = None) -> DataFrame:
    """Last row per key in the written ``order`` (row_number() == n())."""
    return pick_row(df, keys, [(o, "desc") for o in order], cols)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              cols: Sequence[str] | None = None) -> DataFrame:
    """First row per key, ``order`` ascending with NULLs last."""
    return pick_row(df, keys, [(o, "asc") for o in order], cols)


def with_group_stats(df: DataFrame, group: Sequence[str], n_col: str = "n") -> DataFrame:
    """Attach row_count (= n()) and max_n (= max(n)) of each group.

    Aggregate then join back on the group key: skew-safe (partial
    aggregation), and AQE broadcasts the aggregate when it is small.
    """
    from exposa.functions.expr import join_null_safe
    stats = df.groupBy(*group).agg(F.count(F.lit(1)).alias("row_count"),
                                   F.max(n_col).alias("max_n"))
    return join_null_safe(df, stats, list(group))


def with_group_mean(df: DataFrame, group: str, x: str, out: str | None = None) -> DataFrame:
    """Mean of ``x`` in the row's group attached to every row."""
    out = out or f"mean_{x}"
    m = df.groupBy(group).agg(F.avg(x).alias(out))
    return df.join(m, group, "left")
