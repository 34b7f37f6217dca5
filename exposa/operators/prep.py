"""Feature preparation for models: level tables, coding, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels_of(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct levels (a category's level table is small by nature;
    only the levels reach the driver, never rows)."""
    return [r[0] for r in df.select(F.col(col).cast("string")).distinct()
            .orderBy(F.col(col).asc_nulls_last()).collect() if r[0] is not None]


def dummies(df: DataFrame, cols: Sequence[str], levels: dict[str, list[str]] | None = None,
            drop_first: bool = True) -> DataFrame:
    """k-1 indicator columns <col>_<level>; the first level is the base."""
    out = {}
    for c in cols:
        lv = (levels or {}).get(c) or levels_of(df, c)
        for v in (lv[1:] if drop_first else lv):
            out[f"{c}_{v}"] = (F.col(c).cast("string") == v).cast("int")
    return df.withColumns(out)


def ordinal(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Integer codes 0..k-1 in alphabetical level order (StringIndexer)."""
    from pyspark.ml.feature import StringIndexer
    idx = StringIndexer(inputCols=list(cols), outputCols=[c + suffix for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    return idx.fit(df).transform(df)


class MinMax:
    """(x - min) / (max - min) with TRAINING bounds; inverse for predictions."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)
        self.bounds: dict[str, tuple[float, float]] = {}

    def fit(self, train: DataFrame) -> "MinMax":
        one = train.agg(*[F.min(c).alias(f"lo_{c}") for c in self.cols],
                        *[F.max(c).alias(f"hi_{c}") for c in self.cols]).first()
        self.bounds = {c: (one[f"lo_{c}"], one[f"hi_{c}"]) for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (lo, hi) in self.bounds.items():
            span = (hi - lo) if hi is not None and lo is not None and hi != lo else None
            out[c] = (F.col(c) - F.lit(lo)) / F.lit(span) if span else F.lit(0.0)
        return df.withColumns(out)

    def invert(self, df: DataFrame, col: str, like: str) -> DataFrame:
        lo, hi = self.bounds[like]
        return df.withColumn(col, F.col(col) * F.lit(hi - lo) + F.lit(lo))


def drop_unused_levels(levels: DataFrame, data: DataFrame, col: str) -> DataFrame:
    """Level rows that still have data rows."""
    return levels.join(data.select(col).distinct(), col, "left_semi")
