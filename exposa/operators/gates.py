"""Data-quality gates.

A rule is a count of bad rows as an aggregate column, so a stage can observe
its rules while it is written (``stages.stage``).

Each audit returns a small audit DataFrame computed in ONE aggregation pass
(so it is checkable and cheap at any size); ``raise_if_bad`` turns an audit
into an exception on the driver, reading only the audit rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.functions.expr import count_if


def _long(df_one_row: DataFrame, names: Sequence[str], label: str = "column",
          value: str = "bad_rows") -> DataFrame:
    """Unpivot the one-row audit into (column, bad_rows)."""
    return df_one_row.unpivot([], list(names), label, value)


def count_bad(bad: Column) -> Column:
    """Rows where ``bad`` is true."""
    return count_if(bad)


def null_rules(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, Column]:
    """Column -> count of its NULLs (rules of a gate, see ``raise_if_counted``)."""
    return {c: count_if(F.col(c).isNull()) for c in cols or df.columns}


def covered_rules(df: DataFrame, allowed_when_uncovered: Sequence[str],
                  cover: str = "LossofIncome_cover") -> dict[str, Column]:
    """Covered rows: no NULL anywhere.  Uncovered: NULL only in listed columns."""
    cols, cov = [c for c in df.columns if c != cover], F.col(cover)
    out = {f"covered|{c}": count_if(cov & F.col(c).isNull()) for c in cols}
    out |= {f"uncovered|{c}": count_if(~cov & F.col(c).isNull()) for c in cols if c not in set(allowed_when_uncovered)}
    return out | {f"cover_null|{cover}": count_if(cov.isNull())}


def raise_if_counted(counts: Mapping[str, int], what: str = "gate") -> None:
    """Raise when a rule counted bad rows."""
    bad = {k: v for k, v in counts.items() if v}
    if bad:
        raise AssertionError(f"{what} failed: {bad}")


def null_audit(df: DataFrame, cols: Sequence[str] | None = None,
               where: Column | None = None) -> DataFrame:
    """(column, bad_rows): NULL count per column, optionally on a row subset."""
    cols = list(cols or df.columns)
    src = df if where is None else df.filter(where)
    one = src.agg(*[c.alias(n) for n, c in null_rules(src, cols).items()])
    return _long(one, cols)


def conditional_null_audit(df: DataFrame, allowed_when_uncovered: Sequence[str],
                           cover: str = "LossofIncome_cover") -> DataFrame:
    """Covered rows: no NULL anywhere.  Uncovered: NULL only in listed columns.

    Returns (rule, column, bad_rows) from one pass over ``df``.
    """
    one = df.agg(*[c.alias(n) for n, c in covered_rules(df, allowed_when_uncovered, cover).items()])
    names = one.columns
    long = _long(one, names, "key")
    return long.select(
        F.split("key", r"\|")[0].alias("rule"), F.split("key", r"\|")[1].alias("column"),
        "bad_rows")


def raise_if_bad(audit: DataFrame, what: str = "gate") -> None:
    """Raise when any audit row has bad_rows > 0 (reads only bad rows)."""
    bad = audit.filter(F.col("bad_rows") > 0).collect()
    if bad:
        raise AssertionError(f"{what} failed: {[r.asDict() for r in bad]}")


def assert_no_nulls(df: DataFrame, cols: Sequence[str] | None = None,
                    where: Column | None = None) -> None:
    raise_if_bad(null_audit(df, cols, where), "no-NULL assertion")


def assert_covered(df: DataFrame, allowed_when_uncovered: Sequence[str],
                   cover: str = "LossofIncome_cover") -> None:
    """Raise on a NULL in a covered row, or in an uncovered one outside the listed columns."""
    raise_if_bad(conditional_null_audit(df, allowed_when_uncovered, cover), "cover-conditional NULL assertion")


def join_loss_audit(before: DataFrame, after: DataFrame, dim: DataFrame,
                    key: str = "riskpostcode", dim_key: str = "postcode") -> DataFrame:
    """rows(before) - rows(after) must equal rows whose key is unknown to dim."""
    known = dim.select(F.col(dim_key).alias(key)).distinct()
    n = F.count(F.lit(1))
    out = before.sparkSession.range(1).select(
        before.select(n).scalar().alias("rows_before"),
        after.select(n).scalar().alias("rows_after"),
        before.join(known, key, "left_anti").select(n).scalar().alias("rows_unknown"))
    return out.withColumn(
        "bad_rows", F.abs(F.col("rows_before") - F.col("rows_after") - F.col("rows_unknown")))


def mapping_audit(df: DataFrame, maps: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """(column, key) of every recode key that is not an existing level."""
    spark = df.sparkSession
    rows = [(c, k) for c, m in maps.items() for k in m]
    if not rows:
        return spark.createDataFrame([], "column string, key string")
    keys = spark.createDataFrame(rows, "column string, key string")
    levels = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("key"))
        for c in maps])).alias("s")).select("s.*").distinct()
    return keys.join(levels, ["column", "key"], "left_anti")


def missing_patterns(df: DataFrame, cols: Sequence[str] | None = None,
                     n: int = 7) -> DataFrame:
    """Rows per combination of NULL flags (the n columns with most NULLs).

    Column choice needs the NULL counts (one pass); the pattern table is a
    second partial aggregation.
    """
    cols = list(cols or df.columns)
    counts = null_audit(df, cols).filter(F.col("bad_rows") > 0).orderBy(
        F.desc("bad_rows"), "column").limit(n).collect()
    chosen = [r["column"] for r in counts]
    if not chosen:
        return df.agg(F.count(F.lit(1)).alias("n_rows"))
    return df.groupBy(*[F.col(c).isNull().alias(f"na_{c}") for c in chosen]).agg(
        F.count(F.lit(1)).alias("n_rows"))


def drop_constant(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Drop predictors with one distinct value (one countDistinct pass)."""
    one = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols]).first()
    const = [c for c in cols if one[c] <= 1]
    return df.drop(*const), const
