"""Policy-version consolidation: representatives, weights, versions.

Skew: every operator here aggregates BEFORE it picks, so a policy with a
third of all monthly rows is combined map-side (partial aggregation) and
never lands whole in one task.  The "pick one combination per version" step
is a ``min`` over an ordered struct - itself a partial aggregate - instead
of a window over raw rows.

``versions`` does the same for many picks at once and moves the rows once: policies of
ordinary size are dealt out by policy, and counts, picks and sums of all their
versions follow in place; policies measured larger take the operators above.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.functions.expr import count_if, money_sum, recency_weight_expr
from exposa.session import dealt
from exposa.sources.schema import VERSION_KEYS


def _asc_nulls_last(cols: Sequence[str]) -> list[Column]:
    """Struct fields that sort ascending with NULLs after values."""
    out = []
    for c in cols:
        out += [F.col(c).isNull().alias(f"{c}__null"), F.col(c).alias(c)]
    return out


def representative(df: DataFrame, cols: Sequence[str],
                   keys: Sequence[str] = VERSION_KEYS,
                   order: Sequence[str] = ("ym", "xm")) -> DataFrame:
    """Most frequent combination of ``cols`` per key.

    Ties go to the combination seen latest by ``order`` (ym, xm), then to the
    smallest values (ascending, NULLs last).  One row per key.
    """
    keys, cols = list(keys), list(cols)
    latest = F.struct(*[F.col(o) for o in order])
    combos = df.groupBy(*keys, *cols).agg(
        F.count(F.lit(1)).alias("_n"), F.max(latest).alias("_latest"))
    rank_key = F.struct(
        (-F.col("_n")).alias("neg_n"),
        *[(-F.col(f"_latest.{o}")).alias(f"neg_{o}") for o in order],
        *_asc_nulls_last(cols),
    )
    best = combos.groupBy(*keys).agg(F.min(rank_key).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in cols])


def representative_sums(df: DataFrame, keys: Sequence[str] = VERSION_KEYS,
                        mode: str = "by_cover",
                        prop: str = "suminsured_prop",
                        loi: str = "suminsured_lossofinc",
                        indem: str = "indem_per_grp",
                        cover: str = "LossofIncome_cover") -> DataFrame:
    """Representative sums insured per policy version.

    ``literal``: combinations (prop, loi, indem) that are alone in their
    version, OR carry a non-NULL loss-of-income sum, OR are most frequent
    are kept; the smallest (ascending, NULLs last) of those wins.  For a
    covered version this means the LOWEST sums win, as in the study.

    ``by_cover``: the property sum is the mode of the version; the loss of
    income sum and indemnity are the mode over covered rows only (NULL when
    the version has no covered row).  Ties: latest month, then smallest.
    """
    keys = list(keys)
    if mode == "literal":
        from pyspark.sql import Window
        combos = df.groupBy(*keys, prop, loi, indem).agg(F.count(F.lit(1)).alias("_n"))
        version = Window.partitionBy(*keys)          # the combinations of a version: a handful
        kept = combos.withColumns({"_combos": F.count(F.lit(1)).over(version),
                                   "_max_n": F.max("_n").over(version)}).filter(
            (F.col("_combos") == 1) | F.col(loi).isNotNull() | (F.col("_n") == F.col("_max_n")))
        best = kept.groupBy(*keys).agg(
            F.min(F.struct(*_asc_nulls_last([prop, loi, indem]))).alias("_b"))
        return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (prop, loi, indem)])
    if mode == "by_cover":
        p = representative(df, [prop], keys)
        b = representative(df.filter(F.col(cover)), [loi, indem], keys)
        return p.join(b, keys, "left")
    raise ValueError(f"unknown mode {mode!r}")


def max_of(df: DataFrame, c: str) -> Column:
    """Scalar subquery max(c) over the whole table (computed once, no window)."""
    return df.select(F.max(c)).scalar()


def recency_weight(df: DataFrame, date_col: str = "start", base: float = 0.9996,
                   out: str = "date_weights") -> DataFrame:
    """base ** days(max(date) - date), max over the whole table."""
    return df.withColumn(out, recency_weight_expr(date_col, max_of(df, date_col), base))


def weighted_exposure(df: DataFrame, epy: str = "epy", weight: str = "date_weights",
                      out: str = "exposure") -> DataFrame:
    return df.withColumn(out, F.col(epy) * F.col(weight))


def weight_curves(df: DataFrame, bases: Sequence[float], date_col: str = "start") -> DataFrame:
    """(base, days, value = base ** days) for days 0 .. max-min of ``date_col``.

    The day range comes from the data (one scalar aggregate); each base row
    is expanded with ``sequence`` - no join.
    """
    span = df.select(F.datediff(F.max(date_col), F.min(date_col)).alias("d"))
    base_rows = span.select(F.explode(F.array(*[F.lit(float(b)) for b in bases])).alias("base"),
                            "d")
    return base_rows.select(
        "base", F.explode(F.sequence(F.lit(0), F.col("d"))).alias("days")
    ).withColumn("value", F.pow(F.col("base"), F.col("days")))


def consolidate(df: DataFrame, keys: Sequence[str] = VERSION_KEYS) -> DataFrame:
    """One row per policy version from monthly rows."""
    return df.groupBy(*keys).agg(*_sums())


def _sums() -> list[Column]:
    p, b = F.col("grossincurred_prop"), F.col("grossincurred_lossofinc")
    return [
        money_sum("epy", 12).alias("exposure"),     # exact: order-independent
        F.avg("date_weights").alias("date_weights"),
        count_if(p > 0).alias("claimcount_prop"),
        count_if(b > 0).alias("claimcount_lossofinc"),
        F.coalesce(money_sum(p), F.lit(0.0)).alias("grossincurred_prop"),
        F.coalesce(money_sum(b), F.lit(0.0)).alias("grossincurred_lossofinc"),
        F.bool_or("LossofIncome_cover").alias("LossofIncome_cover"),
    ]


HOT = 200_000          # rows of a (policyno, situation_num) beyond which it is not dealt out whole
BUCKETS = 1 << 14


@dataclass(frozen=True)
class Pick:
    """A combination of columns that each version gets.

    ``mode``: the most frequent one (see ``representative``); ``literal``: see
    ``representative_sums``.  ``where``: boolean column of the rows that count; the pick is then
    only given to versions of which any row has it."""
    cols: tuple[str, ...]
    how: str = "mode"
    where: str | None = None


def large_groups(df: DataFrame, by: Sequence[str], most: int = HOT) -> tuple[int, DataFrame | None]:
    """Number of rows, and the groups of more than ``most`` rows, None if there are none.  Rows are first
    counted by a hash of the group, so groups themselves are only counted where a hash has that many rows."""
    spread = F.pmod(F.xxhash64(*by), F.lit(BUCKETS))
    rows, full = df.groupBy(spread.alias("b")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.collect_list(F.when(F.col("n") > most, F.col("b")))).first()
    if not full:
        return rows, None
    own = df if len(full) > 1000 else df.filter(spread.isin(full))
    large = df.sparkSession.createDataFrame(
        [tuple(r) for r in own.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*by).collect()],
        df.select(*by).schema)
    return rows, None if large.isEmpty() else large


def versions(df: DataFrame, picks: Sequence[Pick], weight: str = "date_weights", keys: Sequence[str] = VERSION_KEYS,
             within: Sequence[str] = ("policyno", "situation_num"), most: int = HOT) -> DataFrame:
    """One row per policy version: ``consolidate`` with every pick joined to it.

    A version with a NULL key gets no pick, as a join on the keys would give it none."""
    keys, within = list(keys), list(within)
    rows, large = large_groups(df, within, most)
    if large is None:
        return _versions_in_place(df, rows, picks, weight, keys, within)
    from exposa.functions.expr import join_null_safe
    flag = F.broadcast(large.withColumn("_large", F.lit(True)))          # rows / most of them at the utmost
    d = join_null_safe(df, flag, within, "left")
    small = _versions_in_place(d.filter("_large IS NULL").drop("_large"), rows, picks, weight, keys, within)
    hot = d.filter("_large").drop("_large")
    out = consolidate(hot, keys)
    for p in picks:
        if p.how == "literal":
            out = out.join(representative_sums(hot, keys, "literal", *p.cols), keys, "left")
        elif p.where is None:
            out = out.join(representative(hot, p.cols, keys), keys, "left")
        else:
            own = representative(hot.filter(F.col(p.where)), p.cols, keys)
            out = out.join(own, keys, "left")
    return small.unionByName(out)


def _versions_in_place(df: DataFrame, rows: int, picks: Sequence[Pick], weight: str, keys: list[str],
                       within: list[str]) -> DataFrame:
    """``versions`` of policies of ordinary size: one exchange, a sort a pick, no join."""
    from pyspark.sql import Window
    used = [*keys, "ym", "xm", "epy", weight, "grossincurred_prop", "grossincurred_lossofinc", "LossofIncome_cover",
            *[c for p in picks for c in (*p.cols, *([p.where] if p.where else []))]]
    df = df.select(*dict.fromkeys(used))
    runs = _runs(df, picks, [*keys, *within, *[p.where for p in picks if p.where]])
    df, picks = _pack(df, runs), [replace(p, cols=_packed_cols(p.cols, runs)) for p in picks]
    d = dealt(df, rows, *within)
    for i, p in enumerate(picks):
        combo = Window.partitionBy(*keys, *([p.where] if p.where else []), *p.cols)
        d = d.withColumns({f"_n{i}": F.count(F.lit(1)).over(combo)} | (
            {f"_l{i}": F.max(F.struct("ym", "xm")).over(combo)} if p.how == "mode" else {}))
    best = []
    for i, p in enumerate(picks):
        values = _asc_nulls_last(p.cols)
        if p.how == "mode":
            rank = F.struct((-F.col(f"_n{i}")).alias("n"), (-F.col(f"_l{i}.ym")).alias("neg_ym"),
                            (-F.col(f"_l{i}.xm")).alias("neg_xm"), *values)
            best.append(F.min(F.when(F.col(p.where), rank) if p.where else rank).alias(f"_b{i}"))
        else:
            known = F.col(p.cols[1]).isNotNull()
            best += [F.min(F.when(known, F.struct(*values))).alias(f"_k{i}"),
                     F.min(F.struct((-F.col(f"_n{i}")).alias("n"), *values)).alias(f"_m{i}")]
    out = d.groupBy(*keys).agg(*_sums(), *best)
    ok = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    for i, p in enumerate(picks):
        if p.how == "literal":
            often = F.struct(*[F.col(f"_m{i}.{f}") for c in p.cols for f in (f"{c}__null", c)])
            out = out.withColumn(f"_b{i}", F.least(F.col(f"_k{i}"), often))
        out = out.withColumns({c: F.when(ok, F.col(f"_b{i}.{c}")) for c in p.cols})
    out = out.drop(*[f"_{x}{i}" for x in "bkm" for i in range(len(picks))])
    return out.select(*[v for c in out.columns for v in (runs[c].unpacked() if c in runs else [F.col(c)])])


MOST_LEVELS = 10_000       # levels of a text column up to which its rows are moved as a number
MOST_CODES = 1 << 62
_BREAK = "\u0001"


@dataclass(frozen=True)
class _Run:
    """Adjoining text columns of a pick as one number: the places of their values among the column's
    sorted levels, NULL last, as digits.  Numbers are equal and ordered as the values are."""
    name: str
    cols: tuple[str, ...]
    levels: tuple[list[str], ...]

    def unpacked(self) -> list[Column]:
        out, rest = [], self.name
        for c, levels in reversed(list(zip(self.cols, self.levels, strict=True))):
            n = len(levels)
            place, rest = F.expr(f"int(pmod({rest}, {n + 1}))"), f"({rest} div {n + 1})"
            at = F.get(F.split(F.lit(_BREAK.join(levels)), _BREAK, -1), place)
            out.insert(0, F.when(place < n, at).alias(c))
        return out


def _levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted values of each text column that has few enough of them, by name."""
    if not cols:
        return {}
    about = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    few = [c for c in cols if about[c] <= MOST_LEVELS]
    if not few:
        return {}
    found: dict[str, list[str]] = {c: [] for c in few}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in few])).alias("l")
    for r in df.select(each).distinct().select("l.*").filter("v IS NOT NULL").collect():
        found[r["c"]].append(r["v"])
    return {c: sorted(v) for c, v in found.items() if not any(_BREAK in x for x in v)}


def _runs(df: DataFrame, picks: Sequence[Pick], apart: Sequence[str]) -> dict[str, _Run]:
    """Runs of the picks by name, for columns that are in one pick only and not in ``apart``."""
    types = dict(df.dtypes)
    often = [c for p in picks for c in p.cols]
    levels = _levels(df, [c for c in often if types[c] == "string" and often.count(c) == 1 and c not in apart])
    runs: list[list[str]] = []
    for p in picks:
        size, last = MOST_CODES, False
        for c in p.cols:
            if c in levels:
                size *= len(levels[c]) + 1
                if not last or size > MOST_CODES:
                    runs.append([])
                    size = len(levels[c]) + 1
                runs[-1].append(c)
            last = c in levels
    return {f"_r{i}": _Run(f"_r{i}", tuple(r), tuple(levels[c] for c in r)) for i, r in enumerate(runs)}


def _packed_cols(cols: Sequence[str], runs: dict[str, _Run]) -> tuple[str, ...]:
    of = {c: r.name for r in runs.values() for c in r.cols}
    return tuple(dict.fromkeys(of.get(c, c) for c in cols))


def _pack(df: DataFrame, runs: dict[str, _Run]) -> DataFrame:
    """``df`` with a number for the columns of each run; the levels are sent to the rows."""
    for r in runs.values():
        number = F.lit(0).cast("bigint")
        for k, (c, levels) in enumerate(zip(r.cols, r.levels, strict=True)):
            places = df.sparkSession.createDataFrame(list(enumerate(levels)), f"{r.name}_{k} bigint, {r.name}_v{k} string")
            df = df.join(F.broadcast(places), F.col(c) == F.col(f"{r.name}_v{k}"), "left")
            number = number * F.lit(len(levels) + 1) + F.coalesce(F.col(f"{r.name}_{k}"), F.lit(len(levels)))
        df = df.withColumn(r.name, number).drop(
            *r.cols, *[f"{r.name}_{x}{k}" for x in ("", "v") for k in range(len(r.cols))])
    return df


def policy_version(df: DataFrame, within: Sequence[str] = ("policyno", "situation_num"),
                   order: Sequence[str] = ("effectdate", "expirydate"),
                   out: str = "policy_version") -> DataFrame:
    """dense_rank of (effectdate, expirydate) inside each situation.

    Runs on consolidated rows (one per version), so a window partition holds
    one situation's versions - a handful of rows, never a raw-row group.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn(out, F.dense_rank().over(w))


def lossofinc_nulls(df: DataFrame, mode: str = "main") -> DataFrame:
    """Loss-of-income NULL rules.

    ``main``: no cover -> sum insured 0 and indemnity 'LoI_NULL'; rows still
    NULL in the sum insured are then removed.
    ``second``: covered rows with a NULL sum insured or incurred amount -> 0 there;
    uncovered rows keep their amounts and get indemnity 'LoI_NULL'.
    """
    cover = F.col("LossofIncome_cover")
    if mode == "main":
        out = df.withColumns({
            "suminsured_lossofinc": F.when(~cover, F.lit(0.0)).otherwise(F.col("suminsured_lossofinc")),
            "indem_per_grp": F.when(~cover, F.lit("LoI_NULL")).otherwise(F.col("indem_per_grp")),
        })
        return out.filter(F.col("suminsured_lossofinc").isNotNull())
    if mode == "second":
        return df.withColumns({
            **{c: F.when(cover & F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c))
               for c in ("suminsured_lossofinc", "grossincurred_lossofinc")},
            "indem_per_grp": F.when(~cover, F.lit("LoI_NULL")).otherwise(F.col("indem_per_grp")),
        })
    raise ValueError(mode)


def with_sum_insured(df: DataFrame, line: str = "prop") -> DataFrame:
    """Row filters on sums insured: 'prop' (> 0), 'loi' (both > 0),
    'nonzero' (property sum != 0, the main path and tree data)."""
    p, b = F.col("suminsured_prop"), F.col("suminsured_lossofinc")
    if line == "prop":
        return df.filter(p > 0)
    if line == "loi":
        return df.filter((p > 0) & (b > 0))
    if line == "nonzero":
        return df.filter(p != 0)
    raise ValueError(line)


def split_by_cover(df: DataFrame, lossofinc: bool) -> DataFrame:
    """Cover-line view with ``has_claim``.

    Loss of income: both sums > 0, has_claim = claimcount_lossofinc > 0.
    Property: every column whose name contains lossofinc / loi / indem
    (any case) dropped, property sum > 0, has_claim = claimcount_prop > 0.
    """
    if lossofinc:
        return with_sum_insured(df, "loi").withColumn(
            "has_claim", F.col("claimcount_lossofinc") > 0)
    drop = [c for c in df.columns if any(t in c.lower() for t in ("lossofinc", "loi", "indem"))]
    return with_sum_insured(df.drop(*drop), "prop").withColumn(
        "has_claim", F.col("claimcount_prop") > 0)
