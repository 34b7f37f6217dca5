"""Seeded, exact, engine-independent sampling: splits, folds, re-balancing.

Every row gets ``md5(seed | key)``.  Splits need the row's RANK inside its
stratum; a plain ``row_number() over (partition by stratum)`` would sort a
whole stratum (half the table for a yes/no flag) in one task.  Instead the
rank is computed in two distributed steps:

1. counts per (stratum, hash prefix) - a partial aggregate into at most
   strata x 16^prefix rows (65,536 per stratum for 4 hex digits);
2. rank = rows in earlier prefixes (running sum on that small table)
   + row_number inside (stratum, prefix) - windows of ~n/65,536 rows.

The prefix table is joined back on (stratum, prefix); AQE broadcasts it
from its measured size.

Splits, folds and down-sampling need no rank but the side of a few cuts
(``cuts_passed``): the prefix counts say in which prefix each cut falls, only that
prefix's rows are ranked to find the row at the cut, and all rows are then
compared with it in place, so the rows themselves are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(key: Sequence[str], seed: int | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def prefix_for(n_rows: int, target: int = 200_000) -> int:
    """Hex digits of the hash prefix so a (stratum, prefix) window holds about
    ``target`` rows even if one stratum has all ``n_rows``: 2..10 digits."""
    need = max(1.0, n_rows / target)
    return int(min(10, max(2, math.ceil(math.log(need, 16)))))


def exact_rank(df: DataFrame, strata: Sequence[str], key: Sequence[str], seed: int | str,
               prefix: int | None = None, out: str = "_rank", total: str = "_n") -> DataFrame:
    """Row rank (1-based) by md5(seed|key) inside each stratum, plus the
    stratum size.  Ties (equal keys) are broken by the key columns.  The
    result does not depend on ``prefix``; by default it is sized from the
    row count (one count job) so windows stay ~200k rows at any scale."""
    strata = list(strata)
    if prefix is None:
        prefix = prefix_for(df.count())
    d = df.withColumn("_h", hash_key(key, seed)).withColumn("_b", F.substring("_h", 1, prefix))
    counts = d.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_bc"))
    w = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({
        "_off": F.sum("_bc").over(w) - F.col("_bc"),
        total: F.sum("_bc").over(Window.partitionBy(*strata))}).drop("_bc")
    local = Window.partitionBy(*strata, "_b").orderBy("_h", *key)
    from exposa.functions.expr import join_null_safe
    return (join_null_safe(d, counts, strata + ["_b"])
            .withColumn(out, F.col("_off") + F.row_number().over(local))
            .drop("_b", "_off"))


def cuts_passed(df: DataFrame, strata: Sequence[str], key: Sequence[str], seed: int | str,
                cuts: Sequence[Callable[[Column], Column]], out: str = "_passed",
                prefix: int | None = None) -> DataFrame:
    """Number of cuts below each row's rank (see ``exact_rank``) inside its stratum.

    A cut is a rank, given as a function of the stratum's size.  Strata are few (their cuts come
    to the driver).  Where rows of equal keys lie on both sides of a cut, no comparison
    can tell them apart and all rows are ranked."""
    from exposa.functions.expr import join_null_safe
    strata, key = list(strata), list(key)
    if prefix is None:
        prefix = prefix_for(df.count())
    d = df.withColumn("_h", hash_key(key, seed))
    bucket = F.substring("_h", 1, prefix)
    upto = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = d.groupBy(*strata, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_bc")).withColumns({
        "_off": F.sum("_bc").over(upto) - F.col("_bc"), "_n": F.sum("_bc").over(Window.partitionBy(*strata))})
    at = [c(F.col("_n")).cast("bigint") for c in cuts]
    # the last prefix that has a row below the cut, and the cut
    edges = counts.groupBy(*strata).agg(*[
        F.struct(F.max(F.when(F.col("_off") < c, F.struct("_b", "_off", "_bc"))).alias("e"), F.max(c).alias("c"))
        .alias(f"_e{j}") for j, c in enumerate(at)])
    edge = lambda j, f: F.col(f"_e{j}.e.{f}")
    rank_of = F.struct("_h", *key)
    edges = _small(edges)
    opened = [(bucket == edge(j, "_b")) & (edge(j, "_off") + edge(j, "_bc") > F.col(f"_e{j}.c")) for j in range(len(at))]
    near = join_null_safe(d, F.broadcast(edges), strata).withColumns({
        "_b": bucket, "_off": F.coalesce(*[F.when(o, edge(j, "_off")) for j, o in enumerate(opened)])}).filter("_off IS NOT NULL")
    local = Window.partitionBy(*strata, "_b").orderBy("_h", *key)
    near = near.withColumn("_rank", F.col("_off") + F.row_number().over(local))
    picks = _small(near.groupBy(*strata).agg(*[
        F.max(F.when(F.col("_rank") == F.col(f"_e{j}.c") + k, rank_of)).alias(f"_t{j}_{k}")
        for j in range(len(at)) for k in (0, 1)]))
    same = [F.col(f"_t{j}_0") == F.col(f"_t{j}_1") for j in range(len(at))]
    if any(r[0] for r in picks.select(F.array_contains(F.array(*same), True)).collect()):
        ranked = exact_rank(df, strata, key, seed, prefix)
        at = [c(F.col("_n")) for c in cuts]
        return ranked.withColumn(out, sum((F.col("_rank") > c).cast("int") for c in at)).drop("_h", "_rank", "_n")
    table = join_null_safe(edges, picks, strata, "left")
    passed = [F.when(edge(j, "_b").isNull() | (bucket > edge(j, "_b")), 1).when(bucket < edge(j, "_b"), 0)
              .otherwise(F.coalesce((rank_of > F.col(f"_t{j}_0")).cast("int"), F.lit(0))) for j in range(len(at))]
    return join_null_safe(d, F.broadcast(_small(table)), strata).withColumn(out, sum(passed, F.lit(0))) \
        .select(*df.columns, out)


def _small(table: DataFrame) -> DataFrame:
    """The rows of a table of one line a stratum, without their lineage."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


def stratified_split(df: DataFrame, frac: float, strata: Sequence[str], key: Sequence[str],
                     seed: int = 123, out: str = "split") -> DataFrame:
    """'train' for the first floor(frac * n) rows of each stratum in hash
    order, 'test' for the rest."""
    r = cuts_passed(df, strata, key, seed, [lambda n: F.floor(n * frac)])
    return r.withColumn(out, F.when(F.col("_passed") == 0, "train").otherwise("test")).drop("_passed")


def ntile_of(rank: Column, n: Column, k: int) -> Column:
    """SQL ntile(k) from a 1-based rank and the group size."""
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    return F.when(rank <= big, F.floor((rank - 1) / (q + 1)) + 1).otherwise(
        rem + F.floor((rank - big - 1) / q) + 1).cast("int")


def stratified_folds(df: DataFrame, k: int, strata: Sequence[str], key: Sequence[str],
                     seed: int = 123, out: str = "fold") -> DataFrame:
    """Fold 1..k: ntile(k) over each stratum in hash order."""
    last = lambda n, j: j * F.floor(n / k) + F.least(n % k, F.lit(j))  # noqa: E731   (last rank of fold j)
    r = cuts_passed(df, strata, key, seed, [lambda n, j=j: last(n, j) for j in range(1, k)])
    return r.withColumn(out, (F.col("_passed") + 1).cast("int")).drop("_passed")


def _class_sizes(df: DataFrame, cls: str):
    c = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_cn"))
    return (c.select(F.min("_cn")).scalar(), c.select(F.max("_cn")).scalar())


def downsample(df: DataFrame, cls: str, key: Sequence[str], ratio: float = 10.0,
               seed: int = 123) -> DataFrame:
    """Every class keeps at most floor(ratio * minority size) rows (hash order)."""
    n_min = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_cn")).agg(F.min("_cn")).first()[0] or 0
    r = cuts_passed(df, [cls], key, seed, [lambda n: F.lit(math.floor(n_min * ratio))])
    return r.filter("_passed = 0").drop("_passed")


def upsample(df: DataFrame, cls: str, key: Sequence[str], ratio: float = 0.05,
             seed: int = 123) -> DataFrame:
    """Classes smaller than floor(ratio * majority) are replicated (whole
    copies, then a hash-ordered part copy) up to exactly that size."""
    _, n_max = _class_sizes(df, cls)
    target = F.floor(n_max * F.lit(ratio))
    r = exact_rank(df, [cls], key, seed)
    copies = F.greatest(F.ceil(target / F.col("_n")), F.lit(1)).cast("int")
    r = r.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    keep = (F.col("copy") == 0) | (F.col("copy") * F.col("_n") + F.col("_rank") <= target)
    return r.filter(keep).drop("_h", "_rank", "_n")


def hash_normal(cols: Sequence[str], seed) -> Column:
    """Standard normal draw from md5(seed|cols) by Box-Muller: the same row
    always gets the same value, even when a lost partition is recomputed."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))
    u1 = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(16 ** 13)
    u2 = F.conv(F.substring(h, 14, 13), 16, 10).cast("double") / float(16 ** 13)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)


def rose(df: DataFrame, cls: str, numeric: Sequence[str], key: Sequence[str],
         n_out: int | None = None, seed: int = 123) -> DataFrame:
    """Smoothed bootstrap to balance classes (ROSE-style).

    Each class is resampled to n_out/2 rows (whole copies plus a hash-ordered
    part copy, as in ``upsample``); numeric columns get Gaussian noise with
    the class's Silverman scale h = (4/((d+2) n))^(1/(d+4)) * sd; categories
    are copied.  Noise comes from a hash of (key, copy), so it is seeded and
    stable under recomputation.
    """
    sizes = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_cn"))
    n_tot = sizes.select(F.sum("_cn")).scalar()
    half = F.floor((F.lit(n_out) if n_out else n_tot) / 2)
    r = exact_rank(df, [cls], key, seed)
    copies = F.greatest(F.ceil(half / F.col("_n")), F.lit(1)).cast("int")
    r = r.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    r = r.filter(F.col("_copy") * F.col("_n") + F.col("_rank") <= half)
    d = len(numeric)
    sds = df.groupBy(cls).agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in numeric],
                              F.count(F.lit(1)).alias("_cn"))
    r = r.join(sds, cls)
    scale = F.pow(F.lit(4.0) / ((d + 2) * F.col("_cn")), F.lit(1.0 / (d + 4)))
    for i, c in enumerate(numeric):
        z = hash_normal(list(key) + ["_copy"], f"{seed}|{c}")
        r = r.withColumn(c, F.col(c) + z * scale * F.coalesce(F.col(f"_sd_{c}"), F.lit(0.0)))
    return r.drop("_h", "_rank", "_n", "_copy", "_cn", *[f"_sd_{c}" for c in numeric])
