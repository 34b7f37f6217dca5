"""As-of joins and ranks whose hot keys are split by slices of the order.

The order's range is cut in at most ``slices`` slices of equal width.  A (key, slice) that then holds more
than ``SLICE_ROWS`` rows is cut again, between its own least and greatest order, and so on until
none is overfull, so a key's rows are split whether they lie far apart or came in one burst.
Rows meet within (key, slice); what comes before a slice is carried over one line a (key, slice).
A slice is known by its least possible order, so slices sort as their rows do.  Rows of one key
and the very same order stay together in ``rank_within``; the as-of join never sorts them, as
none is earlier than another.  Built-in operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exposa.llm.tables import cut, unused

SLICES = 1024
SLICE_ROWS = 250_000
FEW = 100_000                    # overfull slices, a line each, that are broadcast


def _hinted(groups: DataFrame, n: int) -> DataFrame:
    return F.broadcast(groups) if n <= FEW else groups


def _same(keys: list[str]):
    same = F.col("slice") == F.col("_slice")
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"_k{i}")
    return same


def _sliced(rows: DataFrame, keys: list[str], order: str, slices: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with the column ``slice`` (null orders: null, a slice before all others), and the
    (key, slice) of one order alone that are overfull all the same."""
    r = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if r["lo"] is None:
        return rows.withColumn("slice", F.lit(None).cast("bigint")), None
    width = max(1, -(-(r["hi"] - r["lo"] + 1) // slices))
    rows = rows.withColumn("slice", F.expr(f"{r['lo']}L + (`{order}` - {r['lo']}L) div {width}L * {width}L"))
    columns = [c for c in rows.columns if c != "slice"]
    while True:
        full = rows.groupBy(*keys, "slice").agg(F.count("*").alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")) \
            .where((F.col("_n") > SLICE_ROWS) & F.col("slice").isNotNull())
        full = cut(full.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("slice").alias("_slice"), "_lo",
                               (F.col("_lo") < F.col("_hi")).alias("_wide"),
                               F.expr(f"(_hi - _lo) div (2 * _n div {SLICE_ROWS} + 1) + 1").alias("_width")))
        n = {x["_wide"]: x["n"] for x in full.groupBy("_wide").agg(F.count("*").alias("n")).collect()}
        if not n.get(True):
            flat = full.select(*[f"_k{i}" for i in range(len(keys))], "_slice", F.lit(True).alias("_flat"))
            return rows, _hinted(flat, n[False]) if n.get(False) else None
        again = F.expr(f"_lo + (`{order}` - _lo) div _width * _width")
        rows = cut(rows.join(_hinted(full.where("_wide"), n[True]), _same(keys), "left")
                   .select(*columns, F.when(F.col("_slice").isNotNull(), again).otherwise(F.col("slice")).alias("slice")))


def latest_before(asking: DataFrame, known: DataFrame, keys: list[str], order: str, value: str,
                  slices: int = SLICES) -> DataFrame:
    """``asking`` with the column ``value``: that of the last ``known`` row of the same keys and a
    smaller order, null if there is none.

    ``order`` is a long and ``value`` a struct that can be compared; of known rows with equal keys
    and order the greatest value counts.  Null keys and null orders match nothing.
    """
    ok = F.col(order).isNotNull()
    for k in keys:
        ok &= F.col(k).isNotNull()
    (best,) = unused(asking, "best")
    kind = known.schema[value].dataType
    known = known.where(ok).select(*keys, order, F.struct(F.col(order).alias("at"), F.col(value).alias("v")).alias(best),
                                   F.lit(False).alias("asks"), *[F.lit(None).cast(f.dataType).alias(f.name)
                                                                 for f in asking.schema if f.name not in [*keys, order]])
    rest = [c for c in asking.columns if c not in [*keys, order]]
    rows = known.unionByName(asking.where(ok).withColumn("asks", F.lit(True))
                             .withColumn(best, F.lit(None).cast(known.schema[best].dataType)))
    rows, flat = _sliced(cut(rows), keys, order, slices)
    inside = Window.partitionBy(*keys, "slice").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "slice").agg(F.max(best).alias("b")) \
        .select(*keys, "slice", F.max("b").over(across).alias("carried")).where("carried is not null")
    columns, none_inside = rows.columns, F.lit(None).cast(rows.schema[best].dataType).alias("own")
    if flat is None:
        own = rows.withColumn("own", F.max(best).over(inside))
    else:
        marked = rows.join(flat, _same(keys), "left")
        own = marked.where("_flat IS NULL").select(*columns, F.max(best).over(inside).alias("own")) \
            .unionByName(marked.where("_flat").select(*columns, none_inside))
    got = own.where("asks").join(carried, [*keys, "slice"], "left") \
        .select(*keys, order, *rest, F.coalesce("own", "carried")["v"].alias(value))
    none = asking.where(~F.coalesce(ok, F.lit(False))).select(*keys, order, *rest, F.lit(None).cast(kind).alias(value))
    return got.unionByName(none)


def rank_within(rows: DataFrame, key: str, order: str, tie: str, to: str, slices: int = SLICES) -> DataFrame:
    """``rows`` with their place (from 0) among those of their key (never null), by order (a long, nulls
    first) and then tie."""
    rows, _ = _sliced(rows, [key], order, slices)
    across = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(key, "slice").agg(F.count("*").alias("n")) \
        .select(F.col(key).alias("_key"), F.col("slice").alias("_slice"),
                F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    inside = Window.partitionBy(key, "slice").orderBy(order, tie)
    here = (F.col(key) == F.col("_key")) & F.col("slice").eqNullSafe(F.col("_slice"))
    return rows.withColumn("own", F.row_number().over(inside)).join(before, here).drop("_key", "_slice") \
        .withColumn(to, (F.col("before") + F.col("own") - 1).cast("bigint")).drop("slice", "own", "before")
