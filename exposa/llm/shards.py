"""Shards of near equal size by sampled splitters.

Keys are drawn with a chance in proportion to their record's size; weighted quantiles of the
draw split the key order into many ranges, and every record is dealt to its range.  Exact
sizes of the ranges follow from one aggregation; a range with more than twice its share of
bytes or rows is subdivided by a new, denser draw among its own records.  With the ranges'
exact offsets and a running sum inside each (bounded) range, every record knows the bytes and
rows that come before it in key order, so the shards are cut to within a record's size.

The key ends in a number given to every row, so rows that repeat and keys that fill a third
of the table can be split like any other.  Only the draw (``draws`` a range) and one line a
range reach the driver.

Null texts have size ``overhead``; null keys come first.  An empty table has an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exposa.llm.tables import cut, unused, with_row_key

RANGE_ROWS = 250_000
ROUNDS = 24


def _range(key: Column, splitters: list, kind: str) -> Column:
    """Number of splitters that are not above the key: found among groups, then in the group.

    kind: the key's type as a DDL string."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    names = ("has", "id", "crc", "tie")
    groups = [[dict(zip(names, k, strict=True)) for k in splitters[i:i + step]]
              for i in range(0, len(splitters), step)]
    literal = lambda v, of: F.from_json(F.lit(json.dumps(v)), of)
    below = lambda rows: F.size(F.filter(rows, lambda s: s <= key))
    at = below(literal([g[0] for g in groups], f"array<{kind}>"))
    inner = F.element_at(literal(groups, f"array<array<{kind}>>"), F.greatest(at, F.lit(1)))
    return F.when(at == 0, 0).otherwise((at - 1) * step + below(inner))


def _draw(rows: DataFrame, chance: Column, seed: int) -> list[tuple[tuple, float, float]]:
    """(key, bytes, rows) of drawn rows in key order: what each stands for, by one over its chance."""
    u = F.pmod(F.xxhash64("tie", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    got = rows.withColumn("chance", F.least(chance, F.lit(1.0))).where(u < F.col("chance")) \
        .select("key", (F.col("size") / F.col("chance")).alias("b"), (1 / F.col("chance")).alias("n")).collect()
    return sorted((tuple(r["key"]), r["b"], r["n"]) for r in got)


def _quantiles(drawn: list[tuple[tuple, float]], parts: int) -> list[tuple]:
    """Keys that cut the drawn weight in ``parts`` equal pieces."""
    total, run, out = sum(w for _, w in drawn), 0.0, []
    for key, w in drawn:
        if run >= total * (len(out) + 1) / parts and (not out or key > out[-1]):
            out.append(key)
        run += w
    return out


def assign(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", overhead: int = 8,
           draws: int = 16, row_key: str | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row, in order of id within and across shards.

    size: UTF-8 bytes of the text plus ``overhead``; slot: the row's place in its shard, from 0.
    ``row_key``: a column of ``docs`` that tells its rows apart; it is handed on as the last column.
    """
    carried = ["carried"] if row_key else []
    rows = cut(docs.select(
        docs[id].alias("id"), *([docs[row_key].alias("carried")] if row_key else []),
        (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + F.lit(overhead)).cast("bigint").alias("size"),
        F.crc32(docs[text].cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("tie")))
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    n, size = total["n"], total["b"] or 0
    numeric = rows.withColumn("key", F.struct(
        F.col("id").isNotNull().cast("int").alias("has"), F.coalesce("id", F.lit(0).cast(rows.schema["id"].dataType))
        .alias("id"), F.coalesce("crc", F.lit(-1)).alias("crc"), "tie"))
    kind = numeric.schema["key"].dataType.simpleString()
    ranges = min(max(40 * shards, -(-n // RANGE_ROWS)), max(n, 1))
    most_bytes, most_rows = 2 * size / ranges, 2 * n / ranges
    first = _draw(numeric, F.col("size") * (ranges * draws / max(size, 1)), 0)
    splitters = _quantiles([(key, b) for key, b, _ in first], ranges)
    for attempt in range(1, ROUNDS + 1):
        dealt = numeric.withColumn("range", _range(F.col("key"), splitters, kind))
        found = dealt.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"),
                                           F.max("size").alias("top")).collect()
        sums = {r["range"]: (r["b"], r["n"]) for r in found}
        # a cut falls between records, so one record above the share does not make a range overfull
        over = {r["range"]: max(r["b"] / most_bytes, r["n"] / most_rows) for r in found
                if r["n"] > 1 and (r["b"] > most_bytes + r["top"] or r["n"] > most_rows)}
        if not over:
            break
        chance = F.greatest(F.col("size") / most_bytes, F.lit(1 / most_rows)) * F.lit(float(draws * attempt))
        drawn = _draw(dealt.where(F.col("range").isin(*over)), chance, attempt)
        splitters = sorted({*splitters, *_subdivide(drawn, splitters, over)})
    else:
        raise RuntimeError(f"ranges are still overfull after {ROUNDS} rounds")
    offsets, bytes_before, rows_before = [], 0, 0
    for k in sorted(sums):
        offsets.append((k, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + sums[k][0], rows_before + sums[k][1]
    offsets = docs.sparkSession.createDataFrame(offsets, "range int, bytes_before bigint, rows_before bigint")
    inside = Window.partitionBy("range").orderBy("key")
    placed = cut(dealt.withColumn("own", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
                 .withColumn("nth", F.row_number().over(inside)).join(offsets, "range")
                 .select("id", *carried, "size", "crc", (F.col("rows_before") + F.col("nth") - 1).alias("rank"),
                         F.expr(f"cast((2 * (bytes_before + coalesce(own, 0)) + size) * {shards} div "
                                f"{max(2 * size, 1)} as int)").alias("shard")))
    start = {r["shard"]: r["r"] for r in placed.groupBy("shard").agg(F.min("rank").alias("r")).collect()}
    at = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("shard")) \
        if start else F.lit(0)
    return placed.select(F.col("id").alias(id), "size", F.col("crc").alias("text_crc32"), "shard",
                         (F.col("rank") - at).cast("bigint").alias("slot"),
                         *[F.col(c).alias(row_key) for c in carried])


def _subdivide(drawn: list, splitters: list[tuple], over: dict[int, float]) -> list[tuple]:
    """New splitters inside the overfull ranges, as many as each is over its share."""
    from bisect import bisect_right
    by_range: dict[int, list] = {}
    for drawn_row in drawn:
        by_range.setdefault(bisect_right(splitters, drawn_row[0]), []).append(drawn_row)
    out: set[tuple] = set()
    for k, own in by_range.items():
        parts = max(2, int(2 * over.get(k, 1)) + 1)
        out.update(_quantiles([(key, b) for key, b, _ in own], parts))      # equal bytes
        out.update(_quantiles([(key, n) for key, _, n in own], parts))      # equal rows
    return sorted(out)


def write(docs: DataFrame, path: str, shards: int, id: str = "doc_id", text: str = "text", **how) -> None:
    """Files of each shard: every row of ``docs`` with its shard and slot, written under ``shard=k``.

    Rows meet their places by a key of the row, so null and repeated ids keep every row once.
    Columns of ``docs`` named shard or slot give way to these.
    """
    docs = docs.drop("shard", "slot")
    (row_key,) = unused(docs, "row_key")
    keyed = with_row_key(docs, row_key)
    placed = assign(keyed, shards, id, text, row_key=row_key, **how)
    keyed.join(placed.select(row_key, "shard", "slot"), row_key).drop(row_key) \
        .write.mode("overwrite").partitionBy("shard").parquet(path)
