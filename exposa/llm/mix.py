"""Mixing sources to target weights by pivotal dependent rounding.  Built-in operations only.

Every source gets a share of the wished total by its weight, no more than ``most`` times its own
size; the excess is shared again by weight until no target is above (a sum a round; sources never
reach the driver).  A document's expected copies are its source's target over the source's size:
whole copies, and a fraction that is rounded together with those of its source.

Pivotal rounding takes two documents with open fractions and moves words from one to the other,
in a direction drawn so that both keep their expectation, until one fraction is 0 or 1.  The words
in total stay what they are, so a source ends within one document of its target.  The documents
of a source are dealt to buckets of about ``fan`` by a hash; each bucket goes through its documents from
large to small, which leaves a small one open; the open ones of ``fan`` buckets make a bucket of the
next level, and so on until a source has one, which is drawn by its fraction.  Every level is one
shuffle of the open documents and is cut by a checkpoint.

Rows that are equal in id, source, size and text checksum are one entry with a count, before any shuffle: among n of
them with fraction p, floor(n p) get a copy more and one stays open with what is left.  They are
put out again in runs of at most ``RUN`` rows, spread over tasks where there are more.

Draws depend on ids, checksums and the seed alone, so a rerun, on any number of tasks, takes the same.
Null texts and texts without words have size 0 and take nothing; a source without words has the
target 0.  A null source is a source of its own, the last.  An empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exposa.llm.tables import cut

FAN = 128
RUN = 4096
_SPACE = r"[\x20\x09-\x0D]"
_OTHER = r"[^\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters, without an array of them (a null: 0)."""
    bare = F.regexp_replace(text, f"^{_SPACE}+", "")
    return F.coalesce(F.length(F.regexp_replace(bare, f"{_OTHER}+{_SPACE}*", "x")), F.lit(0)).cast("bigint")


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their place (from 0) in code-point order, null last: sorted in ranges, each
    range counted, and the counts before it added."""
    ranged = cut(sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
                 .withColumn("range", F.spark_partition_id()))
    before = ranged.groupBy("range").agg(F.count("*").alias("c")) \
        .select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("before"))
    inside = Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())
    return ranged.withColumn("own", F.row_number().over(inside)).join(before, "range") \
        .withColumn("place", F.col("before") + F.col("own") - 1).drop("range", "own", "before")


def targets(sources: DataFrame, weights: Sequence[float], times: float, most: float) -> DataFrame:
    """(source, n, source_size, target) of ``sources`` (source, n, source_size).

    Weights go to the sources in code-point order (null last) and repeat; the targets share
    ``times`` all sizes by weight and stop at ``most`` times their source's size.
    """
    if not weights or min(weights) <= 0 or not 0 <= times <= most:
        raise ValueError("weights must be positive and 0 <= times <= most")
    of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = cut(_numbered(sources).select("source", "n", "source_size", of.alias("w"),
                                            (F.col("source_size") * F.lit(float(most))).alias("cap")))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"] * float(times)
    rate, full = 0.0, -1
    while True:
        # sources at their cap under this rate stay there under every later, higher one
        at_cap = F.col("cap") <= F.col("w") * F.lit(rate)
        r = weighed.agg(F.count(F.when(at_cap, 1)).alias("full"),
                        F.coalesce(F.sum(F.when(at_cap, F.col("cap"))), F.lit(0.0)).alias("caps"),
                        F.coalesce(F.sum(F.when(~at_cap, F.col("w"))), F.lit(0.0)).alias("open")).first()
        if r["full"] == full or not r["open"]:
            break
        full, rate = r["full"], max(rate, (total - r["caps"]) / r["open"])
    return weighed.select("source", "n", "source_size", F.least("cap", F.col("w") * F.lit(rate)).alias("target")) \
        if r["open"] else weighed.select("source", "n", "source_size", F.col("cap").alias("target"))


def _fold(entries: Column, seed: int) -> Column:
    """(out, open) of a bucket's entries (e, s: words, p: open fraction, h): pivotal steps from the
    first to the last, carrying one entry.  out: (e, one) of the entries whose fraction is settled."""
    def step(acc, x):
        a, s, b, t = acc["open"]["p"], acc["open"]["s"], x["p"], x["s"]
        rise = F.least(1 - a, b * t / s)                     # the carried one up, the next one down
        fall = F.least(a, (1 - b) * t / s)
        u = F.pmod(F.xxhash64(acc["open"]["h"], x["h"], F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
        up = u * (rise + fall) < fall
        carried_done = (a <= 0) | (a >= 1)
        next_done = (b <= 0) | (b >= 1)
        settles = F.when(up, (1 - a) <= b * t / s).otherwise(a <= (1 - b) * t / s)
        goes = F.when(carried_done, F.lit(True)).when(next_done, F.lit(False)).otherwise(settles)
        one = F.when(carried_done, a >= 1).when(next_done, b >= 1).otherwise(F.when(settles, up).otherwise(~up))
        rest = F.when(up, F.when(settles, b - (1 - a) * s / t).otherwise(a + b * t / s)) \
            .otherwise(F.when(settles, b + a * s / t).otherwise(a - (1 - b) * t / s))
        p = F.when(carried_done, b).when(next_done, a).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rest)))
        settled = F.struct(F.when(goes, acc["open"]["e"]).otherwise(x["e"]).alias("e"), one.alias("one"))
        kept = F.struct(*[F.when(goes, x[c]).otherwise(acc["open"][c]).alias(c) for c in ("e", "s", "h")], p.alias("p"))
        return F.struct(F.concat(acc["out"], F.array(settled)).alias("out"), kept.alias("open"))

    first = F.element_at(entries, 1)
    none = F.filter(F.transform(entries, lambda x: F.struct(x["e"].alias("e"), F.lit(True).alias("one"))),
                    lambda _: F.lit(False))
    start = F.struct(none.alias("out"), F.struct(*[first[c].alias(c) for c in ("e", "s", "h", "p")]).alias("open"))
    return F.aggregate(F.slice(entries, 2, F.size(entries)), start, step)


def _levels(rows: DataFrame, fan: int, seed: int) -> DataFrame:
    """(source, e, one) of every row (source, e, s, p, h, bucket, buckets): rounded through the tree."""
    done = None
    while True:
        # large first: the one left open is then among the small ones
        entries = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("m"), "h", "e", "s", "p")))
        folded = cut(rows.groupBy("source", "bucket", "buckets").agg(entries.alias("x"))
                     .select("source", "bucket", "buckets", _fold(F.col("x"), seed).alias("f")))
        out = folded.select("source", F.explode("f.out").alias("o")).select("source", "o.*")
        done = out if done is None else done.union(out)
        last = folded.where("buckets = 1")
        by_chance = F.pmod(F.xxhash64("f.open.h", F.lit(seed), F.lit(1)), F.lit(1 << 52)) / float(1 << 52)
        done = done.union(last.select("source", F.col("f.open.e").alias("e"), (by_chance < F.col("f.open.p")).alias("one")))
        if folded.where("buckets > 1").isEmpty():
            return done
        rows = folded.where("buckets > 1").select(
            "source", "f.open.*", F.expr(f"bucket div {fan}").alias("bucket"),
            F.expr(f"(buckets + {fan - 1}) div {fan}").alias("buckets"))


def _spread(rows: DataFrame, count: str) -> DataFrame:
    """Every row ``count`` times; counts above RUN are cut in runs that are dealt over all tasks."""
    few = rows.where(F.col(count) <= RUN).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))
    runs = rows.where(F.col(count) > RUN) \
        .withColumn("_r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({count} - 1) div {RUN}"))))
    many = runs.repartition("_r").withColumn("_k", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(RUN), F.col(count) - F.col("_r") * RUN).cast("int")))).drop("_r")
    return few.unionByName(many).drop("_k")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), times: float = 1.5, most: float = 2.0,
        id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20, fan: int = FAN) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row.

    copies: how often the mix takes the document; taken: copies times size, in words.
    """
    entries = cut(docs.select(docs[source].alias("source"), docs[id].alias("id"), word_count(docs[text]).alias("size"),
                              F.crc32(docs[text].cast("binary")).alias("crc"))
                  .groupBy("source", "id", "size", "crc").agg(F.count("*").alias("rows")))
    sources = entries.groupBy("source").agg(F.sum("rows").alias("n"), F.count("*").alias("entries"),
                                            F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    goals = cut(targets(sources.select("source", F.col("entries").alias("n"), "source_size"), weights, times, most))
    rated = entries.join(goals, entries["source"].eqNullSafe(goals["source"])).drop(goals["source"]) \
        .withColumn("rate", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)) \
        .withColumn("whole", F.floor("rate")).withColumn("f", (F.col("rate") - F.col("whole")) * F.col("rows")) \
        .withColumn("more", F.floor("f"))
    key = F.xxhash64("id", "crc", "size", F.lit(seed))
    shut = F.struct("id", "size", "source_size", "target", "whole", "rows", "more")
    buckets = F.greatest(F.lit(1), F.expr(f"(n + {fan - 1}) div {fan}"))
    rows = rated.select("source", shut.alias("e"), (F.col("f") - F.col("more")).alias("p"), F.col("size").alias("s"),
                        key.alias("h"), F.pmod(key, buckets).alias("bucket"), buckets.alias("buckets"))
    sized = rows.where("s > 0")
    settled = _levels(sized, fan, seed).union(rows.where("s = 0").select("source", "e", F.lit(False).alias("one"))) \
        .select("source", "e.*", "one")
    up = (F.col("more") + F.col("one").cast("bigint"))
    parts = settled.withColumn("deal", F.explode(F.array(
        F.struct(up.alias("k"), (F.col("whole") + 1).alias("copies")),
        F.struct((F.col("rows") - up).alias("k"), F.col("whole").alias("copies"))))) \
        .select("id", "source", "size", "source_size", "target", "deal.*").where("k > 0")
    return _spread(parts, "k").select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target",
                                      "copies", (F.col("copies") * F.col("size")).alias("taken"))
