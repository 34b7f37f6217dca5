"""Connected components of a link table, by alternating star contraction.

Every round is joins and aggregations on the links alone: no list of links or
members ever reaches the driver or one task.  A node that holds most links is
dealt out again by the aggregations' map side, which keeps one minimum a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm.tables import cut


def _stars(links: DataFrame, wide: bool) -> DataFrame:
    """One star step.  wide: all neighbours greater than the node move to the least neighbour
    (itself included); else the neighbours not greater than it do."""
    if wide:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = both.join(least, both["a"] == least["n"])
    if wide:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))))
    return moved.where("a != b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: the least node it can reach.

    Nodes without links do not appear.  An empty table gives an empty result; repeated links
    and links to itself change nothing.  Raises if the contraction has not ended after
    ``rounds`` (it takes a number of rounds that grows with the logarithm of the nodes).
    """
    now = cut(links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
              .select("a", "b").where("a != b").distinct())
    mark = None
    for _ in range(rounds):
        now = cut(_stars(_stars(now, wide=True), wide=False))
        seen = now.agg(F.count("*").alias("n"),
                       F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark:
            break
        mark = (seen["n"], seen["s"])
        if not seen["n"]:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
