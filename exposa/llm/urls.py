"""URL filter: a blocked Bloom filter of listed URLs, then an exact hash join.

A listed entry is a host and the beginning of a path; it fits its host and all subdomains of
it where the path begins so.  A URL is looked up under every key it could be listed by: the
ends of its host with as many labels as some entry has, with the beginnings of its path that
are as long as some entry's.  Each key is looked up in one block of eight words of the filter;
those whose eight bits are set go on to the exact join with the list, which removes the false
positives.  The longest fitting entry decides (ties: the longer host; then ``block``).

Built-in operations only.  Distinct (host, path) pairs are looked up, so a URL that fills a
third of the table is one lookup.  The filter has a known size, which is checked before it is
sent to all tasks; above ``SENT_BLOCKS`` it is joined like any table.

Null URLs and those without ``://`` have empty host and path, which only an entry with an
empty host could fit.  Null entries of the list are ignored.  Repeated rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.llm.tables import cut, unused

BITS_EACH = 24              # filter bits a listed key
SENT_BLOCKS = 1 << 17       # 64 bytes each: 8 MB
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """The bit that a key sets in a word: six bits of a second hash."""
    spread = F.xxhash64(key, F.lit("bits"))
    place = F.shiftrightunsigned(spread, 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the blocked filter of the keys; blocks without a key are left out."""
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(
        *[F.bit_or(_bit(F.col(key), w)).alias(f"w{w}") for w in range(8)])


def may_contain(rows: DataFrame, key: str, filter: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key passes the filter."""
    if blocks <= SENT_BLOCKS:
        filter = F.broadcast(filter)
    hit = F.lit(True)
    for w in range(8):
        bit = _bit(F.col(key), w)
        hit &= F.col(f"w{w}").bitwiseAND(bit) == bit
    return rows.withColumn("block", _block(F.col(key), blocks)).join(filter, "block").where(hit).select(*rows.columns)


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the deciding entry, or null) and verdict.

    listed: columns host, path and verdict (``block`` or ``allow``); unlisted URLs get ``default``.
    """
    entries = cut(listed.where("host is not null and path is not null and verdict is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("h"), F.col("path").alias("p"), "verdict")
        .groupBy("h", "p").agg(F.max("verdict").alias("rule_verdict"))
        .select(F.concat("h", "p").alias("key"), "h", "p", "rule_verdict"))
    shape = entries.agg(F.count("*").alias("n"), F.collect_set(_labels(F.col("h"))).alias("labels"),
                        F.collect_set(F.length("p")).alias("lengths")).first()
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    named = unused(pages, "_host", "_path")
    rows = pages.select(*[pages[c] for c in keep], host_of(pages[url]).alias(named[0]),
                        path_of(pages[url]).alias(named[1]))
    distinct = rows.select(F.col(named[0]).alias("host"), F.col(named[1]).alias("path")).distinct()
    blocks = 1
    while blocks * 512 < shape["n"] * BITS_EACH:
        blocks *= 2
    label = F.split("host", r"\.")
    ends = F.array(*[F.when(F.size(label) >= k, F.array_join(F.slice(label, F.size(label) - (k - 1), k), "."))
                     for k in sorted(shape["labels"])]) if shape["n"] else F.array().cast("array<string>")
    starts = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape["lengths"])]) \
        if shape["n"] else F.array().cast("array<string>")
    keys = distinct.withColumn("end", F.explode(ends)).withColumn("start", F.explode(starts)) \
        .where("end is not null and start is not null") \
        .select("host", "path", F.concat("end", "start").alias("key"), F.length("end").alias("of_host"))
    possible = may_contain(keys, "key", bloom(entries, "key", blocks), blocks)
    # equal keys of unlike host and path ('a' + 'b', 'ab' + '') are told apart by the host's length
    exact = possible.join(entries, "key").where(F.length("h") == F.col("of_host"))
    best = F.max(F.struct(F.length("key").alias("n"), F.length("h").alias("m"), "rule_verdict", "key"))
    decided = exact.groupBy(F.col("host").alias(named[0]), F.col("path").alias(named[1])).agg(best.alias("best"))
    out = rows.join(decided, named, "left")
    return out.select(*keep, F.col(named[0]).alias("host"), F.col(named[1]).alias("path"),
                      F.col("best.key").alias("rule"),
                      F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"))
