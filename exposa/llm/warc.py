"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit record (a 304 answer) is joined to the latest earlier full response of the same
canonical URL.  Its validators are checked: an entity tag it gives must be the response's (weak
comparison), or else a last-modified date it gives must be; a revisit without either is taken
to mean that response.  The resolved record has the response's headers, of which those that a
304 answer may update are replaced by the revisit's; its payload is the response's.

Records: record_id, warc_type (``response`` or ``revisit``), target_uri, warc_date (epoch
seconds, long), http (status line and header lines, as text), payload.  Only headers and a
payload digest go through the join; a URL that fills a third of the archive is split by date.

Every revisit gives one row.  outcome: ``resolved``, ``no_earlier_response``,
``validator_mismatch`` or ``not_a_304``.  Of two responses at one second the greater record_id
counts; a response at the revisit's own second is not earlier.  Null URLs or dates resolve
nothing.  Built-in operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.llm.asof import latest_before

# Headers that a 304 answer may carry for the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, without default port and fragment, empty path as ``/``."""
    whole = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(whole, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(whole, r"(?s)^[^:/?#]+://([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")) \
        .when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_extract(whole, r"(?s)^[^:/?#]+://[^/?#]*(.*)$", 1)
    return F.when(scheme == "", whole).otherwise(
        F.concat(scheme, F.lit("://"), host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def _headers(http: Column) -> Column:
    """Header lines as array<struct<name, value>>, names in lower case; lines without a colon go."""
    lines = F.filter(F.split(F.coalesce(http, F.lit("")), r"\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    return F.transform(lines, lambda x: F.struct(
        F.lower(F.substring_index(x, ":", 1)).alias("name"),
        F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))


def _header(headers: Column, name: str) -> Column:
    """First value of a header, or null."""
    return F.try_element_at(F.filter(headers, lambda h: h["name"] == name), F.lit(1))["value"]


def _tag(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged(stored: Column, new: Column) -> Column:
    """The stored headers, the permitted ones among the new in place of theirs."""
    allowed = F.filter(new, lambda h: h["name"].isin(*PERMITTED))
    kept = F.filter(stored, lambda s: ~F.exists(allowed, lambda h: h["name"] == s["name"]))
    return F.concat(kept, allowed)


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, canonical_url, warc_date, outcome, response_id, payload_md5, headers) of every revisit."""
    parsed = records.select(
        "record_id", "warc_type", "warc_date", canonical(F.col("target_uri")).alias("canonical_url"),
        F.regexp_extract(F.coalesce("http", F.lit("")), r"^HTTP/\S+ (\d{3})", 1).alias("status"),
        _headers(F.col("http")).alias("headers"), "payload")
    full = parsed.where("warc_type = 'response' and status = '200'").select(
        "canonical_url", "warc_date", F.struct("record_id", F.md5(F.col("payload").cast("binary")).alias("md5"),
                                               "headers").alias("found"))
    revisits = parsed.where("warc_type = 'revisit'").drop("payload", "warc_type")
    got = latest_before(revisits, full, ["canonical_url"], "warc_date", "found")
    mine, theirs = F.col("headers"), F.col("found.headers")
    valid = F.when(_header(mine, "etag").isNotNull(),
                   F.coalesce(_tag(_header(mine, "etag")) == _tag(_header(theirs, "etag")), F.lit(False))) \
        .when(_header(mine, "last-modified").isNotNull(),
              F.coalesce(_header(mine, "last-modified") == _header(theirs, "last-modified"), F.lit(False))) \
        .otherwise(F.lit(True))
    outcome = F.when(F.col("status") != "304", "not_a_304").when(F.col("found").isNull(), "no_earlier_response") \
        .when(~valid, "validator_mismatch").otherwise("resolved")
    ok = F.col("outcome") == "resolved"
    lines = F.transform(merged(theirs, mine), lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return got.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "warc_date", "outcome", F.when(ok, F.col("found.record_id")).alias("response_id"),
        F.when(ok, F.col("found.md5")).alias("payload_md5"),
        F.when(ok, F.array_join(F.array_sort(lines), "\n")).alias("headers"))


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the payload they stand for (null if it is null), one row a revisit.

    A response row that repeats counts once; of rows with one id and several payloads, that which
    ``resolve`` took, known by its digest."""
    bodies = records.where("warc_type = 'response'").groupBy(
        F.col("record_id").alias("_id"), F.md5(F.col("payload").cast("binary")).alias("_md5")) \
        .agg(F.min("payload").alias("payload"))
    return resolved.join(bodies, (F.col("response_id") == F.col("_id")) & F.col("payload_md5").eqNullSafe(F.col("_md5")),
                         "left").drop("_id", "_md5")
