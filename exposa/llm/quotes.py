"""Conversations rebuilt from quotations, and written without them.

A line's quote level is the number of ``>`` it begins with.  Lines of one level that follow
each other, up to a blank line, are a passage.  Quoted passages are normalised (lower case,
one space for any run of white space) and hashed.  A message can answer an earlier one that has one
of its quoted passages among its own unquoted ones, and it answers the one that explains most of
what it quotes: at the least-nested level first, then by the rarest passage they share (the one
that fewest messages have as their own, then the longest), then by the number of shared passages,
where a passage quoted ``l`` levels deeper than the answered message itself quotes it counts too;
ties go to the later message, then the greater id.  Following the answers gives each message its
conversation, its depth, and its place among the messages of the conversation, in which a message
always comes after the one it answers.

Messages: msg_id (string), sent (long), text; other columns are not read.  One aggregation a passage
tells when it was first a message's own, and so which level of quotes a message's answer is found
at and which passage decides (its key).  Pairs of messages are then formed only through passages
that stand in at most ``RARE`` messages.  What is left are pairs that share nothing but more frequent
passages: there the distinct sets of passages asked for meet the distinct sets of those held that have
the key, and of all holders that explain a set equally well only the latest earlier one is looked up,
split by the time they were sent, as is a conversation.  So a signature in all messages makes lines
in proportion to them times the distinct sets whose rarest passage is the signature.  Chains of
answers are followed by doubling, so their length costs its logarithm in joins.

Null texts are empty; empty passages are no passages; a quote without an original links
nothing.  Null times link nothing.  Rows without a msg_id are no messages; of repeated ids
the first in (sent, text) order stands.  Built-in operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposa.llm.asof import latest_before, rank_within
from exposa.llm.tables import cut

_MARKS = r"^(?:[ \t]*>)+"
DOUBLINGS = 40
RARE = 32


def _lines(text: Column) -> Column:
    """Lines as structs of quote level (blank lines too have one) and body."""
    marks = lambda x: F.regexp_extract(x, _MARKS, 0)
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.struct(
        F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"),
        F.regexp_replace(F.regexp_replace(x, _MARKS, ""), r"^[ \t]+|[ \t\r]+$", "").alias("body")))


def _passages(lines: Column) -> Column:
    """Runs of lines of a level, cut at blank lines: structs of level and normalised text."""
    at = lambda i: F.element_at(lines, i)
    fresh = lambda i: (i == 1) | (at(i)["level"] != at(F.greatest(i - 1, F.lit(1)))["level"]) | \
        (at(i)["body"] == "")
    starts = F.filter(F.sequence(F.lit(1), F.size(lines)), fresh)
    spans = F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, F.lit(2), F.size(starts)),
                                                     F.array(F.size(lines) + 1)).alias("b"))
    body = lambda s: F.array_join(F.transform(F.slice(lines, s["a"], s["b"] - s["a"]),
                                              lambda x: x["body"]), " ")
    found = F.transform(spans, lambda s: F.struct(
        at(s["a"])["level"].alias("level"),
        F.trim(F.regexp_replace(F.lower(body(s)), r"\s+", " ")).alias("passage")))
    return F.filter(found, lambda p: p["passage"] != "")


def parse(messages: DataFrame) -> DataFrame:
    """(msg_id, sent, own_text, passages): lines without quotes, and all passages with their levels.

    A line that announces a quote (it ends with ``wrote:`` and a quoted line follows) is left out of both.
    """
    first = messages.where("msg_id is not null").groupBy("msg_id").agg(F.min(F.struct("sent", "text")).alias("m")) \
        .select("msg_id", "m.sent", _lines(F.col("m.text")).alias("lines"))
    n = F.size("lines")
    at = lambda i: F.element_at("lines", F.least(i, n))
    announces = lambda x, i: (x["level"] == 0) & x["body"].rlike(r"\bwrote:$") & \
        (i + 1 < n) & (at(i + 2)["level"] > 0)
    kept = cut(first.withColumn("lines", F.filter("lines", lambda x, i: ~announces(x, i))))
    own = F.filter("lines", lambda x: x["level"] == 0)
    text = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\n+|\n+$", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return kept.select("msg_id", "sent", text.alias("own_text"), _passages(F.col("lines")).alias("passages"))


def answers(parsed: DataFrame, rare: int = RARE) -> DataFrame:
    """(msg_id, parent): the message each one answers, where a quoted passage has an original."""
    every = parsed.select("msg_id", "sent", F.explode("passages").alias("p")).where("sent is not null") \
        .select("msg_id", "sent", "p.level", F.sha2("p.passage", 256).alias("hash"),
                F.length("p.passage").alias("length")).distinct()
    own = F.col("level") == 0
    known = every.groupBy("hash").agg(F.count("*").alias("rows"), F.count(F.when(own, 1)).alias("holders"),
                                      F.min(F.when(own, F.col("sent"))).alias("first"))
    # a passage can tell something where it is quoted and stands in another message too
    every = cut(every.join(known.where("rows > 1"), "hash"))
    # the least-nested level with an original, and the keys: its rarest, then longest passages with one
    keys = every.where("level > 0 and first < sent").groupBy("msg_id", "level", "holders", "length") \
        .agg(F.sort_array(F.collect_list("hash")).alias("keys")).groupBy("msg_id").agg(F.max(F.struct(
            (-F.col("level")).alias("near"), (-F.col("holders")).alias("rarity"), "length", "keys")).alias("k")) \
        .select("msg_id", (-F.col("k.near")).alias("near"), "k.keys")
    # the answered message has what is asked for at ``depth``
    asked = cut(every.join(keys, "msg_id").where("level >= near")
                .select("msg_id", "sent", "hash", "rows", "first", "keys", (F.col("level") - F.col("near")).alias("depth")))
    is_key = (F.col("depth") == 0) & F.array_contains("keys", F.col("hash"))
    holder = every.where(F.col("rows") <= rare).select(
        "hash", F.col("level").alias("depth"), F.col("msg_id").alias("parent"), F.col("sent").alias("at"))
    few = asked.where(F.col("rows") <= rare).join(holder, ["hash", "depth"]).where("at < sent") \
        .groupBy("msg_id", "parent", "at").agg(F.count("*").alias("n"), F.max(is_key).alias("has_key"))
    # frequent passages: sets of them, as depth and hash
    named = lambda depth: F.concat_ws(":", depth, "hash")
    held = cut(every.where(F.col("rows") > rare).groupBy("msg_id", "sent").agg(
        F.sort_array(F.collect_list(named("level"))).alias("held"))
        .withColumn("kind", F.sha2(F.concat_ws(",", "held"), 256)))
    wanted = cut(asked.where((F.col("rows") > rare) & ((F.col("depth") > 0) | (F.col("first") < F.col("sent"))))
                 .groupBy("msg_id", "sent").agg(F.sort_array(F.collect_list(named("depth"))).alias("wanted"),
                                                F.sort_array(F.collect_list(F.when(is_key, named("depth")))).alias("keys"))
                 .withColumn("set", F.sha2(F.concat_ws("|", F.concat_ws(",", "wanted"), F.concat_ws(",", "keys")), 256)))
    shared = F.size(F.array_intersect("wanted", "held")).cast("bigint")
    none = F.array().cast("array<string>")
    first = few.join(wanted.select("msg_id", "wanted", "keys"), "msg_id", "left") \
        .join(held.select(F.col("msg_id").alias("parent"), "held"), "parent", "left") \
        .withColumns({c: F.coalesce(c, none) for c in ("wanted", "keys", "held")}) \
        .where(F.col("has_key") | F.arrays_overlap("keys", "held")) \
        .select("msg_id", "parent", "at", (F.col("n") + shared).alias("n"))
    # pairs of frequent passages alone
    sets = wanted.where(F.size("keys") > 0).groupBy("set").agg(F.first("wanted").alias("wanted"), F.first("keys").alias("keys"))
    kinds = held.groupBy("kind").agg(F.first("held").alias("held"))
    between = cut(sets.select("set", "wanted", F.explode("keys").alias("key"))
                  .join(kinds.select("kind", "held", F.explode(F.filter("held", lambda h: h.startswith("0:"))).alias("key")), "key")
                  .select("set", "kind", shared.alias("n")).distinct())
    asking = wanted.select("msg_id", "sent", "set").join(between.select("set", "n").distinct(), "set")
    origins = between.join(held.select("kind", "sent", F.struct("sent", "msg_id").alias("origin")), "kind").drop("kind")
    second = latest_before(asking, origins, ["set", "n"], "sent", "origin").where("origin is not null") \
        .select("msg_id", F.col("origin.msg_id").alias("parent"), F.col("origin.sent").alias("at"), "n")
    return first.unionByName(second).groupBy("msg_id").agg(F.max(F.struct("n", "at", "parent")).alias("best")) \
        .select("msg_id", F.col("best.parent").alias("parent"))


def conversations(messages: DataFrame) -> DataFrame:
    """(msg_id, sent, parent, conversation, depth, position, text): messages without quotes.

    conversation: id of the first message of the chain of answers; depth: answers from it.
    """
    parsed = cut(parse(messages))
    linked = cut(answers(parsed))
    # pointers are doubled; messages that have reached the first of their chain are done and only
    # looked up from then on
    active, done = linked.select("msg_id", F.col("parent").alias("up"), F.lit(1).alias("depth")), []
    for _ in range(DOUBLINGS):
        further = reduce(DataFrame.union, done, active).select(
            F.col("msg_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = cut(active.join(further, "up", "left"))
        done.append(joined.where("next is null").select("msg_id", "up", "depth"))
        active = joined.where("next is not null").select(
            "msg_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        if active.isEmpty():
            break
    else:
        raise RuntimeError("answers form a chain of more than 2**40 messages")
    now = reduce(DataFrame.union, done)
    placed = parsed.drop("passages").join(linked, "msg_id", "left").join(now, "msg_id", "left").select(
        "msg_id", "sent", "parent", F.coalesce("up", "msg_id").alias("conversation"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.col("own_text").alias("text"))
    return rank_within(cut(placed), "conversation", "sent", "msg_id", "position") \
        .select("msg_id", "sent", "parent", "conversation", "depth", "position", "text")
