"""Registered queries of this subpackage: one thin query an operator, on its whole table."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposa.llm import bpe, decontam, embed, langid, lm, mix, quotes, ranked, shards, simhash, urls, variants, warc
from exposa.llm.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return keep


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; EXPOSA_TOKENIZERS names another folder."""
    folder = os.environ.get("EXPOSA_TOKENIZERS")
    if not folder:
        found = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, name)


@register("op1_bpe_round_trip")
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the byte-level vocabulary and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@register("op2_simhash_near_dups")
def op2_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of 3-word shingles and component (2 bits or fewer) of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, bits=2)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op5_decontaminate", f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT row_number() OVER () AS n, item_id, {_WORDS.format("text")} AS w FROM benchmark),
item AS (SELECT n, item_id, k, unnest(range(1, len(w) - k + 2)) AS ip, w
         FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0) WHERE k > 0),
wanted AS (SELECT n, item_id, k, ip, array_to_string(w[ip:ip + k - 1], ' ') AS t FROM item),
place AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS dp, w
          FROM d, (SELECT DISTINCT k FROM wanted) WHERE len(w) >= k),
here AS (SELECT doc_id, k, dp, array_to_string(w[dp:dp + k - 1], ' ') AS t FROM place),
occ AS (SELECT h.doc_id, h.dp, h.k, x.n, x.item_id, x.ip FROM here h JOIN wanted x ON x.t = h.t AND x.k = h.k),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
        FROM (SELECT doc_id, unnest(range(dp, dp + k)) AS pos FROM occ) GROUP BY doc_id),
run AS (SELECT doc_id, count(*) + max(k) - 1 AS len
        FROM (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, n, dp - ip ORDER BY dp) AS island FROM occ)
        GROUP BY doc_id, n, dp - ip, island),
most AS (SELECT doc_id, max(len) AS longest FROM run GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
        FROM (SELECT DISTINCT doc_id, item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(longest, 0)::INTEGER AS longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN most USING (doc_id) LEFT JOIN ids USING (doc_id)""")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontam.overlaps(docs, table(spark, sf_dir, "benchmark"), window=10)
    o = got.select("doc_id", "overlap.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return o.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "longest")


@register("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; the model sees no held-out row."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    got = langid.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"))


@register("op8_lm_score")
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the backoff automaton of the training rows:
    contexts of two words, which fall back to one word, then to none."""
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), order=3)


@register("op8_lm_score_order2")
def op8_lm_score_order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8_lm_score, with contexts of one word."""
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), order=2)


@register("op7_sampled_shards")
def op7_sampled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of near equal bytes, contiguous in doc_id."""
    got = shards.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return got.select("doc_id", "size", F.coalesce("text_crc32", F.lit(0)).cast("bigint").alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op3_embedding_near_dups", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a, least(a, min(b)) AS r FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(r, vec_id) AS component_id, coalesce(r, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN root ON root.a = vec_id""")
def op3_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more, and components, over all vectors whatever their labels."""
    return embed.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


# The rules of the URL filter's query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


@register("op4_url_filter", r"""
WITH cut AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                          ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
       (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
       coalesce((SELECT v FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM cut""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by the longest listed host and path that fits it."""
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


_CAPTURES = 4


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in archive: four captures of every page, full answers and 304s with validators."""
    take = table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.lit(_CAPTURES - 1))).alias("k")) \
        .withColumn("record_id", F.col("page_id") * _CAPTURES + F.col("k")) \
        .withColumn("dice", F.md5(F.concat_ws(":", "page_id", "k"))) \
        .withColumn("at", 1700000000 + F.col("page_id") * 37 % 100000 + F.col("k") * 86400)
    version = F.substring(F.md5(F.concat(F.col("url"), F.when(F.col("k") < 2, "a").otherwise("b"))), 1, 12)
    is_full = (F.col("k") == 0) | (F.substring("dice", 1, 1) < "5")
    etag = F.when(F.substring("dice", 2, 1) < "c", F.concat(F.lit('ETag: "'), version, F.lit('"\r\n'))).otherwise("")
    common = F.concat(F.lit("Cache-Control: max-age="), F.substring("dice", 3, 1), F.lit("\r\n"), etag)
    full = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"), common, F.lit("\r\n"))
    again = F.concat(F.lit("HTTP/1.1 304 Not Modified\r\nContent-Length: 0\r\n"), common, F.lit("\r\n"))
    return take.select("record_id", F.when(is_full, "response").otherwise("revisit").alias("warc_type"),
                       F.col("url").alias("target_uri"), F.col("at").alias("warc_date"),
                       F.when(is_full, full).otherwise(again).alias("http"),
                       F.when(is_full, F.concat("html", F.lit("<!-- "), F.col("k"), F.lit(" -->"))).alias("payload"))


@register("op6_warc_revisits", r"""
WITH take AS (
  SELECT page_id, url, html, k, page_id * 4 + k AS record_id, md5(page_id::VARCHAR || ':' || k::VARCHAR) AS dice,
         1700000000 + page_id * 37 % 100000 + k * 86400 AS at
  FROM pages, (SELECT unnest([0, 1, 2, 3]) AS k)),
rec AS (
  SELECT *, (k = 0 OR substr(dice, 1, 1) < '5') AS is_full,
    CASE WHEN substr(dice, 2, 1) < 'c'
         THEN '"' || substr(md5(url || CASE WHEN k < 2 THEN 'a' ELSE 'b' END), 1, 12) || '"' END AS etag,
    'max-age=' || substr(dice, 3, 1) AS cc,
    regexp_replace(url, '#.*$', '') AS bare
  FROM take),
canon AS (
  SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
    CASE WHEN lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) = 'http'
         THEN regexp_replace(lower(regexp_extract(bare, '^[^:/?#]+://([^/?#]*)', 1)), ':80$', '')
         ELSE regexp_replace(lower(regexp_extract(bare, '^[^:/?#]+://([^/?#]*)', 1)), ':443$', '') END ||
    CASE WHEN starts_with(regexp_extract(bare, '^[^:/?#]+://[^/?#]*(.*)$', 1), '/') THEN '' ELSE '/' END ||
    regexp_extract(bare, '^[^:/?#]+://[^/?#]*(.*)$', 1) AS canonical_url
  FROM rec),
found AS (
  SELECT r.record_id, r.canonical_url, r.at AS warc_date, r.etag AS etag, r.cc AS cc,
         max(struct_pack(at := f.at, id := f.record_id)) AS f
  FROM canon r LEFT JOIN canon f ON f.is_full AND f.canonical_url = r.canonical_url AND f.at < r.at
  WHERE NOT r.is_full GROUP BY ALL),
judged AS (
  SELECT g.*, o.etag AS o_etag, md5(o.html || '<!-- ' || o.k::VARCHAR || ' -->') AS md5_,
    CASE WHEN g.f IS NULL THEN 'no_earlier_response'
         WHEN g.etag IS NOT NULL AND g.etag IS DISTINCT FROM o.etag THEN 'validator_mismatch'
         ELSE 'resolved' END AS outcome
  FROM found g LEFT JOIN canon o ON o.record_id = g.f.id)
SELECT record_id, canonical_url, warc_date, outcome,
  CASE WHEN outcome = 'resolved' THEN f.id::VARCHAR END AS response_id,
  CASE WHEN outcome = 'resolved' THEN md5_ END AS payload_md5,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: ' || cc || chr(10) || 'content-type: text/html' ||
       coalesce(chr(10) || 'etag: ' || coalesce(etag, o_etag), '') END AS headers
FROM judged""")
def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified revisit of the archive, resolved to the response it stands for."""
    return warc.resolve(archive(spark, sf_dir)).withColumn("response_id", F.col("response_id").cast("string"))


def mailbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in mail: each turn quotes the turn before it, and that one's own quote one level deeper."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    one, two = turns.alias("m"), turns.alias("q")
    quoted = lambda text, mark: F.regexp_replace(text, "(?m)^", mark)
    joined = one.join(two, (F.col("m.conv_id") == F.col("q.conv_id")) & (F.col("m.turn") == F.col("q.turn") + 1), "left") \
        .join(turns.alias("d"), (F.col("m.conv_id") == F.col("d.conv_id")) & (F.col("m.turn") == F.col("d.turn") + 2),
              "left")
    head = F.concat(F.lit("A reader wrote:\n"), quoted(F.col("q.text"), "> "), F.lit("\n"))
    deep = F.concat(quoted(F.col("d.text"), ">> "), F.lit("\n"))
    return joined.select(F.concat_ws("-", F.lpad(F.col("m.conv_id").cast("string"), 12, "0"), "m.turn").alias("msg_id"),
                         (F.col("m.conv_id").cast("bigint") * 100000 + F.col("m.turn")).alias("sent"),
                         F.concat(F.coalesce(head, F.lit("")), F.coalesce(deep, F.lit("")), F.col("m.text"))
                         .alias("text"))


@register("op9_quotation_threads")
def op9_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply-ordered conversations of the mailbox, every message without its quotes."""
    return quotes.conversations(mailbox(spark, sf_dir))


@register("op11_ranked_search", f"""
WITH t AS (SELECT r, doc_id, unnest(w) AS term
           FROM (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
size AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
df AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
       FROM tf, total GROUP BY term),
q AS (SELECT i, item_id, term, count(*) AS c
      FROM (SELECT i, item_id, unnest(w) AS term
            FROM (SELECT row_number() OVER () AS i, item_id, {_WORDS.format("text")} AS w FROM benchmark))
      GROUP BY i, item_id, term),
scored AS (SELECT i, item_id, r, doc_id,
             sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
           FROM q JOIN df USING (term) JOIN tf USING (term) JOIN size USING (r), total GROUP BY i, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank
      FROM scored WHERE score > 0)
WHERE rank <= 20""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@register("op12_source_mix")
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of one and a half times all words, sources weighed 5, 2, 1."""
    got = mix.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), (5, 2, 1), times=1.5, most=2.0)
    return got.select("doc_id", "size", "source_size", "target", "taken")


@register("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, with the form and the root that each is a variant of."""
    known = variants.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), least=6, often=5, every=199)
    return variants.group(known, ratio=5)
