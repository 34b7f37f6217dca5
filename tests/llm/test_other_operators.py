"""Embeddings, shards, LM scoring, URLs, revisits, quotes and the pipeline."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from exposa.llm import asof, embed, lm, queries, quotes, shards, urls, warc
from exposa.llm.asof import latest_before, rank_within
from tests.llm.common import CLASHING, LONG, ROWS, SF, frame, space_words, union_find
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    ok, info = compare(spark, duck(sf), name, queries.QUERIES[name], queries.ORACLE[name], sf)
    assert ok, info


def _links(vectors, threshold=0.95):
    unit = []
    for _, v in vectors:
        ok = v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    return [(i, j) for i in range(len(unit)) for j in range(i) if unit[i] is not None and unit[j] is not None
            and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold]


def test_embedding_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    links = _links(rows)
    root = union_find(links, range(len(rows)))
    n = Counter(x for pair in links for x in pair)
    want = sorted((i, n[k], rows[root[k]][0], rows[root[k]][0] == i) for k, (i, _) in enumerate(rows))
    got = queries.QUERIES["op3_embedding_near_dups"](spark, SF).collect()
    assert sum(r.n_links for r in got) >= 0.99 * 2 * len(links)
    assert sorted(map(tuple, got)) == want


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
            (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [1e-300, 0.0]), (12, [-1.0]),
            (13, [3.0]), (None, [5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = embed.near_duplicates(df)
    want = {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 3, 8: 3, 9: 0, 10: 0, 11: 3, 12: 0, 13: 1, None: 1}
    rows = got.collect()
    assert {r.vec_id: r.n_links for r in rows} == want and len(rows) == 15
    assert {r.vec_id: r.component_id for r in rows}[11] == 7 and {r.vec_id: r.component_id for r in rows}[None] == 13
    assert embed.near_duplicates(df.where("false")).collect() == []


def test_embedding_split_buckets(spark):
    rnd = np.random.default_rng(1)
    centre = rnd.standard_normal(16)
    rows = [(i, (centre + 0.1 * rnd.standard_normal(16)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    one, many = (sorted(map(tuple, embed.near_duplicates(df, most=m).collect())) for m in (1024, 37))
    links = _links(rows)
    root, n = union_find(links, range(len(rows))), Counter(x for pair in links for x in pair)
    assert one == many == sorted((i, n[i], root[i], root[i] == i) for i, _ in rows) and sum(n.values()) > 600


def test_rotated_codes_estimate_without_bias():
    rnd = np.random.default_rng(2)
    d, turn = 64, embed.rotations(64, 1)
    x = rnd.standard_normal((400, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turned = x @ turn
    sign = np.where(turned >= 0, 1.0, -1.0)
    f = np.abs(turned).sum(1) / 8
    error = sign @ turned.T / (8 * f)[:, None] - x @ x.T
    off = ~np.eye(400, dtype=bool)
    assert abs(error[off].mean()) < 0.005
    bound = 5 * np.sqrt((1 - f ** 2) / f ** 2)[:, None] / math.sqrt(d - 1)
    assert (np.abs(error) <= bound)[off].mean() > 0.9999
    assert np.allclose(np.diag(error), 0)


def _shards(rows, k):
    sizes = sorted(((i is not None, i or 0), zlib.crc32((t or "").encode()) if t is not None else -1,
                    len((t or "").encode()) + 8) for i, t in rows)
    total, run, place, out = sum(s for _, _, s in sizes), 0, Counter(), []
    for (has, i), c, s in sizes:
        shard = (2 * run + s) * k // (2 * total)
        out.append((i if has else None, s, c if c >= 0 else None, shard, place[shard]))
        place[shard] += 1
        run += s
    return out


def test_shards_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op7_sampled_shards"](spark, SF).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32, r["shard"], r.slot) for r in got) == sorted(_shards(rows, 24))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_shards_hot_key_and_edges(spark):
    rows = [(7 if i % 3 else None if i % 2 else i, None if i % 5 == 0 else "x" * (i % 50)) for i in range(3000)]
    got = [tuple(r) for r in shards.assign(frame(spark, rows), 5).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _shards(rows, 5)))
    assert shards.assign(frame(spark).where("false"), 3).collect() == []
    assert len(shards.assign(frame(spark), 1).collect()) == len(ROWS)


def _scores(rows, strength=20.0):
    tokens = [(i, [*space_words(t), None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    one, two = Counter(), Counter()
    for i, t in tokens:
        if not held(i):
            one.update(t)
            two.update(zip([0, *t], t))
            one[0] += 1
    n, v = sum(c for w, c in one.items() if w != 0), len(one) - (0 in one)
    out = []
    for i, t in tokens:
        base = [(one[w] + 0.1) / (n + 0.1 * (v + 1)) for w in t]
        score = sum(math.log10((two[h, w] + strength * p) / (one[h] + strength)) for h, w, p in zip([0, *t], t, base))
        out.append((i, held(i), len(t), sum(one[w] > 0 for w in t), n, sum(map(math.log10, base)), score))
    return out


def _same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_lm_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op8_lm_score_order2"](spark, SF).collect()
    _same_scores([tuple(r) for r in got], _scores(rows))


def test_lm_edges(spark):
    _same_scores([tuple(r) for r in lm.score(frame(spark)).collect()], _scores(ROWS))
    assert lm.score(frame(spark).where("false")).collect() == []
    only = frame(spark, [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0])
    assert {(r.train_tokens, r.n_known, r.base_score) for r in lm.score(only).collect()} == {(0, 0, 0.0)}


def test_lm_probabilities_add_up(spark):
    """In every state the known words, the end and one unknown word have probability one."""
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:4]
    held = [i for i in range(1000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    words = ["a", "b", "c", "unseen"]
    for order in (1, 2, 3, 4):
        asked = [" ".join(c) for n in range(4) for c in itertools.product(words, repeat=n)]
        rows = [*zip(train, ["a b a c", "b a", "c c a", ""]), *zip(held, asked)]
        got = {r.doc_id: r.score for r in lm.score(frame(spark, rows, clashing=False), order=order).collect()}
        log_p = {tuple(t.split()): got[i] for i, t in zip(held, asked)}
        # P(words of c) = P(c, end) + sum over the next word w of P(words of c, w)
        whole = lambda c: 10 ** log_p[c]
        ends = _end_probability(rows[:4], order)
        for c in (c for c in log_p if len(c) < 3):
            after = whole(c) + sum(whole((*c, w)) / ends((*c, w)) for w in words)
            assert after == pytest.approx(whole(c) / ends(c), rel=1e-9)


def _end_probability(rows, order, strength=20.0):
    """P(end | words of a text) by plain counting."""
    pad = ["<s>"] * (order - 1)
    count = Counter()
    for _, t in rows:
        t = [*pad, *t.split(), None]
        for n in range(1, order + 1):
            count.update(tuple(t[k - n + 1:k + 1]) for k in range(len(pad), len(t)))
    for n in range(1, order):
        count[("<s>",) * n] = len(rows)
    single = [c for g, c in count.items() if len(g) == 1 and g != ("<s>",)]

    def of(words):
        known = [*pad, *words]
        p = (count[(None,)] + 0.1) / (sum(single) + 0.1 * (len(single) + 1))
        for n in range(2, order + 1):
            h = tuple(known[len(known) - n + 1:])
            p = (count[(*h, None)] + strength * p) / (count[h] + strength)
        return p
    return of


@pytest.mark.parametrize("lane", [1, 2, 3, 256])
def test_lm_lanes_and_failure_arcs(spark, monkeypatch, lane):
    """Texts read in short lanes score the same; the automaton's arcs end in the longest trained state."""
    monkeypatch.setattr(lm, "LANE", lane)
    rnd = random.Random(lane)
    rows = [(i, " ".join(rnd.choices("abcde", weights=[8, 4, 2, 1, 1], k=rnd.randint(0, 40)))) for i in range(60)]
    df = frame(spark, rows, clashing=False)
    _same_scores([tuple(r) for r in lm.score(df, order=2).collect()], _scores(rows))
    three = {r.doc_id: r.score for r in lm.score(df, order=3).collect()}
    monkeypatch.setattr(lm, "LANE", 1000)
    assert three == pytest.approx({r.doc_id: r.score for r in lm.score(df, order=3).collect()})


def test_lm_automaton_states():
    import pyarrow as pa
    text = b"a b a b c a b c"
    block = lm.Block([0, len(text)], pa.compress(text, "zstd", asbytes=True), len(text), 3).hold()
    counts = [np.bincount(of, minlength=len(k)) for k, of in zip(block.keys, block.of, strict=True)]
    base = np.full(len(block.keys[0]), 0.2)
    m = lm.Automaton(block, counts, base, 20.0)
    state, at = np.array([m.start]), []
    for t in block.of[0]:
        state, gained = m.step(state, np.array([t]))
        at.append(int(state[0]))
        assert gained[0] < 0
    assert at[1] == at[1 + 0] and at[2 + 1] == at[6] != at[2] and len(set(at[:-1])) == 5   # ab, ba, ab, bc, ca, ab, bc
    assert m.fail_to[m.fail_to[at[3]]] == 0                                 # a b -> b -> the empty context
    unseen = block.of[0][4]                                                  # c after "b a" has no arc in it, nor in a
    _, p = m.step(np.array([at[2]]), np.array([unseen]))
    assert p[0] == pytest.approx(m.fail[at[2]] + m.fail[m.fail_to[at[2]]] + math.log10(0.2))


def test_url_edges(spark):
    listed = spark.createDataFrame([("net", "/", "block"), ("Example.net", "/en/", "allow"), ("a.b", "", "block"),
                                    ("b", "/x", "allow"), ("x.b", "/", "block"), (None, "/", "block"), ("net", "/", "allow")],
                                   "host string, path string, verdict string")
    want = {None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"),
            "HTTP://WWW.Example.NET/en/Q?x#y": ("www.example.net", "/en/Q", "example.net/en/", "allow"),
            "http://example.net": ("example.net", "", None, "allow"), "http://net/": ("net", "/", "net/", "block"),
            "http://anet/": ("anet", "/", None, "allow"), "x://q.a.b?z://k": ("q.a.b", "", "a.b", "block"),
            "x://x.b/x": ("x.b", "/x", "x.b/", "block"), "://net/a\nb": ("net", "/a\nb", "net/", "block")}
    rows = [(k, u) for k, u in enumerate([*want, *want])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr(
        "*", *[f"'{c}!' AS {c}" for c in CLASHING if c != "host"], "'old' AS verdict")
    got = urls.judge(pages, listed).collect()
    assert len(got) == len(rows) and all(r["key"] == "key!" for r in got)
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in got} == want
    assert {r.verdict for r in urls.judge(pages, listed.where("false"), default="block").collect()} == {"block"}
    assert urls.judge(pages.where("false"), listed).collect() == []


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) AS key")
    for blocks in (1, 8, 128):
        filter = urls.bloom(keys, "key", blocks)
        assert urls.may_contain(keys, "key", filter, blocks).count() == 2000
    other = spark.range(20_000).selectExpr("concat('other', id) AS key")
    assert urls.may_contain(other, "key", filter, 128).count() < 400


def _no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_native_plans(spark):
    for name in ("op4_url_filter", "op9_quotation_threads"):
        _no_python(queries.QUERIES[name](spark, SF))


def _record(i, kind, url, at, head, payload=None):
    return i, kind, url, at, head, payload


def test_revisits(spark):
    ok = 'HTTP/1.1 200 OK\r\nETag: "1"\r\nLast-Modified: Mon\r\nCache-Control: a\r\nContent-Type: t\r\n\r\n'
    r304 = "HTTP/1.1 304 Not Modified\r\n"
    rows = [_record(1, "response", "HTTP://A.com:80#f", 10, ok, "one"), _record(2, "response", "http://a.com/", 20, ok, "two"),
            _record(3, "response", "http://a.com/", 20, ok.replace("Mon", "Tue"), "three"),
            _record(4, "revisit", "http://a.com/", 20, r304 + 'ETag: W/"1"\r\nCache-Control: b\r\nContent-Length: 0\r\n'),
            _record(5, "revisit", "http://a.com/", 30, r304 + "Last-Modified: Mon\r\n"),
            _record(6, "revisit", "http://a.com/", 30, r304), _record(6, "revisit", "http://a.com/", 30, r304),
            _record(7, "revisit", "http://a.com/", 5, r304), _record(8, "revisit", None, 30, r304),
            _record(9, "revisit", "http://a.com/", None, r304), _record(10, "revisit", "http://a.com/", 40, ok),
            _record(11, "revisit", "http://a.com/", 40, None), _record(12, "response", "http://a.com/", 35, r304, "no"),
            _record(13, "revisit", "http://a.com/", 50, r304 + 'ETag: "2"')]
    df = spark.createDataFrame(rows, "record_id bigint, warc_type string, target_uri string, warc_date bigint, http string, "
                                     "payload string").selectExpr("*", "1 AS best", "2 AS slice", "3 AS found")
    got = warc.resolve(df)
    rows = sorted(got.collect(), key=lambda r: r.record_id)
    assert [(r.record_id, r.outcome, r.response_id) for r in rows] == [
        (4, "resolved", 1), (5, "validator_mismatch", None), (6, "resolved", 3), (6, "resolved", 3),
        (7, "no_earlier_response", None), (8, "no_earlier_response", None), (9, "no_earlier_response", None),
        (10, "not_a_304", None), (11, "not_a_304", None), (13, "validator_mismatch", None)]
    assert rows[0].headers == 'cache-control: b\ncontent-type: t\netag: W/"1"\nlast-modified: Mon'
    assert {r.payload for r in warc.with_payload(got, df).where("record_id = 4").collect()} == {"one"}
    assert warc.resolve(df.where("false")).collect() == []


@pytest.mark.parametrize("most", [3, 25, 250_000])
def test_as_of_and_ranks(spark, monkeypatch, most):
    monkeypatch.setattr(asof, "SLICE_ROWS", most)
    rnd = random.Random(1)
    known = [(rnd.choice("ab"), rnd.randint(0, 300), rnd.randint(0, 9)) for _ in range(400)]
    known += [("a", 10**12, 1), ("a", -10**12, 2), *[("b", 50, k) for k in range(60)]]
    asked = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(300)]), n) for n in range(300)]
    asked += [("b", 50, 1000 + n) for n in range(40)] + [("a", 2 * 10**12, 2000)]
    k = spark.createDataFrame(known, "k string, at bigint, v int").selectExpr("k", "at", "struct(v) AS v")
    a = spark.createDataFrame(asked, "k string, at bigint, n int")
    want = {n: max(((t, v) for key, t, v in known if key == c and at is not None and t < at), default=(None, None))[1]
            for c, at, n in asked}
    for slices in (1, 7, 1024):
        got = {r.n: r.v and r.v.v for r in latest_before(a, k, ["k"], "at", "v", slices).collect()}
        assert got == want
        ranked = rank_within(a.where("k is not null"), "k", "at", "n", "place", slices).collect()
        for c in "abc":
            own = sorted((r for r in ranked if r.k == c), key=lambda r: (r["at"] is not None, r["at"] or 0, r.n))
            assert [r.place for r in own] == list(range(len(own)))


def test_a_burst_beside_an_outlying_time_is_cut(spark, monkeypatch):
    """Equal widths put the burst in one slice; it is cut again until no slice is overfull."""
    monkeypatch.setattr(asof, "SLICE_ROWS", 100)
    rows = spark.range(3000).selectExpr("'hot' AS k", "cast(5000 + id div 2 as bigint) AS at") \
        .union(spark.range(1).selectExpr("'hot'", "1000000000000000"))
    got, flat = asof._sliced(rows, ["k"], "at", 1024)
    sizes = got.groupBy("slice").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("slice").collect()
    assert flat is None and max(r.n for r in sizes) <= 100 and sum(r.n for r in sizes) == 3001
    assert all(a.hi < b.slice <= b.lo for a, b in zip(sizes[:-1], sizes[1:], strict=True))
    _, flat = asof._sliced(rows.withColumn("at", F.col("at") * 0), ["k"], "at", 1024)
    assert [r["_k0"] for r in flat.collect()] == ["hot"]


def test_quotes_query(spark):
    """Every turn is linked to the turn it quotes; texts come back without quotes."""
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = {r.msg_id: r for r in queries.QUERIES["op9_quotation_threads"](spark, SF).collect()}
    name = lambda c, t: f"{c:012d}-{t}"
    assert len(got) == len(turns)
    first = Counter(turns.values())
    for (c, t), text in turns.items():
        r = got[name(c, t)]
        assert r.text.split() == text.split()
        if t and (c, t - 1) in turns and first[turns[c, t - 1]] == 1:
            assert r.parent == name(c, t - 1) and r.depth == got[r.parent].depth + 1
            assert r.conversation == got[r.parent].conversation and r.position > got[r.parent].position
        if not t:
            assert (r.parent, r.depth, r.conversation) == (None, 0, r.msg_id)


def test_quotes_edges(spark):
    rows = [("a", 1, "Hello there\n\nSecond para"), ("b", 2, "X wrote:\n> hello   THERE\n>\n> Second para\nMy reply"),
            ("c", 3, "> My reply\n>> Hello there\nMore\n\n\n\n\nend"), ("d", 4, None), ("e", 5, "> nothing known\nfoo"),
            ("f", None, "> My reply\nq"), ("a", 1, "Zdup"), (None, 6, "> foo"), ("g", 9, ">Hello there\r\n"),
            ("h", 8, "Hello there"), ("i", 10, "He wrote:"), ("j", 11, "> > foo\nx" * 1)]
    df = spark.createDataFrame(rows, "msg_id string, sent bigint, text string").selectExpr("*", "1 AS depth", "2 AS hash")
    got = {r.msg_id: (r.parent, r.conversation, r.depth, r.position, r.text) for r in quotes.conversations(df).collect()}
    assert got == {"a": (None, "a", 0, 0, "Hello there\n\nSecond para"), "b": ("a", "a", 1, 1, "My reply"),
                   "c": ("b", "a", 2, 2, "More\n\nend"), "d": (None, "d", 0, 0, ""), "e": (None, "e", 0, 0, "foo"),
                   "f": (None, "f", 0, 0, "q"), "g": ("h", "h", 1, 1, ""), "h": (None, "h", 0, 0, "Hello there"),
                   "i": (None, "i", 0, 0, "He wrote:"), "j": ("e", "e", 1, 1, "x")}
    assert quotes.conversations(df.where("false")).collect() == []


def test_long_chain_of_answers(spark):
    rows = [("m000", 0, "text 0")] + [(f"m{i:03d}", i, f"> text {i - 1}\ntext {i}") for i in range(1, 200)]
    got = quotes.conversations(spark.createDataFrame(rows, "msg_id string, sent bigint, text string")).collect()
    assert {(r.conversation, r.depth, r.position) for r in got} == {("m000", i, i) for i in range(200)}


def test_pipeline(spark):
    """The rows of run() against the stages done plainly in Python."""
    import corpus_pipeline
    from tests.llm.test_text_operators import BPE_FILE, _library_row, _overlap, _simhash_rows
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    lettered = [(i, r.text) for i, r in docs.items() if any(c.isalpha() for c in r.text or "")]
    single = {i for i, _, c in _simhash_rows(lettered) if i == c}
    clean = {i for i in single if not _overlap(docs[i].text, items, 10)[1]}
    assert set(got) == clean
    import tokenizers
    library = tokenizers.Tokenizer.from_file(BPE_FILE)
    for i, r in got.items():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _library_row(library, docs[i].text)
        assert len(r.token_ids) == r.n_tokens


def test_pipeline_stages_take_awkward_rows(spark, tmp_path):
    import corpus_pipeline
    docs = frame(spark).selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (docs, docs.where("false")):
            out = stage(spark, rows, SF)
            assert out.count() <= rows.count()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns


def test_embedding_links_just_above_the_threshold(spark):
    """Planted pairs at cosine 0.950 to 0.960, far apart from each other: every one is a link."""
    rnd = np.random.default_rng(5)
    d, rows = 64, []
    for k in range(3000):
        x = rnd.standard_normal(d)
        x /= np.linalg.norm(x)
        y = rnd.standard_normal(d)
        y -= (y @ x) * x
        c = 0.9501 + 0.0099 * k / 3000
        rows += [(2 * k, x.tolist()), (2 * k + 1, (c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for most in (500, 8000):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(df, most=most).collect()}
        assert got == {i: (1, i - i % 2) for i, _ in rows}


def test_lm_query_of_order_three(spark):
    """Scores with contexts of two words, against plain counting."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tokens = [(i, [*space_words(t), None]) for i, t in rows]
    grams = lambda t, n: [tuple(([0] * (n - 1) + t)[k:k + n]) for k in range(len(t))]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(g for i, t in tokens if not held(i) for n in (1, 2, 3) for g in grams(t, n))
    first = sum(not held(i) for i, _ in tokens)
    count[0,] = count[0, 0] = first                       # the start stands before every training row
    total, v = sum(c for g, c in count.items() if len(g) == 1 and g != (0,)), sum(len(g) == 1 and g != (0,) for g in count)
    want = {}
    for i, t in tokens:
        p = [(count[w,] + 0.1) / (total + 0.1 * (v + 1)) for w in t]
        for n in (2, 3):
            p = [(count[g] + 20 * q) / (count[g[:-1]] + 20) for g, q in zip(grams(t, n), p, strict=True)]
        want[i] = sum(map(math.log10, p))
    got = {r.doc_id: r.score for r in queries.QUERIES["op8_lm_score"](spark, SF).collect()}
    assert got == pytest.approx(want)
    assert got != pytest.approx({r.doc_id: r.score for r in queries.QUERIES["op8_lm_score_order2"](spark, SF).collect()})


def test_shard_files_hold_every_row_once(spark, tmp_path):
    """Null ids stay, repeated ids are not multiplied, whether rows come from files or not."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i}") for i in range(300)]
    made = frame(spark, rows)
    made.write.parquet(str(tmp_path / "docs"))
    places = sorted(map(str, ((i, c, s, t) for i, _, c, s, t in _shards(rows, 4))))
    for k, docs in enumerate([made, spark.read.parquet(str(tmp_path / "docs"))]):
        shards.write(docs, str(tmp_path / f"out{k}"), 4)
        got = spark.read.parquet(str(tmp_path / f"out{k}")).collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, rows))
        assert sorted(map(str, ((r.doc_id, zlib.crc32(r.text.encode()), r.shard, r.slot) for r in got))) == places
        assert all(r["row_key"] == "row_key!" for r in got)


def test_shard_files_replace_columns_of_their_names(spark, tmp_path):
    docs = frame(spark, [(i, "x" * i) for i in range(40)]).selectExpr("*", "'mine' AS shard", "'mine' AS slot")
    shards.write(docs, str(tmp_path / "out"), 3)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 40 and {r.shard for r in got} == {0, 1, 2} and all(isinstance(r.slot, int) for r in got)


def test_payloads_of_repeated_responses(spark):
    http = "HTTP/1.1 200 OK\r\n\r\n"
    rows = [(1, "response", "http://a.org/", 10, http, "one")] * 2 + [(1, "response", "http://a.org/", 10, http, "other"),
            (2, "revisit", "http://a.org/", 20, "HTTP/1.1 304 Not Modified\r\n\r\n", None),
            (3, "response", "http://b.org/", 10, http, None),
            (4, "revisit", "http://b.org/", 20, "HTTP/1.1 304 Not Modified\r\n\r\n", None)]
    df = spark.createDataFrame(rows, "record_id bigint, warc_type string, target_uri string, warc_date bigint, "
                                     "http string, payload string")
    got = {r.record_id: r for r in warc.with_payload(warc.resolve(df), df).collect()}
    assert set(got) == {2, 4} and got[2].payload in ("one", "other") and got[4].payload is None
    assert got[2].payload_md5 == hashlib.md5(got[2].payload.encode()).hexdigest()
    assert warc.with_payload(warc.resolve(df), df).count() == 2


def test_frequent_passages_do_not_outrank_the_original(spark):
    """A greeting of a later, unrelated message, against all quoted passages and plain scoring."""
    rows = [("A", 10, "A long passage of its own\n\nThanks."), ("B", 50, "Thanks."),
            ("m", 60, "> A long passage of its own\n>\n> Thanks.\nMy answer"),
            ("n", 70, "> Thanks.\n>> A long passage of its own\n>> Thanks.\nagain"),
            ("p", 80, "> A long passage of its own\nThanks."), ("q", 85, "Thanks."),
            ("r", 90, "> Thanks.\n>> A long passage of its own\nend")]
    rows += [(f"x{k:03d}", 100 + k, "Thanks." if k % 2 else "Thanks.\n\nBest regards") for k in range(100)]
    rows += [("late", 300, "> Thanks.\n>\n> Best regards\nyes"), ("old", 20, "> Thanks.\nno")]
    df = spark.createDataFrame(rows, "msg_id string, sent bigint, text string")
    want = {"m": "A", "p": "A", "r": "p", "late": "x098", "old": "A", "n": "B"}
    parsed = quotes.parse(df).cache()
    for rare in (1, 3, 32, 1000):
        assert {r.msg_id: r.parent for r in quotes.answers(parsed, rare).collect()} == want


def _plain_answers(mail):
    """The message that each (id, sent, {(level, passage)}) answers, pair by pair."""
    holders = Counter(p for _, _, said in mail for level, p in said if level == 0)
    out = {}
    for i, sent, said in mail:
        best = []
        for j, at, held in mail:
            for near in {level for level, _ in said if level} if at < sent else ():
                keys = [(-holders[p], len(p)) for level, p in said if level == near and (0, p) in held]
                if keys:
                    n = sum((level - near, p) in held for level, p in said if level >= near)
                    best.append((-near, max(keys), n, at, j))
        if best:
            out[i] = max(best)[-1]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_answers_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    passages = ["thanks", "regards", *[f"passage {'x' * (k % 4)} {k}" for k in range(10)]]
    weights = [12, 8, 5, *[1] * (len(passages) - 3)]
    mail = []
    for k in range(90):
        said = [(0, rnd.choices(passages, weights)[0]) for _ in range(rnd.randint(0, 3))]
        said += [(rnd.choice([1, 1, 2, 3]), rnd.choices(passages, weights)[0]) for _ in range(rnd.randint(0, 4))]
        mail.append((f"m{k:02d}", rnd.randint(0, 60), said))
    rows = [(i, sent, "\n\n".join("> " * level + p for level, p in said)) for i, sent, said in mail]
    parsed = quotes.parse(spark.createDataFrame(rows, "msg_id string, sent bigint, text string")).cache()
    want = _plain_answers([(i, sent, set(said)) for i, sent, said in mail])
    assert len(want) > 30
    for rare in (0, 2, 8, 1000):
        assert {r.msg_id: r.parent for r in quotes.answers(parsed, rare).collect()} == want


def test_a_signature_in_all_messages_stays_linear(spark, monkeypatch):
    """Threads with a frequent passage of their own, and one signature everywhere: lines grow with the messages."""
    def lines(n):
        rows = [(f"t{k // 10:03d}-{k % 10}", k, (f"> Opening of thread {k // 10}\n>\n> Sent from afar\n\n" if k % 10 else
                 f"Opening of thread {k // 10}\n\n") + f"Opening of thread {k // 10}\n\nSent from afar") for k in range(n)]
        rows += [(f"s{k:03d}", n + k, "> Sent from afar\n\nSent from afar") for k in range(n // 10)]
        seen = []

        def counted(asking, known, *rest):
            seen.append(asking.count() + known.count())
            return latest_before(asking, known, *rest)

        monkeypatch.setattr(quotes, "latest_before", counted)
        parsed = quotes.parse(spark.createDataFrame(rows, "msg_id string, sent bigint, text string"))
        got = {r.msg_id: r.parent for r in quotes.answers(parsed, 4).collect()}
        assert all(got[f"t{k // 10:03d}-{k % 10}"] == f"t{k // 10:03d}-{k % 10 - 1}" for k in range(n) if k % 10)
        return seen[0]

    few, many = lines(100), lines(400)
    assert many <= 5 * few
