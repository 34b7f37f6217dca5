"""Ranked search, source mixing and spelling variants against plain versions, and on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from exposa.llm import mix, queries, ranked, variants
from tests.llm.common import LONG, ROWS, SF, frame, space_words


# ---- ranked lexical search

def _terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                      re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _plain_search(docs, items, top):
    """(row of items, rank, doc_id, score), every document scored for every item."""
    own = [(i, Counter(_terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, length = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for k, (_, text) in enumerate(items):
        got = []
        want = Counter(_terms(text))
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in want.items() if t in c)
            if s > 0:
                got.append((-s, i is None, i, s))
        got.sort(key=lambda r: r[:2] + (0 if r[2] is None else r[2],))
        out += [(k, rank, r[2], r[3]) for rank, r in enumerate(got[:top], 1)]
    return out


def _ranks(spark, docs, items, top, **how):
    got = ranked.search(docs, items, top, **how).collect()
    return sorted((r.item_id, r.rank, -1 if r.doc_id is None else r.doc_id, r.score) for r in got)


def _want(docs, items, top):
    return sorted((items[k][0], rank, -1 if i is None else i, s) for k, rank, i, s in _plain_search(docs, items, top))


def test_ranked_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op11_ranked_search"](spark, SF).collect()
    assert sorted(map(tuple, got)) == _want(docs, items, 20)


@pytest.mark.parametrize("leaf", [1, 3, 24])
@pytest.mark.parametrize("limits", [(1 << 14, 1 << 22), (5, 40)])
def test_ranked_small_trees_and_blocks(spark, monkeypatch, leaf, limits):
    rnd = random.Random(leaf)
    vocabulary = [f"w{k}" for k in range(30)]
    pick = lambda n: " ".join(rnd.choices(vocabulary, weights=[1 / (k + 1) for k in range(30)], k=n))
    docs = [(i, pick(rnd.randint(0, 12))) for i in range(150)]
    docs += [(200 + i, "w1 w2 w2 w9") for i in range(60)] + [(i, None) for i in range(3)] + [(None, "w1 w9"), (None, "w9 w1")]
    items = [(k, pick(rnd.randint(1, 6))) for k in range(8)] + [(20, None), (21, "--"), (22, "unseen words"), (23, "w1 W1 w1")]
    # tasks are forked with the module as it is here
    monkeypatch.setattr(ranked, "LEAF", leaf)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", limits[0])
    monkeypatch.setattr(ranked, "TREE_PAIRS", limits[1])
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert _ranks(spark, df, spark.createDataFrame(items, "item_id int, text string"), 5) == _want(docs, items, 5)


def test_tree_bounds_hold_and_prune():
    """Every node's maxima and minima bound its documents, and a search in a grown tree skips nodes."""
    rnd = np.random.default_rng(5)
    first, ranks, tf = [0], [], []
    for _ in range(600):
        own = np.flatnonzero(rnd.random(40) < 1 / (1 + np.arange(40)) ** 0.7)
        ranks += own.tolist()
        tf += rnd.integers(1, 9, len(own)).tolist()
        first.append(len(ranks))
    m = rnd.integers(76, 400, 600)
    tree = ranked.Tree(np.array(first), np.array(ranks), np.array(tf), m, 40)
    full = tree.counts(0, 600)
    assert sorted(tree.doc.tolist()) == list(range(600))
    for k, (a, b, children) in enumerate(tree.nodes):
        assert (tree.most[k] == full[a:b].max(0)).all() and tree.least[k] == tree.m[a:b].min()
        spans = sorted(tree.nodes[c][:2] for c in children)
        assert not children or (spans[0][0] == a and spans[-1][1] == b
                                and all(x[1] == y[0] for x, y in zip(spans[:-1], spans[1:], strict=True)))
    gain = np.array([9000, 8000, 7000])
    search = ranked.Search(np.array([0, 3]), np.array([30, 35, 39]), gain, 3, np.zeros(1, np.int64))
    scored = []
    counts = tree.counts
    tree.counts = lambda a, b: scored.append(b - a) or counts(a, b)
    (item, doc, score), = search.run(tree, np.arange(600))
    every = (ranked.impact(full[:, [30, 35, 39]], tree.m[:, None]) * gain).sum(1)
    assert item == 0 and score.tolist() == sorted(every.tolist())[::-1][:3]
    assert sum(scored) < 600


def test_ranked_awkward_rows(spark):
    rows = [r for r in ROWS]
    items = [(1, "same text"), (1, "same text"), (2, "lorem dolor"), (3, "ÉTÉ naïve"), (4, None), (5, "")]
    items_df = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "1 AS rank", "2 AS score")
    assert _ranks(spark, frame(spark), items_df, 20) == _want(rows, items, 20)
    assert ranked.search(frame(spark).where("false"), items_df).collect() == []
    assert ranked.search(frame(spark), items_df.where("false")).collect() == []
    text_ids = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "doc_id string, text string")
    more = text_ids.union(spark.createDataFrame([(f"z{k}", "other words") for k in range(9)], text_ids.schema))
    got = ranked.search(more, spark.createDataFrame([("q", "x")], "item_id string, text string")).orderBy("rank").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


# ---- mixing sources

def _plain_targets(size, weights, times, most):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, target, still = times * sum(size.values()), {s: 0.0 for s in order}, [s for s in order if size[s]]
    while left > 1e-9 and still:
        share = left / sum(w[s] for s in still)
        for s in still:
            target[s] += share * w[s]
        left = sum(max(0.0, target[s] - most * size[s]) for s in still)
        target.update({s: min(target[s], most * size[s]) for s in still})
        still = [s for s in still if target[s] < most * size[s]]
    return target


def _check_mix(docs, got, weights=(5, 2, 1), times=1.5, most=2.0):
    size = defaultdict(int)
    for _, text, s in docs:
        size[s] += len(space_words(text))
    target = _plain_targets(size, weights, times, most)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted(
        (i is None, i or 0, len(space_words(t))) for i, t, _ in docs)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-6)
        rate = r.target / r.source_size if r.size else 0
        assert r.taken == r.copies * r.size <= most * r.size and r.copies - math.floor(rate + 1e-12) in (0, 1)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6


def _mixed(docs, **how):
    return mix.mix(docs, **how).collect()


def test_mix_query(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = _mixed(df)
    _check_mix(docs, got)
    key = lambda r: (r.doc_id, r.size, r.source_size, r.target, r.taken)
    rows = queries.QUERIES["op12_source_mix"](spark, SF)
    assert sorted(map(tuple, rows.collect())) == sorted(map(key, got))
    assert [f.dataType.simpleString() for f in rows.schema] == ["bigint", "bigint", "bigint", "double", "bigint"]
    assert sorted(map(key, _mixed(df.repartition(13)))) == sorted(map(key, got))


def test_mix_levels_hot_source_and_repeats(spark):
    rnd = random.Random(3)
    docs = [(i, "w " * rnd.choice([1, 2, 5, 40]), rnd.choice(["hot", "hot", "hot", "b", None, "é"])) for i in range(900)]
    docs += [(7, "again and again", "hot")] * 300 + [(None, "no id", "z")] * 50 + [(1, None, "nothing"), (2, " ", "nothing")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    for fan, run in ((4, 7), (128, 4096)):
        mix_run, mix.RUN = mix.RUN, run
        try:
            got = _mixed(df, fan=fan)
        finally:
            mix.RUN = mix_run
        _check_mix(docs, got)
        assert sum(r.doc_id == 7 for r in got) == 300 + sum(d[0] == 7 for d in docs[:900])


def test_mix_keeps_expectation(spark):
    """Over some seeds documents of each size are taken as often as their fraction says."""
    rnd = random.Random(4)
    docs = [(i, "w " * rnd.choice([1, 3, 10]), "a") for i in range(300)] + [(1000, "w " * 500, "b")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").coalesce(1).cache()
    n, copies, seen = 8, Counter(), set()
    for seed in range(n):
        got = [r for r in _mixed(df, seed=seed, fan=16, times=0.5, most=2.0, weights=(1, 1)) if r.source == "a"]
        copies.update({size: sum(r.copies for r in got if r.size == size) for size in (1, 3, 10)})
        seen.add(tuple(sorted(r.doc_id for r in got if r.copies)))
    rate = got[0].target / got[0].source_size
    assert 0.05 < rate < 0.95 and len(seen) == n
    for size in (1, 3, 10):
        draws = n * sum(len(t.split()) == size for _, t, s in docs if s == "a")
        assert abs(copies[size] - draws * rate) < 4.5 * math.sqrt(draws * rate * (1 - rate))


def test_mix_awkward_rows(spark):
    rows = [(i, t, s) for (i, t), s in zip(ROWS, ["a", None, "b", "c", "a", "a", None, "é", "z", "z"], strict=True)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string") \
        .selectExpr("*", "1 AS e", "2 AS p", "3 AS size", "4 AS target", "5 AS bucket")
    _check_mix(rows, _mixed(df))
    assert _mixed(df.where("false")) == []
    _check_mix(rows[:3], _mixed(df.where("doc_id <= 3")))
    texts = [None, "", " ", "\t\r\n\x0b\x0c", "a", " a", "a ", "\n a b 　 c\x1c ", LONG]
    counted = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string") \
        .select("k", mix.word_count("t").alias("n")).orderBy("k").collect()
    assert [r.n for r in counted] == [len(space_words(t)) for t in texts]
    with pytest.raises(ValueError):
        mix.mix(df, times=3.0)


# ---- spelling variants

def _plain_words(docs, least=6, often=5, every=199):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= often}


def _plain_groups(n, ratio=5):
    """By the words with one code point left out, which all near words share."""
    holes = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].add(w)
    near = {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            near[w] |= holes[w[:k], w[k + 1:]]
            if w[:k] + w[k + 1:] in n:
                near[w].add(w[:k] + w[k + 1:])
                near[w[:k] + w[k + 1:]].add(w)
    form = {}
    for w in n:
        near[w].discard(w)
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_variants_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = queries.QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.01").collect()
    want = _plain_groups(_plain_words(docs))
    assert len(want) > 1000 and any(r[1] for r in want)
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("block", [3, 7, 2048])
def test_variants_split_groups(spark, monkeypatch, block):
    rnd = random.Random(block)
    n = {}
    while len(n) < 400:
        w = "".join(rnd.choices("abé", k=rnd.randint(1, 9)))
        n[w] = rnd.choice([5, 6, 30, 200, 1100, 6000, 40_000])
    monkeypatch.setattr(variants, "CELL_ROWS", 50)
    known = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = variants.group(known, block=block).collect()
    assert sorted(map(tuple, got), key=str) == _plain_groups(n)


def test_checksums_of_long_and_short_runs():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 123, 5000).astype(np.uint8)
    starts = np.array([0, 3, 10, 60, 200, 4000, 4999])
    ends = np.array([3, 3 + 6, 10 + 48, 60 + 49, 200 + 3000, 4998, 5000])
    before = np.array([zlib.crc32(f"{k}:".encode()) for k in range(7)], np.uint32)
    want = [zlib.crc32(f"{k}:".encode() + data[a:b].tobytes()) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert variants.checksums(data, starts, ends, before).tolist() == want


def test_variants_awkward_rows(spark):
    far = "x" * 4_000
    rows = ROWS + [(20, "Ärmel ärmel×÷ÿ ×abcdef Zebras ZEBRAS zebras, zebraß zebras-zebra's"), (None, "zebras zebra"),
                   (21, f"{far} {far}y")] + [(30 + k, "zebraé colour color Colours") for k in range(6)]
    docs = [(i, t) for i, t in rows]
    for often, every in ((1, 199), (2, 3), (1, 1), (5, 0)):
        known = variants.vocabulary(frame(spark, rows), often=often, every=every)
        want = _plain_words(docs, often=often, every=every)
        assert {r.word: r.n for r in known.collect()} == want
        assert sorted(map(tuple, variants.group(known).collect()), key=str) == _plain_groups(want)
    empty = variants.vocabulary(frame(spark).where("false"))
    assert empty.collect() == [] and variants.group(empty).collect() == []
