"""BPE, SimHash, decontamination and language ID against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from exposa.llm import bpe, decontam, langid, queries, simhash, words
from exposa.llm.components import components
from tests.llm.common import CLASHING, LONG, ROWS, SF, alnum_words, frame, space_words, union_find

BPE_FILE = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    import tokenizers
    return tokenizers.Tokenizer.from_file(BPE_FILE)


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _library_row(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), _sha(",".join(map(str, ids))), _sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_query_equals_library(spark, library):
    got = queries.QUERIES["op1_bpe_round_trip"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == _library_row(library, texts[r.doc_id])


def test_bpe_random_texts(library):
    rnd = random.Random(4)
    parts = [*"ab \n\t'sx1\u00b2\u00bd_\u00e9\u0151\u4e2d\U0001f600\x1c\x85\u00a0\u2003\u3000\u0660.,!-", "<|endoftext|>", "'re", " the"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, "aaa", " " * 900]
    vocab = bpe.vocabulary(BPE_FILE)
    for text, ids in zip(texts, bpe.encode_texts(texts, vocab), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode_ids(ids, vocab) == library.decode(ids.tolist(), skip_special_tokens=False)
    assert bpe.decode_ids([vocab.of_byte[0xC3]], vocab) == "\ufffd"


def test_bpe_edges(spark, library):
    docs = frame(spark)
    got = bpe.decode(bpe.encode(docs, BPE_FILE), BPE_FILE)
    assert got.columns == [*docs.columns, "token_ids", "decoded"]
    rows = got.collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in rows) == sorted((i or 0, t or "") for i, t in ROWS)
    assert all(r[c] == f"{c}!" for r in rows for c in CLASHING)
    assert bpe.round_trip(docs.where("false"), BPE_FILE).collect() == []


def test_bpe_pattern_classes_agree():
    texts = [chr(c) + "x " + chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    assert all(bpe._NEAR.findall(t) == bpe._general().findall(t) for t in texts)


def _print(text, k=3):
    w = space_words(text)
    shingles = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _simhash_rows(rows):
    prints = [_print(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = union_find(near, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return sorted((i or 0, f"{prints[k]:016x}", least.get(root[k])) for k, (i, _) in enumerate(rows))


def test_simhash_query(spark):
    got = queries.QUERIES["op2_simhash_near_dups"](spark, SF).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, got)) == _simhash_rows(rows)


def test_simhash_edges(spark):
    rows = [r for r in ROWS if r[1] != LONG] + [(11, "one two"), (12, "x y z " * 30_000), (13, "x y z " * 30_000 + "x")]
    got = simhash.near_duplicates(frame(spark, rows))
    assert sorted((r[0] or 0, r[1], r[2]) for r in got.collect()) == _simhash_rows(rows)
    assert simhash.near_duplicates(frame(spark).where("false")).collect() == []
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    parts = {c for _, _, c in _simhash_rows(rows)}
    assert kept.count() == len(parts)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_simhash_links_join_what_pairs_join(spark, bits):
    rnd = random.Random(bits)
    seeds = [rnd.getrandbits(64) for _ in range(6)]
    prints = sorted({s ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) & (1 << 64) - 1
                     for s in seeds for _ in range(60)} | {5 ^ x for x in range(256)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "simhash bigint")
    got = union_find([(r.a, r.b) for r in simhash.links(df, bits=bits).collect()], signed)
    near = [(signed[i], signed[j]) for i in range(len(prints)) for j in range(i)
            if (prints[i] ^ prints[j]).bit_count() <= bits]
    assert got == union_find(near, signed)


@pytest.mark.parametrize("short", [4, 32, 1000])
def test_simhash_tally_rejects_pairs_that_lists_bring_together(spark, monkeypatch, short):
    """Pairs that share five bytes meet in one list, those that share six in six; any length of lists
    gives the same components."""
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    rnd = random.Random(8)
    seed = rnd.getrandbits(64)
    far = [seed ^ sum(rnd.randrange(1, 256) << 8 * p for p in rnd.sample(range(8), 3)) for _ in range(30)]
    near = [seed ^ 1 << k for k in range(0, 64, 9)]
    prints = sorted({seed, *far, *near})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "simhash bigint")
    got = union_find([(r.a, r.b) for r in simhash.links(df).collect()], signed)
    assert got == union_find([(signed[i], signed[j]) for i in range(len(prints)) for j in range(i)
                              if (prints[i] ^ prints[j]).bit_count() <= 2], signed)
    if short == 1000:
        same = lambda x, y: sum((x ^ y) >> 8 * p & 255 == 0 for p in range(8))
        whole = {s: p for s, p in zip(signed, prints, strict=True)}
        lists = {(r.a, r.b): r.lists for r in simhash.tally(df).collect()}
        assert all(n == math.comb(same(whole[a], whole[b]), 5) for (a, b), n in lists.items())
        assert sum(n == 1 for n in lists.values()) >= 20 and sum(n >= 6 for n in lists.values()) >= 28


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(500, 400), (400, 500), (7, 7), (900, 901)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 400: 400, 500: 400, 900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def _overlap(text, items, window):
    found = {}
    for i, t in items:
        w = alnum_words(t)
        for p in range(len(w) - min(window, len(w)) + 1 if w else 0):
            found.setdefault(tuple(w[p:p + window]), set()).add(i)
    w, hit, ids, longest = alnum_words(text), set(), set(), 0
    for k in {len(x) for x in found}:
        for p in range(len(w) - k + 1):
            if (got := found.get(tuple(w[p:p + k]))) is not None:
                hit |= set(range(p, p + k))
                ids |= {i for i in got if i is not None}
    for i, t in items:
        v = alnum_words(t)
        for p in range(len(w)):
            for q in range(len(v)):
                n = 0
                while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                    n += 1
                if n >= min(window, len(v)):
                    longest = max(longest, n)
    return len(w), len(hit), sorted(ids), longest


def _flat(o):
    return o["n_words"], sum(s["end"] - s["start"] for s in o["spans"]), o["items"], o["longest"]


def test_decontam_random():
    rnd = random.Random(3)
    vocabulary = ["a", "b", "c", "\u00c9", "x9"]
    for _ in range(300):
        items = [(rnd.choice([1, 2, 3, None]), rnd.choice([None, "", " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 7)))]))
                 for _ in range(rnd.randint(0, 5))]
        texts = [rnd.choice([None, "", ".", "-".join(rnd.choices(vocabulary, k=rnd.randint(0, 30)))]) for _ in range(6)]
        data, offsets = words.column_bytes(pa.array(texts, pa.string()))
        got = [_flat(o) for o in decontam._shard(decontam.Index(items, 4), data, offsets)]
        assert got == [_overlap(t, items, 4) for t in texts]


def test_suffix_array_and_longest_prefixes():
    rnd = random.Random(5)
    for _ in range(200):
        size, other = rnd.choice([2, 3, 40]), rnd.choice([3, 60])
        texts, asked = ([[rnd.randint(1, k) for _ in range(rnd.randint(1, 25))] for _ in range(rnd.randint(1, 4))]
                        for k in (size, other))
        flat = lambda x: (np.array([w for t in x for w in t]), np.array([len(t) - i for t in x for i in range(len(t))]))
        suffixes = lambda x: [t[i:] for t in x for i in range(len(t))]
        number, run = flat(texts)
        array = decontam.Suffixes(number, run, np.arange(len(number)), 1000)
        own = suffixes(texts)
        assert [own[i] for i in array.order] == sorted(own)
        number, run = flat(asked)
        found, lo, hi = array.find(number, run, np.arange(len(number)))
        for x, n, a, b in zip(suffixes(asked), found.tolist(), lo.tolist(), hi.tolist(), strict=True):
            shared = lambda y: next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))  # noqa: B023, E731
            assert n == max(map(shared, own))
            assert sorted(array.order[a:b].tolist()) == [i for i, y in enumerate(own) if y[:n] == x[:n]]


def test_decontam_tells_where_the_longest_match_is():
    rnd = random.Random(8)
    for _ in range(200):
        items = [(rnd.choice([1, 2, 3, None]), " ".join(rnd.choices("abc", k=rnd.randint(0, 12)))) for _ in range(4)]
        texts = [" ".join(rnd.choices("abcd", k=rnd.randint(0, 30))) for _ in range(5)]
        data, offsets = words.column_bytes(pa.array(texts, pa.string()))
        for text, o in zip(texts, decontam._shard(decontam.Index(items, 4), data, offsets), strict=True):
            d, best = text.split(), []
            for i, t in items:
                w = t.split()
                for p in range(len(w)):
                    for s in range(len(d)):
                        n = next((k for k, (x, y) in enumerate(zip(d[s:], w[p:], strict=False)) if x != y),
                                 min(len(d) - s, len(w) - p))
                        if n >= 4 or 0 < n == len(w) and p == 0:
                            best.append((-n, s, [] if i is None else [i], p, i))
            # the least id counts, and none only where there is no other
            ids = {t: sorted(i for i, u in items if u == t and i is not None) for _, t in items}
            if best:
                n, s = min(best)[:2]
                told = min((not ids[t], ids[t][:1], p) for _, t in items for p in range(len(t.split()))
                           if t.split()[p:p - n] == d[s:s - n] and (-n >= 4 or (p == 0 and -n == len(t.split()))))
                assert (o["longest"], o["longest_at"], o["longest_item_at"]) == (-n, s, told[2])
                assert o["longest_item"] == (told[1][0] if told[1] else None)
            else:
                assert o["longest"] == 0 and o["longest_at"] is None and o["spans"] == []


def test_decontam_window_of_many_items():
    """A window that 1,000 items share costs a line a place, not a line a place and item."""
    shared = "one two three four five six seven eight nine ten"
    items = [(i, f"{shared} only{i}") for i in range(1000)]
    index = decontam.Index(items, 10)
    assert len(index.lists) <= 1001
    texts = [" x ".join([shared] * 40)] * 40 + [f"{shared} only7", shared + " only7 tail"]
    data, offsets = words.column_bytes(pa.array(texts, pa.string()))
    got = decontam._shard(index, data, offsets)
    assert all(o["items"] == list(range(1000)) and len(o["spans"]) == 40 for o in got[:40])
    assert [(o["longest"], o["longest_item"], len(o["items"])) for o in got[40:]] == [(11, 7, 1000)] * 2


def test_decontam_query(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op5_decontaminate"](spark, SF).collect()
    assert len(got) == len(texts) and any(r.contaminated for r in got)
    for r in got:
        if r.contaminated or r.doc_id % 5 == 0:
            n, hit, ids, longest = _overlap(texts[r.doc_id], items, 10)
            assert (r.n_words, r.n_hit, r.n_items, r.longest) == (n, hit, len(ids), longest)
            assert r.items_sha256 == _sha(",".join(sorted(map(str, ids)))) and r.contaminated == (hit > 0)


def test_decontam_blocks_and_edges(spark):
    items = spark.createDataFrame([(1, "Lorem ipsum, dolor sit"), (1, "Lorem ipsum, dolor sit"), (2, "text twice"),
                                   (3, None), (None, "no id here"), (4, "")], "item_id bigint, text string")
    docs = frame(spark)
    key = lambda df: sorted(str(r) for r in df.select("doc_id", "overlap.*").collect())
    whole, parts = (decontam.overlaps(docs, items, window=3, block_bytes=b) for b in (1 << 20, 10))
    assert key(whole) == key(parts)
    want = [_overlap(t, [(r.item_id, r.text) for r in items.collect()], 3) if t != LONG else None for _, t in ROWS]
    got = {r.doc_id: _flat(r.overlap.asDict()) for r in whole.collect()}
    assert all(got[i] == w for (i, _), w in zip(ROWS, want, strict=True) if w)
    assert got[7][:3] == (100_000, 80_000, [1])
    kept = decontam.clean(docs, items, window=3)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 8, 9} - {5}
    assert decontam.clean(docs, items.where("false"), window=3).count() == len(ROWS)
    assert decontam.clean(docs.where("false"), items).collect() == []


def test_langid_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.98 * len(held)


def _plain_language(train, text):
    """(language, score) by plain counting over the training rows: words first, then shorter and shorter n-grams."""
    letters = lambda w: "".join(c for c in w if c.isalpha())
    found = lambda t: [w for w in map(letters, re.findall(r"[^\W\d_]+", (t or "").lower())) if w]
    grams = lambda w, n: [w] if n == 0 else [v[i:i + n] for v in [f" {w} " if n > 1 else w]
                                             for i in range(len(v) - n + 1)]
    if not hasattr(_plain_language, "memo") or _plain_language.memo[0] is not train:
        count = {}
        for lang, t in train:
            for w in found(t):
                for n in range(5):
                    for g in grams(w, n):
                        count.setdefault(n, Counter())[g, lang] += 1
        langs = sorted({lang for lang, _ in train})
        size = {(n, x): sum(c for (_, y), c in v.items() if x == y) for n, v in count.items() for x in langs}
        known = {n: {g for g, _ in v} for n, v in count.items()}
        _plain_language.memo = train, count, langs, size, known
    _, count, langs, size, known = _plain_language.memo
    log = lambda n, g, x: math.log((count[n][g, x] + 0.5) / (size[n, x] + 0.5 * (len(known[n]) + 1)))
    total, n_words = dict.fromkeys(langs, 0.0), 0
    for w, times in Counter(found(text)).items():
        for n in (0, 4, 3, 2, 1):
            has = [g for g in grams(w, n) if g in known[n]]
            if has:
                for x in langs:
                    total[x] += times * sum(log(n, g, x) for g in has) / len(has)
                n_words += times
                break
    if not n_words:
        return None
    mean = [total[x] / n_words for x in langs]
    return langs[mean.index(max(mean))], 1 / sum(math.exp(m - max(mean)) for m in mean)


def test_langid_scores_by_plain_counting(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    train = [(r.lang, r.text) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None]
    assert max(Counter(lang for lang, _ in train).values()) < 4000        # so the sample is all of them
    got = {r.doc_id: r for r in queries.QUERIES["op10_language_id"](spark, SF).collect()}
    for r in docs:
        want = _plain_language(train, r.text)
        if want:
            assert got[r.doc_id].lang_pred == want[0] and got[r.doc_id].score == pytest.approx(want[1], rel=1e-6)


def test_langid_sizes_cut_ties_by_text(spark):
    rows = [(i, " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)) + " often often", "en")
            for i in range(1, 4) if zlib.crc32(str(i).encode()) % 5]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole, some = langid.fit(df), langid.fit(df, words_each=100, grams_each=10)
    assert len(whole.index[0]) == 301 and len(some.index[0]) == 100
    assert set(some.index[0]) == {"often", *sorted(set(whole.index[0]) - {"often"})[:99]}
    assert all(len(some.index[n]) == 10 for n in (1, 2, 3, 4))
    assert np.allclose(some.log[0][some.index[0]["often"]], np.log((len(rows) * 2 + 0.5) / (302 * len(rows) + 0.5 * 101)))


def test_overlap_of_items_with_text_ids(spark):
    docs = frame(spark, [(1, "x one two three y"), (2, "none")])
    items = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "one two")], "item_id string, text string")
    got = {r.doc_id: r.overlap for r in decontam.overlaps(docs, items, window=3).collect()}
    assert got[1]["items"] == ["a", "b"] and got[1]["longest_item"] == "a" and got[2]["items"] == []


def test_decontam_blocks_of_files(spark, tmp_path):
    """Many blocks of items give what one gives: rows from files, null and repeated ids, clashing names."""
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choices("abcdef", k=n))
    rows = [(rnd.choice([None, 1, 2, i]), text(rnd.randint(0, 40))) for i in range(200)] + ROWS
    frame(spark, rows).selectExpr("*", "'x' AS overlap_row").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    items = spark.createDataFrame([(rnd.choice([None, *"pqrst"]), text(rnd.randint(0, 9))) for _ in range(60)],
                                  "item_id string, text string")
    whole, parts = (decontam.overlaps(docs, items, window=4, block_bytes=b) for b in (1 << 20, 60))
    assert whole.columns == parts.columns == [c for c in docs.columns if c != "overlap"] + ["overlap"]
    key = lambda df: sorted(str((r.doc_id, r.text, r.overlap_row, r.overlap)) for r in df.collect())
    assert key(whole) == key(parts) and len(rows) == parts.count()
    assert [len(b) for b in decontam.item_blocks(items.withColumnRenamed("item_id", "id"), 60)] != [60]


def test_langid_ignores_held_out_and_null_labels(spark):
    rows = [(i, t, lang) for i in range(60) for t, lang in [("the cat and the hat", "en"), ("le chat et le chien", "fr")]]
    rows += [(i, "zzzz qqqq", "xx") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows += [(301, "zzzz", None), (None, "zzzz", "yy")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs == ["en", "fr"]
    got = model.predict([None, "", "123 !?", "Le CHIEN", "hat", "catz", "\u4e2d\u6587", "\u00bd \u00b2"])
    assert [g[0] for g in got] == ["und", "und", "und", "fr", "en", "en", "en", "und"]
    assert got[6][1] == 0.5 and got[0][1] == 0.0


def test_langid_falls_back_to_shorter_grams():
    rows = [("a", 0, "known", 5), ("b", 3, "xyz", 9), ("a", 2, "qr", 9), ("b", 1, "w", 9)]
    model = langid.Model(["a", "b"], rows, {("a", 0): (5, 1), ("b", 3): (9, 1), ("a", 2): (9, 1), ("b", 1): (9, 1)}, [1, 1])
    assert [p[0] for p in model.predict(["known", "xyz", "aqrz", "w", "xyzqr"])] == ["a", "b", "a", "b", "b"]


def test_langid_edges(spark):
    docs = frame(spark).selectExpr("*", "'en' AS lang")
    model = langid.fit(docs)
    got = langid.identify(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "lang_score"] and got.count() == len(ROWS)
    assert {r.doc_id for r in got.where("lang_pred = 'und'").collect()} == {1, 2, 3}
    assert langid.keep_identified(docs, model).count() == len(ROWS) - 3
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).collect() == []
