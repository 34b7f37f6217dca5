"""Ranked lexical search: the best documents of every item, from FP-trees of document vectors.

Items are taken in blocks of bounded size.  For a block every document is reduced to its restricted term
vector: the block's terms that it holds, with their counts.  The vectors are written once;
document frequencies, the number of documents and the number of terms follow from them.

A task lays the vectors of a run of documents in a frequency-ordered tree: terms go from the most
to the least frequent, so documents with the same beginning share a path, and a subtree is a
run of documents.  Every node stores the greatest count of each term below it and the least
length norm below it; the score rises with the one and falls with the other, so both together
bound what any document below can reach for an item.  The tree is searched depth first,
children of the greatest bound first; each item leaves the way down where the bound falls short of
its best results so far.  Bounds and scores are 64-bit integers, so nothing is lost to rounding.

The search starts from what a first search in a bounded draw of the documents reached
(a score that real documents have bounds the final one from below; it spares work and changes no
result).  A tree gives at most ``top`` rows an item; they are merged in two steps, so no task gets
the rows of all trees of an item.

Null texts and texts without terms take part in no count and match nothing.  Rows that repeat
are documents of their own.  Equal scores go by ascending id, null ids last.  Items that repeat
are ranked each by itself; null and empty items have no rows.  An empty table has an empty result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exposa.llm import words
from exposa.llm.tables import cut, ensure_checkpoint_dir

BLOCK_TERMS = 1 << 14            # distinct terms of a block of items
BLOCK_BYTES = 8 << 20            # text of a block of items
DRAW_ROWS = 200_000              # documents that the first search draws, at most
LEAF = 24                        # documents of a subtree that are scored without going further down
TREE_PAIRS = 1 << 22             # terms in the vectors of one tree
FOLDS = 64                       # parts of an item's rows in the first step of the merge
_CELLS = 1 << 22


def terms_of(text: str | None) -> list[str]:
    data, offsets = words.column_bytes(_arrow([text]))
    s, e, _ = words.spans(data, offsets, words.ALNUM_WORDS)
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8") for a, b in zip(s.tolist(), e.tolist(), strict=True)]


def _arrow(texts):
    import pyarrow as pa
    return pa.array(texts, pa.large_string())


class Items:
    """A block of items: its distinct terms, and each item's terms with their number of repeats."""

    def __init__(self, rows: list[tuple[int, object, list[str]]]):
        self.rows = [r[0] for r in rows]
        self.ids = [r[1] for r in rows]
        number: dict[str, int] = {}
        self.term, self.count, self.first = [], [], [0]
        for _, _, terms in rows:
            own: dict[int, int] = {}
            for t in terms:
                k = number.setdefault(t, len(number))
                own[k] = own.get(k, 0) + 1
            self.term += own
            self.count += own.values()
            self.first.append(len(self.term))
        self.terms = list(number)


def item_blocks(items: DataFrame, id: str, text: str):
    """Blocks of items with at most BLOCK_TERMS terms and BLOCK_BYTES of text (one item at least);
    one is held at a time."""
    held, seen, size = [], set(), 0
    rows = items.select(items[id].alias("id"), items[text].alias("text"))
    for k, r in enumerate(rows.toLocalIterator()):
        terms = terms_of(r["text"])
        if not terms:
            continue
        own = set(terms)
        if held and (len(seen | own) > BLOCK_TERMS or size + len(r["text"]) > BLOCK_BYTES):
            yield Items(held)
            held, seen, size = [], set(), 0
        held.append((k, r["id"], terms))
        seen |= own
        size += len(r["text"])
    if held:
        yield Items(held)


class Lookup:
    """Terms of a block found among the words of texts, by hash and then by their bytes."""

    def __init__(self, terms: list[str]):
        data, offsets = words.column_bytes(_arrow(terms))
        starts, ends = offsets[:-1], offsets[1:]
        h = words.hashes(data, starts, ends)
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.data, self.starts, self.size = data, starts[self.order], (ends - starts)[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word's term, -1 if it is none."""
        h = words.hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero((self.hash[at] == h) & (self.size[at] == ends - starts))
        size = self.size[at[hit]]
        to = np.concatenate(([0], np.cumsum(size)))
        step = np.arange(to[-1]) - np.repeat(to[:-1], size)
        differs = data[np.repeat(starts[hit], size) + step] != self.data[np.repeat(self.starts[at[hit]], size) + step]
        if len(size):
            hit = hit[~np.logical_or.reduceat(differs, to[:-1])]
        out = np.full(len(starts), -1, np.int64)
        out[hit] = self.order[at[hit]]
        return out


def vectors(docs: DataFrame, terms: list[str], id: str, text: str) -> DataFrame:
    """(id, n, term, tf) of every row with words: all its words counted, and the listed terms that it holds."""
    rows = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        lookup = Lookup(terms)
        for batch in batches:
            data, offsets = words.column_bytes(batch.column("text"))
            for at, to in words.blocks(offsets, 8 << 20):
                a = offsets[at]
                part = data[a:offsets[to]]
                starts, ends, first = words.spans(part, offsets[at:to + 1] - a, words.ALNUM_WORDS)
                n = np.diff(first)
                found = lookup.find(part, starts, ends)
                doc = np.repeat(np.arange(to - at), n)
                has = found >= 0
                key, tf = np.unique(doc[has] * len(terms) + found[has], return_counts=True)
                rows_of = np.searchsorted(key, np.arange(to - at + 1) * len(terms))
                keep = np.flatnonzero(n)
                lists = [pa.ListArray.from_arrays(pa.array(rows_of, pa.int32()), pa.array(v, pa.int32()))
                         for v in (key % len(terms), tf)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, to - at), pa.array(n, pa.int64()), *lists],
                    names=["id", "n", "term", "tf"]).take(pa.array(keep))

    return rows.mapInArrow(run, f"id {kind}, n bigint, term array<int>, tf array<int>")


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of the score before its weight (0 for a term that is absent)."""
    return 1_000_000_000 * tf // np.maximum(1000 * tf + 12 * m, 1)


class Tree:
    """Documents in the order of a frequency-ordered tree; its nodes are runs of them.

    vectors: for each document its terms as ranks (0 the most frequent) in ascending order.
    A node: (first, last + 1, children); ``most[node]`` the greatest counts below it, ``least[node]``
    the least norm.  Siblings with few documents share a leaf.
    """

    def __init__(self, first: np.ndarray, rank: np.ndarray, tf: np.ndarray, m: np.ndarray, terms: int):
        # big-endian bytes sort as the rank sequences do
        raw = rank.astype(">u4").tobytes()
        cut = (4 * first).tolist()
        keys = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.doc = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        self.keys = [keys[k] for k in self.doc.tolist()]
        size = np.diff(first)[self.doc]
        self.first = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(first[:-1][self.doc] - self.first[:-1], size) + np.arange(self.first[-1])
        self.rank, self.tf, self.m, self.terms = rank[take], tf[take].astype(np.int64), m[self.doc], terms
        self.most, self.least, self.nodes = [], [], []
        self.root = self._grow(0, len(keys), 0)
        del self.keys

    def _shared(self, a: int, b: int) -> int:
        """Number of terms that all documents from a to b - 1 begin with."""
        x, y = self.keys[a], self.keys[b - 1]
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            return n // 4
        lo, hi = 0, n
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid)
        return lo // 4

    def _grow(self, a: int, b: int, depth: int) -> int:
        """The node of a run of documents, all of which share ``depth`` terms."""
        pending, made = [(a, b, depth, None)], []
        while pending:                                  # no recursion: paths can be as long as texts
            a, b, depth, parent = pending.pop()
            me = len(made)
            made.append((a, b, []))
            if parent is not None:
                made[parent][2].append(me)
            if b - a <= LEAF:
                continue
            depth = self._shared(a, b)
            if 4 * depth == len(self.keys[b - 1]):      # all vectors are the same: a leaf
                continue
            at, run = a, a
            while at < b:
                end = self.keys[at][4 * depth:4 * depth + 4]
                to, hi = at + 1, b                      # the end of the child's run, by halving
                while to < hi:
                    mid = (to + hi) // 2
                    to, hi = (mid + 1, hi) if self.keys[mid][4 * depth:4 * depth + 4] == end else (to, mid)
                if to - at > LEAF:
                    if run < at:
                        pending.append((run, at, depth, me))
                    pending.append((at, to, depth + 1, me))
                    run = to
                elif to - run > LEAF:
                    if run < at:
                        pending.append((run, at, depth, me))
                    run = at
                at = to
            if run < b:
                pending.append((run, b, depth, me))
        self.most = np.zeros((len(made), self.terms), np.int32)
        self.least = np.empty(len(made), np.int64)
        for me in reversed(range(len(made))):
            a, b, children = made[me]
            if children:
                self.most[me] = self.most[children].max(0)
                self.least[me] = self.least[children].min()
            else:
                pairs = slice(self.first[a], self.first[b])
                np.maximum.at(self.most[me], self.rank[pairs], self.tf[pairs])
                self.least[me] = self.m[a:b].min()
        self.nodes = made
        return 0

    def counts(self, a: int, b: int) -> np.ndarray:
        """Counts of every term in documents a to b - 1, in the tree's order."""
        out = np.zeros((b - a, self.terms), np.int64)
        pairs = slice(self.first[a], self.first[b])
        out[np.repeat(np.arange(b - a), np.diff(self.first[a:b + 1])), self.rank[pairs]] = self.tf[pairs]
        return out


class Search:
    """Branch and bound for a block of items in one tree after another; keeps what each item has reached.

    term, gain: of all items in turn, the terms as ranks and their weight times repeats; first: where an item's begin.
    """

    def __init__(self, first: np.ndarray, term: np.ndarray, gain: np.ndarray, top: int, floor: np.ndarray):
        self.first, self.term, self.gain, self.top = first, term, gain, top
        self.reached = np.sort(np.repeat(floor[:, None], top, axis=1))     # best scores, least first

    def _sums(self, counts: np.ndarray, m: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Scores (or bounds) of rows with these counts and norms, for the given items."""
        size = np.diff(self.first)[items]
        at = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(self.first[:-1][items] - at[:-1], size) + np.arange(at[-1])
        term, gain = self.term[take], self.gain[take]
        out = np.empty((len(counts), len(items)), np.int64)
        step = max(1, _CELLS // max(1, len(take)))
        for k in range(0, len(counts), step):
            part = impact(counts[k:k + step, term].astype(np.int64), m[k:k + step, None]) * gain
            out[k:k + step] = np.add.reduceat(part, at[:-1], axis=1)
        return out

    def run(self, tree: Tree, place: np.ndarray):
        """(item, document, score): at most ``top`` documents of each item that this tree adds.

        place: order of the tree's documents by id, for equal scores."""
        best: dict[int, list] = {}
        stack = [(tree.root, np.arange(len(self.first) - 1))]
        while stack:
            node, items = stack.pop()
            a, b, children = tree.nodes[node]
            if children:
                bound = self._sums(tree.most[children], tree.least[children], items)
                open_ = bound >= np.maximum(self.reached[items, 0], 1)
                for k in np.argsort(bound.max(1), kind="stable").tolist():      # the greatest is next
                    if open_[k].any():
                        stack.append((children[k], items[open_[k]]))
                continue
            step = max(1, _CELLS // tree.terms)
            for lo in range(a, b, step):
                hi = min(b, lo + step)
                score = self._sums(tree.counts(lo, hi), tree.m[lo:hi], items)
                for k in np.flatnonzero((score >= np.maximum(self.reached[items, 0], 1)).any(0)).tolist():
                    self._keep(best, int(items[k]), score[:, k], tree.doc[lo:hi], place)
        for item, (score, doc) in best.items():
            yield item, doc, score

    def _keep(self, best: dict, item: int, score: np.ndarray, doc: np.ndarray, place: np.ndarray) -> None:
        has = score >= max(self.reached[item, 0], 1)
        score, doc = score[has], doc[has]
        self.reached[item] = np.sort(np.concatenate((self.reached[item], score)))[-self.top:]
        if item in best:
            score, doc = np.concatenate((best[item][0], score)), np.concatenate((best[item][1], doc))
        order = np.lexsort((place[doc], -score))[:self.top]
        best[item] = (score[order], doc[order])


def _found(rows: DataFrame, items: Items, weight: list[int], rank: np.ndarray, docs: int, words_: int, top: int,
           floor: list[int], id_kind: str, item_kind: str) -> DataFrame:
    """(item_row, item_id, doc_id, score) of what every tree adds to the items' best."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    item_type = to_arrow_type(item_kind)
    first = np.array(items.first, np.int64)
    term = rank[np.array(items.term, np.int64)]
    gain = np.array(weight, np.int64)[np.array(items.term, np.int64)] * np.array(items.count, np.int64)
    n_terms, item_rows, item_ids = len(items.terms), items.rows, items.ids
    doc_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow.compute as pc
        search = Search(first, term, gain, top, np.array(floor, np.int64))
        ids = pa.array(item_ids, item_type)
        for batch in batches:
            # ranks in ascending order within each document
            lists = batch.column("term")
            own = np.asarray(lists.flatten())
            flat = np.asarray(batch.column("tf").flatten())
            start = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))))
            m = 75 + 25 * batch.column("n").to_numpy().astype(object) * docs // words_
            m = m.astype(np.int64)
            ranked = rank[own]
            order = np.argsort(np.repeat(np.arange(len(start) - 1), np.diff(start)) * n_terms + ranked)
            ranked, flat = ranked[order], flat[order]
            for at, to in words.blocks(start, TREE_PAIRS):
                part = batch.column("id").slice(at, to - at)
                place = np.empty(to - at, np.int64)
                place[np.asarray(pc.sort_indices(part, null_placement="at_end"))] = np.arange(to - at)
                pairs = slice(start[at], start[to])
                tree = Tree(start[at:to + 1] - start[at], ranked[pairs], flat[pairs], m[at:to], n_terms)
                for item, doc, score in search.run(tree, place):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item_rows[item]] * len(doc), pa.int64()), ids.take(pa.array([item] * len(doc))),
                         part.take(pa.array(doc)), pa.array(score, pa.int64())],
                        names=["item_row", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, f"item_row bigint, item_id {item_kind.simpleString()}, doc_id {doc_type}, score bigint")


def _merged(found: DataFrame, top: int) -> DataFrame:
    """The best ``top`` of each item, with their rank: within parts of an item's rows, then of all parts."""
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("item_row", "part").orderBy(*by)
    best = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(FOLDS))) \
        .withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("part", "rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("item_row").orderBy(*by))) \
        .where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 20, doc_id: str = "doc_id", doc_text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item with a score above 0.

    A document scores the sum, over the item's terms with repeats, of
    weight * (10**9 tf div (1000 tf + 12 m)); weight: floor(1000 ln((2N + 2) / (2 df + 1)));
    m: 75 + 25 n N div L, with n the document's words, L those of all N documents that have any.
    """
    if top < 1:
        raise ValueError("top must be 1 or more")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/ranked-{uuid.uuid4().hex}"
    item_kind = items.schema[item_id].dataType
    doc_kind = docs.schema[doc_id].dataType
    result = None
    for k, block in enumerate(item_blocks(items, item_id, item_text)):
        vectors(docs, block.terms, doc_id, doc_text).write.parquet(f"{folder}/{k}")
        rows = spark.read.parquet(f"{folder}/{k}")
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        n, length = size["n"], size["l"]
        if not n:
            continue
        df = np.zeros(len(block.terms), np.int64)
        for r in rows.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            df[r["t"]] = r["df"]                          # a line a term of the block
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df]
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        how = (block, weight, rank, n, length, top)
        none = [0] * len(block.ids)
        drawn = _merged(_found(rows.sample(min(1 / 32, DRAW_ROWS / n), seed=1), *how, none, doc_kind, item_kind), top)
        reached = drawn.where(F.col("rank") == top).select("item_row", "score").collect()    # a line an item
        at = {row: i for i, row in enumerate(block.rows)}
        floor = list(none)
        for r in reached:
            floor[at[r["item_row"]]] = r["score"]
        got = cut(_merged(_found(rows, *how, floor, doc_kind, item_kind), top))
        result = got if result is None else result.union(got)
    if result is None:
        return spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, "
                                         f"doc_id {doc_kind.simpleString()}, score bigint")
    return result.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
