"""Benchmark decontamination with suffix arrays over the training shards.

Words become numbers of the benchmark's vocabulary (0: a word it lacks).  A run is a stretch of
benchmark words that follow each other, pair by pair, somewhere in the benchmark; no match can
leave its run.  Each shard (a run of a partition's documents) gets the suffix array of its runs
that are long enough to hold a window: their suffixes, cut at the end of the run, in the order of
their words, by prefix doubling.  Each test suffix that begins a window is binary-searched in
every shard's array; the interval it gets holds all places of its window.  These places are then
searched in the suffix array of the test items, which gives the longest verbatim match at each,
and where it stands.  Both searches compare names of blocks of 2^j words, from long to short, so
a match of n words costs log n binary searches.  Names stand for the words themselves (the
vocabulary compares bytes), so no hash decides anything.

A place has one line for each window length, however many items hold the window: windows held by
the same items share one list, and a document gets the union of its lists.

The test items are cut in blocks of at most ``block_bytes`` (or one item) by a Spark job; the driver
holds one block at a time.  A benchmark of one block is one pass over the documents without a
shuffle; the matches of each further block are written under a key of the row, and joined at last.

Null, empty and word-free texts have no words and match nothing.  An item without a word is
no window; items of fewer words than a window are one window of all their words.  Item rows
that repeat count once; an item whose id is null marks words but has no id to list.  Extra
columns pass through.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exposa.llm import words
from exposa.llm.tables import cut, unused, with_row_key

SHARD_BYTES = 8 << 20
FOUND = ("n_words bigint, spans array<struct<start:int,end:int>>, items array<{id}>, longest int, "
         "longest_at int, longest_item {id}, longest_item_at int")


class Suffixes:
    """Suffix array of ``number``: the places ``at`` sorted by the ``run`` words (up to ``limit``) from each on.

    ``names[j]`` numbers the blocks of 2^j words (fewer at the end of a run) in the order of their
    words; ``tables[j]`` holds the pairs of names of which those of ``names[j + 1]`` are made.
    """

    def __init__(self, number: np.ndarray, run: np.ndarray, at: np.ndarray, limit: int):
        self.run, self.names, self.tables = run, [number.astype(np.int64)], []
        self.base = max(len(number), int(number.max(initial=0))) + 1
        h, limit = 1, min(limit, int(run.max(initial=0)))
        while h < limit:
            table, place = np.unique(self._pairs(self.names[-1], h, run > h), return_inverse=True)
            self.tables.append(table)
            self.names.append(place.reshape(-1) + 1)
            h *= 2
        self.order = at[np.argsort(self.names[-1][at], kind="stable")]

    def _pairs(self, names: np.ndarray, h: int, goes_on: np.ndarray) -> np.ndarray:
        after = np.zeros_like(names)
        after[:-h] = names[h:]
        return names * self.base + np.where(goes_on, after, 0)

    def _bound(self, j: int, skip: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, after: bool):
        """First place in [lo, hi) whose block at ``skip`` words on is not below (``after``: is above) ``value``."""
        names, a, b = self.names[j], lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(a < b)):
            mid = (a[open_] + b[open_]) >> 1
            place, on = self.order[mid], skip[open_]
            here = np.where(self.run[place] > on, names[np.minimum(place + on, len(names) - 1)], 0)
            right = here <= value[open_] if after else here < value[open_]
            a[open_[right]] = mid[right] + 1
            b[open_[~right]] = mid[~right]
        return a

    def find(self, number: np.ndarray, run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the ``run`` words from each place ``at`` on, how many a suffix here begins with at most, and the
        interval [lo, hi) of the suffixes that do."""
        names = [number.astype(np.int64)]
        for j, table in enumerate(self.tables):
            h, known = 1 << j, names[-1]
            whole = np.flatnonzero((run >= 2 * h) & (known > 0))
            after = known[whole + h]
            whole = whole[(after > 0) & (after < self.base)]
            if not len(whole):
                break
            key = known[whole] * self.base + known[whole + h]
            place = np.minimum(np.searchsorted(table, key), len(table) - 1)
            names.append(np.zeros_like(known))
            names[-1][whole] = np.where(table[place] == key, place + 1, 0)
        found, lo, hi = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.full(len(at), len(self.order))
        for j in range(len(names) - 1, -1, -1):
            live = np.flatnonzero(run[at] - found >= 1 << j)
            value = names[j][at[live] + found[live]]
            live, value = live[value > 0], value[value > 0]
            a = self._bound(j, found[live], lo[live], hi[live], value, False)
            b = self._bound(j, found[live], a, hi[live], value, True)
            has = b > a
            live = live[has]
            lo[live], hi[live] = a[has], b[has]
            found[live] += 1 << j
        return found, lo, hi


class Index:
    """Test suffixes of a block of items: their array, the window each begins, and the ids that hold it."""

    def __init__(self, items: list[tuple[int | str | None, str | None]], window: int):
        import pyarrow as pa
        by_text: dict[bytes, set] = {}
        data, offsets = words.column_bytes(pa.array([t for _, t in items], pa.string()))
        starts, ends, first = words.spans(data, offsets, words.ALNUM_WORDS)
        raw = data.tobytes()
        for k, (i, _) in enumerate(items):
            key = b" ".join(raw[s:e] for s, e in zip(starts[first[k]:first[k + 1]].tolist(),
                                                     ends[first[k]:first[k + 1]].tolist(), strict=True))
            if key:
                by_text.setdefault(key, set()).add(i)
        self.ids = sorted({i for v in by_text.values() for i in v if i is not None})
        rank = {i: n for n, i in enumerate(self.ids)}
        of_text = [sorted(rank[i] for i in v if i is not None) for v in by_text.values()]
        lists = [k.split(b" ") for k in by_text]
        number = {w: n for n, w in enumerate(sorted({w for x in lists for w in x}), 1)}
        self.words = [b"", *number]
        self.length = np.array([len(w) for w in self.words])
        self.at_word = np.concatenate(([0], np.cumsum(self.length)))
        self.bytes = np.frombuffer(b"".join(self.words), np.uint8)
        keys = words.hashes(self.bytes, self.at_word[1:-1], self.at_word[2:])
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_word = keys[order], (order + 1).astype(np.int32)
        # all texts one after another
        size = np.array([len(x) for x in lists], np.int64)
        self.window = window
        self.sequence = np.array([number[w] for x in lists for w in x], np.int64)
        self.text = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(self.text)) - np.repeat(np.cumsum(size) - size, size)
        self.left = size[self.text] - self.place if len(size) else self.place
        inner = np.flatnonzero(self.left > 1)
        self.pairs = np.unique(self.sequence[inner] * len(self.words) + self.sequence[inner + 1])
        need = np.minimum(window, self.left + self.place)
        self.at = np.flatnonzero(self.left >= need)                # each begins a window
        self.need = need[self.at]
        self.least, self.longest = int(self.need.min(initial=window)), int(size.max(initial=0))
        self.suffixes = Suffixes(self.sequence, self.left, self.at, self.longest)
        # equal windows, and equal lists of the ids that hold them
        known: dict[bytes, int] = {}
        raw, width = self.sequence.tobytes(), self.sequence.itemsize
        self.which = np.array([known.setdefault(raw[p * width:(p + k) * width], len(known))
                               for p, k in zip(self.at.tolist(), self.need.tolist(), strict=True)], np.int64)
        holders = np.unique(np.stack([self.which, self.text[self.at]]), axis=1)
        lists_of: dict[tuple, int] = {}
        self.list_of = np.zeros(len(known), np.int64)
        cuts = np.searchsorted(holders[0], np.arange(len(known) + 1))
        for w, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            self.list_of[w] = lists_of.setdefault(
                tuple(sorted({i for t in holders[1, a:b].tolist() for i in of_text[t]})), len(lists_of))
        self.lists = [np.array(x, np.int64) for x in lists_of]
        # which of several places of a match is told: the least id's (no id after all others), then the earliest
        self.first_id = np.array([x[0] if x else len(self.ids) for x in of_text], np.int64)
        self.told = np.empty(len(self.text), np.int64)
        self.told[np.lexsort((self.place, self.first_id[self.text]))] = np.arange(len(self.text))

    def number(self, data, starts, ends) -> np.ndarray:
        """Vocabulary number of every word; bytes are compared, so a hash alone decides nothing."""
        if not len(self.keys):
            return np.zeros(len(starts), np.int32)
        got = words.hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.keys, got), len(self.keys) - 1)
        number = np.where(self.keys[at] == got, self.key_word[at], 0).astype(np.int32)
        has = np.flatnonzero(number)
        same = ends[has] - starts[has] == self.length[number[has]]
        number[has[~same]] = 0
        has = has[same]
        n = self.length[number[has]]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = data[np.repeat(starts[has], n) + step] == self.bytes[np.repeat(self.at_word[number[has]], n) + step]
        if not equal.all():
            number[np.unique(np.repeat(has, n)[~equal])] = 0
        return number

    def runs(self, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For every word, how many from it on are benchmark words, each pair of them a pair there."""
        follow = np.zeros(len(number), bool)
        if len(number) > 1:
            a = np.flatnonzero((number[:-1] > 0) & (number[1:] > 0))
            if len(self.pairs):
                key = number[a].astype(np.int64) * len(self.words) + number[a + 1]
                follow[a] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
        ends = first[1:] - 1
        follow[ends[(ends >= 0) & (np.diff(first) > 0)]] = False
        stop = np.where(follow, len(number), np.arange(len(number)))
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        return np.where(number > 0, stop - np.arange(len(number)) + 1, 0)


def _merge(intervals: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"start": s, "end": e} for s, e in out]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one after another."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)


def _shard(index: Index, data, offsets) -> list[dict]:
    """What each document of a shard has in common with the items."""
    starts, ends, first = words.spans(data, offsets, words.ALNUM_WORDS)
    result = [{"n_words": int(n), "spans": [], "items": [], "longest": 0, "longest_at": None,
               "longest_item": None, "longest_item_at": None} for n in np.diff(first)]
    number = index.number(data, starts, ends)
    run = index.runs(number, first)
    inside = np.flatnonzero(run)
    begins = np.ones(len(inside), bool)
    begins[1:] = run[inside[:-1]] == 1
    inside = inside[run[inside[begins]][np.cumsum(begins) - 1] >= index.least]
    number, run = number[inside], run[inside]
    own = Suffixes(number, run, np.flatnonzero(run >= index.least), index.longest)
    if not len(own.order):
        return result
    found, lo, hi = own.find(index.sequence, np.minimum(index.left, index.window), index.at)
    hit = np.flatnonzero(found == index.need)
    which, one = np.unique(index.which[hit], return_index=True)
    if not len(which):
        return result
    hit = hit[one]                                # one suffix for each window that occurs
    n = hi[hit] - lo[hit]
    local = own.order[_ranges(lo[hit], hi[hit])]
    window, k, suffix = np.repeat(which, n), np.repeat(index.need[hit], n), np.repeat(index.at[hit], n)
    place = inside[local]
    row = np.searchsorted(first, place, "right") - 1
    # words inside of an occurrence, as spans of their documents
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + k, -1)
    covered = np.concatenate(([False], np.cumsum(step)[:-1] > 0, [False]))
    edge = np.zeros(len(starts) + 1, bool)
    edge[first] = True
    opens = np.flatnonzero(covered[1:] & (edge | ~covered[:-1]))
    closes = np.flatnonzero(covered[:-1] & (edge | ~covered[1:]))
    of = np.searchsorted(first, opens, "right") - 1
    for r, s, e in zip(of.tolist(), (opens - first[of]).tolist(), (closes - first[of]).tolist(), strict=True):
        result[r]["spans"].append({"start": s, "end": e})
    # items: the union of the lists of a document's windows
    lists = np.unique(row * len(index.lists) + index.list_of[window])
    rows, at = np.unique(lists // len(index.lists), return_index=True)
    for r, a, b in zip(rows.tolist(), at.tolist(), [*at[1:].tolist(), len(lists)], strict=True):
        has = np.zeros(len(index.ids), bool)
        for i in (lists[a:b] % len(index.lists)).tolist():
            has[index.lists[i]] = True
        result[r]["items"] = [index.ids[i] for i in np.flatnonzero(has).tolist()]
    # the longest match of each place; a short item's only window is all of it
    distinct, back = np.unique(local, return_inverse=True)
    found, lo, hi = index.suffixes.find(number, run, distinct)
    longer = found[back] >= index.window
    length = np.where(longer, found[back], k)
    order = np.lexsort((place, -length, row))
    best = order[np.unique(row[order], return_index=True)[1]]
    for i in best.tolist():
        p = suffix[i]
        if longer[i]:
            same = index.suffixes.order[lo[back[i]]:hi[back[i]]]
            p = same[index.told[same].argmin()]
        item = index.first_id[index.text[p]]
        result[row[i]] |= {"longest": int(length[i]), "longest_at": int(place[i] - first[row[i]]),
                           "longest_item": index.ids[item] if item < len(index.ids) else None, "longest_item_at": int(index.place[p])}
    return result


def _both(a: dict, b: dict) -> dict:
    """What a document has in common with the items of two blocks."""
    def told(o):
        id = o["longest_item"]
        return -o["longest"], o["longest_at"] or 0, id is None, [] if id is None else [id], o["longest_item_at"] or 0

    return min(a, b, key=told) | {
        "n_words": a["n_words"], "items": sorted({*a["items"], *b["items"]}),
        "spans": _merge([(x["start"], x["end"]) for x in a["spans"] + b["spans"]])}


def item_blocks(items: DataFrame, block_bytes: int):
    """The items as lists of at most ``block_bytes`` of text (or one item), fetched one at a time."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total = items.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    if total <= block_bytes:
        yield [tuple(r) for r in items.collect()]
        return

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        block, full = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out = []
            for n in batch.column("size").to_pylist():
                if full and full + n > block_bytes:
                    block, full = block + 1, 0
                full += n
                out.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "block"])

    sized = items.select("id", "text", size.alias("size"))
    kept = cut(sized.mapInArrow(number, T.StructType([*sized.schema.fields, T.StructField("block", T.LongType())])))
    for (block,) in kept.select("block").distinct().sort("block").collect():
        yield [tuple(r) for r in kept.where(F.col("block") == block).select("id", "text").collect()]


def overlaps(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
             item_text: str = "text", block_bytes: int = 8 << 20, to: str = "overlap") -> DataFrame:
    """``docs`` with a struct ``to`` of the FOUND fields (in place of a column of that name).

    spans: the words inside any occurrence of a window, as disjoint [start, end) word
    numbers; items: ids with an occurring window; longest...: the longest verbatim match of a
    window's words or more, where it stands, and in which item (earliest place, least id).
    Ids keep their type, whole numbers as long.
    """
    docs = docs.drop(to) if to in docs.columns else docs
    found, more, key = unused(docs, "found_overlap", "more_overlaps", "overlap_row")
    whole = isinstance(items.schema[item_id].dataType, T.IntegralType)
    frame = items.select((items[item_id].cast("bigint") if whole else items[item_id]).alias("id"),
                         items[item_text].alias("text"))
    kind = T._parse_datatype_string(FOUND.format(id=frame.schema["id"].dataType.simpleString()))
    blocks = item_blocks(frame, block_bytes)
    block, further = next(blocks, []), next(blocks, None)
    if further is None:
        return _pass(docs, found, kind, text, block, window).withColumnRenamed(found, to)
    columns, docs = docs.columns, with_row_key(docs, key)
    out = _pass(docs, found, kind, text, block, window)
    parts = []
    while further is not None:
        part = _pass(docs.select(key, text), found, kind, text, further, window)
        parts.append(cut(part.where(F.col(f"{found}.longest") > 0).select(key, found)))
        further = next(blocks, None)
    rest = reduce(DataFrame.union, parts).groupBy(key).agg(F.collect_list(found).alias(more))
    return _joined(out.join(rest, key, "left"), found, more).select(*columns, F.col(found).alias(to))


def _pass(docs: DataFrame, found: str, kind: T.StructType, text: str, block: list, window: int) -> DataFrame:
    """``docs`` with what they have in common with one block of items."""
    columns = docs.columns

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        index = Index(block, window)
        for batch in batches:
            data, offsets = words.column_bytes(batch.column(text))
            new = []
            for at, to in words.blocks(offsets, SHARD_BYTES):
                lo = offsets[at]
                new += _shard(index, data[lo:offsets[to]], offsets[at:to + 1] - lo)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(new, to_arrow_type(kind))],
                                             names=[*columns, found])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(found, kind)]))


def _joined(docs: DataFrame, found: str, more: str) -> DataFrame:
    """Column ``found`` with the matches of further blocks, at most one a block."""
    kind = docs.schema[found].dataType

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        for batch in batches:
            new = [reduce(_both, rest or [], one) for one, rest in
                   zip(batch.column(found).to_pylist(), batch.column(more).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, to_arrow_type(kind)) if c == found else batch.column(c) for c in batch.schema.names],
                names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def clean(docs: DataFrame, items: DataFrame, window: int = 10, max_hit: float = 0.0, **names) -> DataFrame:
    """The documents of which at most ``max_hit`` of the words lie in an occurring window."""
    (to,) = unused(docs, "overlap")
    marked = overlaps(docs, items, window, to=to, **names)
    hit = F.aggregate(f"{to}.spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return marked.where(hit <= F.lit(max_hit) * F.col(f"{to}.n_words")).select(*docs.columns)
