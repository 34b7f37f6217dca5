"""Language-model scoring with a weighted backoff automaton.

States are the contexts that n-grams of the training rows begin with; an n-gram is an arc
with its smoothed probability, and every state has a failure arc to the next shorter context.
The smoothing is a Dirichlet prior: with c the training counts, w a token, h a context and h'
the context without its first token,

    P(w | h) = (c(h w) + strength * P(w | h')) / (c(h) + strength)

so an arc weighs the log10 of that, and the failure arc log10(strength / (c(h) + strength)),
which is what an n-gram without an arc pays before it is looked up in the shorter context.
Unigrams get (c + 0.1) / (N + 0.1 (V + 1)).  Probabilities over the known words and one
unknown word add up to 1 in every state.

No task and no broadcast ever holds the whole automaton, which grows with the corpus.
Documents are packed in blocks.  Each block sends the distinct n-grams of its texts, with
their counts in its training rows, to slices of the n-gram hash range; a slice adds the
counts up and answers each block in the order it was asked, so an answer is only counts.  An n-gram that
fills a third of the corpus is one entry a block.

From the answers a block builds the part of the automaton that its texts can reach: the states
of its trained contexts, their arcs, failure arcs and the state that each leads to.  Its texts are
then read from left to right, all at the same time: every text carries its state from token to token, takes
failure arcs until the state has an arc for the token, and adds up the weights on the way.  Long
texts are read in lanes of ``LANE`` tokens; a lane that begins inside a text first reads as many tokens before
it as the longest context has, which leads to the same state.

n-grams are known by hashes with ``SPARE`` bits more than the count of the text's bytes has (64 at
most), so the chance that one n-gram is taken for another is less than one in 2 ** SPARE at
every size of the corpus.

Null and empty texts have the one token ``end``.  Rows that repeat count as often as they
stand there and are scored alike.  Rows whose id is null are training rows.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm import words
from exposa.llm.tables import cut, read_from_files, shuffle_partitions

BLOCK_BYTES = 8 << 20
SLICE_KEYS = 4 << 20
SPARE = 22
LANE = 256
END, START = np.uint64(0x5EED0E4D), np.uint64(0x5EED57A7)
_STEP = np.uint64(0x9DDFEA08EB382D69)


def held_out(id, parts: int = 10):
    """Whether crc32 of the id as text is a multiple of ``parts`` (a null id: false)."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def _packed(batches):
    """Rows (id, held, text) of Arrow batches packed in blocks: ids, held flags, compressed text, offsets."""
    import pyarrow as pa
    from pyspark import TaskContext
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = words.column_bytes(batch.column("text"))
        for at, to in words.blocks(offsets, BLOCK_BYTES):
            own = batch.slice(at, to - at)
            text = data[offsets[at]:offsets[to]].tobytes()
            yield {"block": (part << 32) + k, "ids": own.column("id").to_pylist(),
                   "held": own.column("held").to_pylist(), "size": len(text),
                   "offsets": (offsets[at:to + 1] - offsets[at]).tolist(),
                   "packed": pa.compress(text, "zstd", asbytes=True)}
            k += 1


def _blocks(rows: DataFrame) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            id_type = batch.schema.field("id").type
            break
        else:
            return
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())),
                            ("size", pa.int64()), ("offsets", pa.list_(pa.int64())), ("packed", pa.binary())])
        for row in _packed(itertools.chain([batch], batches)):
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return rows.mapInArrow(run, f"block bigint, ids array<{kind}>, held array<boolean>, size bigint, "
                                "offsets array<bigint>, packed binary")


class Block:
    """Tokens of a block's documents, and its distinct n-grams of every order (keys of ``bits`` bits)."""

    def __init__(self, offsets, packed: bytes, size: int, order: int, bits: int = 64):
        import pyarrow as pa
        text = pa.decompress(packed, size, "zstd", asbytes=True) if size else b""
        data, offsets = np.frombuffer(text, np.uint8), np.asarray(offsets, np.int64)
        starts, ends, first = words.spans(data, offsets, words.SPACE_WORDS)
        n = np.diff(first) + 1
        self.first = np.cumsum(n) - n                 # first token of each document
        self.n = n
        token = np.empty(int(n.sum()), np.uint64)
        is_end = np.zeros(len(token), bool)
        is_end[self.first + n - 1] = True
        token[is_end] = END
        token[~is_end] = words.hashes(data, starts, ends)
        self.token, self.bits, self.order = token, bits, order
        self.place = np.arange(len(token)) - np.repeat(self.first, n)
        self.keys, self.of, self.at = [], [], []      # see ``grams``, by order

    def grams(self):
        """Of every order: sorted distinct keys, the key of each token's n-gram, a place of each key."""
        gram, past = self.token, self.token
        for k in range(1, self.order + 1):
            if k > 1:
                past = np.concatenate(([START], past[:-1]))
                past[self.place < k - 1] = START
                gram = words.mix(gram * _STEP + past + np.uint64(k))
            keys, at, of = np.unique(gram >> np.uint64(64 - self.bits), return_index=True, return_inverse=True)
            yield keys, of.astype(np.int32), at.astype(np.int32)

    def hold(self) -> Block:
        """The block with the n-grams of all orders at once."""
        self.keys, self.of, self.at = (list(x) for x in zip(*self.grams(), strict=True))
        return self


def _cuts(keys: np.ndarray, slices: int, bits: int) -> np.ndarray:
    """Where each slice of the hash range begins among sorted keys (slices + 1)."""
    bounds = (np.arange(1, slices, dtype=object) * (1 << bits) // slices).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)])).astype(np.int64)


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte of all (leading bytes are mostly zero), compressed."""
    import pyarrow as pa
    planes = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _expand(packed: bytes, n: int) -> np.ndarray:
    import pyarrow as pa
    planes = np.frombuffer(pa.decompress(packed, 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def _ask(rows: DataFrame, order: int, slices: int, bits: int) -> DataFrame:
    """(slice, n, block, size, keys, counts): what blocks hold of every slice; keys as their steps.

    rows: blocks, or the rows that they are packed from."""
    packed = "packed" in rows.columns

    def run(batches):
        import pyarrow as pa
        for row in (r for b in batches for r in b.to_pylist()) if packed else _packed(batches):
            block = Block(row["offsets"], row["packed"], row["size"], order, bits)
            train = np.repeat(~np.asarray(row["held"], bool), block.n)
            for n, (keys, of, _) in enumerate(block.grams(), 1):
                count = np.bincount(of[train], minlength=len(keys))
                cuts = _cuts(keys, slices, bits)
                has = np.flatnonzero(np.diff(cuts)).tolist()
                steps = [np.diff(keys[cuts[s]:cuts[s + 1]], prepend=np.uint64(0)) for s in has]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(has, pa.int32()), pa.array([n] * len(has), pa.int32()),
                     pa.array([row["block"]] * len(has), pa.int64()), pa.array([len(x) for x in steps], pa.int64()),
                     pa.array([_squeeze(x) for x in steps], pa.binary()),
                     pa.array([_squeeze(count[cuts[s]:cuts[s + 1]]) for s in has], pa.binary())],
                    names=["slice", "n", "block", "size", "keys", "counts"])

    return rows.mapInArrow(run, "slice int, n int, block bigint, size bigint, keys binary, counts binary")


def _answer(asked: DataFrame) -> DataFrame:
    """(block, slice, n, size, totals, distinct, trained): counts of all blocks, in the asker's order.

    The first answer of a slice and order carries the slice's distinct trained n-grams."""
    def run(table):
        import pyarrow as pa
        size = table.column("size").to_pylist()
        keys = [np.cumsum(_expand(k, n), dtype=np.uint64) for k, n in zip(table.column("keys").to_pylist(), size, strict=True)]
        count = [_expand(c, n) for c, n in zip(table.column("counts").to_pylist(), size, strict=True)]
        _, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate(count)).astype(np.int64)
        cuts = np.concatenate(([0], np.cumsum(size)))
        n = len(keys)
        return pa.table({
            "block": table.column("block"), "slice": table.column("slice"), "n": table.column("n"),
            "size": table.column("size"),
            "totals": pa.array([_squeeze(total[of[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            "distinct": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64()),
            "trained": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64())})

    return asked.groupBy("slice", "n").applyInArrow(
        run, "block bigint, slice int, n int, size bigint, totals binary, distinct bigint, trained bigint")


class Automaton:
    """The states that a block's texts can reach, with their arcs and failure arcs.

    counts: for each order the training counts of the block's distinct n-grams; base: probability of
    each distinct token without a context.  State 0 is the empty context; n-gram j of order k is
    state ``base_of[k] + j``, the k-fold start of a text the last of its order.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], base: np.ndarray, strength: float):
        order, tokens = len(counts), len(block.keys[0])
        end = np.searchsorted(block.keys[0], block.keys[0][block.of[0][block.first[0] + block.n[0] - 1]])
        starts = counts[0][end]                        # training rows, each of which has one end
        sizes = [len(k) for k in block.keys]
        base_of = np.concatenate(([0, 1], 1 + np.cumsum([n + 1 for n in sizes[:order - 1]]))).astype(np.int64)
        n_states = int(base_of[order])
        self.tokens = tokens
        self.fail, self.fail_to = np.zeros(n_states), np.zeros(n_states, np.int64)
        longest = [np.zeros(tokens, np.int64)]         # by order: the state that a text is in after the n-gram
        self.start = 0
        for k in range(1, order):
            states = base_of[k] + np.arange(sizes[k - 1])
            suffix = np.zeros(sizes[0], np.int64) if k == 1 else block.of[k - 2][block.at[k - 1]]
            shorter = longest[k - 1][suffix] if k > 1 else suffix
            trained = counts[k - 1] > 0
            longest.append(np.where(trained, states, shorter))
            self.fail_to[states] = shorter
            self.fail[states] = np.log10(strength / (counts[k - 1] + strength))
            first = base_of[k] + sizes[k - 1]
            self.fail_to[first], self.fail[first] = self.start, np.log10(strength / (starts + strength))
            self.start = first if starts else 0
        self.root, self.root_to = np.log10(base), longest[1] if order > 1 else longest[0]
        keys, weight, to, shorter_p = [], [], [], base
        for k in range(2, order + 1):
            at = block.at[k - 1]
            token, before = block.of[0][at], block.of[k - 2][np.maximum(at - 1, 0)]
            opens = block.place[at] == 0               # the context is the start of a text
            context = np.where(opens, starts, counts[k - 2][before])
            suffix = block.of[k - 2][at]
            p = (counts[k - 1] + strength * shorter_p[suffix]) / (context + strength)
            arc = np.flatnonzero(counts[k - 1])
            state = base_of[k - 1] + np.where(opens, sizes[k - 2], before)
            keys.append(state[arc] * tokens + token[arc])
            weight.append(np.log10(p[arc]))
            to.append(longest[k][arc] if k < order else longest[k - 1][suffix[arc]])
            shorter_p = p
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        sort = np.argsort(key)
        self.key = np.append(key[sort], np.iinfo(np.int64).max)
        self.weight = np.append(np.concatenate(weight)[sort] if keys else [], 0.0)
        self.to = np.append(np.concatenate(to)[sort] if keys else [], 0).astype(np.int64)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 probability) of one token for each of many texts."""
        state, total, to = state.copy(), np.zeros(len(state)), np.empty(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            here, word = state[left], token[left]
            at_root = here == 0
            key = here * self.tokens + word
            at = np.searchsorted(self.key, key)
            arc = (self.key[at] == key) & ~at_root
            total[left] += np.where(arc, self.weight[at], np.where(at_root, self.root[word], self.fail[here]))
            to[left] = np.where(arc, self.to[at], self.root_to[word])
            state[left] = self.fail_to[here]
            left = left[~(arc | at_root)]
        return to, total


def traverse(block: Block, automaton: Automaton, warm: int) -> np.ndarray:
    """Score of each document: all texts are read at once, each from left to right with its state.

    warm: tokens that a lane inside a text reads before its own (the longest context)."""
    lanes = -(-block.n // LANE)
    doc = np.repeat(np.arange(len(block.n)), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    skip = np.minimum(nth * LANE, warm)                # read, but not counted
    begin = block.first[doc] + nth * LANE - skip
    size = np.minimum(block.n[doc] - nth * LANE, LANE) + skip
    order = np.argsort(-size, kind="stable")
    doc, begin, size, skip, nth = (x[order] for x in (doc, begin, size, skip, nth))
    state = np.where(skip == nth * LANE, automaton.start, 0)
    total = np.zeros(len(doc))
    for t in range(int(size[0])):
        n = int(np.searchsorted(-size, -t, "left"))    # lanes with a token at this step
        state[:n], gained = automaton.step(state[:n], block.of[0][begin[:n] + t])
        total[:n] += np.where(t >= skip[:n], gained, 0.0)
    return np.bincount(doc, total, len(block.n))


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = 2, strength: float = 20.0,
          parts: int = 10) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows that ``held_out(id, parts)`` leaves; tokens are runs of non-space
    characters in lower case (A-Z), then one end.
    """
    if order < 1 or strength <= 0:
        raise ValueError("order must be 1 or more and strength positive")
    spark = docs.sparkSession
    rows = docs.select(docs[id].alias("id"), held_out(docs[id], parts).alias("held"), docs[text].alias("text"))
    # blocks of files are the same whenever they are made again; of other rows they are kept
    again = read_from_files(docs)
    blocks = _blocks(rows) if again else cut(_blocks(rows))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s")).first()["s"]
    slices = max(shuffle_partitions(spark), -(-size * order // (4 * SLICE_KEYS)))
    bits = min(64, (size + 2).bit_length() + SPARE)
    answers = cut(_answer(_ask(rows if again else blocks, order, slices, bits)))
    total = answers.where("n = 1").agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"),
                                       F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    n_train, n_words = total["n"], total["v"]

    def run(left, right):
        import pyarrow as pa
        (row,) = left.to_pylist()
        block = Block(row["offsets"], row["packed"], row["size"], order, bits).hold()
        got = sorted(right.to_pylist(), key=lambda r: (r["n"], r["slice"]))
        counts = [np.concatenate([_expand(r["totals"], r["size"]) for r in got if r["n"] == n]).astype(np.int64)
                  for n in range(1, order + 1)]
        p = (counts[0] + 0.1) / (n_train + 0.1 * (n_words + 1))
        known = np.add.reduceat((counts[0] > 0)[block.of[0]].astype(np.int64), block.first)
        base = np.add.reduceat(np.log10(p)[block.of[0]], block.first)
        own = traverse(block, Automaton(block, counts, p, strength), order - 1)
        return pa.table({"id": left.column("ids").combine_chunks().flatten(), "held_out": pa.array(row["held"]),
                         "n_tokens": pa.array(block.n), "n_known": pa.array(known),
                         "train_tokens": pa.array(np.full(len(block.n), n_train)),
                         "base_score": pa.array(base), "score": pa.array(own)})

    kind = rows.schema["id"].dataType.simpleString()
    return blocks.groupBy("block").cogroup(answers.select("block", "slice", "n", "size", "totals").groupBy("block")) \
        .applyInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                           "base_score double, score double").withColumnRenamed("id", id)
