"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes.  Two fingerprints that differ in at most ``bits``
bits differ in at most ``bits`` bytes, so they share at least ``8 - bits`` positional bytes.
A posting list of one positional byte would hold 1/256 of all fingerprints; the lists here are
those of every set of ``7 - bits`` positions, one fewer than the pair is sure to share, so the pair
stands together in at least ``8 - bits`` lists: the guaranteed minimum of matches.  The lists
that each pair shares are tallied, pairs that reach the minimum are kept (others share no more than
one list), and their bit distance is verified.

Copies count once (lists hold distinct fingerprints).  Only short lists give out their pairs.  A
list of more than ``SHORT_LIST`` members, which a group of near copies makes, is searched for
each member's neighbours instead; what is close in it is verified there, and it gives links to a
neighbour of its part of the list only, so what a list gives out grows with its length, not its
square.  A pair within ``bits`` bits thus stands in a long list, or reaches the minimum in short ones.

Null and empty texts and texts without a word have fingerprint zero and are linked like any
other.  Repeated rows are documents of their own.  Extra columns pass through.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exposa.llm import words
from exposa.llm.components import components
from exposa.llm.tables import cut, shuffle_partitions, unused, with_row_key

BLOCK_BYTES = 4 << 20
SHORT_LIST = 32
_LANE = np.uint64(0x0001000100010001)


def fingerprint_column(column, shingle: int) -> np.ndarray:
    """Fingerprints of an Arrow string column, as unsigned 64-bit numbers."""
    data, offsets = words.column_bytes(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for at, to in words.blocks(offsets, BLOCK_BYTES):
        lo = offsets[at]
        out[at:to] = _block(data[lo:offsets[to]], offsets[at:to + 1] - lo, shingle)
    return out


def _block(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    import xxhash

    # words joined by one space: drop every separator but the first after a word
    word = words.SPACE_WORDS[data]
    keep = word.copy()
    keep[1:] |= word[:-1]
    moved = np.concatenate(([0], np.cumsum(keep)))[offsets]
    data = np.where(word, data, np.uint8(0x20))[keep]
    starts, ends, first = words.spans(data, moved, words.SPACE_WORDS)
    n_words = np.diff(first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(np.int64))
    rows = np.flatnonzero(n)
    result = np.zeros(len(offsets) - 1, np.uint64)
    if not len(rows):
        return result
    count = n[rows]
    begin = np.concatenate(([0], np.cumsum(count)))
    word_at = np.repeat(first[rows] - begin[:-1], count) + np.arange(begin[-1])
    last = word_at + np.repeat(np.minimum(n_words[rows], shingle) - 1, count)
    raw = data.tobytes()
    texts = map(raw.__getitem__, map(slice, starts[word_at].tolist(), ends[last].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, texts, repeat(42)), np.uint64, int(begin[-1]))
    # bit counts in 16-bit lanes, over pieces that cannot overflow one
    per = -(-count // 65535)
    piece_row = np.repeat(np.arange(len(rows)), per)
    first_piece = np.cumsum(per) - per
    piece_at = begin[:-1][piece_row] + (np.arange(len(piece_row)) - first_piece[piece_row]) * 65535
    ones = np.zeros((len(piece_row), 64), np.int64)
    for j in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & _LANE, piece_at)
        for k in range(4):
            ones[:, j + 16 * k] = (lanes >> np.uint64(16 * k)) & np.uint64(0xFFFF)
    ones = np.add.reduceat(ones, first_piece, axis=0)
    bits = (2 * ones > count[:, None]).astype(np.uint8)
    result[rows] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return result


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3,
                 to: str = "simhash") -> DataFrame:
    """``docs`` without ``text`` but with its fingerprint as a (signed) long."""
    keep = [c for c in docs.columns if c not in (text, to)]
    value, made = unused(docs, "_value", "_print")
    frame = docs.select(*[docs[c] for c in keep], docs[text].alias(value))
    schema = frame.drop(value).schema.add(made, T.LongType())

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            got = fingerprint_column(batch.column(value), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(got)], names=[*keep, made])

    return frame.mapInArrow(run, schema).withColumnRenamed(made, to)


def position_sets(bits: int) -> list[int]:
    """Masks (signed) of every choice of 7 - bits of the eight byte positions."""
    masks = (sum(0xFF << 8 * p for p in s) for s in combinations(range(8), 7 - bits))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _flips(free: int, bits: int) -> np.ndarray:
    """Differences of 1 to ``bits`` bits within the bytes that a list leaves free."""
    at = [b for b in range(64) if free >> b & 1]
    return np.array([sum(1 << b for b in s) for k in range(1, bits + 1) for s in combinations(at, k)], np.uint64)


def list_pairs(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a short list; ``members`` are distinct and sorted."""
    a, b = np.triu_indices(len(members), 1)
    return members[b], members[a]


def list_links(members: np.ndarray, bits: int, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the close pairs of a long list join; ``members`` are distinct and sorted."""
    label, place = np.arange(len(members)), []
    for flip in _flips(free, bits):
        at = np.minimum(np.searchsorted(members, members ^ flip), len(members) - 1)
        has = np.flatnonzero(members[at] == members ^ flip)
        if len(has):
            place.append((has, at[has]))
    while True:
        before = label.copy()
        for a, b in place:
            label[a] = np.minimum(label[a], label[b])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(members)))
    return members[moved], members[label[moved]]


def tally(prints: DataFrame, column: str = "simhash", bits: int = 2) -> DataFrame:
    """(a, b, lists, near): pairs of fingerprints that short lists hold, with the number of those, and
    links that long lists have verified (near), which count as the minimum."""
    if not 0 <= bits <= 3:
        raise ValueError("bits must be 0 to 3: lists of fewer positions are not bounded well")
    masks = position_sets(bits)
    lists = prints.where(F.col(column).isNotNull()).select(
        F.col(column).alias("member"),
        F.posexplode(F.array(*[F.col(column).bitwiseAND(F.lit(m)) for m in masks])).alias("positions", "shared"))
    lists = lists.repartition(shuffle_partitions(prints.sparkSession), "positions", "shared") \
        .sortWithinPartitions("positions", "shared", "member")

    def run(batches):
        import pyarrow as pa
        tail = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("positions", "shared", "member")]
            if tail is not None:
                now = [np.concatenate(x) for x in zip(tail, now, strict=True)]
            p, s, _ = now
            starts = np.concatenate(([0], np.flatnonzero((p[1:] != p[:-1]) | (s[1:] != s[:-1])) + 1))
            tail = [x[starts[-1]:] for x in now]         # its list may go on in the next batch
            yield from out(pa, [x[:starts[-1]] for x in now], starts)
        if tail is not None and len(tail[0]):
            yield from out(pa, tail, np.array([0, len(tail[0])]))

    def out(pa, now, starts):
        p, _, m = now
        size = np.diff(starts)
        for near, some in ((False, (size > 1) & (size <= SHORT_LIST)), (True, size > SHORT_LIST)):
            found = [list_links(own, bits, ~masks[p[a]] & (1 << 64) - 1) if near else list_pairs(own)
                     for a, n in zip(starts[:-1][some].tolist(), size[some].tolist(), strict=True)
                     for own in (np.sort(m[a:a + n].view(np.uint64)),)]
            if found:
                a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(np.full(len(a), 8 - bits if near else 1, np.int64)),
                     pa.array(np.full(len(a), near))], names=["a", "b", "lists", "near"])

    pairs = lists.select("positions", "shared", "member").mapInArrow(run, "a bigint, b bigint, lists bigint, near boolean")
    return pairs.groupBy("a", "b").agg(F.sum("lists").alias("lists"), F.bool_or("near").alias("near"))


def links(prints: DataFrame, column: str = "simhash", bits: int = 2) -> DataFrame:
    """(a, b) links that connect exactly the fingerprints that chains of close pairs connect.

    ``prints`` holds distinct fingerprints.  Every link is a pair that differs in ``bits`` bits or
    fewer, or a chain of such pairs.
    """
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    return tally(prints, column, bits).where((F.col("lists") >= 8 - bits) & (F.col("near") | close)).select("a", "b")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3,
                    bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of every row: component_id is the least id reachable.

    Fingerprints link at ``bits`` differing bits or fewer.  A component whose ids are all
    null has a null component_id.  An empty table gives an empty result.
    """
    printed = cut(fingerprints(docs.select(docs[id].alias("id"), docs[text].alias("text")), shingle=shingle))
    distinct = cut(printed.groupBy("simhash").agg(F.min("id").alias("least")))
    joined = components(links(distinct.select("simhash"), bits=bits))
    of_node = joined.join(distinct, joined["node"] == distinct["simhash"])
    of_root = of_node.groupBy("root").agg(F.min("least").alias("least_of_all"))
    linked = of_node.join(of_root, "root").select("simhash", "least_of_all")
    hexed = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    classes = distinct.join(linked, "simhash", "left").select(
        hexed.alias("fingerprint"), F.coalesce("least_of_all", "least").alias("component_id"))
    return printed.select(F.col("id").alias(id), hexed.alias("fingerprint")).join(classes, "fingerprint") \
        .select(id, "fingerprint", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row of every component: that with the least id (ties: the first file and place)."""
    key, who = unused(docs, "row_key", "who")
    keyed = with_row_key(docs, key)
    named = keyed.select(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col(key).alias("row"))
                         .alias(who), F.col(text).alias("text"))
    kept = near_duplicates(named, who, "text", shingle, bits).where(F.col(who) == F.col("component_id"))
    return keyed.join(kept.select(F.col(f"{who}.row").alias(key)), key, "left_semi").select(*docs.columns)
