"""Spelling variants grouped by single edits, from dense prefix-suffix tiles.

Words are maximal runs of Latin letters, which all have one byte in Latin-1, so a set of words
of near equal length is a padded matrix of code points, once from the left and once from the
right.  Two different words differ by one inserted, deleted or replaced code point just when
their common prefix and their common suffix together reach the longer length minus one; a tile
compares every word of one block with every word of another that way.

One of the two then has at least half of the longer length.  So blocks are made of words that share
the longer length and the first (or last) half, and no pair outside of such a group is near.
Groups of a few words are packed into common tasks; a group of more than ``block`` words is cut
in blocks, and every pair of blocks is a tile of its own, so a beginning that a third of all
words share is many tasks.  A tile returns one line a word: its near words counted, and the best
of them.  Nothing is broadcast or collected.

Null and empty texts have no words.  Rows that repeat count as often as they stand there.  A
null id is written as the empty string before the colon.  An empty table has an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm import words
from exposa.llm.tables import cut

BLOCK = 2048
CELL_ROWS = 1 << 15
_TILE_BYTES = 8 << 20
_LONG = 48                       # longer runs get their checksum one by one


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_CRC = _crc_table()
# A-Z are lower-cased before; U+00C0 to U+00FF are the byte C3 and a second one.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), 0xC3]] = True


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of every run's bytes after a text whose CRC-32 is ``before``; a step a byte for all runs."""
    state = before ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    ranked = size[order]
    out = np.empty(len(starts), np.uint32)
    far = int(np.searchsorted(-ranked, -_LONG, "left"))          # runs longer than _LONG come first
    for k in order[:far].tolist():
        out[k] = zlib.crc32(data[starts[k]:ends[k]].tobytes(), int(before[k]))
    order, ranked = order[far:], ranked[far:]
    now, at = state[order], starts[order]
    for step in range(int(ranked[0]) if len(ranked) else 0):
        n = int(np.searchsorted(-ranked, -step, "left"))         # runs with a byte at this step
        now[:n] = _CRC[(now[:n] ^ data[at[:n] + step]) & np.uint32(0xFF)] ^ (now[:n] >> np.uint32(8))
    out[order] = now ^ np.uint32(0xFFFFFFFF)
    return out


def _shortened(run: bytes, h: int) -> bytes:
    text = run.decode("utf-8")
    k = h % len(text)
    return (text[:k] + text[k + 1:]).encode("utf-8")


def block_counts(data: np.ndarray, offsets: np.ndarray, ids: list[str], least: int, every: int):
    """Distinct words of a block of texts (Arrow binary) and how often each occurs."""
    import pyarrow as pa
    second = np.zeros(len(data), bool)
    lead = data == 0xC3
    second[1:] = lead[:-1]
    starts, ends, first = words.runs(_LETTER[data] | second, offsets)
    marks = np.concatenate(([0], np.cumsum(second)))
    points = (ends - starts) - (marks[ends] - marks[starts])
    doc = np.repeat(np.arange(len(ids)), np.diff(first))
    keep = points >= least
    starts, ends, points, doc = starts[keep], ends[keep], points[keep], doc[keep]
    prefix = np.fromiter((zlib.crc32(f"{i}:".encode()) for i in ids), np.uint32, len(ids))
    h = checksums(data, starts, ends, prefix[doc])
    cut_one = h % np.uint32(every) == 0 if every else np.zeros(len(h), bool)
    short: dict[bytes, int] = {}
    for k in np.flatnonzero(cut_one & (points > least)).tolist():
        w = _shortened(data[starts[k]:ends[k]].tobytes(), int(h[k]))
        short[w] = short.get(w, 0) + 1
    starts, ends = starts[~cut_one], ends[~cut_one]
    _, at, n = np.unique(words.hashes(data, starts, ends), return_index=True, return_counts=True)
    starts, size = starts[at], (ends - starts)[at]
    to = np.concatenate(([0], np.cumsum(size)))
    take = np.arange(to[-1]) + np.repeat(starts - to[:-1], size)
    whole = pa.Array.from_buffers(pa.large_string(), len(at), [
        None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[take]))])
    extra = pa.array([w.decode("utf-8") for w in short], pa.large_string())
    return (pa.concat_arrays([whole, extra]).cast(pa.string()),
            pa.array(np.concatenate((n, np.fromiter(short.values(), np.int64, len(short)))).astype(np.int64)))


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 6, often: int = 5,
               every: int = 199) -> DataFrame:
    """(word, n): words of ``least`` code points and ``often`` occurrences, or more, in all texts.

    A run whose checksum with its document's id is a multiple of ``every`` loses one code point
    (the noise that the variants come from); 0 leaves every run as it is.
    """
    if least < 1 or every < 0:
        raise ValueError("least must be 1 or more and every not negative")
    rows = docs.select(F.coalesce(docs[id].cast("string"), F.lit("")).alias("id"), docs[text].alias("text"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            data, offsets = words.column_bytes(batch.column("text"))
            ids = batch.column("id").to_pylist()
            for at, to in words.blocks(offsets, 8 << 20):
                a, b = offsets[at], offsets[to]
                word, n = block_counts(data[a:b], offsets[at:to + 1] - a, ids[at:to], least, every)
                if len(word):
                    yield pa.RecordBatch.from_arrays([word, n], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= often)


def matrices(text: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of code points, padded to ``width``: from their first on, and from their last back."""
    left = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in text), np.uint8).reshape(-1, width)
    right = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in text), np.uint8).reshape(-1, width)
    return left, right


def tile(one: tuple, other: tuple, longer: int, half: int, from_end: bool) -> np.ndarray:
    """Which words of two blocks differ by a single edit (a bool matrix).

    ``from_end``: leave out pairs that share ``half`` beginning code points too, as the group
    of that beginning holds them.
    """
    (left, right), (left2, right2) = one, other
    out = np.empty((len(left), len(left2)), bool)
    step = max(1, _TILE_BYTES // max(1, len(left2) * left.shape[1]))
    for a in range(0, len(left), step):
        prefix = (left[a:a + step, None, :] == left2[None, :, :]).argmin(2)
        suffix = (right[a:a + step, None, :] == right2[None, :, :]).argmin(2)
        near = prefix + suffix >= longer - 1
        out[a:a + step] = near & (prefix < half) if from_end else near
    return out


def _near_in_group(text: list[bytes], n: np.ndarray, part: np.ndarray, longer: int, from_end: bool,
                   across: bool):
    """(row, near words, row of the best) of a group's rows; rows come in order of n (greatest first), word."""
    blocks = [np.flatnonzero(part == p) for p in np.unique(part)]
    if across and len(blocks) < 2:
        return
    made = [matrices([text[k] for k in b], longer) for b in blocks]
    one, other = (0, 1) if across else (0, 0)
    near = tile(made[one], made[other], longer, longer // 2, from_end)
    if not across:
        np.fill_diagonal(near, False)
    for rows, partners, m in [(blocks[one], blocks[other], near)] + (
            [(blocks[other], blocks[one], near.T)] if across else []):
        count = m.sum(1)
        has = np.flatnonzero(count)
        yield rows[has], count[has], partners[m[has].argmax(1)]


def near_words(known: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form_n, form) of every word with near words: how many, and the most frequent.

    known: distinct words of Latin-1 code points with their counts (word, n).  Of equal counts
    the word that comes first in code-point order counts.
    """
    keys = []
    for longer in (F.char_length("word"), F.char_length("word") + 1):
        half = F.floor(longer / 2).cast("int")
        keys += [F.struct(longer.alias("longer"), F.lit(from_end).alias("from_end"), side.alias("key"))
                 for from_end, side in ((False, F.left("word", half)), (True, F.right("word", half)))]
    rows = cut(known.select("word", "n", F.explode(F.array(*keys)).alias("g")).select("word", "n", "g.*"))
    group = ["longer", "from_end", "key"]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    cells = max(1, -(-total // CELL_ROWS))
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    dealt = rows.join(sizes, group).withColumn("parts", parts) \
        .withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("word"), F.col("parts"))).otherwise(0).cast("int")) \
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .withColumn("one", F.least("part", "q")).withColumn("other", F.greatest("part", "q")) \
        .withColumn("cell", F.when(F.col("parts") > 1, F.xxhash64(*group))
                    .otherwise(F.pmod(F.xxhash64(*group), F.lit(cells))))

    def run(table):
        import pyarrow as pa
        table = table.sort_by([("longer", "ascending"), ("from_end", "ascending"), ("key", "ascending"),
                               ("n", "descending"), ("word", "ascending")])
        own = table.column("word").to_pylist()
        text = [w.encode("latin-1") for w in own]
        n, part = (table.column(c).to_numpy() for c in ("n", "part"))
        across = table.column("one")[0].as_py() != table.column("other")[0].as_py()
        key = list(zip(*(table.column(c).to_pylist() for c in group), strict=True))
        starts = [k for k in range(len(key)) if k == 0 or key[k] != key[k - 1]] + [len(key)]
        row, count, best = [], [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a < 2:
                continue
            for r, c, f in _near_in_group(text[a:b], n[a:b], part[a:b], key[a][0], key[a][1], across):
                row.append(r + a)
                count.append(c)
                best.append(f + a)
        row, best = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, best))
        return pa.table({"word": pa.array(own, pa.string()).take(pa.array(row)),
                         "n_near": pa.array(np.concatenate(count) if count else row, pa.int64()),
                         "form_n": pa.array(n[best]),
                         "form": pa.array(own, pa.string()).take(pa.array(best))})

    found = dealt.groupBy("cell", "one", "other").applyInArrow(
        run, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")) \
        .select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.form").alias("form"))


def group(known: DataFrame, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``known`` (word, n).

    form: the most frequent near word, if it is ``ratio`` times as frequent as the word or more;
    root: the last word on the way from form to form.  Counts grow by ``ratio`` on that way, so
    pointers that double end after a few rounds.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    known = cut(known.select("word", "n"))
    got = cut(known.join(near_words(known, block), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("form_n") >= F.lit(ratio) * F.col("n"), F.col("form")).alias("form"),
        F.when(F.col("form_n") >= F.lit(ratio) * F.col("n"), F.col("form_n")).alias("form_n")))
    way = cut(got.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        after = way.select(F.col("word").alias("via"), F.col("root").alias("next"))
        way = cut(way.join(after, way["root"] == after["via"], "left")
                  .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if way.where("moved").isEmpty():
            break
        way = way.select("word", "root")
    return got.join(way.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
