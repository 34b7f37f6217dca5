"""Byte-level BPE: encoding by a pair-occurrence index, and decoding.

The distinct pre-tokens of a partition (in runs of bounded bytes) lie in one array of
symbols.  An index maps each mergeable pair to all its positions there; the active ranks
are taken in ascending order, each rank's merges are made at all its positions at once,
and the lists of the pairs that come up beside them are extended.  That gives every
pre-token the merges it would get alone, because each merge makes a symbol of its own and
so can bring up only pairs of later ranks (checked when the vocabulary is read).

Nulls are encoded as the empty text; repeated rows are encoded alike; columns besides the
named text column pass through and may have any name.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exposa.llm.tables import unused

RUN_BYTES = 16 << 20

# The pattern that splits text before byte-level merges.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The same pattern with its classes written out for U+0000 to U+024F and common marks,
# where the standard module is faster; other texts take the general form.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_NEAR = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_FAR_CHAR = re.compile("[^\x00-ɏ‐-‧€]")


@lru_cache(maxsize=1)
def _general():
    import regex
    return regex.compile(PATTERN)


def pre_tokens(text: str) -> list[str]:
    return (_general() if _FAR_CHAR.search(text) else _NEAR).findall(text)


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class Vocabulary:
    """Merges, ids and bytes of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], {c: b for b, c in _byte_chars().items()}
        ids: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        born = {int(t): r for r, t in enumerate(self.made)}
        if len(born) != len(pairs) or any(
                born.get(int(x), -1) >= r for r, ab in enumerate(zip(left, right, strict=True)) for x in ab):
            raise ValueError("merges must make distinct symbols, each before its use")
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) \
            if self.added else None
        self.size = 1 + max([*ids.values(), *self.added.values()])
        self.bytes = [b""] * self.size
        for t, i in ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in t)
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        self.of_byte = np.array([ids[c] for _, c in sorted(_byte_chars().items())], np.int32)
        key = left * self.size + right
        self.rank_at = np.argsort(key)
        self.keys = key[self.rank_at]
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where none merges them."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_at[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Positions of every active pair, by rank, over pre-tokens laid end to end."""

    def __init__(self, vocab: Vocabulary, words: list[bytes]):
        self.v = vocab
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate(([0], np.cumsum(lengths)))
        n = int(self.first[-1])
        self.symbol = vocab.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        self.next = np.arange(1, n + 1, dtype=np.int32)
        self.prev = np.arange(-1, n - 1, dtype=np.int32)
        self.next[self.first[1:] - 1] = -1
        self.prev[self.first[:-1]] = -1
        self.alive = np.ones(n, bool)
        self.at: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._add(np.flatnonzero(self.next >= 0))

    def _add(self, at: np.ndarray) -> None:
        """List the positions of the pairs that begin at ``at`` under their ranks."""
        if not len(at):
            return
        rank = self.v.ranks(self.symbol[at], self.symbol[self.next[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
            if r in self.at:
                self.at[r].append(part)
            else:
                self.at[r] = [part]
                heapq.heappush(self.active, r)

    def _take(self, r: int) -> np.ndarray:
        """Positions where pair ``r`` still stands, leftmost first where occurrences overlap."""
        lists = self.at.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = self.v.left[r], self.v.right[r]
        at = at[self.alive[at] & (self.symbol[at] == a)]
        to = self.next[at]
        at = at[(to >= 0) & (self.symbol[to] == b)]
        if a == b and len(at) > 1:
            at = np.sort(at)
            nxt, keep, last = self.next[at].tolist(), [], -2
            for i, p in enumerate(at.tolist()):
                if p != last:
                    keep.append(i)
                    last = nxt[i]
            at = at[keep]
        return at

    def merge(self) -> None:
        while self.active:
            r = heapq.heappop(self.active)
            at = self._take(r)
            if not len(at):
                continue
            gone = self.next[at]
            self.symbol[at] = self.v.made[r]
            self.alive[gone] = False
            after = self.next[gone]
            self.next[at] = after
            has = after >= 0
            self.prev[after[has]] = at[has]
            before = self.prev[at]
            self._add(np.unique(np.concatenate((before[before >= 0], at[has]))))

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and the n+1 offsets of the words in them."""
        kept = np.concatenate(([0], np.cumsum(self.alive)))
        return self.symbol[self.alive], kept[self.first]


class _Numbered(dict):
    """Numbers new keys 0, 1, 2, ... as they are looked up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def encode_texts(texts: list[str | None], vocab: Vocabulary) -> Iterator[np.ndarray]:
    """Ids of each text, in order; memory is bounded by RUN_BYTES of text and the longest text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size < RUN_BYTES):
            size += len(texts[to] or "")
            to += 1
        number, uses = _Numbered(), []
        for text in texts[at:to]:
            parts, pos = [], 0
            for m in vocab.split_added.finditer(text or "") if vocab.split_added else ():
                parts += [*map(number.__getitem__, pre_tokens(text[pos:m.start()])), -1 - vocab.added[m[0]]]
                pos = m.end()
            parts.extend(map(number.__getitem__, pre_tokens((text or "")[pos:])))
            uses.append(np.array(parts, np.int32))
        index = PairIndex(vocab, [w.encode() for w in number])
        del number
        index.merge()
        ids, first = index.ids()
        for use in uses:
            yield _gather(ids, first, use)
        at = to


def _gather(ids: np.ndarray, first: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Ids of the words numbered in ``use``, end to end; -1-i stands for the id i itself."""
    own = use < 0
    word = np.where(own, 0, use)
    n = np.where(own, 1, first[word + 1] - first[word]) if len(first) > 1 else np.ones(len(use), np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    start = np.where(own, 0, first[word])
    out = np.repeat(start - (ends - n), n) + np.arange(total)
    out = ids[out] if len(ids) else np.zeros(total, np.int32)
    if own.any():
        out[(ends - n)[own]] = -1 - use[own]
    return out


def decode_ids(ids, vocab: Vocabulary) -> str:
    """Text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(vocab.bytes.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids)) \
        .decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """``docs`` with an array<int> column of ids (null text: empty array)."""
    return _map_texts(docs, path, text, [(to, "array<int>")], _EncodeIds())


def decode(docs: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``docs`` with the text of an id array; a null array gives the empty text."""
    return _map_texts(docs, path, ids, [(to, "string")], _DecodeIds())


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256."""
    return _map_texts(docs, path, text, [("n_tokens", "bigint"), ("ids_sha256", "string"),
                                         ("decoded_sha256", "string")], _RoundTrip())


def tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with token_ids, n_tokens, ids_sha256 and decoded_sha256."""
    return _map_texts(docs, path, text, [("token_ids", "array<int>"), ("n_tokens", "bigint"),
                                         ("ids_sha256", "string"), ("decoded_sha256", "string")], _RoundTrip(True))


def _map_texts(docs, path, column, added, make) -> DataFrame:
    """Run ``make`` over one column; the others pass through under names that cannot clash."""
    keep = [c for c in docs.columns if c not in {n for n, _ in added}]
    (value,) = unused(docs, "value")
    names = unused(docs.select(*[docs[c] for c in keep]), *[f"_{n}" for n, _ in added])
    frame = docs.select(*[docs[c] for c in keep], docs[column].alias(value))
    schema = T.StructType([f for f in frame.schema.fields if f.name != value])
    for name, (_, kind) in zip(names, added, strict=True):
        schema.add(name, T._parse_datatype_string(kind))

    def run(batches):
        import pyarrow as pa
        vocab = vocabulary(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                new = make(part.column(value).to_pylist(), vocab)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + new, names=[*keep, *names])

    out = frame.mapInArrow(run, schema)
    return out.select(*keep, *[F.col(n).alias(to) for n, (to, _) in zip(names, added, strict=True)])


class _EncodeIds:
    def __call__(self, texts, vocab):
        import pyarrow as pa
        return [pa.array([*encode_texts(texts, vocab)], pa.list_(pa.int32()))]


class _DecodeIds:
    def __call__(self, lists, vocab):
        import pyarrow as pa
        return [pa.array([decode_ids(i or [], vocab) for i in lists], pa.string())]


class _RoundTrip:
    def __init__(self, with_ids: bool = False):
        self.with_ids = with_ids

    def __call__(self, texts, vocab):
        import hashlib

        import pyarrow as pa
        number = list(map(str, range(vocab.size)))
        count, of_ids, of_text, lists = [], [], [], []
        for ids in encode_texts(texts, vocab):
            plain = ids.tolist()
            if self.with_ids:
                lists.append(ids)
            count.append(len(plain))
            of_ids.append(hashlib.sha256(",".join(map(number.__getitem__, plain)).encode()).hexdigest())
            of_text.append(hashlib.sha256(decode_ids(plain, vocab).encode()).hexdigest())
        first = [pa.array(lists, pa.list_(pa.int32()))] if self.with_ids else []
        return [*first, pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
