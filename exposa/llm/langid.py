"""Language identification: words first, then shorter and shorter character n-grams.

The model holds, for every language, log frequencies of its frequent words and of the
character n-grams (n = 1 to ``longest``) inside words, boundaries marked.  A known word adds
its log frequency in each language.  An unseen word falls back to its n-grams of the greatest
length of which any is known, and adds the mean of their log frequencies; a word without any
known letter adds nothing.  The language with the greatest sum is predicted (ties: the least
name); the score is its share when the mean log frequencies a word are made probabilities.

The model is fitted on a bounded sample: about ``rows_each`` labelled rows a language, drawn
by a hash of their id.  All words and n-grams of the drawn rows are part of it; ``words_each`` and
``grams_each`` make it smaller, to that many words and n-grams of a length a language (the most
frequent; equal counts in the order of their text).  Every document is predicted, from its whole
text.

Null texts and texts without a letter are ``und`` with score 0; so is everything if no row is
labelled.  A text with letters but without evidence gets the language with most labelled rows
and an equal share as score.  Rows that repeat are predicted alike; extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exposa.llm.tables import unused

RUN_CHARS = 8 << 20
_WORD = re.compile(r"[^\W\d_]+")


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _grams(word: str, n: int) -> list[str]:
    marked = f" {word} " if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies: row ``word[w]`` or ``gram[n][g]`` of a matrix with a column a language."""

    def __init__(self, langs: list[str], rows: list, totals: dict, prior: list[int]):
        """rows: (lang, n, gram, count), n = 0 for words; totals: (lang, n) -> (count, distinct)."""
        self.langs, self.prior = langs, int(np.argmax(prior)) if langs else 0
        lengths = sorted({r[1] for r in rows})
        at = {x: k for k, x in enumerate(langs)}
        self.index: dict[int, dict[str, int]] = {n: {} for n in lengths}
        for _, n, gram, _ in rows:
            self.index[n].setdefault(gram, len(self.index[n]))
        self.log: dict[int, np.ndarray] = {}
        for n in lengths:
            count = np.zeros((len(self.index[n]), len(langs)))
            for lang, k, gram, c in rows:
                if k == n:
                    count[self.index[n][gram], at[lang]] = c
            size = np.array([totals.get((x, n), (0, 0)) for x in langs], float)
            self.log[n] = np.log((count + 0.5) / (size[:, 0] + 0.5 * (len(count) + 1)))

    def vectors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: what it adds to each language, and whether it counts."""
        out, counts = np.zeros((len(words), len(self.langs))), np.zeros(len(words), bool)
        known, lengths = self.index.get(0, {}), sorted((n for n in self.index if n), reverse=True)
        hit_word, hit_row = [], []
        pending: dict[int, tuple[list, list, list]] = {n: ([], [], []) for n in lengths}
        for k, raw in enumerate(words):
            word = _letters(raw)
            if not word:
                continue
            row = known.get(word)
            if row is not None:
                hit_word.append(k)
                hit_row.append(row)
                continue
            for n in lengths:
                got = [r for r in map(self.index[n].get, _grams(word, n)) if r is not None]
                if got:
                    at, size, rows = pending[n]
                    at.append(k)
                    size.append(len(got))
                    rows += got
                    break
        if hit_word:
            out[hit_word], counts[hit_word] = self.log[0][hit_row], True
        for n, (at, size, rows) in pending.items():
            if at:
                size = np.array(size)
                out[at] = np.add.reduceat(self.log[n][rows], np.cumsum(size) - size) / size[:, None]
                counts[at] = True
        return out, counts

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        result: list[tuple[str, float]] = []
        at = 0
        while at < len(texts):
            to, size, number, uses = at, 0, _Numbered(), []
            while to < len(texts) and (to == at or size < RUN_CHARS):
                text = texts[to] or ""
                uses.append(np.array([*map(number.__getitem__, _WORD.findall(text.lower()))], np.int64))
                size, to = size + len(text), to + 1
            vectors, counts = self.vectors([*number])
            letters = np.array([bool(_letters(w)) for w in number], bool)
            result += [self._one(u, vectors, counts, letters) for u in uses]
            at = to
        return result

    def _one(self, use, vectors, counts, letters) -> tuple[str, float]:
        if not self.langs or not letters[use].any():
            return "und", 0.0
        n = int(counts[use].sum())
        if not n:
            return self.langs[self.prior], 1 / len(self.langs)
        mean = vectors[use].sum(0) / n
        best = int(np.argmax(mean))
        return self.langs[best], float(1 / np.exp(mean - mean[best]).sum())


class _Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def held_out(id: Column, parts: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of ``parts`` (a null id: false)."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def _count(frame: DataFrame, longest: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update(_WORD.findall((text or "").lower()))
            out: dict[tuple, int] = Counter()
            for lang, found in by_lang.items():
                for raw, c in found.items():
                    if word := _letters(raw):
                        out[lang, 0, word] += c
                        for n in range(1, longest + 1):
                            for g in _grams(word, n):
                                out[lang, n, g] += c
            if out:
                lang, n, gram = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(gram, pa.string()),
                     pa.array(list(out.values()), pa.int64())], names=["lang", "n", "gram", "c"])

    return frame.mapInArrow(run, "lang string, n int, gram string, c bigint") \
        .groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows_each: int = 4000,
        words_each: int | None = None, grams_each: int | None = None, longest: int = 4) -> Model:
    """Model of the labelled rows of ``docs`` that are not held out."""
    from exposa.llm.tables import cut
    rows = docs.select(docs[id].alias("id"), docs[text].alias("text"), docs[lang].alias("lang")) \
        .where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    labelled = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(labelled)
    if not langs:
        return Model([], [], {}, [])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = [(F.col("lang") == x) & (draw < int(min(1.0, rows_each / labelled[x]) * (1 << 30))) for x in langs]
    counts = cut(_count(rows.where(reduce(lambda a, b: a | b, share)), longest))
    sizes = counts.groupBy("lang", "n").agg(F.sum("c").alias("c"), F.count("*").alias("k")).collect()
    totals = {(r["lang"], r["n"]): (r["c"], r["k"]) for r in sizes}
    most = F.when(F.col("n") == 0, F.lit(words_each).cast("bigint")).otherwise(F.lit(grams_each).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))
    if words_each is not None or grams_each is not None:
        counts = counts.withColumn("place", place).where(F.coalesce(F.col("place") <= most, F.lit(True)))
    # bounded by the sample that the model is fitted on
    found = list(zip(*counts.select("lang", "n", "gram", "c").toArrow().to_pydict().values(), strict=True))
    return Model(langs, sorted(found), totals, [labelled[x] for x in langs])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    docs = docs.select(*[docs[c] for c in keep])
    pred, score = unused(docs, "_pred", "_score")
    schema = docs.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score)).schema
    for f in schema.fields:
        f.nullable = True

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                got = model.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, keep), pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.float64())], names=[*keep, pred, score])

    return docs.mapInArrow(run, schema).withColumnsRenamed({pred: "lang_pred", score: "lang_score"})


def keep_identified(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.0,
                    accepted: list[str] | None = None) -> DataFrame:
    """The rows with a predicted language (one of ``accepted``, if given) and ``min_score`` or more."""
    got = identify(docs, model, text)
    ok = (F.col("lang_pred") != "und") & (F.col("lang_score") >= min_score)
    if accepted is not None:
        ok &= F.col("lang_pred").isin(accepted)
    return got.where(ok).select(*docs.columns)
