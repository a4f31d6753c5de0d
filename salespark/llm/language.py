"""Language identification by words first, then ever shorter character n-grams.

A word that the model knows adds its log frequency in each language. An unseen word is padded with a blank on
either side and cut into n-grams; the longest length with a known n-gram gives its score, the mean over the
known n-grams of that length. The language with the largest sum wins, and the softmax of the sums is its score.

Word counts cover all training texts: each task counts words and emits partial counts, Spark adds them up. The
n-gram counts come from the word counts. The model keeps the most frequent `entries` words and n-grams in all,
shared evenly among languages and lengths, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from salespark.session import ship_package, stage

_LETTERS = re.compile(r"[^\W\d_]+")
LONGEST_GRAM = 5
LONGEST_WORD = 40  # longer runs of letters are scored by their n-grams only
PARTS = 64
_CHUNK = 1 << 20


def letter_runs(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a text, some at a time, so that a very long text needs little memory."""
    for start in range(0, len(text), _CHUNK):
        stop = min(len(text), start + _CHUNK)
        if stop < len(text) or start:  # never cut a word
            while start and start < len(text) and text[start - 1].isalpha() and text[start].isalpha():
                start += 1
            while stop < len(text) and text[stop - 1].isalpha() and text[stop].isalpha():
                stop += 1
        if start < stop:
            yield _LETTERS.findall(text[start:stop].lower())


def grams(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def word_counts(batches: Iterator[pa.RecordBatch], flush: int = 200_000) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, str]] = Counter()

    def emit() -> pa.RecordBatch:
        keys = list(counts)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "word", "n"],
        )
        counts.clear()
        return batch

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for found in letter_runs(text or ""):
                for word, n in Counter(found).items():
                    if len(word) <= LONGEST_WORD:
                        counts[lang, word] += n
            if len(counts) >= flush:
                yield emit()
    if counts:
        yield emit()


@dataclass
class LanguageModel:
    """Log frequencies by language: `words` and `grams[size]` map a string to its row in `rows`."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    rows: np.ndarray

    def unseen(self, word: str) -> list[int]:
        """Rows of the longest known n-grams; none if not even a letter is known."""
        padded = f" {word} "
        for size in range(min(LONGEST_GRAM, len(padded)), 0, -1):
            known = self.grams.get(size)
            if known and (hits := [row for i in range(len(padded) - size + 1) if (row := known.get(padded[i : i + size])) is not None]):
                return hits
        return []


class Scorer:
    """Scores texts with a model. Unseen words get rows of their own, which later texts use again."""

    def __init__(self, model: LanguageModel, most: int = 200_000):
        self.model, self.most = model, most
        self.cache: dict[str, int] = {}
        self.extra = np.zeros((0, len(model.languages)))

    def _add(self, fresh: list[str]) -> None:
        rows = [self.model.unseen(word) for word in fresh]
        counts = np.array([len(r) for r in rows])
        sums = np.zeros((len(rows), len(self.model.languages)))
        np.add.at(sums, np.repeat(np.arange(len(rows)), counts), self.model.rows[[x for r in rows for x in r]])
        self.extra = np.vstack([self.extra, sums / np.maximum(counts, 1)[:, None]])

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        languages, words = self.model.languages, self.model.words
        if len(self.cache) > self.most:
            self.cache, self.extra = {}, self.extra[:0]
        base, cache = len(self.model.rows), self.cache
        rows, times, ends, letters, fresh = [], [], [], [], []
        for text in texts:
            letter = False
            for found in letter_runs(text or ""):
                for word, n in Counter(found).items():
                    row = words.get(word)
                    if row is None:
                        row = cache.get(word)
                        if row is None:
                            row = cache[word] = base + len(cache)
                            fresh.append(word)
                    rows.append(row)
                    times.append(n)
                letter = letter or any(any(map(str.isalpha, word)) for word in found)
            ends.append(len(rows))
            letters.append(letter)
        if not languages:
            return [("und", 0.0)] * len(texts)
        if fresh:
            self._add(fresh)
        place, times = np.array(rows, dtype=np.int64), np.array(times, dtype=float)
        known = place < base
        values = np.empty((len(place), len(languages)))
        values[known], values[~known] = self.model.rows[place[known]], self.extra[place[~known] - base]
        of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        totals = np.column_stack([np.bincount(of, values[:, i] * times, len(texts)) for i in range(len(languages))])
        best = totals.argmax(axis=1)  # of equal sums, the first language by code point
        scores = 1 / np.exp(totals - totals.max(axis=1)[:, None]).sum(axis=1)
        return [(languages[b], float(s)) if has else ("und", 0.0) for b, s, has in zip(best, scores, letters, strict=True)]


def gram_counts(batches: Iterator[pa.RecordBatch], flush: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of counted words."""
    counts: Counter[tuple[str, int, str]] = Counter()

    def emit() -> pa.RecordBatch:
        keys = list(counts)
        arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "size", "item", "n"])

    for batch in batches:
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            for size in range(1, LONGEST_GRAM + 1):
                for gram in grams(word, size):
                    counts[lang, size, gram] += n
            if len(counts) >= flush:
                yield emit()
    if counts:
        yield emit()


def learn(training: DataFrame, entries: int = 120_000) -> LanguageModel:
    """Fit on the text and lang columns of `training`; rows without either add nothing."""
    spark = training.sparkSession
    ship_package(spark)
    known = training.where("lang is not null and text is not null").select("lang", "text")
    counts = stage(known.mapInArrow(word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    totals = {r["lang"]: (r["n"], r["v"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], {}, {}, np.zeros((0, 0)))
    cut = counts.mapInArrow(gram_counts, "lang string, size int, item string, n long").groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    items = counts.select("lang", F.lit(0).alias("size"), F.col("word").alias("item"), "n").unionByName(cut)
    share = max(1, entries // (len(languages) * (LONGEST_GRAM + 1)))
    best = [F.desc("n"), "item"]
    part = F.pmod(F.xxhash64("item"), F.lit(PARTS))
    items = stage(items, "language-items")
    sums = {(r["lang"], r["size"]): (r["n"], r["v"]) for r in items.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    # the best of each part first, so that the last choice sees at most PARTS times `share` items of a length
    first = items.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "size", "part").orderBy(*best)))
    last = first.where(F.col("rank") <= share).withColumn("rank", F.row_number().over(W.partitionBy("lang", "size").orderBy(*best)))
    kept = last.where(F.col("rank") <= share).select("size", "item").distinct()
    chosen = items.join(kept, ["size", "item"]).select("lang", "size", "item", "n").toPandas()  # at most `entries` items in each language
    return _model(languages, sums, chosen)


def _model(languages: list[str], sums: dict, chosen) -> LanguageModel:
    place = {lang: i for i, lang in enumerate(languages)}
    maps: dict[int, dict[str, int]] = {size: {} for size in range(LONGEST_GRAM + 1)}
    keys = list(dict.fromkeys(zip(chosen["size"].tolist(), chosen["item"].tolist(), strict=True)))
    keys.sort()
    rows = np.zeros((len(keys), len(languages)))
    for i, (size, item) in enumerate(keys):
        maps[size][item] = i
        for j, lang in enumerate(languages):
            n, v = sums.get((lang, size), (0, 0))
            rows[i, j] = math.log(0.5 / (n + 0.5 * (v + 1)))
    for lang, size, item, n in chosen.itertuples(index=False):
        total, v = sums[lang, size]
        rows[maps[size][item], place[lang]] = math.log((n + 0.5) / (total + 0.5 * (v + 1)))
    return LanguageModel(languages, maps.pop(0), maps, rows)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of docs plus lang_pred and score. Only text is looked at.

    `und` with score 0 where text is null or has no letter, or where nothing was learned. Repeated rows are
    answered one by one. Columns of docs named lang_pred or score are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, at = Scorer(shared.value), others.index("text")
        for batch in batches:
            texts = batch.column(at)
            found = [x for low in range(0, batch.num_rows, 256) for x in scorer.score(texts.slice(low, 256).to_pylist())]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "lang_pred", "score"])

    return kept.mapInArrow(answer, schema)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
