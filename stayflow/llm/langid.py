"""Language identification, words first: a known word counts with its log frequency in each language, an unseen word
with that of its longest known character n-grams.

A word is a run of letters and combining marks that begins with a letter, in lower case; fitting and prediction cut texts
by the same function. The model is fitted on a bounded sample of labelled documents of each language (docs_per_lang) and
keeps all words and n-grams of it, so it grows with the number of languages and not with the corpus. Predictions read whole
texts and nothing else.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayflow.sources.store import scratch, written

#: Documents of each language that are learned from, at most: a documented parameter of fit().
DOCS_PER_LANG = 1000
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case; none if it has no letter."""
    return _WORDS(text.lower()) if text else []


class Level:
    """Terms with their scores by language: a dictionary of rows, and packed pairs of a row."""

    def __init__(self, terms: dict[str, list[tuple[int, float]]]):
        self.row = {term: i for i, term in enumerate(terms)}
        self.start = np.cumsum([0, *map(len, terms.values())], dtype=np.int32)
        pairs = [pair for found in terms.values() for pair in found]
        self.lang, self.above = np.array([x for x, _ in pairs], np.int32), np.array([x for _, x in pairs], np.float64)

    @classmethod
    def of(cls, terms: np.ndarray, lang: np.ndarray, above: np.ndarray) -> Level:
        """From rows in order of terms."""
        found = cls({})
        new = np.ones(len(terms), bool)
        new[1:] = terms[1:] != terms[:-1]
        found.start = np.append(np.flatnonzero(new), len(terms)).astype(np.int32)
        found.row = {term: i for i, term in enumerate(terms[new].tolist())}
        found.lang, found.above = lang.astype(np.int32), above
        return found

    @cached_property
    def plain(self) -> tuple[list[int], list[int], list[float]]:
        """The arrays as lists, of which single numbers are read faster."""
        return self.start.tolist(), self.lang.tolist(), self.above.tolist()

    def get(self, term: str) -> list[tuple[int, float]] | None:
        at = self.row.get(term)
        if at is None:
            return None
        start, lang, above = self.plain
        a, b = start[at], start[at + 1]
        return [(lang[a], above[a])] if b == a + 1 else list(zip(lang[a:b], above[a:b], strict=True))

    def items(self) -> Iterator[tuple[str, list[tuple[int, float]]]]:
        return ((term, self.get(term)) for term in self.row)


class Model:
    """levels[0] has words, levels[n] n-grams: text -> [(language, log frequency above the language's floor)].

    A level is a dictionary of term -> row and, for each row, the languages and numbers from start[row] to start[row + 1].
    """

    def __init__(self, langs: list[str], levels: list[dict[str, list[tuple[int, float]]]], floors: list[list[float]], common: int, cells: int = 1_000_000):
        self.langs, self.floors, self.common = langs, floors, common
        self.levels = [Level(terms) for terms in levels]
        # words met have a row of the table: their scores by language, then a 1 for the level that scored them
        self.width = len(langs) + len(levels)
        self.limit = max(1000, cells // max(1, self.width))
        self.rows: dict[str, int] = {}
        self.table: np.ndarray | None = None

    @classmethod
    def counted(cls, langs: list[str], levels: list[Level], floors: list[list[float]], common: int) -> Model:
        found = cls(langs, [], floors, common)
        found.levels, found.width = levels, len(langs) + len(levels)
        found.limit = max(1000, 1_000_000 // found.width)
        return found

    def word(self, word: str) -> tuple[int, list[tuple[int, float]]] | None:
        """The level that scores a word and its scores above that level's floors; None if not even a letter is known."""
        found = self.levels[0].get(word)
        if found is not None:
            return 0, found
        padded = f" {word} "
        for n in range(len(self.levels) - 1, 0, -1):
            level = self.levels[n]
            row = level.row
            at = [row[p] for i in range(len(padded) - n + 1) if (p := padded[i : i + n]) in row]
            if at:
                start, langs, scores = level.plain
                total: dict[int, float] = {}
                for k in at:
                    for j in range(start[k], start[k + 1]):
                        total[langs[j]] = total.get(langs[j], 0.0) + scores[j]
                return n, [(lang, above / len(at)) for lang, above in total.items()]
        return None

    def _row(self, word: str) -> int:
        at = self.rows[word] = len(self.rows)
        row = [0.0] * self.width
        if scored := self.word(word):
            row[len(self.langs) + scored[0]] = 1.0
            for lang, above in scored[1]:
                row[lang] = above
        self.table[at] = row
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The most likely language (of equals the first by name) and its share, from the mean score of a word."""
        found = Counter(words_of(text))
        if not found or not self.langs:
            return UNKNOWN, 0.0
        if self.table is None:
            self.table = np.zeros((self.limit, self.width))
        total, known = np.zeros(self.width), self.rows
        words, times = list(found), np.fromiter(found.values(), np.float64, len(found))
        for start in range(0, len(words), self.limit // 2):
            part = words[start : start + self.limit // 2]
            if len(known) + len(part) > self.limit:
                known.clear()
            at = [known[w] if w in known else self._row(w) for w in part]
            total += times[start : start + len(part)] @ self.table[at]
        k = len(self.langs)
        per_level, n = total[k:], total[k:].sum()
        if not n:
            return self.langs[self.common], 1 / k
        mean = (total[:k] + per_level @ np.array(self.floors)) / n
        best = int(np.argmax(mean))
        return self.langs[best], float(1 / np.exp(mean - mean[best]).sum())


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG, longest: int = 5) -> Model:
    """Learn from rows with text and language; others are ignored.

    Of each language at most docs_per_lang whole texts are drawn by a hash of the text (all, if there are no more; repeated
    texts one by one). All their words and n-grams up to `longest` are kept; the driver gets no more than these. No labelled
    rows give a model without languages.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    with scratch():
        sizes = written(rows.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
        counts = {r["lang"]: r["docs"] for r in sizes.collect()}
        if not counts:
            return Model([], [{}], [[]], 0)
        names = sorted(counts)
        scale = 1 << 30
        # about twice the documents that are wanted pass a hash; the first of them by another hash are taken, so that a text
        # that is repeated does not exceed the bound
        share = F.least(F.lit(scale), F.ceil(F.lit(2 * scale * docs_per_lang) / F.col("docs")))
        passed = rows.join(sizes, "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(scale)) < share)
        order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("order"), "text"), "text")
        sample = passed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_lang)
        terms = written(_terms(sample, longest), "terms")
        totals = {(r["lang"], r["level"]): (r["t"], r["v"]) for r in terms.groupBy("lang", "level").agg(F.sum("n").alias("t"), F.count("*").alias("v")).collect()}
        index = {name: i for i, name in enumerate(names)}
        levels = [_level(terms.where(F.col("level") == n), index) for n in range(longest + 1)]
    size = {(name, n): math.log(t + 0.5 * (v + 1)) for name in names for n in range(longest + 1) for t, v in [totals.get((name, n), (0, 0))]}
    floors = [[math.log(0.5) - size[name, n] for name in names] for n in range(longest + 1)]
    return Model.counted(names, levels, floors, index[max(names, key=lambda name: counts[name])])


def _level(rows: DataFrame, index: dict[str, int]) -> Level:
    found = rows.select("term", "lang", "n").orderBy("term", "lang").toArrow()
    lang = np.array([index[x] for x in found.column("lang").to_pylist()], np.int32)
    return Level.of(np.array(found.column("term").to_pylist(), object), lang, np.log(found.column("n").to_numpy() + 0.5) - math.log(0.5))


def _terms(sample: DataFrame, longest: int) -> DataFrame:
    """(lang, level, term, n): how often a language has each word (level 0) and each n-gram of a word between blanks (level n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(name, Counter()).update(words_of(text))
            rows = [(name, term, n) for name, c in found.items() for term, n in c.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "term", "n"])

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit(" "), "term", F.lit(" "))

    def parts(n: int) -> Column:
        starts = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.struct(F.lit(n).alias("level"), padded.substr(at, F.lit(n)).alias("term")))

    whole = F.array(F.struct(F.lit(0).alias("level"), F.col("term").alias("term")))
    found = counted.select("lang", "n", F.inline(F.concat(whole, *[parts(n) for n in range(1, longest + 1)])))
    return found.groupBy("lang", "level", "term").agg(F.sum("n").alias("n"))


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "predicted") -> DataFrame:
    """Add struct<lang_pred, score>: und and 0 for a text that is null or has no letter, and where nothing was learned."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = sent.value
        for texts in batches:
            yield pd.DataFrame([one.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(out, predicted(F.col(text)))


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True for documents that are not learned from: crc32 of the id as text, modulo folds. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == fold, F.lit(False))
