"""Quality scores: a ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

The features approximate a Gaussian kernel over standardised statistics of a text. Each partition of the examples sums its
own normal equations, by fold; Spark adds them up, and the driver solves systems whose size depends on the number of
features alone. Scores of examples by models that have not seen them are calibrated. The model is fitted on about
`max_labels` labelled documents (a documented bound); everything is scored from its whole text and nothing else.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.sources.store import scratch, written

#: Bytes whose share of a text is a statistic.
_CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "digit": "0123456789",
    "blank": " \t\x0b\x0c\r",
    "newline": "\n",
    "symbol": "#*$%&|<>",
    "loud": "!?",
    "stop": ".,;:",
    "other": "\"'()[]{}-_/\\@^~`+=",
}
NAMES = (
    *_CLASSES, "beyond_ascii", "entropy", "log_words", "word_length", "longest_word", "distinct_words", "commonest_word",
    "repeated_pairs", "repeated_lines", "words_per_line", "capitalised", "shouted", "marked_words",
)
_WEIGHTS = np.zeros((256, len(_CLASSES) + 1))
for _i, _chars in enumerate(_CLASSES.values()):
    _WEIGHTS[[ord(c) for c in _chars], _i] = 1.0
_WEIGHTS[128:, len(_CLASSES)] = 1.0
_MARKS = frozenset("#*$%&|<>!")


def text_statistics(text: str | None) -> list[float]:
    """The statistics NAMES of a text; all are 0 without a character that is no white space."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    some = share[share > 0]
    n, times = len(words), Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        *(share @ _WEIGHTS).tolist(),
        float(-(some * np.log2(some)).sum()),
        math.log1p(n),
        math.log1p(sum(map(len, words)) / n),
        math.log1p(max(map(len, words))),
        len(times) / n,
        max(times.values()) / n,
        1 - pairs / (n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        sum(k for w, k in times.items() if w[0].isupper()) / n,
        sum(k for w, k in times.items() if w.isupper() and len(w) > 1) / n,
        sum(k for w, k in times.items() if w[-1] in _MARKS) / n,
    ]


def statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """Add array<double> `out` (a column of that name is replaced): text_statistics of the whole text, 0 for null texts."""

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([text_statistics(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return docs.withColumn(out, F.arrow_udf(batch, "array<double>")(F.col(text)))


@dataclass
class Model:
    """Standardisation, random directions, weights and calibration; without examples there are no weights."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    at: np.ndarray | None = None
    value: np.ndarray | None = None
    threshold: float = 0.7

    def features(self, stats: np.ndarray) -> np.ndarray:
        """A one, and cosines whose products of two rows average exp(-|x - y|^2 / 2 width^2)."""
        x = np.clip((stats - self.mean) / self.scale, -5, 5)
        z = np.cos(x @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.at, self.value), 0.0, 1.0).round(9)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: places and values of the non-decreasing step means of total / n over ascending x."""
    blocks: list[list[float]] = []
    for at, t, k in zip(x.tolist(), total.tolist(), n.tolist(), strict=True):
        blocks.append([at * k, t, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    found = np.array(blocks, float).reshape(-1, 3)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def examples(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", max_labels: int = 20_000, column: str = "statistics") -> DataFrame:
    """(id, x, y) of about max_labels labelled documents, drawn by a hash of their ids (all, if there are no more).

    Rows with a null id or label teach nothing. An id that is labelled several times has the mean label; of several texts of
    one id the one of the smallest statistics counts, so that there is one example an id. Drawn ids are broadcast: they are
    max_labels numbers.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    known = written(known, "labels")
    scale, rows = 1 << 30, known.count()
    share = min(scale, math.ceil(scale * max_labels / max(1, rows)))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("drawn"), "id"), F.lit(scale)) < share)
    found = stats.select(F.col(doc_id).alias("of"), F.col(column).alias("x")).join(F.broadcast(drawn), F.col("of") == F.col("id"))
    found = found.groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
    return written(found.repartition(max(1, -(-min(rows, max_labels) // 2500)), "id").sortWithinPartitions("id"), "examples")


def normal_equations(rows: DataFrame, model: Model, folds: int) -> np.ndarray:
    """[fold, i, j]: sums of z_i z_j over the examples of a fold, and in the last column of z_i y."""
    size = len(model.phases) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size, size + 1))
        for b in batches:
            z, y, fold = model.features(_matrix(b.column("x"))), b.column("y").to_numpy(), b.column("fold").to_numpy()
            both = np.concatenate([z, y[:, None]], axis=1)
            for k in range(folds):
                total[k] += z[fold == k].T @ both[fold == k]
        cells = pa.ListArray.from_arrays(pa.array(np.arange(folds * size + 1) * (size + 1), pa.int32()), pa.array(total.ravel()))
        at = np.arange(folds * size)
        yield pa.RecordBatch.from_arrays([pa.array(at // size, pa.int32()), pa.array(at % size, pa.int32()), cells], names=["fold", "i", "cells"])

    parts = rows.select("x", "y", _fold(folds)).mapInArrow(sums, "fold int, i int, cells array<double>")
    none = F.array_repeat(F.lit(0.0), size + 1)
    ordered = F.sort_array(F.collect_list("cells"))
    whole = parts.groupBy("fold", "i").agg(F.aggregate(ordered, none, lambda a, c: F.zip_with(a, c, lambda x, y: x + y)).alias("cells"))
    found = np.zeros((folds, size, size + 1))
    for r in whole.collect():
        found[r["fold"], r["i"]] = r["cells"]
    return found


def _fold(folds: int):
    return F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(folds)).cast("int").alias("fold")


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", max_labels: int = 20_000, features: int = 256, width: float = 1.0, ridge: float = 1e-4, folds: int = 5, threshold: float = 0.7, seed: int = 42, column: str = "statistics") -> Model:
    """A Model from documents with their statistics and from labels (doc_id, label from 0 to 1); see examples().

    width is that of the kernel, in units of the square root of the number of statistics; ridge is the penalty for each
    example. The driver gets sums of a size that `features` fixes, and one calibration score for each example.
    """
    with scratch():
        rows = examples(stats, labels, doc_id, label, max_labels, column)
        d = len(NAMES)
        of = lambda f: F.array(*[f(F.get("x", F.lit(i))) for i in range(d)])
        n, mean, spread = rows.agg(F.count("*"), of(F.avg), of(F.stddev_pop)).first()
        rng = np.random.default_rng(seed)
        directions, phases = rng.standard_normal((d, features)) / (width * math.sqrt(d)), rng.uniform(0, 2 * math.pi, features)
        if not n:
            return Model(np.zeros(d), np.ones(d), directions, phases, threshold=threshold)
        spread = np.array(spread)
        model = Model(np.array(mean), np.where(spread > 1e-9, spread, 1.0), directions, phases, threshold=threshold)
        sums = normal_equations(rows, model, folds)
        whole = sums.sum(0)
        penalty = np.diag([1e-9, *[ridge] * features])

        def solve(s: np.ndarray) -> np.ndarray:
            return np.linalg.solve(s[:, :-1] + penalty * max(1.0, s[0, 0]), s[:, -1])

        apart = np.stack([solve(whole - sums[k]) for k in range(folds)])

        def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = (model.features(_matrix(b.column("x"))) * apart[b.column("fold").to_numpy()]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(raw.round(9)), b.column("y")], names=["raw", "y"])

        seen = rows.select("x", "y", _fold(folds)).mapInArrow(unseen, "raw double, y double")
        points = seen.groupBy("raw").agg(F.sum("y").alias("total"), F.count("*").alias("n")).orderBy("raw").toPandas()
    model.weights = solve(whole)
    model.at, model.value = isotonic(points["raw"].to_numpy(), points["total"].to_numpy(), points["n"].to_numpy())
    return model


def predict(stats: DataFrame, model: Model, out: str = "scored", column: str = "statistics") -> DataFrame:
    """Add struct<score, predicted> (a column `out` is replaced): the score from 0 to 1, and 1 if it is threshold or more.

    Every row has a score, those of null and empty texts that of statistics of 0; equal texts have equal scores. A model
    without examples gives 0.5.
    """

    def batch(x: pa.Array) -> pa.Array:
        score = model.score(_matrix(x)) if len(x) else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array((score >= model.threshold).astype(np.int32))], names=["score", "predicted"])

    return stats.withColumn(out, F.arrow_udf(batch, "struct<score: double, predicted: int>")(F.col(column)))
