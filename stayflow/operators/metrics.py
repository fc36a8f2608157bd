"""Ranking and calibration metrics of predictions (predicted_prob, actual_positive), by any grouping columns.

Scores of a group are cut into ranges that hold about equally many distinct scores, with bounds from a mergeable rank
sketch: however the scores lie, no task orders more than a part of a group, and running sums go through ranges first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.sources.store import written

GROUP = ["label", "horizon_hours"]
#: Ranges of scores within a group, and the items of the sketch that cuts them.
RANGES, SKETCH = 64, 1024


def _scores(preds: DataFrame, by: list[str]) -> DataFrame:
    """Counts per distinct score: what all metrics need, and as many rows as there are scores."""
    return preds.groupBy(*by, "predicted_prob").agg(F.sum(F.col("actual_positive").cast("long")).alias("pos"), F.count("*").alias("n"))


def _same(by: list[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by])


def in_ranges(preds: DataFrame, by: list[str]) -> DataFrame:
    """Counts per distinct score with `range`, which grows with the score. Ranges of a group hold about equally many distinct
    scores; scores that are null are a range of their own, before the others."""
    s = written(_scores(preds, by), "scores")
    sketch = s.where(F.col("predicted_prob").isNotNull()).groupBy(*[F.col(c).alias(f"r_{c}") for c in by]).agg(F.kll_sketch_agg_double("predicted_prob", F.lit(SKETCH)).alias("sketch"))
    at = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]))
    some = F.kll_sketch_get_n_double("sketch") > 0
    bounds = sketch.select(*[f"r_{c}" for c in by], F.when(some, F.array_distinct(at)).otherwise(F.array().cast("array<double>")).alias("bounds"))
    rows = s.join(written(bounds, "bounds"), _same(by, "r_"), "left")
    p = F.col("predicted_prob")
    found = F.when(p.isNull(), F.lit(-1)).otherwise(F.size(F.filter("bounds", lambda x: x < p)))
    return rows.select(*by, "predicted_prob", "pos", "n", found.alias("range"))


def _ranked(preds: DataFrame, by: list[str]) -> DataFrame:
    """Scores with `below`, the negatives under each, and tp and seen, the positives and rows at or above it."""
    s = in_ranges(preds, by)
    neg = F.col("n") - F.col("pos")
    totals = s.groupBy(*by, "range").agg(F.sum(neg).alias("t_neg"), F.sum("pos").alias("t_pos"), F.sum("n").alias("t_n"))
    under = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = totals.select(*[F.col(c).alias(f"g_{c}") for c in (*by, "range")], zero("t_neg", under).alias("under"), zero("t_pos", over).alias("over_pos"), zero("t_n", over).alias("over_n"))
    here = Window.partitionBy(*by, "range")
    up = here.orderBy("predicted_prob").rowsBetween(Window.unboundedPreceding, 0)
    down = here.orderBy(F.desc("predicted_prob")).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"in_neg": F.sum(neg).over(up) - neg, "in_pos": F.sum("pos").over(down), "in_n": F.sum("n").over(down)}).join(totals, _same([*by, "range"], "g_"))
    return s.select(*by, "predicted_prob", "pos", "n", (F.col("under") + F.col("in_neg")).alias("below"), (F.col("over_pos") + F.col("in_pos")).alias("tp"), (F.col("over_n") + F.col("in_n")).alias("seen"))


def _bin(score: Column, n_bins: int) -> Column:
    """Index of the last lower edge that a score of [0, 1] reaches; null for others."""
    edges = [i * (1.0 / n_bins) for i in range(n_bins)]
    at = F.lit(None).cast("int")
    for i in range(n_bins):
        at = F.when((score >= edges[i]) & (score <= 1.0), i).otherwise(at)
    return at


def calibration(preds: DataFrame, by: list[str] = GROUP, n_bins: int = 10) -> DataFrame:
    """(by, bin, n, mean_predicted, mean_actual) of equal bins on [0, 1], the last one closed; empty bins are left out."""
    rows = preds.withColumn("bin", _bin(F.col("predicted_prob"), n_bins)).where("bin is not null")
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("predicted_prob").alias("mean_predicted"), F.avg(F.col("actual_positive").cast("int")).alias("mean_actual"))


def grouped(preds: DataFrame, by: list[str] = GROUP, n_bins: int = 10) -> DataFrame:
    """All metrics and counts per group, from one reading of the predictions: counts per score, running sums over scores,
    sums per calibration bin, and sums of these.

    auroc: probability that a positive has a higher score than a negative, ties counting half; null if either is missing.
    auprc: average precision over distinct scores; null without a positive. ece: gaps of the bins weighted by their share.
    """
    p, pos, n = F.col("predicted_prob"), F.col("pos"), F.col("n")
    neg = n - pos
    bins = _ranked(preds, by).groupBy(*by, _bin(p, n_bins).alias("bin")).agg(
        F.sum(pos * F.col("below") + pos * neg * 0.5).alias("wins"),
        F.sum(pos * (F.col("tp") / F.col("seen"))).alias("precision"),
        F.sum(pos * F.pow(p - 1, 2) + neg * F.pow(p, 2)).alias("square"),
        F.sum(n * p).alias("predicted"),
        F.sum("pos").alias("n_positive"),
        F.sum(neg).alias("n_negative"),
        F.sum("n").alias("n_total"),
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("predicted") - F.col("n_positive")))
    total = lambda c: F.sum(c)
    return bins.groupBy(*by).agg(
        F.when((total("n_positive") > 0) & (total("n_negative") > 0), total("wins") / (total("n_positive") * total("n_negative").cast("double"))).alias("auroc"),
        F.when(total("n_positive") > 0, total("precision") / total("n_positive")).alias("auprc"),
        (total("square") / total("n_total")).alias("brier"),
        (F.coalesce(F.sum(gap), F.lit(0.0)) / total("n_total")).alias("ece"),
        *[total(c).alias(c) for c in ("n_positive", "n_negative", "n_total")],
    )


def auroc(preds: DataFrame, by: list[str] = GROUP) -> DataFrame:
    return grouped(preds, by).select(*by, "auroc")


def auprc(preds: DataFrame, by: list[str] = GROUP) -> DataFrame:
    return grouped(preds, by).select(*by, "auprc")


def brier(preds: DataFrame, by: list[str] = GROUP) -> DataFrame:
    return grouped(preds, by).select(*by, "brier")


def ece(preds: DataFrame, by: list[str] = GROUP, n_bins: int = 10) -> DataFrame:
    return grouped(preds, by, n_bins).select(*by, "ece")


#: The prime that draws are taken modulo, and factors that mix the number of the resample in.
PRIME, FACTOR, STEP = 2_147_483_647, 48_271, 69_621


def uniform(key: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, the ends left out, from keys of 28 bits (rows) and numbers of resamples (columns). Whole
    numbers below 2^63 throughout, so that SQL gives the same."""
    x = (key[:, None].astype(np.int64) * FACTOR + draws[None, :] * STEP + 1) % PRIME
    for _ in range(3):
        x = (x * (x + 2 * draws[None, :] + 1)) % PRIME
        x = (x * FACTOR + draws[None, :]) % PRIME
    return (x + 0.5) / PRIME


def distribution(mean: int, upto: int = 40) -> list[float]:
    """P(X <= k) of a Poisson variable for k below upto."""
    term, total, found = math.exp(-mean), 0.0, []
    for k in range(upto):
        total += term
        found.append(total)
        term *= mean / (k + 1)
    return found


#: Up to this mean the inverse of the distribution is taken, beyond it a corrected normal quantile.
EXACT = 8
_TABLES = np.array([distribution(m) for m in range(1, EXACT + 1)])


def poisson(mean: np.ndarray, u: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Poisson numbers for whole means (one a row), from uniform u (small means) and normal z, corrected for skewness."""
    found = np.zeros(u.shape)
    large = mean > EXACT
    if large.any():
        m, n = mean[large][:, None].astype(float), z[large]
        found[large] = np.maximum(0, np.floor(m + np.sqrt(m) * n + (n * n - 1) / 6 + 0.5))
    for m in range(1, EXACT + 1):
        at = mean == m
        if at.any():
            found[at] = np.searchsorted(_TABLES[m - 1], u[at].ravel(), side="left").reshape(u[at].shape)
    return found


def _keys(by: list[str], seed: int) -> list[Column]:
    """Three numbers of 28 bits for each (seed, group, score), from a digest: for positives, negatives and the normal angle."""
    score = F.floor(F.coalesce("predicted_prob", F.lit(-1.0)) * 1e15).cast("string")
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], score))
    return [F.conv(F.substring(digest, 7 * i + 1, 7), 16, 10).cast("long").alias(f"key_{i}") for i in range(3)]


def bootstrap_auroc(preds: DataFrame, by: list[str] = GROUP, n: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """(by, low, median, high) of AUROC over n resamples with replacement.

    Rows of one group, score and class are alike, so a resample weighs their count by one Poisson number drawn from a digest
    of (seed, group, score) and the number of the resample: neither rows nor their partitioning matter. What is shuffled
    are counts per score, whatever n is: the draws of all resamples are vectors, made where a range of scores is summed in
    order, and a range leaves three vectors. Resamples that lack a class are left out, and without any all three are 0.
    """
    s = in_ranges(preds, by).select(F.struct(*by).alias("by"), "range", "predicted_prob", "pos", (F.col("n") - F.col("pos")).alias("neg"), *_keys(by, seed))
    rows = s.repartition("by", "range").sortWithinPartitions("by", "range", "predicted_prob")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, here, held = np.arange(1, n + 1, dtype=np.int64), None, np.zeros((3, n))
        step = max(1, 500_000 // n)
        for b in batches:
            of, ranges = b.column("by").to_pylist(), b.column("range").to_pylist()
            pos, neg, *keys = (b.column(c).to_numpy() for c in ("pos", "neg", "key_0", "key_1", "key_2"))
            i = 0
            while i < len(of):
                group = (of[i], ranges[i])
                j = i
                while j < len(of) and j - i < step and (of[j], ranges[j]) == group:
                    j += 1
                if here is not None and here != group:
                    yield _vectors(here, held, b.column("by").type)
                    held = np.zeros((3, n))
                here = group
                u, v, w = (uniform(k[i:j], draws) for k in keys)
                radius, angle = np.sqrt(-2 * np.log(u)), 2 * np.pi * w
                p, m = poisson(pos[i:j], u, radius * np.cos(angle)), poisson(neg[i:j], v, radius * np.sin(angle))
                upto = held[1] + m.cumsum(0)
                held[0] += (p * (upto - m / 2)).sum(0)
                held[1], held[2] = upto[-1], held[2] + p.sum(0)
                i = j
        if here is not None:
            yield _vectors(here, held, b.column("by").type)

    kind = s.schema["by"].dataType.simpleString()
    parts = rows.mapInArrow(sums, f"by {kind}, range int, wins array<double>, neg array<double>, pos array<double>")
    # a group's ranges are at most RANGES + 1
    items = F.sort_array(F.collect_list(F.struct("range", "wins", "neg", "pos")))
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    zero = F.array_repeat(F.lit(0.0), n)

    def merge(a: Column, x: Column) -> Column:
        return F.struct(add(add(a.wins, x.wins), F.zip_with(x.pos, a.neg, lambda p, m: p * m)).alias("wins"), add(a.neg, x.neg).alias("neg"), add(a.pos, x.pos).alias("pos"))

    whole = parts.groupBy("by").agg(items.alias("items")).select("by", F.aggregate("items", F.struct(zero.alias("wins"), zero.alias("neg"), zero.alias("pos")), merge).alias("x"))
    one = whole.select("by", F.explode(F.arrays_zip("x.wins", "x.neg", "x.pos")).alias("d"))
    share = F.when((F.col("d.neg") > 0) & (F.col("d.pos") > 0), F.col("d.wins") / (F.col("d.pos") * F.col("d.neg")))
    tail = (1 - confidence) / 2
    found = one.groupBy("by").agg(F.percentile(share, F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail))).alias("q"))
    return found.select(*[F.col(f"by.{c}").alias(c) for c in by], *[F.coalesce(F.get("q", F.lit(i)), F.lit(0.0)).alias(name) for i, name in enumerate(("low", "median", "high"))])


def _vectors(of: tuple[dict, int], held: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    vectors = [pa.array([x], pa.list_(pa.float64())) for x in held]
    return pa.RecordBatch.from_arrays([pa.array([of[0]], kind), pa.array([of[1]], pa.int32()), *vectors], names=["by", "range", "wins", "neg", "pos"])
