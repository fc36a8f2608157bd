"""A next-token model of counts, its loss, and sampled continuations: what the evaluation needs from a language model.

Model and samples are tables. Engines that run elsewhere give samples (hospitalization_id, window_id, sample_id, tokens) for
windows with context_ids, and evaluation takes them as it takes those of generate().
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions import constants as C
from stayflow.sources.store import written

PAD = C.SPECIAL_TOKENS.index("[PAD]")


@dataclass(frozen=True)
class Generation:
    """How continuations are sampled. clocks and clock_limit end a sample at the n-th clock token."""

    n_samples: int = 8
    max_new_tokens: int = 500
    temperature: float = 1.0
    top_k: int = 50
    top_p: float = 0.95
    stop: tuple[int, ...] = ()
    clocks: tuple[int, ...] = ()
    clock_limit: int = 12
    seed: int = 42


def train(rows: DataFrame, keep: int | None = None) -> DataFrame:
    """(token_id, next_id, n, share) from token rows of the training part: how often each token follows another.

    The model has as many rows as there are pairs of tokens that stand side by side, whatever the number of sequences;
    with `keep` only each token's most frequent successors are kept.
    """
    by = Window.partitionBy("hospitalization_id").orderBy("pos")
    pairs = rows.select("token_id", F.lead("token_id").over(by).alias("next_id")).where("next_id is not null")
    counts = pairs.groupBy("token_id", "next_id").agg(F.count("*").alias("n"))
    of = Window.partitionBy("token_id")
    ranked = counts.withColumns({"share": F.col("n") / F.sum("n").over(of), "rank": F.row_number().over(of.orderBy(F.desc("n"), "next_id"))})
    return (ranked if keep is None else ranked.where(F.col("rank") <= keep)).drop("rank")


def loss(rows: DataFrame, model: DataFrame, vocab_size: int, label_weight: float = 75.0, smooth: float = 1e-6, pad: int = PAD) -> DataFrame:
    """One row (loss, tokens): negative log-likelihood of next tokens, weighted and divided by the sum of the weights (1 at
    least).

    A label (is_label of the next row) weighs label_weight, others 1; where the next row's loss_mask is 0 (if rows have
    one) nothing counts. Padding that comes next has no likelihood but its weight.
    """
    by = Window.partitionBy("hospitalization_id").orderBy("pos")
    mask = F.lead("loss_mask").over(by) if "loss_mask" in rows.columns else F.lit(1)
    pairs = rows.select("token_id", F.lead("token_id").over(by).alias("next_id"), F.lead("is_label").over(by).alias("is_label"), mask.alias("mask")).where("next_id is not null")
    joined = pairs.join(model.select("token_id", "next_id", "share"), ["token_id", "next_id"], "left")
    p = F.coalesce("share", F.lit(0.0)) * (1 - smooth) + smooth / vocab_size
    weight = F.when(F.col("is_label"), F.lit(float(label_weight))).otherwise(1.0) * F.col("mask")
    surprise = F.when(F.col("next_id") == pad, 0.0).otherwise(-F.log(p))
    return joined.agg((F.sum(surprise * weight) / F.greatest(F.sum(weight), F.lit(1.0))).alias("loss"), F.count("*").alias("tokens"))


def _alias(weights: list[float]) -> tuple[list[float], list[int]]:
    """An alias table: slot j is kept with the first number, else the slot of the second number is taken."""
    n = len(weights)
    left = [w * n for w in weights]
    keep, other = [1.0] * n, list(range(n))
    small, large = [j for j, w in enumerate(left) if w < 1], [j for j, w in enumerate(left) if w >= 1]
    while small and large:
        j, k = small.pop(), large[-1]
        keep[j], other[j] = left[j], k
        left[k] -= 1 - left[j]
        if left[k] < 1:
            small.append(large.pop())
    return keep, other


def successors(model: DataFrame, how: Generation) -> DataFrame:
    """(token_id, next_id, share): what temperature, top-k and top-p leave of each token's successors, with shares that sum to
    1. The most likely come first, equal ones by id; the last one that top-p keeps is that which reaches it. A temperature
    of 0 or below leaves the most likely one."""
    of = Window.partitionBy("token_id").orderBy(F.desc("share"), "next_id")
    rows = model.where("share > 0").withColumn("rank", F.row_number().over(of))
    most = 1 if how.temperature <= 0 else how.top_k
    rows = rows.where(F.col("rank") <= most) if most else rows
    rows = rows.withColumn("w", F.pow("share", F.lit(1.0 / how.temperature)) if how.temperature > 0 else F.lit(1.0))
    whole = Window.partitionBy("token_id")
    before = F.sum("w").over(of.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    rows = rows.withColumn("before", before / F.sum("w").over(whole)).where((F.col("before") < how.top_p) | (F.col("rank") == 1))
    return rows.select("token_id", "next_id", (F.col("w") / F.sum("w").over(whole)).alias("share"))


def alias_tables(chosen: DataFrame) -> DataFrame:
    """(token_id, nexts, keep, other) of successors(): a row for each token, from which one slot number and one coin draw a
    successor. Its arrays are as long as the token has successors."""

    def tables(rows: pa.Array) -> pa.Array:
        made = [_alias([x["share"] for x in r]) for r in rows.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.list_(pa.float64())), pa.array([m[1] for m in made], pa.list_(pa.int32()))], names=["keep", "other"])

    items = F.sort_array(F.collect_list(F.struct("next_id", "share")))
    rows = chosen.groupBy("token_id").agg(items.alias("items"))
    made = F.arrow_udf(tables, "struct<keep: array<double>, other: array<int>>")(F.col("items"))
    return rows.select("token_id", F.col("items.next_id").alias("nexts"), made.alias("t")).select("token_id", "nexts", "t.keep", "t.other")


def _uniform(*key: Column | str) -> Column:
    """A number of [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / float(1 << 52)


def generate(contexts: DataFrame, model: DataFrame, how: Generation, steps: int = 16) -> DataFrame:
    """(hospitalization_id, window_id, sample_id, tokens) for windows (hospitalization_id, window_id, context_ids).

    All samples go a token further with each join with the alias tables, a row for each token. After `steps` joins samples
    are written, and those that have ended leave. A sample ends with a stop token, at the clock limit, at a token without
    successors (as an empty context is), or after max_new_tokens. Its random numbers are hashes of the seed, the window, its
    own number and the step, so that a repeated task gives the same.
    """
    tables = written(alias_tables(successors(model, how)).withColumnRenamed("token_id", "of"), "alias")
    key = ["hospitalization_id", "window_id", "sample_id"]
    rows = contexts.select("hospitalization_id", "window_id", F.try_element_at("context_ids", F.lit(-1)).alias("last"), F.explode(F.sequence(F.lit(0), F.lit(how.n_samples - 1))).alias("sample_id"))
    rows = rows.select(*key, "last", F.array().cast("array<int>").alias("tokens"), F.lit(0).alias("clocks"), F.lit(how.max_new_tokens > 0).alias("open"))
    ended = None
    for first in range(0, max(1, how.max_new_tokens), steps):
        for step in range(first, min(first + steps, how.max_new_tokens)):
            rows = _advanced(rows, tables, how, step, key)
        rows = written(rows, "samples")
        done = rows.where("not open").select(*key, "tokens")
        ended = done if ended is None else ended.unionByName(done)
        rows = rows.where("open")
        if rows.isEmpty():
            break
    return ended


def _advanced(rows: DataFrame, tables: DataFrame, how: Generation, step: int, key: list[str]) -> DataFrame:
    joined = rows.join(tables, F.col("open") & (F.col("last") == F.col("of")), "left")
    drawn = lambda what: _uniform(F.lit(how.seed), F.lit(what), F.lit(step), *key)
    slot = F.floor(drawn("slot") * F.size("nexts")).cast("int")
    chosen = F.when(drawn("coin") < F.get("keep", slot), slot).otherwise(F.get("other", slot))
    joined = joined.withColumn("next", F.get("nexts", chosen))
    found = F.col("next").isNotNull()
    clocks = F.col("clocks") + F.when(found & F.col("next").isin(*how.clocks), 1).otherwise(0) if how.clocks else F.col("clocks")
    stops = F.col("next").isin(*how.stop) if how.stop else F.lit(False)
    full = (clocks >= how.clock_limit) if how.clocks else F.lit(False)
    goes = found & ~stops & ~full & F.lit(step + 1 < how.max_new_tokens)
    return joined.select(*key, F.coalesce("next", "last").alias("last"), F.when(found, F.array_append("tokens", F.col("next"))).otherwise(F.col("tokens")).alias("tokens"), clocks.alias("clocks"), goes.alias("open"))


def step_shares(contexts: DataFrame, model: DataFrame, how: Generation, steps: int) -> DataFrame:
    """(step, token_id, expected): how many samples have a token at each of the first steps in the mean, exactly: the counts
    of last tokens, multiplied by the successors' shares step by step. Stop tokens and clocks are not looked at."""
    chosen = successors(model, how).withColumnRenamed("token_id", "of")
    mass = contexts.select(F.try_element_at("context_ids", F.lit(-1)).alias("token_id")).groupBy("token_id").agg((F.count("*") * F.lit(float(how.n_samples))).alias("expected"))
    found = None
    for step in range(steps):
        mass = mass.join(chosen, F.col("token_id") == F.col("of")).groupBy(F.col("next_id").alias("token_id")).agg(F.sum(F.col("expected") * F.col("share")).alias("expected"))
        one = mass.select(F.lit(step).alias("step"), "token_id", "expected")
        found = one if found is None else found.unionByName(one)
    return found


def generated_shares(samples: DataFrame, expected: DataFrame, steps: int, deviations: float = 6.0) -> DataFrame:
    """(step, token_id, expected, n, within): how often samples have a token at a step, and whether that lies within
    `deviations` standard deviations (of independent draws, at most the square root of what is expected) and one of it."""
    rows = samples.select(F.posexplode(F.slice("tokens", 1, steps)).alias("step", "token_id")).groupBy("step", "token_id").agg(F.count("*").alias("n"))
    joined = expected.join(rows, ["step", "token_id"], "full").select("step", "token_id", F.coalesce("expected", F.lit(0.0)).alias("expected"), F.coalesce("n", F.lit(0)).alias("n"))
    return joined.withColumn("within", F.abs(F.col("n") - F.col("expected")) <= deviations * F.sqrt("expected") + 1)
