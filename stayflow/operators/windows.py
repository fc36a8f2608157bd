"""Prediction windows, what came true within a horizon, and probabilities from sampled continuations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions import constants as C

MIDNIGHT, DEATH = "CLOCK//00:00", "DISCH//Expired"
#: Columns that name a window.
WINDOW = ("hospitalization_id", "window_id")


def midnight_windows(rows: DataFrame, vocab: DataFrame, max_days: int = 7) -> DataFrame:
    """(hospitalization_id, window_id, end_pos, end_us) of the first max_days midnight tokens; the context is all up to end_pos."""
    midnight = vocab.where(F.col("token") == MIDNIGHT).select(F.col("id").alias("token_id"))
    by = Window.partitionBy("hospitalization_id").orderBy("pos")
    found = rows.join(midnight, "token_id", "left_semi").withColumn("window_id", F.row_number().over(by) - 1)
    return found.where(F.col("window_id") < max_days).select("hospitalization_id", "window_id", F.col("pos").alias("end_pos"), F.col("ts_us").alias("end_us"))


def contexts(windows: DataFrame, seqs: DataFrame, max_len: int | None = None) -> DataFrame:
    """Add context_ids, of which the last max_len tokens are kept."""
    joined = windows.join(seqs.select("hospitalization_id", "token_ids"), "hospitalization_id")
    size = F.col("end_pos") + 1
    start = F.greatest(F.lit(1), size - max_len + 1) if max_len else F.lit(1)
    return joined.withColumn("context_ids", F.slice("token_ids", start, size - start + 1)).drop("token_ids")


def _by_label(found: DataFrame, label_tokens: DataFrame, horizons: tuple[int, ...], *of_label: Column | str, **values: Callable[[int], Column]) -> DataFrame:
    """A row for each window of found, horizon and label, of which there are many times more than windows: they are made where
    the window is, as the last step, and never shuffled. values: from a horizon's place to a column of it, which may use of_label."""
    rows = found.join(F.broadcast(label_tokens.select("label"))).select(*WINDOW, "label", *of_label)  # labels are a fixed list
    each = [F.struct(F.lit(h).alias("horizon_hours"), *[value(i).alias(name) for name, value in values.items()]) for i, h in enumerate(horizons)]
    return rows.select(*WINDOW, "label", F.inline(F.array(*each))).select(*WINDOW, "horizon_hours", "label", *values)


def label_times(windows: DataFrame, rows: DataFrame, label_tokens: DataFrame) -> DataFrame:
    """(hospitalization_id, window_id, after_us): for each window a map from labels that follow it to the time until the first
    token. label_tokens: (label, token_id).

    Only label tokens are joined to the windows of their stay; times are taken to be in order.
    """
    hits = rows.join(label_tokens, "token_id").select(F.col("hospitalization_id").alias("stay"), "label", "ts_us")
    after = windows.join(hits, (F.col("hospitalization_id") == F.col("stay")) & (F.col("ts_us") > F.col("end_us")), "left")
    first = after.groupBy(*WINDOW, "label").agg(F.min(F.col("ts_us") - F.col("end_us")).alias("us"))
    return first.groupBy(*WINDOW).agg(_map("label", F.col("us")).alias("after_us"))


def _map(key: str, value: Column) -> Column:
    """Aggregate to a map; rows whose key is null add nothing."""
    return F.map_from_entries(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(F.col(key), value))))


def _positive(horizons: tuple[int, ...]) -> Callable[[int], Column]:
    return lambda i: F.coalesce(F.col("after") <= horizons[i] * 3_600_000_000, F.lit(False))


def horizon_truth(windows: DataFrame, rows: DataFrame, label_tokens: DataFrame, horizons: tuple[int, ...] = (8, 24, 48)) -> DataFrame:
    """(hospitalization_id, window_id, horizon_hours, label, actual_positive): does the label's token stand after the
    window's end, at most horizon hours later? label_tokens: (label, token_id)."""
    times = label_times(windows, rows, label_tokens)
    return _by_label(times, label_tokens, horizons, F.try_element_at("after_us", F.col("label")).alias("after"), actual_positive=_positive(horizons))


def truncate_at_clock(tokens: Column, clocks: list[int], n: int) -> Column:
    """Tokens up to the n-th clock token, it included; all if there are fewer."""
    places = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.get(tokens, i - 1).isin(clocks))
    return F.when(F.size(tokens) > 0, F.slice(tokens, F.lit(1), F.coalesce(F.get(places, F.lit(n - 1)), F.size(tokens)))).otherwise(tokens)


def label_hits(samples: DataFrame, label_tokens: DataFrame, clocks: list[int], death: int | None, horizons: tuple[int, ...] = (8, 24, 48), clock_hours: int = C.CLOCK_HOURS) -> DataFrame:
    """(hospitalization_id, window_id, n, hits) from samples (hospitalization_id, window_id, sample_id, tokens): how many a
    window has, and a map from labels to how many of them have the label's token within each horizon's clock tokens. Labels
    whose name has "mortality" take the token of death instead. A window without samples is not in `samples`.

    Only tokens that some label wants leave the samples, each with the first place at which it stands, and a null before
    them by which samples are counted, so that all comes from one reading.
    """
    tokens = F.coalesce("tokens", F.array().cast(samples.schema["tokens"].dataType))
    size = F.size("tokens")
    places = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.get("tokens", i).isin(clocks)) if clocks else F.array().cast("array<int>")
    # the last place of a horizon is that of its n-th clock token; without so many all of the sample belongs to it
    ends = F.array(*[F.coalesce(F.get("places", F.lit(h // clock_hours - 1)), size) for h in horizons])
    rows = samples.select(*WINDOW, "sample_id", tokens.alias("tokens")).select(*WINDOW, "sample_id", "tokens", places.alias("places"))
    rows = rows.select(*WINDOW, "sample_id", ends.alias("ends"), F.posexplode(F.concat(F.array(F.lit(None).cast("int")), "tokens")).alias("at", "token"))
    target = F.when(F.col("label").contains("mortality"), F.lit(death).cast("int")).otherwise(F.col("token_id"))
    targets = label_tokens.select("label", target.alias("target"))  # a fixed list
    rows = rows.join(F.broadcast(targets), F.col("token") == F.col("target"), "left").where("at = 0 or label is not null")
    found = rows.groupBy(*WINDOW, "sample_id", "label").agg((F.min("at") - 1).alias("place"), F.first("ends").alias("ends"), F.count("*").alias("n"))
    within = F.array(*[F.count_if(F.col("place") <= F.get("ends", F.lit(i))) for i in range(len(horizons))])
    found = found.groupBy(*WINDOW, "label").agg(within.alias("within"), F.sum("n").alias("n"))
    return found.groupBy(*WINDOW).agg(F.max(F.when(F.col("label").isNull(), F.col("n"))).alias("n"), _map("label", F.col("within")).alias("hits"))


def _within(i: int) -> Column:
    return F.coalesce(F.get("within", F.lit(i)), F.lit(0)) / F.col("n")


def probabilities(samples: DataFrame, label_tokens: DataFrame, clocks: list[int], death: int | None, horizons: tuple[int, ...] = (8, 24, 48), clock_hours: int = C.CLOCK_HOURS) -> DataFrame:
    """(hospitalization_id, window_id, horizon_hours, label, predicted_prob): the share of a window's samples that have the
    label, as label_hits() counts them."""
    hits = label_hits(samples, label_tokens, clocks, death, horizons, clock_hours)
    return _by_label(hits, label_tokens, horizons, "n", F.try_element_at("hits", F.col("label")).alias("within"), predicted_prob=_within)


def scored(hits: DataFrame, times: DataFrame, label_tokens: DataFrame, horizons: tuple[int, ...] = (8, 24, 48)) -> DataFrame:
    """Predictions beside what came true, from label_hits() and label_times(); windows without samples have probability 0.

    Windows get a row each before they are taken apart by horizon and label. Both sides are grouped, not joined, by window:
    where both are dealt by stay already, a group finds its rows there, and a join by two columns would shuffle them.
    """
    both = times.withColumn("found", F.lit(True)).unionByName(hits, allowMissingColumns=True)
    whole = both.groupBy(*WINDOW).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("found", "after_us", "n", "hits")]).where("found")
    of_label = [F.try_element_at(c, F.col("label")).alias(name) for c, name in (("after_us", "after"), ("hits", "within"))]
    share = lambda i: F.coalesce(_within(i), F.lit(0.0))
    return _by_label(whole, label_tokens, horizons, "n", *of_label, actual_positive=_positive(horizons), predicted_prob=share)
