"""Reports over logs, sequences and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_histogram(log: DataFrame) -> DataFrame:
    """(prefix, n): events by what stands before the first //."""
    return log.groupBy(F.substring_index("code", "//", 1).alias("prefix")).agg(F.count("*").alias("n"))


def label_histogram(log: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent labels."""
    labels = log.where(F.col("code").startswith("LABEL//")).groupBy("code").agg(F.count("*").alias("n"))
    return labels.orderBy(F.desc("n"), "code").limit(top)


def ecg_histogram(log: DataFrame) -> DataFrame:
    """(kind, n): waveform events by kind."""
    rows = log.where(F.col("code").startswith("ECG//"))
    return rows.groupBy(F.split_part(F.split_part("code", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


def length_stats(log: DataFrame) -> DataFrame:
    """Number of stays and their numbers of events: least, median, most, mean."""
    n = log.groupBy("hospitalization_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("stays"), F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def describe(df: DataFrame, column: str) -> DataFrame:
    """(statistic, value) of a numeric column."""
    c = F.col(column)
    q = [F.percentile(c, F.lit(p)).alias(n) for n, p in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75))]
    one = df.agg(F.count(c).alias("count"), F.sum(c.isNull().cast("int")).alias("null_count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *q, F.max(c).alias("max"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(f"`{n}`").cast("double").alias("value")) for n in one.columns])))


def stays_with_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stays that both tables have."""
    return a.select("hospitalization_id").distinct().intersect(b.select("hospitalization_id").distinct())


def align_tokens(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(hospitalization_id, pos, token, event_idx): tokens beside the events they come from; bin tokens belong to the
    event before them, special tokens to none."""
    named = rows.join(vocab.withColumnRenamed("id", "token_id"), "token_id")
    bin_token, special = F.col("token").rlike("^Q_-?[0-9]+$"), F.col("token").startswith("[") & F.col("token").endswith("]") & ~(F.col("token") == "[UNK]")
    by = Window.partitionBy("hospitalization_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    index = F.sum((~bin_token & ~special).cast("int")).over(by) - 1
    return named.select("hospitalization_id", "pos", "token", F.when(~special, index).alias("event_idx"))


def run_statistics(log: DataFrame) -> DataFrame:
    """One row: stays, events, labels, waveform events, clock and gap tokens."""
    count = lambda *m: F.sum(F.col("modality").isin(*m).cast("long"))
    return log.agg(F.countDistinct("hospitalization_id").alias("stays"), F.count("*").alias("events"), count("LABEL").alias("labels"), count("ECG").alias("ecg_events"), count("CLOCK").alias("clock_tokens"), count("DT").alias("gap_tokens"))


def parse_metric_keys(metrics: DataFrame, key: str = "key") -> DataFrame:
    """LABEL//<name>_<h>h -> label, horizon_hours; null where a key has another form."""
    form = r"^(?:LABEL//)?(.+)_([0-9]+)h$"
    ok = F.col(key).rlike(form)
    return metrics.withColumns({"label": F.when(ok, F.regexp_extract(key, form, 1)), "horizon_hours": F.when(ok, F.regexp_extract(key, form, 2).cast("int"))})


def evaluable(metrics: DataFrame, least: int = 20) -> DataFrame:
    """Metrics with enough positives and an AUROC; adds prevalence."""
    return metrics.where((F.col("n_positive") >= least) & F.col("auroc").isNotNull()).withColumn("prevalence", F.col("n_positive") / F.col("n_total"))


def route_summary(metrics: DataFrame) -> DataFrame:
    """Means per route and horizon, and the number of labels."""
    means = [F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("auroc", "auprc", "brier")]
    return metrics.groupBy("route", "horizon_hours").agg(*means, F.countDistinct("label").alias("n_labels"))


def route_pivot(metrics: DataFrame, routes: list[str], baseline: str = "no_ecg", value: str = "auroc") -> DataFrame:
    """A column per route and, for those that are not the baseline, its difference from it."""
    wide = metrics.groupBy("label", "horizon_hours").pivot("route", routes).agg(F.first(value, ignorenulls=True))
    return wide.select("*", *[(F.col(r) - F.col(baseline)).alias(f"delta_{r}") for r in routes if r != baseline])


def route_delta(metrics: DataFrame, baseline: str = "no_ecg", values: tuple[str, ...] = ("auroc", "auprc", "brier")) -> DataFrame:
    """Each route's metrics less the baseline's for the same label and horizon, and the relative change in percent."""
    base = metrics.where(F.col("route") == baseline).select("label", "horizon_hours", *[F.col(v).alias(f"base_{v}") for v in values])
    rows = metrics.where(F.col("route") != baseline).join(base, ["label", "horizon_hours"])
    deltas = [(F.col(v) - F.col(f"base_{v}")).alias(f"delta_{v}") for v in values]
    percent = (F.try_divide(F.col(values[0]) - F.col(f"base_{values[0]}"), F.col(f"base_{values[0]}")) * 100).alias(f"percent_{values[0]}")
    return rows.select("route", "label", "horizon_hours", *deltas, percent)


def route_macro(metrics: DataFrame, baseline: str = "no_ecg", value: str = "auroc") -> DataFrame:
    """Per route and horizon the mean over labels that route and baseline both have, the baseline's, their difference and the
    relative change in percent."""
    base = metrics.where(F.col("route") == baseline).select("label", "horizon_hours", F.col(value).alias("base"))
    rows = metrics.where(F.col("route") != baseline).join(base, ["label", "horizon_hours"]).where(F.col(value).isNotNull() & F.col("base").isNotNull())
    means = rows.groupBy("route", "horizon_hours").agg(F.count("*").alias("n_labels"), F.avg(value).alias("macro"), F.avg("base").alias("macro_base"))
    return means.withColumns({"delta": F.col("macro") - F.col("macro_base"), "percent": F.try_divide(F.col("macro") - F.col("macro_base"), F.col("macro_base")) * 100})


def top_labels(metrics: DataFrame, n: int = 8) -> DataFrame:
    """The n labels with the highest mean AUROC (ties by name)."""
    return metrics.groupBy("label").agg(F.avg("auroc").alias("mean_auroc")).orderBy(F.desc("mean_auroc"), "label").limit(n)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """(key, json) per group, key <label>_<h>h."""
    body = F.struct("auroc", "auprc", "brier", "ece", "n_positive", "n_total")
    return metrics.select(F.concat("label", F.lit("_"), F.col("horizon_hours").cast("string"), F.lit("h")).alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
