"""Vocabulary and token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions import constants as C
from stayflow.functions.expressions import bin_of, micros
from stayflow.operators.bins import quantile_edges, with_bins


def train_edges(log: DataFrame, n_bins: int = 10) -> DataFrame:
    """(code, edges) of all codes with n_bins values or more."""
    return quantile_edges(log.select("code", "value"), n_bins)


def vocabulary(log: DataFrame, edges: DataFrame | None = None, n_bins: int = 10, fuse: bool = False, min_count: int = 1) -> DataFrame:
    """(token, id): special tokens, codes in order of code points, Q_0 .. Q_n, then fused code/Q_i by code and bin.

    Codes and edges come from the log given (the training part). The vocabulary is as large as the number of distinct
    codes, not of events, and only that is ordered.
    """
    spark = log.sparkSession
    edges = train_edges(log, n_bins) if edges is None else edges
    special = spark.sql("select * from values " + ", ".join(f"(0, {i}, '', '{t}')" for i, t in enumerate(C.SPECIAL_TOKENS)) + " as s(block, number, code, token)")
    codes = log.groupBy("code").agg(F.count("*").alias("n")).where((F.col("n") >= min_count) & ~F.col("code").isin(*C.SPECIAL_TOKENS))
    codes = codes.select(F.lit(1).alias("block"), F.lit(0).alias("number"), "code", F.col("code").alias("token"))
    most = edges.agg(F.greatest(F.coalesce(F.max(F.size("edges") - 1), F.lit(n_bins)), F.lit(n_bins)).alias("most"))
    bins = most.select(F.lit(2).alias("block"), F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("number"))
    bins = bins.select("block", "number", F.lit("").alias("code"), F.concat(F.lit("Q_"), "number").alias("token"))
    parts = special.unionByName(codes).unionByName(bins)
    if fuse:
        fused = edges.where(F.size("edges") > 1).select("code", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("number"))
        parts = parts.unionByName(fused.select(F.lit(3).alias("block"), "number", "code", F.concat("code", F.lit("/Q_"), "number").alias("token")))
    place = F.row_number().over(Window.orderBy("block", "code", "number", "token")) - 1
    return parts.select("token", place.alias("id"))


def event_tokens(log: DataFrame, edges: DataFrame, fuse: bool = False) -> DataFrame:
    """The log with `token` and `second`, null where an event has one token.

    A numeric value adds the token of its bin, or is fused with its code; of waveform events only similarities have bins,
    and those are never fused; clock and gap tokens have none.
    """
    rows = with_bins(log, edges, bin_of)
    ecg, time = F.col("modality") == "ECG", F.col("modality").isin("CLOCK", "DT")
    binned = F.col("bin").isNotNull() & ~time & (~ecg | F.col("code").startswith("ECG//Similarity/"))
    q = F.concat(F.lit("Q_"), F.col("bin"))
    fused = binned & ~ecg & F.lit(fuse)
    return rows.withColumns({"token": F.when(fused, F.concat("code", F.lit("/"), q)).otherwise(F.col("code")), "second": F.when(binned & ~fused, q)})


def encoded_rows(log: DataFrame, vocab: DataFrame, edges: DataFrame, fuse: bool = False, stays: DataFrame | None = None) -> DataFrame:
    """(hospitalization_id, pos, token_id, ts_us): [BOS], the tokens, [EOS]; unknown tokens are [UNK].

    The ends have the times of the first and last event; stays without an event (if `stays` are given) 2000-01-01. Positions
    are running counts over events in their order, so that a log in buckets is neither shuffled nor sorted.
    """
    special = {t: i for i, t in enumerate(C.SPECIAL_TOKENS)}
    rows = event_tokens(log, edges, fuse).select("hospitalization_id", "event_idx", "token", "second", micros(F.col("time")).alias("ts_us"))
    for name in ("token", "second"):
        known = vocab.select(F.col("token").alias("known"), F.col("id").alias(f"{name}_id"))
        rows = rows.join(known, F.col(name) == F.col("known"), "left").drop("known")
    unknown = F.lit(special["[UNK]"])
    ids = F.concat(F.array(F.coalesce("token_id", unknown)), F.when(F.col("second").isNull(), F.array().cast("array<int>")).otherwise(F.array(F.coalesce("second_id", unknown))))
    by = Window.partitionBy("hospitalization_id").orderBy("event_idx")
    rows = rows.withColumn("ids", ids)
    rows = rows.withColumns({"first": F.lag("event_idx").over(by).isNull(), "last": F.lead("event_idx").over(by).isNull(), "upto": F.sum(F.size("ids")).over(by.rowsBetween(Window.unboundedPreceding, 0))})
    none = F.array().cast("array<int>")
    pieces = F.concat(F.when(F.col("first"), F.array(F.lit(special["[BOS]"]))).otherwise(none), "ids", F.when(F.col("last"), F.array(F.lit(special["[EOS]"]))).otherwise(none))
    start = F.col("upto") - F.size("ids") + F.when(F.col("first"), 0).otherwise(1)
    out = rows.select("hospitalization_id", F.posexplode(pieces).alias("at", "token_id"), start.alias("start"), "ts_us")
    out = out.select("hospitalization_id", (F.col("start") + F.col("at")).cast("int").alias("pos"), "token_id", "ts_us")
    if stays is not None:
        none = stays.select("hospitalization_id").distinct().join(log.select("hospitalization_id").distinct(), "hospitalization_id", "left_anti")
        start = F.lit(946_684_800_000_000)
        ends = F.array(F.struct(F.lit(0).alias("pos"), F.lit(special["[BOS]"]).alias("token_id"), start.alias("ts_us")), F.struct(F.lit(1).alias("pos"), F.lit(special["[EOS]"]).alias("token_id"), start.alias("ts_us")))
        out = out.unionByName(none.select("hospitalization_id", F.inline(ends)))
    return out


def sequences(rows: DataFrame) -> DataFrame:
    """One row per stay: token_ids, timestamps_us, token_count."""
    items = F.sort_array(F.collect_list(F.struct("pos", "token_id", "ts_us")))
    grouped = rows.groupBy("hospitalization_id").agg(items.alias("items"))
    return grouped.select("hospitalization_id", F.col("items.token_id").alias("token_ids"), F.col("items.ts_us").alias("timestamps_us"), F.size("items").alias("token_count"))


def decode(ids: DataFrame, vocab: DataFrame, column: str = "token_id") -> DataFrame:
    """Add `token`; unknown ids are [UNK]."""
    named = vocab.select(F.col("id").alias("known_id"), "token")
    return ids.join(named, F.col(column) == F.col("known_id"), "left").drop("known_id").withColumn("token", F.coalesce("token", F.lit("[UNK]")))
