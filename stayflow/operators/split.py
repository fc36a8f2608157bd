"""Chronological split of patients, and samples of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEST_FRACTION = 0.13


def patient_split(stays: DataFrame, val_fraction: float = 0.1) -> DataFrame:
    """(patient_id, first_admit, split): patients in order of their first admission (ties by id), first train, then val,
    the rest test.

    Only two places in the order decide, so they are found by the counts of patients per first admission; no task sorts
    all patients.
    """
    first = stays.groupBy("patient_id").agg(F.min("admission_dttm").alias("first_admit"))
    n = first.agg(F.count("*").alias("n"))
    train = F.floor(F.col("n") * (1.0 - TEST_FRACTION - val_fraction))
    bounds = n.select(train.alias("train"), (train + F.floor(F.col("n") * val_fraction)).alias("val"))
    days = first.groupBy("first_admit").agg(F.count("*").alias("here"))
    # running counts of times: by day first, so that the global part has a row per day
    per_day = days.groupBy(F.to_date("first_admit").alias("day")).agg(F.sum("here").alias("of_day"))
    per_day = per_day.withColumn("earlier", F.sum("of_day").over(Window.orderBy(F.col("day").asc_nulls_first())) - F.col("of_day"))
    by_day = Window.partitionBy("day").orderBy(F.col("first_admit").asc_nulls_first(), "patient_id")
    ranked = first.withColumn("day", F.to_date("first_admit")).withColumn("place", F.row_number().over(by_day))
    ranked = ranked.join(per_day.withColumnRenamed("day", "d"), F.col("day").eqNullSafe(F.col("d")))
    place = F.col("earlier") + F.col("place")
    split = F.when(place <= F.col("train"), "train").when(place <= F.col("val"), "val").otherwise("test")
    return ranked.join(F.broadcast(bounds)).select("patient_id", "first_admit", split.alias("split"))  # bounds has one row


def sample_patients(split: DataFrame, n_patients: int, seed: int = 42) -> DataFrame:
    """About n_patients of a split, each part in proportion, chosen by a seeded hash; deterministic for a seed."""
    counts = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values()) or 1
    want = {s: max(1, int(n_patients * (counts.get(s, 0) / total))) for s in ("train", "val")}
    want["test"] = max(0, n_patients - sum(want.values()))
    parts = [split.where(F.col("split") == s).orderBy(F.md5(F.concat(F.lit(f"{seed}/"), "patient_id")), "patient_id").limit(k) for s, k in want.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
