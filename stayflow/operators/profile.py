"""Frequencies of codes, and which of them events are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayflow.functions import constants as C
from stayflow.functions.expressions import modality
from stayflow.sources.catalog import Catalog

SOURCES = (
    ("vitals", "vital_category", "VITAL"),
    ("labs", "lab_category", "LAB_RESULT"),
    ("medication_admin_continuous", "med_category", "MED_CONT"),
    ("medication_admin_intermittent", "med_category", "MED_BOLUS"),
    ("patient_assessments", "assessment_category", "ASSESS"),
    ("patient_procedures", "procedure_code", "PROC"),
    ("hospital_diagnosis", "diagnosis_code", "ICD"),
)


def code_counts(t: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """(code, event_count, admission_count), an aggregation per source over the stays in ids (all, if None).

    Counting first per code and stay keeps the shuffled rows few, however often a stay has a code.
    """

    def one(name: str, column: str, prefix: str) -> DataFrame:
        rows = t[name] if ids is None else t.for_stays(name, ids)
        stays = rows.groupBy(F.concat(F.lit(f"{prefix}//"), F.col(column)).alias("code"), "hospitalization_id").agg(F.count("*").alias("n"))
        return stays.groupBy("code").agg(F.sum("n").alias("event_count"), F.count("hospitalization_id").alias("admission_count"))

    return reduce(DataFrame.unionByName, [one(*s) for s in SOURCES])


def profile(counts: DataFrame, thresholds: dict[str, tuple[int, int]] | None = None, whitelist: tuple[str, ...] = C.WHITELIST) -> DataFrame:
    """Add `included`: listed, or at least its family's numbers of events and of stays. A code of no family is not included."""
    thresholds = thresholds or C.THRESHOLDS
    enough = F.lit(False)
    for name, family in C.FAMILIES.items():
        if family in thresholds:
            events, stays = thresholds[family]
            enough = enough | ((modality(F.col("code")) == name) & (F.col("event_count") >= events) & (F.col("admission_count") >= stays))
    return counts.withColumn("included", F.coalesce(F.col("code").isin(*whitelist) | enough, F.lit(False)))
