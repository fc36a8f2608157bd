"""Extraction: each source table becomes events (stay, time, code, value, value_cat); their union is the event log.

Every branch carries its modality as a literal column and the number of its source, so that a filter on either folds
whole branches away, and so that events of one time and priority have a defined order. A table that gives several kinds
of events is scanned once and exploded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions import constants as C
from stayflow.functions.expressions import age_bucket
from stayflow.operators.intervals import interval_join
from stayflow.sources.catalog import Catalog

COLUMNS = ("hospitalization_id", "time", "code", "value", "value_cat", "modality", "src")
STOPPED = ("stop", "paused", "held")


def events(df: DataFrame, time: Column, name: str, category: Column, src: int, value: Column | None = None, value_cat: Column | None = None) -> DataFrame:
    """An event per row: code <name>//<category>. A null category makes the code null, as concatenation does."""
    no = F.lit(None)
    return df.select(
        "hospitalization_id", time.alias("time"), F.concat(F.lit(f"{name}//"), category.cast("string")).alias("code"), (no if value is None else value).cast("double").alias("value"),
        (no if value_cat is None else value_cat).cast("string").alias("value_cat"), F.lit(name).alias("modality"), F.lit(src).alias("src"),
    )


def several(df: DataFrame, *kinds: tuple[Column, Column, str, Column, int, Column | None]) -> DataFrame:
    """Several kinds of events from one scan; a kind is (condition, time, modality, category, src, value)."""
    made = [
        F.struct(
            F.coalesce(keep, F.lit(False)).alias("keep"), time.alias("time"), F.concat(F.lit(f"{name}//"), category.cast("string")).alias("code"),
            (F.lit(None) if value is None else value).cast("double").alias("value"), F.lit(None).cast("string").alias("value_cat"), F.lit(name).alias("modality"), F.lit(src).alias("src"),
        )
        for keep, time, name, category, src, value in kinds
    ]
    return df.select("hospitalization_id", F.inline(F.filter(F.array(*made), lambda e: e.keep))).select(*COLUMNS)


def included(df: DataFrame, name: str, category: str, profile: DataFrame | None) -> DataFrame:
    """Rows whose code the profile includes; without a profile all rows."""
    if profile is None:
        return df
    codes = profile.where("included").select(F.col("code").alias("included_code"))
    return df.join(codes, F.concat(F.lit(f"{name}//"), F.col(category)) == F.col("included_code"), "left_semi")


def demographics(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    stays = t["hospitalization"].join(t["patient"].select("patient_id", "sex_category", "race_category"), "patient_id", "left")
    at = F.col("admission_dttm")
    return several(
        stays,
        (F.col("age_at_admission").isNotNull(), at, "DEMO", F.concat(F.lit("AGE_"), age_bucket(F.col("age_at_admission"))), 11, None),
        (F.col("sex_category") != "", at, "DEMO", F.concat(F.lit("SEX_"), "sex_category"), 12, None),
        (F.col("race_category") != "", at, "DEMO", F.concat(F.lit("RACE_"), "race_category"), 13, None),
    )


def poa_diagnoses(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    poa = t["hospital_diagnosis"].where("poa_present = 1").join(t["hospitalization"].select("hospitalization_id", "admission_dttm"), "hospitalization_id", "left")
    return events(poa, F.col("admission_dttm"), "ICD_POA", F.col("diagnosis_code"), 20)


def locations(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    return events(t["adt"], F.col("in_dttm"), "ADT", F.col("location_category"), 30)


def vitals(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    rows = included(t["vitals"], "VITAL", "vital_category", profile)
    return events(rows, F.col("recorded_dttm"), "VITAL", F.col("vital_category"), 40, F.col("vital_value"))


def labs(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    rows = included(t["labs"], "LAB_RESULT", "lab_category", profile)
    ordered, result = F.coalesce("lab_order_dttm", "lab_collect_dttm"), F.coalesce("lab_result_dttm", "lab_collect_dttm")
    return several(
        rows,
        (ordered.isNotNull(), ordered, "LAB_ORDER", F.col("lab_category"), 50, None),
        (result.isNotNull() & F.col("lab_value_numeric").isNotNull(), result, "LAB_RESULT", F.col("lab_category"), 60, F.col("lab_value_numeric")),
    )


def continuous_medications(t: Catalog, profile: DataFrame | None = None, keep_unknown_action: bool = False) -> DataFrame:
    """Stops are not filtered by the profile. A row whose action is null and whose dose is positive is neither a stop nor
    active, as three-valued logic has it; keep_unknown_action makes it active."""
    rows = t["medication_admin_continuous"]
    stop = F.col("mar_action_category").isin(*STOPPED) | F.col("med_dose").isNull() | (F.col("med_dose") == 0)
    active = ~F.coalesce(stop, F.lit(False)) if keep_unknown_action else ~stop
    allowed = F.lit(True)
    if profile is not None:
        codes = profile.where("included and code like 'MED_CONT//%'").select(F.col("code").alias("included_code"))
        rows = rows.join(codes, F.concat(F.lit("MED_CONT//"), F.col("med_category")) == F.col("included_code"), "left")
        allowed = F.col("included_code").isNotNull()
    time, name = F.col("admin_dttm"), F.col("med_category")
    return several(rows, (stop, time, "MED_CONT_STOP", name, 70, None), (active & allowed, time, "MED_CONT", name, 80, F.col("med_dose")))


def intermittent_medications(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    rows = included(t["medication_admin_intermittent"], "MED_BOLUS", "med_category", profile)
    return events(rows, F.col("admin_dttm"), "MED_BOLUS", F.col("med_category"), 90, F.col("med_dose"))


def _parameters(name: str, src: int, **columns: str):
    time = F.col("recorded_dttm")
    return [(F.col(c).isNotNull(), time, name, F.lit(label), src + i, F.col(c)) for i, (label, c) in enumerate(columns.items())]


def respiratory(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    device = (F.lit(True), F.col("recorded_dttm"), "RESP", F.coalesce("device_category", F.lit("unknown")), 100, None)
    settings = _parameters("RESP_PARAM", 110, fio2="fio2_set", peep="peep_set", tidal_volume="tidal_volume_set", resp_rate_set="resp_rate_set", pressure_support="pressure_support_set")
    return several(t["respiratory_support"], device, *settings)


def assessments(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    rows = included(t["patient_assessments"], "ASSESS", "assessment_category", profile)
    return events(rows, F.col("recorded_dttm"), "ASSESS", F.col("assessment_category"), 120, F.col("numerical_value"), F.col("categorical_value"))


def within_stays(df: DataFrame, stays: DataFrame, time: str) -> DataFrame:
    """Rows that have a patient only, put into the patient's stays whose interval holds their time."""
    stays = stays.select("patient_id", F.col("hospitalization_id").alias("stay"), "admission_dttm", "discharge_dttm")
    joined = interval_join(df, stays, "patient_id", time, "admission_dttm", "discharge_dttm", ["stay"])
    return joined.withColumn("hospitalization_id", F.col("stay")).drop("stay")


def code_status_rows(t: Catalog) -> DataFrame:
    rows = t["code_status"]
    return rows if "hospitalization_id" in t.own.get("code_status", {"hospitalization_id"}) else within_stays(rows, t["hospitalization"], "start_dttm")


def code_status(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    return events(code_status_rows(t), F.col("start_dttm"), "CODE_STATUS", F.col("code_status_category"), 130)


def positions(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    return events(t["position"], F.col("recorded_dttm"), "POSITION", F.col("position_category"), 140)


def crrt(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    mode = (F.lit(True), F.col("recorded_dttm"), "CRRT", F.coalesce("crrt_mode_category", F.lit("unknown")), 150, None)
    return several(t["crrt_therapy"], mode, *_parameters("CRRT_PARAM", 151, blood_flow="blood_flow_rate", uf_out="ultrafiltration_out"))


def ecmo(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    device = (F.lit(True), F.col("recorded_dttm"), "ECMO", F.coalesce("device_category", F.lit("ECMO")), 160, None)
    return several(t["ecmo_mcs"], device, *_parameters("ECMO_PARAM", 161, flow="flow"))


def procedures(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    rows = included(t["patient_procedures"].where("procedure_billed_dttm is not null"), "PROC", "procedure_code", profile)
    return events(rows, F.col("procedure_billed_dttm"), "PROC", F.col("procedure_code"), 170)


def discharges(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    out = F.col("discharge_dttm")
    return several(t["hospitalization"], (out.isNotNull(), out, "DISCH", F.lit("GENERAL"), 181, None), (out.isNotNull() & (F.col("discharge_category") != ""), out, "DISCH", F.col("discharge_category"), 182, None))


def billing(t: Catalog, profile: DataFrame | None = None) -> DataFrame:
    """All diagnoses, a minute after discharge."""
    out = t["hospitalization"].where("discharge_dttm is not null").select("hospitalization_id", "discharge_dttm")
    return events(t["hospital_diagnosis"].join(out, "hospitalization_id"), F.col("discharge_dttm") + F.expr("interval '1' minute"), "ICD", F.col("diagnosis_code"), 190)


EXTRACTORS = {
    "demographics": demographics, "poa_diagnoses": poa_diagnoses, "locations": locations, "vitals": vitals, "labs": labs, "continuous_medications": continuous_medications,
    "intermittent_medications": intermittent_medications, "respiratory": respiratory, "assessments": assessments, "code_status": code_status, "positions": positions,
    "crrt": crrt, "ecmo": ecmo, "procedures": procedures, "discharges": discharges, "billing": billing,
}


def base_events(t: Catalog, profile: DataFrame | None = None, ids: DataFrame | None = None, keep_unknown_action: bool = False, parts: int | None = None) -> DataFrame:
    """All events from admission on; those before it, and those without a time, are dropped. There is no upper limit.

    With `parts`, stays are dealt into so many partitions, by the one shuffle that also finds their admission.
    """
    more = {continuous_medications: {"keep_unknown_action": keep_unknown_action}}
    union = reduce(DataFrame.unionByName, [make(t, profile, **more.get(make, {})) for make in EXTRACTORS.values()])
    if parts:
        union = union.repartition(parts, "hospitalization_id")
    stays = t["hospitalization"].select("hospitalization_id", "admission_dttm")
    if ids is not None:
        stays = stays.join(ids.select("hospitalization_id"), "hospitalization_id", "left_semi")
    return union.join(stays, "hospitalization_id").where("time >= admission_dttm").drop("admission_dttm")


def modality_priority(name: Column) -> Column:
    found = F.lit(C.DEFAULT_PRIORITY)
    for level in sorted({*C.PRIORITY.values()}):
        found = F.when(name.isin(*[n for n, p in C.PRIORITY.items() if p == level]), F.lit(float(level))).otherwise(found)
    return found


def ordering(stage: bool = True) -> list[Column]:
    """The total order of a stay's events."""
    first = [F.col(c).asc_nulls_first() for c in ("time", "priority", *["stage"] * stage, "src", "code", "value", "value_cat")]
    return first


def ordered(log: DataFrame) -> DataFrame:
    """Number a stay's events from 0. One shuffle by stay serves this and every later step of the stay."""
    log = log.withColumn("priority", modality_priority(F.col("modality")))
    if "stage" not in log.columns:
        log = log.withColumn("stage", F.lit(0))
    by = Window.partitionBy("hospitalization_id").orderBy(*ordering())
    return log.withColumn("event_idx", F.row_number().over(by) - 1)
