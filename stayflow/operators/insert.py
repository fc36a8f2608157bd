"""What is put into a stay's log after extraction: labels, waveform events, clock tokens, then gaps in the final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions import constants as C
from stayflow.functions.expressions import gap_token, in_stay
from stayflow.operators.extract import modality_priority, ordering

LOG = ("hospitalization_id", "time", "code", "value", "value_cat", "modality", "src", "stage")
LABEL_STAGE, ECG_STAGE, CLOCK_STAGE = 1, 2, 3


def _row(df: DataFrame, time: Column, code: Column, name: str, stage: int, value: Column | None = None, src: Column | None = None) -> DataFrame:
    no = F.lit(None)
    return df.select(
        "hospitalization_id", time.alias("time"), code.alias("code"), (no if value is None else value).cast("double").alias("value"), no.cast("string").alias("value_cat"),
        F.lit(name).alias("modality"), (F.lit(0) if src is None else src).alias("src"), F.lit(stage).alias("stage"),
    )


def first_occurrences(labels: DataFrame) -> DataFrame:
    """One row per stay and label: its earliest time."""
    return labels.groupBy("hospitalization_id", "code").agg(F.min("time").alias("time"))


def label_events(labels: DataFrame) -> DataFrame:
    return _row(first_occurrences(labels), F.col("time"), F.col("code"), "LABEL", LABEL_STAGE)


def ecg_in_window(ecg: DataFrame, ids: DataFrame, stays: DataFrame, days: int = 7) -> DataFrame:
    """Recordings of the stays, from `days` before admission to discharge, both inclusive."""
    bounds = stays.select("hospitalization_id", "admission_dttm", "discharge_dttm")
    joined = ecg.join(ids, "hadm_id").join(bounds, "hospitalization_id")
    start = F.col("admission_dttm") - F.expr(f"interval '{days}' day")
    return joined.where(in_stay(F.col("ecg_time"), start, F.col("discharge_dttm"))).drop("admission_dttm", "discharge_dttm")


def ecg_events(ecg: DataFrame, route: str = "all_branches") -> DataFrame:
    """Up to seven events per recording; class first, then prototype and similarity of each branch that the route has."""
    no = F.lit(None)
    label = F.coalesce("top1class", F.lit("None")) if "top1class" in ecg.columns else F.lit("UNKNOWN")
    made: list[tuple[Column, Column, Column]] = []
    if route != "no_ecg":
        made.append((F.lit(True), F.concat(F.lit("ECG//Class/"), label), F.col("top1score") if "top1score" in ecg.columns else no))
        branches = [("1D", "1d_prototype_num", "1d_similarity")]
        if route == "all_branches":
            branches += [("2D_Morphology", "2d_partial_prototype_num", "2d_partial_similarity"), ("2D_Global", "2d_global_prototype_num", "2d_global_similarity")]
        for name, prototype, similarity in branches:
            p, s = (F.col(f"`{c}`") for c in (prototype, similarity))
            made.append((p.isNotNull(), F.concat(F.lit(f"ECG//Prototype/{name}/"), p.cast("bigint").cast("string")), no))
            made.append((s.isNotNull(), F.lit(f"ECG//Similarity/{name}"), s))
    if not made:
        return _row(ecg.where(F.lit(False)), F.col("ecg_time"), F.lit(""), "ECG", ECG_STAGE)
    items = F.array(*[F.struct(keep.alias("keep"), F.lit(i).alias("src"), code.alias("code"), value.cast("double").alias("value")) for i, (keep, code, value) in enumerate(made)])
    rows = ecg.select("hospitalization_id", "ecg_time", F.inline(F.filter(items, lambda x: x.keep)))
    return _row(rows, F.col("ecg_time"), F.col("code"), "ECG", ECG_STAGE, F.col("value"), F.col("src"))


def clock_events(stays: DataFrame, hours: int = C.CLOCK_HOURS) -> DataFrame:
    """A token at each multiple of `hours` of the day from admission to discharge. hours divides 24."""
    if 24 % hours:
        raise ValueError("hours must divide 24")
    step = hours * 3_600_000_000
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("admission_dttm"))
    first = F.timestamp_add("MICROSECOND", F.ceil(since / step) * step, F.lit("1970-01-01").cast("timestamp_ntz"))
    rows = stays.where("admission_dttm is not null and discharge_dttm is not null").withColumn("first", first).where("first <= discharge_dttm")
    rows = rows.select("hospitalization_id", F.explode(F.sequence("first", "discharge_dttm", F.expr(f"interval '{hours}' hour"))).alias("clock"))
    return _row(rows, F.col("clock"), F.date_format("clock", "'CLOCK//'HH:mm"), "CLOCK", CLOCK_STAGE)


def with_gaps(log: DataFrame, edges: list[int] | None = None, gaps: bool = True, parts: int | None = None) -> DataFrame:
    """The final log: events in order, before each a gap token if a minute or more went by, numbered from 0.

    One window by stay orders the events; a gap stands at its event's time, right before it, and the numbers are running
    counts of what each event brings, so nothing is sorted again. With `parts`, stays are dealt into so many partitions, as
    a table in buckets wants them.
    """
    if parts:
        log = log.repartition(parts, "hospitalization_id")
    by = Window.partitionBy("hospitalization_id").orderBy(*ordering())
    rows = log.withColumn("priority", modality_priority(F.col("modality")))
    minutes = F.timestamp_diff("MICROSECOND", F.lag("time").over(by), F.col("time")) / 60_000_000.0
    rows = rows.withColumn("gap", gap_token(minutes, edges) if gaps else F.lit(None).cast("string"))
    rows = rows.withColumn("last", F.sum(F.when(F.col("gap").isNull(), 1).otherwise(2)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.struct((F.col("last") - 1).cast("int").alias("event_idx"), "time", "code", "value", "value_cat", "modality")
    gap = F.struct((F.col("last") - 2).cast("int").alias("event_idx"), F.col("time"), F.col("gap").alias("code"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("value_cat"), F.lit("DT").alias("modality"))
    return rows.select("hospitalization_id", F.inline(F.when(F.col("gap").isNull(), F.array(own)).otherwise(F.array(gap, own))))


def full_log(base: DataFrame, stays: DataFrame, labels: DataFrame | None = None, ecg: DataFrame | None = None, time_tokens: bool = True, edges: list[int] | None = None, clock_hours: int = C.CLOCK_HOURS, parts: int | None = None) -> DataFrame:
    """Labels, then waveforms, then clocks join the base events; gaps are taken over the merged order."""
    log = base.withColumn("stage", F.lit(0)).select(*LOG)
    known = stays.select("hospitalization_id").distinct()
    if labels is not None:
        log = log.unionByName(label_events(labels).join(known, "hospitalization_id", "left_semi"))
    if ecg is not None:
        log = log.unionByName(ecg)
    if time_tokens:
        log = log.unionByName(clock_events(stays, clock_hours))
    return with_gaps(log, edges, gaps=time_tokens, parts=parts)
