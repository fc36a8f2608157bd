"""Outcome labels: a registry of rules, compiled to one aggregation per source table.

A row rule is a condition on the rows of one table; the label's time is the first time at which it holds. An order rule is
a fold over a stay's rows of one table, sorted by its columns (time first, the others break ties). All rules of a table,
of both kinds, come from one scan and one shuffle. Labels that look beyond a stay have builders of their own. All give
(hospitalization_id, code, time).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayflow.functions import constants as C
from stayflow.operators.extract import code_status_rows
from stayflow.sources.catalog import Catalog


@dataclass(frozen=True)
class Label:
    """A row rule: `when` is SQL on the table's columns, `time` the column that gives the time."""

    name: str
    table: str = ""
    when: str = ""
    time: str = "recorded_dttm"
    category: str = "source_only"

    @property
    def code(self) -> str:
        return f"LABEL//{self.name}"


@dataclass(frozen=True)
class OrderLabel(Label):
    """An order rule: `fold` makes the label's time (or null) of a stay's rows that meet `when`, an array of structs of
    `columns`, sorted by them with nulls first. With `stay`, fold gets columns of the stay as well."""

    columns: tuple[str, ...] = ()
    fold: Callable[..., Column] | None = None
    stay: tuple[str, ...] = ()


def _vital(name: str, test: str) -> str:
    return f"vital_category = '{name}' and vital_value {test}"


def _lab(name: str, test: str) -> str:
    return f"lab_category = '{name}' and lab_value_numeric {test}"


def _score(name: str, test: str) -> str:
    return f"assessment_category = '{name}' and numerical_value {test}"


HOSP, RESP, MEDS, LABS = "hospitalization", "respiratory_support", "medication_admin_continuous", "labs"
_ROWS: dict[tuple[str, str], dict[str, str]] = {
    (HOSP, "discharge_dttm"): {
        "mortality": "discharge_category = 'Expired'",
        "mortality_or_hospice": "discharge_category in ('Expired', 'Hospice')",
        "discharge_home": "discharge_category = 'Home'",
        "discharge_snf": "discharge_category like '%Skilled Nursing%'",
        "discharge_ltach": "discharge_category = 'LTACH'",
        "discharge_hospice": "discharge_category = 'Hospice'",
        "discharge_acute": "discharge_category = 'Acute Care Hospital'",
    },
    ("adt", "in_dttm"): {"stepdown_admission": "location_category = 'stepdown'"},
    (RESP, "recorded_dttm"): {
        "mech_vent": "device_category = 'IMV'",
        "new_intubation": "device_category = 'IMV' and tracheostomy = false",
        "nippv": "device_category = 'NIPPV'",
        "hfnc": "device_category = 'High Flow NC'",
        "high_fio2": "fio2_set > 0.6",
    },
    ("vitals", "recorded_dttm"): {
        "hypoxemia": _vital("spo2", "< 88"),
        "hypotension": _vital("mbp", "< 65"),
        "tachycardia": _vital("hr", "> 120"),
        "bradycardia": _vital("hr", "< 50"),
    },
    ("position", "recorded_dttm"): {"prone": "position_category = 'prone'"},
    (MEDS, "admin_dttm"): {"vasopressor": "med_group = 'vasoactives' and mar_action_category not in ('stop', 'paused', 'held')"},
    ("ecmo_mcs", "recorded_dttm"): {"ecmo": "true"},
    ("crrt_therapy", "recorded_dttm"): {"crrt": "true"},
    (LABS, "lab_result_dttm"): {
        "hyperkalemia": _lab("potassium", "> 6.0"),
        "severe_hyperkalemia": _lab("potassium", "> 6.5"),
        "hypoglycemia": _lab("glucose", "< 50"),
        "severe_anemia": _lab("hemoglobin", "< 7"),
        "thrombocytopenia": _lab("platelets", "< 50000"),
        "lactate_elevated": _lab("lactate", "> 2"),
        "lactate_severe": _lab("lactate", "> 4"),
        "coagulopathy": _lab("inr", "> 2"),
        "acidosis": _lab("ph", "< 7.25"),
        "troponin_elevated": "lab_category in ('troponin_t', 'troponin_i') and lab_value_numeric > 0.04",
        "bnp_elevated": _lab("bnp", "> 300"),
    },
    ("patient_assessments", "recorded_dttm"): {
        "gcs_low": _score("gcs_total", "< 8"),
        "braden_low": _score("braden_total", "<= 12"),
        "delirium": "assessment_category = 'cam_icu' and (lower(categorical_value) like '%positive%' or numerical_value = 1)",
    },
    ("code_status", "start_dttm"): {"dnr": "code_status_category in ('DNR', 'DNAR', 'CMO', 'Comfort Measures Only')"},
}
ROW_LABELS = tuple(Label(name, table, when, time) for (table, time), rules in _ROWS.items() for name, when in rules.items())


def _never() -> Column:
    return F.lit(None).cast("timestamp_ntz")


def first_in_icu(rows: Column) -> Column:
    """First time in intensive care of stays that did not begin there. A stay whose first location is null counts as not."""
    there = F.filter(rows, lambda x: x.location_category == "icu")
    began = F.coalesce(F.get(rows, F.lit(0)).location_category == "icu", F.lit(False))
    return F.when(~began, F.get(there, F.lit(0)).in_dttm)


def icu_lasts(days: int) -> Callable[[Column, dict[str, Column]], Column]:
    """When the summed time in intensive care reaches the limit; open ends close at discharge."""
    limit = days * 24 * 3_600_000_000

    def fold(rows: Column, stay: dict[str, Column]) -> Column:
        def step(a: Column, x: Column) -> Column:
            lasted = F.coalesce(F.timestamp_diff("MICROSECOND", x.in_dttm, F.coalesce(x.out_dttm, stay["discharge_dttm"])), F.lit(0))
            reached = F.timestamp_add("MICROSECOND", F.lit(limit) - a.spent, x.in_dttm)
            return F.struct((a.spent + lasted).alias("spent"), F.when(a.at.isNull() & (a.spent + lasted >= limit), reached).otherwise(a.at).alias("at"))

        start = F.struct(F.lit(0).cast("long").alias("spent"), _never().alias("at"))
        return F.aggregate(F.filter(rows, lambda x: x.location_category == "icu"), start, step, lambda a: a.at)

    return fold


def _severity(device: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in C.SEVERITY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(device, F.lit(""))), F.lit(0))


def escalates(rows: Column) -> Column:
    """Two levels of respiratory support or more between neighbouring rows within a day."""

    def step(a: Column, x: Column) -> Column:
        level, time = _severity(x.device_category), x.recorded_dttm
        hit = (level - a.level >= 2) & (time <= a.since + F.expr("interval '24' hour"))
        return F.struct(level.alias("level"), time.alias("since"), F.coalesce(a.at, F.when(hit, time)).alias("at"))

    start = F.struct(F.lit(None).cast("int").alias("level"), _never().alias("since"), _never().alias("at"))
    return F.aggregate(rows, start, step, lambda a: a.at)


def reintubated(hours: int = 48) -> Callable[[Column], Column]:
    """Ventilated again within hours of the row that ended ventilation; stays with three rows or more."""

    def step(a: Column, x: Column) -> Column:
        vent, time = x.device_category.eqNullSafe(F.lit("IMV")), x.recorded_dttm
        hit = vent & ~a.vent & (time <= a.ended + F.expr(f"interval '{hours}' hour"))
        ended = F.when(~vent & a.vent, time).otherwise(a.ended)
        return F.struct(vent.alias("vent"), ended.alias("ended"), F.coalesce(a.at, F.when(hit, time)).alias("at"))

    start = lambda: F.struct(F.lit(False).alias("vent"), _never().alias("ended"), _never().alias("at"))
    return lambda rows: F.when(F.size(rows) >= 3, F.aggregate(rows, start(), step, lambda a: a.at))


def rises(factor: float = 1.5) -> Callable[[Column], Column]:
    """First value of `factor` times the first one or more; the first must be positive and not the only one."""

    def fold(rows: Column) -> Column:
        base = F.get(rows, F.lit(0)).lab_value_numeric
        hits = F.filter(rows, lambda x: x.lab_value_numeric >= base * factor)
        return F.when((F.size(rows) >= 2) & (base > 0), F.array_min(F.transform(hits, lambda x: x.lab_result_dttm)))

    return fold


_PLACES, _DEVICES = ("in_dttm", "location_category", "out_dttm"), ("recorded_dttm", "device_category")


def order_labels() -> tuple[OrderLabel, ...]:
    """The order rules of the data model."""
    placed = {"table": "adt", "when": "in_dttm is not null", "time": "in_dttm", "columns": _PLACES}
    devices = {"table": RESP, "when": "true", "columns": _DEVICES}
    creatinine = "lab_category = 'creatinine' and lab_value_numeric is not null"
    return (
        OrderLabel("icu_admission", fold=first_in_icu, **placed),
        OrderLabel("prolonged_icu_7d", fold=icu_lasts(7), stay=("discharge_dttm",), **placed),
        OrderLabel("prolonged_icu_14d", fold=icu_lasts(14), stay=("discharge_dttm",), **placed),
        OrderLabel("resp_escalation", fold=escalates, **devices),
        OrderLabel("reintubation_48h", fold=reintubated(), **devices),
        OrderLabel("creatinine_rise", LABS, creatinine, "lab_result_dttm", columns=("lab_result_dttm", "lab_value_numeric"), fold=rises()),
    )


ORDER_LABELS = order_labels()
PARTIAL_LABELS = tuple(Label(n, category="partial") for n in ("readmit_30d", "readmit_7d", "abnormal_troponin_30d"))
#: Registered without a rule: they need sources that are not among the tables, and are never found.
EXTERNAL_LABELS = tuple(
    Label(n, category="external")
    for n in (
        "sepsis3", "aki_kdigo_1", "aki_kdigo_2", "aki_kdigo_3", "qsofa_2", "cardiac_arrest", "transfusion", "dialysis", "central_line",
        "charlson_high", "elixhauser_high", "phecode_chf", "phecode_copd", "phecode_diabetes", "phecode_ckd", "phecode_cancer",
    )
)
REGISTRY: dict[str, Label] = {s.name: s for s in (*ROW_LABELS, *ORDER_LABELS, *PARTIAL_LABELS, *EXTERNAL_LABELS)}


def register(label: Label) -> None:
    """Add a row rule or an order rule of one's own; it is computed with the others of its table."""
    REGISTRY[label.name] = label


def names(categories: tuple[str, ...] = ("source_only", "partial")) -> list[str]:
    return [s.name for s in REGISTRY.values() if s.category in categories]


def tokens(categories: tuple[str, ...] = ("source_only", "partial")) -> list[str]:
    return [REGISTRY[n].code for n in names(categories)]


def _of_table(t: Catalog, name: str, rules: list[Label]) -> DataFrame:
    """The labels of one table: one aggregation by stay, of first times and of sorted rows, which order rules fold."""
    rows = code_status_rows(t) if name == "code_status" else t[name]
    if name == RESP and "tracheostomy" not in t.own.get(RESP, {"tracheostomy"}):
        rows = rows.withColumn("tracheostomy", F.lit(False))  # without the column any intubation counts
    ordered = [s for s in rules if isinstance(s, OrderLabel)]
    kept = list(dict.fromkeys((s.when, s.columns) for s in ordered))
    first = [F.min(F.when(F.expr(s.when), F.col(s.time))).alias(s.name) for s in rules if not isinstance(s, OrderLabel)]
    arrays = [F.sort_array(F.collect_list(F.when(F.expr(when), F.struct(*columns)))).alias(f"rows_{i}") for i, (when, columns) in enumerate(kept)]
    found = rows.groupBy("hospitalization_id").agg(*first, *arrays)
    stay = sorted({c for s in ordered for c in s.stay})
    if stay:
        found = found.join(t[HOSP].select("hospitalization_id", *stay), "hospitalization_id")

    def time(s: Label) -> Column:
        if not isinstance(s, OrderLabel):
            return F.col(s.name)
        own = F.col(f"rows_{kept.index((s.when, s.columns))}")
        return s.fold(own, {c: F.col(c) for c in s.stay}) if s.stay else s.fold(own)

    long = F.array(*[F.struct(F.lit(s.code).alias("code"), time(s).alias("time")) for s in rules])
    return found.select("hospitalization_id", F.inline(F.filter(long, lambda x: x.time.isNotNull())))


def of(t: Catalog, wanted: Iterable[str]) -> DataFrame:
    """The labels of these names that have a rule, at most one row per stay and label. Null times do not count."""
    tables: dict[str, list[Label]] = {}
    for s in (REGISTRY[n] for n in dict.fromkeys(wanted)):
        if s.table:
            tables.setdefault(s.table, []).append(s)
    parts = [_of_table(t, n, rules) for n, rules in tables.items()]
    if days := [d for n, d in READMISSIONS.items() if n in set(wanted)]:
        parts.append(readmission(t, *days))
    none = t.spark.createDataFrame([], "hospitalization_id string, code string, time timestamp_ntz")
    return reduce(DataFrame.unionByName, parts) if parts else none


def row_labels(t: Catalog, table: str | None = None) -> DataFrame:
    """All row rules, or those of one table."""
    return of(t, [s.name for s in REGISTRY.values() if s.table and not isinstance(s, OrderLabel) and table in (None, s.table)])


#: Labels that look at a patient's later stays, and their days.
READMISSIONS = {"readmit_30d": 30, "readmit_7d": 7}


def readmission(t: Catalog, *days: int) -> DataFrame:
    """Stays whose patient is admitted again after discharge and within days of it; the time is the discharge.

    A self-join on the patient would pair all stays of a patient; the next admission after the discharge decides alone,
    so the admissions and discharges of a patient are merged in order and looked ahead, once for all limits.
    """
    stays = t[HOSP]
    ends = stays.where("discharge_dttm is not null").select("patient_id", "hospitalization_id", F.col("discharge_dttm").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("admit"))
    begins = stays.where("admission_dttm is not null").select("patient_id", F.lit(None).cast("string").alias("hospitalization_id"), F.col("admission_dttm").alias("at"), F.lit(0).alias("kind"), F.col("admission_dttm").alias("admit"))
    # from the last to the first, so that the frame only grows; an admission at the time of the discharge is not after it
    by = Window.partitionBy("patient_id").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    marks = ends.unionByName(begins).withColumn("next", F.last("admit", ignorenulls=True).over(by))
    within = [F.when(F.col("next") <= F.col("at") + F.expr(f"interval '{d}' day"), F.lit(f"LABEL//readmit_{d}d")) for d in days]
    rows = marks.where((F.col("kind") == 1) & F.col("next").isNotNull() & F.col("patient_id").isNotNull())
    return rows.select("hospitalization_id", F.explode(F.array_compact(F.array(*within))).alias("code"), F.col("at").alias("time")).distinct()


def all_labels(t: Catalog, categories: tuple[str, ...] = ("source_only", "partial")) -> DataFrame:
    """Every label of the categories, at most one row per stay and label."""
    return of(t, names(categories))
