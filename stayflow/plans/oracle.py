"""DuckDB SQL for the catalogue's queries, on the same test tables.

Written apart from the Spark plans it is held against: rules, thresholds and buckets are spelled out here once more, so
that a wrong one shows. Shared are the test tables, the names of special tokens and of clinical edges' codes.
"""

from __future__ import annotations

import math

from stayflow.functions import constants as C
from stayflow.sources.adapter import event_ctes

MIN_EVENTS, MIN_STAYS, SAMPLES, MAX_LEN, OVERLAP, BUDGET = 20, 5, 4, 32, 8, 256
HORIZONS = (8, 24, 48)


def quantile_ctes(name: str, values: str, key: str = "code", n_bins: int = 10) -> str:
    """{name}_q: (key, i, edge) and {name}_edges: (key, edge_idx, edge), distinct edges in order."""
    return f"""
{name}_v as ({values}),
{name}_r as materialized (select {key}, value, row_number() over w - 1 as r, lead(value, 1, value) over w as next from {name}_v where value is not null window w as (partition by {key} order by value)),
{name}_h as materialized (select {key}, n, i, (n - 1) * ((100.0::double * i / {n_bins}) / 100) as h from (select {key}, count(*) as n from {name}_v where value is not null group by 1) t, range(0, {n_bins} + 1) b(i) where n >= {n_bins}),
{name}_q as (
  select h.{key}, i, case when h - floor(h) < 0.5 then value + (next - value) * (h - floor(h)) else next - (next - value) * (1 - (h - floor(h))) end as edge
  from {name}_r r join {name}_h h on r.{key} = h.{key} and r.r = floor(h.h)::bigint),
{name}_edges as (select {key}, row_number() over (partition by {key} order by edge) - 1 as edge_idx, edge from (select distinct {key}, edge from {name}_q))"""


#: table, time and rules of the row labels.
_RULES = """
hospitalization discharge_dttm
  mortality: discharge_category = 'Expired'
  mortality_or_hospice: discharge_category = 'Expired' or discharge_category = 'Hospice'
  discharge_home: discharge_category = 'Home'
  discharge_snf: contains(discharge_category, 'Skilled Nursing')
  discharge_ltach: discharge_category = 'LTACH'
  discharge_hospice: discharge_category = 'Hospice'
  discharge_acute: discharge_category = 'Acute Care Hospital'
adt in_dttm
  stepdown_admission: location_category = 'stepdown'
respiratory_support recorded_dttm
  mech_vent: device_category = 'IMV'
  new_intubation: device_category = 'IMV' and not tracheostomy
  nippv: device_category = 'NIPPV'
  hfnc: device_category = 'High Flow NC'
  high_fio2: fio2_set > 0.6::double
vitals recorded_dttm
  hypoxemia: vital_category = 'spo2' and vital_value < 88
  hypotension: vital_category = 'mbp' and vital_value < 65
  tachycardia: vital_category = 'hr' and vital_value > 120
  bradycardia: vital_category = 'hr' and vital_value < 50
position_t recorded_dttm
  prone: position_category = 'prone'
medication_admin_continuous admin_dttm
  vasopressor: med_group = 'vasoactives' and mar_action_category not in ('stop', 'paused', 'held')
ecmo_mcs recorded_dttm
  ecmo: true
crrt_therapy recorded_dttm
  crrt: true
labs lab_result_dttm
  hyperkalemia: lab_category = 'potassium' and lab_value_numeric > 6
  severe_hyperkalemia: lab_category = 'potassium' and lab_value_numeric > 6.5::double
  hypoglycemia: lab_category = 'glucose' and lab_value_numeric < 50
  severe_anemia: lab_category = 'hemoglobin' and lab_value_numeric < 7
  thrombocytopenia: lab_category = 'platelets' and lab_value_numeric < 50000
  lactate_elevated: lab_category = 'lactate' and lab_value_numeric > 2
  lactate_severe: lab_category = 'lactate' and lab_value_numeric > 4
  coagulopathy: lab_category = 'inr' and lab_value_numeric > 2
  acidosis: lab_category = 'ph' and lab_value_numeric < 7.25::double
  troponin_elevated: lab_category in ('troponin_t', 'troponin_i') and lab_value_numeric > 0.04::double
  bnp_elevated: lab_category = 'bnp' and lab_value_numeric > 300
patient_assessments recorded_dttm
  gcs_low: assessment_category = 'gcs_total' and numerical_value < 8
  braden_low: assessment_category = 'braden_total' and numerical_value <= 12
  delirium: assessment_category = 'cam_icu' and (categorical_value ilike '%positive%' or numerical_value = 1)
STAYS start_dttm
  dnr: code_status_category in ('DNR', 'DNAR', 'CMO', 'Comfort Measures Only')
"""
_WHITELIST = "'LAB_RESULT//troponin_t', 'LAB_RESULT//troponin_i', 'LAB_RESULT//bnp', 'LAB_RESULT//procalcitonin', 'LAB_RESULT//lactate', 'LAB_RESULT//d_dimer', 'RESP//IMV', 'CRRT//cvvh', 'ECMO//ECMO', 'CODE_STATUS//DNR', 'POSITION//prone'"
_COUNTS = " union all ".join(
    f"select '{p}//' || {c} as code, count(*) as event_count, count(distinct hospitalization_id) as admission_count from {t} where hospitalization_id in (select hospitalization_id from train) group by 1"
    for t, c, p in (("vitals", "vital_category", "VITAL"), ("labs", "lab_category", "LAB_RESULT"), ("medication_admin_continuous", "med_category", "MED_CONT"), ("medication_admin_intermittent", "med_category", "MED_BOLUS"), ("patient_assessments", "assessment_category", "ASSESS"), ("patient_procedures", "procedure_code", "PROC"), ("hospital_diagnosis", "diagnosis_code", "ICD"))
)
_VALUES = " union all ".join(
    f"select '{p}//' || {c} as code, {v} as value from {t} where hospitalization_id in (select hospitalization_id from train) and {v} is not null"
    for t, c, p, v in (("vitals", "vital_category", "VITAL", "vital_value"), ("labs", "lab_category", "LAB_RESULT", "lab_value_numeric"), ("medication_admin_continuous", "med_category", "MED_CONT", "med_dose"), ("medication_admin_intermittent", "med_category", "MED_BOLUS", "med_dose"))
)
_IN = lambda prefix, column: f"('{prefix}//' || {column}) in (select code from profile where included)"
_STOP = "(mar_action_category in ('stop', 'paused', 'held') or med_dose is null or med_dose = 0)"
_AGE = "case when age_at_admission < 30 then '18-29' when age_at_admission >= 80 then '80+' else (age_at_admission // 10 * 10)::varchar || '-' || (age_at_admission // 10 * 10 + 9)::varchar end"


def _branch(src: int, table: str, time: str, code: str, value: str = "null", where: str = "true", cat: str = "null") -> str:
    return f"select hospitalization_id, {time} as time, {code} as code, ({value})::double as value, ({cat})::varchar as value_cat, {src} as src from {table} where {where}"


_STAY_CODES = "(select c.start_dttm, c.code_status_category, h.hospitalization_id from code_status c join hospitalization h on c.patient_id = h.patient_id and c.start_dttm between h.admission_dttm and h.discharge_dttm)"
_BRANCHES = [
    _branch(11, "hospitalization", "admission_dttm", f"'DEMO//AGE_' || {_AGE}", where="age_at_admission is not null"),
    _branch(12, "hospitalization left join patient using (patient_id)", "admission_dttm", "'DEMO//SEX_' || sex_category", where="sex_category <> ''"),
    _branch(13, "hospitalization left join patient using (patient_id)", "admission_dttm", "'DEMO//RACE_' || race_category", where="race_category <> ''"),
    _branch(20, "hospital_diagnosis join hospitalization using (hospitalization_id)", "admission_dttm", "'ICD_POA//' || diagnosis_code", where="poa_present = 1"),
    _branch(30, "adt", "in_dttm", "'ADT//' || location_category"),
    _branch(40, "vitals", "recorded_dttm", "'VITAL//' || vital_category", "vital_value", _IN("VITAL", "vital_category")),
    _branch(50, "labs", "coalesce(lab_order_dttm, lab_collect_dttm)", "'LAB_ORDER//' || lab_category", where=_IN("LAB_RESULT", "lab_category") + " and coalesce(lab_order_dttm, lab_collect_dttm) is not null"),
    _branch(60, "labs", "coalesce(lab_result_dttm, lab_collect_dttm)", "'LAB_RESULT//' || lab_category", "lab_value_numeric", _IN("LAB_RESULT", "lab_category") + " and lab_value_numeric is not null and coalesce(lab_result_dttm, lab_collect_dttm) is not null"),
    _branch(70, "medication_admin_continuous", "admin_dttm", "'MED_CONT_STOP//' || med_category", where=_STOP),
    _branch(80, "medication_admin_continuous", "admin_dttm", "'MED_CONT//' || med_category", "med_dose", f"not {_STOP} and " + _IN("MED_CONT", "med_category")),
    _branch(90, "medication_admin_intermittent", "admin_dttm", "'MED_BOLUS//' || med_category", "med_dose", _IN("MED_BOLUS", "med_category")),
    _branch(100, "respiratory_support", "recorded_dttm", "'RESP//' || coalesce(device_category, 'unknown')"),
    *[_branch(110 + i, "respiratory_support", "recorded_dttm", f"'RESP_PARAM//{n}'", c, f"{c} is not null") for i, (n, c) in enumerate((("fio2", "fio2_set"), ("peep", "peep_set"), ("tidal_volume", "tidal_volume_set"), ("resp_rate_set", "resp_rate_set")))],
    _branch(120, "patient_assessments", "recorded_dttm", "'ASSESS//' || assessment_category", "numerical_value", _IN("ASSESS", "assessment_category"), "categorical_value"),
    _branch(130, _STAY_CODES, "start_dttm", "'CODE_STATUS//' || code_status_category"),
    _branch(140, "position_t", "recorded_dttm", "'POSITION//' || position_category"),
    _branch(150, "crrt_therapy", "recorded_dttm", "'CRRT//' || coalesce(crrt_mode_category, 'unknown')"),
    _branch(151, "crrt_therapy", "recorded_dttm", "'CRRT_PARAM//blood_flow'", "blood_flow_rate", "blood_flow_rate is not null"),
    _branch(152, "crrt_therapy", "recorded_dttm", "'CRRT_PARAM//uf_out'", "ultrafiltration_out", "ultrafiltration_out is not null"),
    _branch(160, "ecmo_mcs", "recorded_dttm", "'ECMO//' || coalesce(device_category, 'ECMO')"),
    _branch(161, "ecmo_mcs", "recorded_dttm", "'ECMO_PARAM//flow'", "flow", "flow is not null"),
    _branch(170, "patient_procedures", "procedure_billed_dttm", "'PROC//' || procedure_code", where="procedure_billed_dttm is not null and " + _IN("PROC", "procedure_code")),
    _branch(181, "hospitalization", "discharge_dttm", "'DISCH//GENERAL'", where="discharge_dttm is not null"),
    _branch(182, "hospitalization", "discharge_dttm", "'DISCH//' || discharge_category", where="discharge_dttm is not null and discharge_category <> ''"),
    _branch(190, "hospital_diagnosis join hospitalization using (hospitalization_id)", "discharge_dttm + interval 1 minute", "'ICD//' || diagnosis_code", where="discharge_dttm is not null"),
]
_PRIORITY = "case split_part(code, '//', 1) when 'DEMO' then 0 when 'ICD_POA' then 1 when 'CLOCK' then 1 when 'ECG' then 2.5 when 'LABEL' then 3 when 'DISCH' then 4 when 'ICD' then 5 else 2 end"
_ORDER = "time nulls first, prio, stage, src, code nulls first, value nulls first, value_cat nulls first"

def _row_labels() -> str:
    parts, table, time = [], "", ""
    for line in _RULES.strip().splitlines():
        if line[0] != " ":
            table, time = line.replace("STAYS", _STAY_CODES).rsplit(" ", 1)
        else:
            name, rule = line.strip().split(": ", 1)
            parts.append(f"select hospitalization_id, 'LABEL//{name}' as code, min({time}) as time from {table} where {rule} group by 1")
    return " union all ".join(parts)


_ROW_LABELS = _row_labels()
_LEVEL = "case when device_category = 'IMV' then 4 when device_category = 'NIPPV' then 3 when device_category in ('CPAP', 'High Flow NC') then 2 when device_category in ('Nasal Cannula', 'Face Mask') then 1 else 0 end"


def _prolonged(days: int) -> str:
    us = days * 86_400_000_000
    return f"""select hospitalization_id, 'LABEL//prolonged_icu_{days}d' as code, (list(in_dttm + to_microseconds({us} - (upto - lasted)) order by upto))[1] as time from (
  select *, sum(lasted) over (partition by hospitalization_id order by in_dttm, out_dttm nulls first rows unbounded preceding)::bigint as upto from (
    select a.hospitalization_id, in_dttm, out_dttm, date_diff('microsecond', in_dttm, coalesce(out_dttm, discharge_dttm)) as lasted from adt a join hospitalization h using (hospitalization_id) where location_category = 'icu')
  ) where upto >= {us} group by 1"""


def _readmit(days: int) -> str:
    return f"select hospitalization_id, 'LABEL//readmit_{days}d' as code, discharge_dttm as time from hospitalization h where exists (select 1 from hospitalization o where o.patient_id = h.patient_id and o.admission_dttm > h.discharge_dttm and o.admission_dttm <= h.discharge_dttm + interval {days} day)"


ORDER_LABELS = {
    "icu": "select hospitalization_id, 'LABEL//icu_admission' as code, min(in_dttm) filter (location_category = 'icu') as time from adt where in_dttm is not null group by 1 having (list(location_category order by in_dttm, location_category nulls first, out_dttm nulls first))[1] is distinct from 'icu' and time is not null",
    "prolonged": _prolonged(7) + " union all " + _prolonged(14),
    "escalation": f"select hospitalization_id, 'LABEL//resp_escalation' as code, min(recorded_dttm) as time from (select *, {_LEVEL} as lv, lag({_LEVEL}) over w as lp, lag(recorded_dttm) over w as tp from respiratory_support window w as (partition by hospitalization_id order by recorded_dttm nulls first, device_category nulls first)) where lv - lp >= 2 and recorded_dttm - tp <= interval 24 hour group by 1",
    "reintubation": "select hospitalization_id, 'LABEL//reintubation_48h' as code, min(recorded_dttm) as time from (select *, last_value(case when dev is distinct from 'IMV' and was is not distinct from 'IMV' then recorded_dttm end ignore nulls) over (partition by hospitalization_id order by recorded_dttm nulls first, dev nulls first rows between unbounded preceding and 1 preceding) as ended from (select hospitalization_id, recorded_dttm, device_category as dev, lag(device_category) over (partition by hospitalization_id order by recorded_dttm nulls first, device_category nulls first) as was, count(*) over (partition by hospitalization_id) as n from respiratory_support)) where n >= 3 and dev = 'IMV' and was is distinct from 'IMV' and recorded_dttm - ended <= interval 48 hour group by 1",
    "creatinine": "select hospitalization_id, 'LABEL//creatinine_rise' as code, min(lab_result_dttm) as time from (select *, first_value(lab_value_numeric) over (partition by hospitalization_id order by lab_result_dttm nulls first, lab_value_numeric) as base, count(*) over (partition by hospitalization_id) as n from labs where lab_category = 'creatinine' and lab_value_numeric is not null) where n >= 2 and base > 0 and lab_value_numeric >= base * 1.5::double group by 1 having min(lab_result_dttm) is not null",
    "readmission": _readmit(30) + " union all " + _readmit(7),
}

_ECG = [("'ECG//Class/' || coalesce(top1class, 'None')", "top1score", "true")]
for _n, _p, _s in (("1D", "p1", "s1"), ("2D_Morphology", "p2", "s2"), ("2D_Global", "p3", "s3")):
    _ECG += [(f"'ECG//Prototype/{_n}/' || {_p}", "null", f"{_p} is not null"), (f"'ECG//Similarity/{_n}'", _s, f"{_s} is not null")]


def ecg_events(n: int) -> str:
    return " union all ".join(f"select hospitalization_id, ecg_time as time, {code} as code, ({value})::double as value, null::varchar as value_cat, {i} as src from ecg_in where {keep}" for i, (code, value, keep) in enumerate(_ECG[:n]))


_GAP = "case when m >= 1 then 'DT//' || case when m <= 5 then '1-5' when m <= 15 then '5-15' when m <= 30 then '15-30' when m <= 60 then '30-60' when m <= 120 then '60-120' when m <= 240 then '120-240' when m <= 480 then '240-480' else '480+' end end"
_SPECIAL = ", ".join(f"(0, {i}, '', '{t}')" for i, t in enumerate(C.SPECIAL_TOKENS))
_EDGES = """
VITAL//hr 0 50 60 80 100 120 150 200
VITAL//sbp 0 70 90 110 130 150 180 250
VITAL//dbp 0 40 50 60 70 80 100 140
VITAL//mbp 0 50 60 65 75 90 110 150
VITAL//resp_rate 0 8 12 16 20 25 30 40
VITAL//spo2 0 70 80 88 92 95 98 100
VITAL//temp_c 33 35 36 36.5 37.5 38 39 42
LAB_RESULT//potassium 0 2.5 3 3.5 4 5 5.5 6 7 10
LAB_RESULT//sodium 0 120 125 130 135 140 145 150 155 180
LAB_RESULT//glucose 0 40 60 70 100 140 200 300 500 1000
LAB_RESULT//creatinine 0 0.4 0.7 1 1.3 1.8 2.5 4 8 20
LAB_RESULT//lactate 0 0.5 1 1.5 2 4 6 10 20
LAB_RESULT//hemoglobin 0 5 7 8 10 12 14 16 20
LAB_RESULT//platelets 0 20 50 100 150 250 400 600 1000
LAB_RESULT//wbc 0 1 4 7 11 15 20 30 50
LAB_RESULT//troponin_t 0 0.01 0.03 0.05 0.1 0.5 1 5 50
LAB_RESULT//inr 0 0.8 1 1.2 1.5 2 3 5 10
LAB_RESULT//ph 6.8 7 7.15 7.25 7.35 7.45 7.55 7.65
LAB_RESULT//pco2 0 20 30 35 40 45 50 60 80 120
LAB_RESULT//bicarbonate 0 10 15 18 22 26 30 35 50
"""
_CLINICAL = ", ".join(f"('{code}', {edge}::double)" for code, *edges in map(str.split, _EDGES.strip().splitlines()) for edge in edges)


def vocabulary_ctes(name: str, fuse: bool) -> str:
    fused = f"union all select 3, i, code, code || '/Q_' || i from (select code, unnest(range(0, max(edge_idx))) as i from tq_edges group by code)" if fuse else ""  # noqa: F541
    return f"""
{name} as (select token, row_number() over (order by block, code, number, token) - 1 as id from (
  select * from (values {_SPECIAL}) as s(block, number, code, token)
  union all select 1, 0, code, code from (select distinct code from train_log)
  union all select 2, i, '', 'Q_' || i from range(0, greatest(10, coalesce((select max(edge_idx) from tq_edges), 10))) t(i) {fused}))"""


def tokens_ctes(name: str, vocab: str, fuse: bool) -> str:
    two = "case when mod <> 'ECG' then [code || '/Q_' || bin] else [code, 'Q_' || bin] end" if fuse else "[code, 'Q_' || bin]"
    return f"""
{name}_t as (select hospitalization_id, event_idx, time, unnest(toks) as token, generate_subscripts(toks, 1) as part from (
  select *, case when binned then {two} else [code] end as toks from (
    select *, bin is not null and mod not in ('CLOCK', 'DT') and (mod <> 'ECG' or starts_with(code, 'ECG//Similarity/')) as binned from log_bins))),
{name}_n as (select t.*, coalesce(v.id, 1) as token_id, row_number() over (partition by hospitalization_id order by event_idx, part) as pos, count(*) over (partition by hospitalization_id) as n, epoch_us(time) as ts_us from {name}_t t left join {vocab} v on t.token = v.token),
{name} as (
  select hospitalization_id, pos, token_id, ts_us from {name}_n
  union all select hospitalization_id, 0, 2, ts_us from {name}_n where pos = 1
  union all select hospitalization_id, n + 1, 3, ts_us from {name}_n where pos = n)"""


CTES = f"""with recursive {event_ctes().replace("position as (", "position_t as (", 1)},
first_admit as (select patient_id, min(admission_dttm) as first_admit from hospitalization group by 1),
split as (select patient_id, first_admit, case when rn <= floor(n * 0.77::double) then 'train' when rn <= floor(n * 0.77::double) + floor(n * 0.1::double) then 'val' else 'test' end as split
  from (select *, row_number() over (order by first_admit, patient_id) as rn, count(*) over () as n from first_admit)),
train as (select hospitalization_id from hospitalization join split using (patient_id) where split = 'train'),
counts as ({_COUNTS}),
profile as (select *, code in ({_WHITELIST}) or (event_count >= {MIN_EVENTS} and admission_count >= {MIN_STAYS}) as included from counts),
raw as ({" union all ".join(_BRANCHES)}),
base as (select r.*, {_PRIORITY} as prio, 0 as stage from raw r join hospitalization h using (hospitalization_id) where time >= admission_dttm),
base_log as materialized (select hospitalization_id, (row_number() over (partition by hospitalization_id order by {_ORDER}) - 1)::int as event_idx, time, code, value, value_cat from base),
row_labels as (select * from ({_ROW_LABELS}) where time is not null),
{"".join(f"{n}_labels as ({sql})," for n, sql in ORDER_LABELS.items())}
labels_all as (select * from row_labels {" ".join(f"union all select * from {n}_labels" for n in ORDER_LABELS)}),
first_labels as (select hospitalization_id, code, min(time) as time from labels_all group by 1, 2),
id_map as (select distinct hospitalization_id, hospitalization_id::bigint as hadm_id from hospitalization),
ecg_in as (select e.*, h.hospitalization_id from ecg e join id_map m using (hadm_id) join hospitalization h on h.hospitalization_id = m.hospitalization_id where ecg_time >= admission_dttm - interval 7 day and ecg_time <= discharge_dttm),
ecg_all as ({ecg_events(7)}),
clocks as (select hospitalization_id, c as time, strftime(c, 'CLOCK//%H:%M') as code from (select hospitalization_id, unnest(generate_series(make_timestamp(((epoch_us(admission_dttm) + 14399999999) // 14400000000) * 14400000000), discharge_dttm, interval 4 hour)) as c from hospitalization)),
merged as (
  select hospitalization_id, time, code, value, value_cat, src, prio, stage from base
  union all select hospitalization_id, time, code, null, null, 0, 3, 1 from first_labels
  union all select hospitalization_id, time, code, value, value_cat, src, 2.5, 2 from ecg_all
  union all select hospitalization_id, time, code, null, null, 0, 1, 3 from clocks),
labelled as (select hospitalization_id, (row_number() over (partition by hospitalization_id order by {_ORDER}) - 1)::int as event_idx, time, code, value, value_cat from merged where stage < 2),
placed as (select *, row_number() over (partition by hospitalization_id order by {_ORDER}) as rn, date_diff('microsecond', lag(time) over (partition by hospitalization_id order by {_ORDER}), time) / 60000000.0::double as m from merged),
gapped as (select *, {_GAP} as gap from placed),
log as materialized (select hospitalization_id, (row_number() over (partition by hospitalization_id order by rn, sub) - 1)::int as event_idx, time, code, value, value_cat, split_part(code, '//', 1) as mod from (
  select hospitalization_id, rn, 1 as sub, time, code, value, value_cat from gapped union all select hospitalization_id, rn, 0, time, gap, null, null from gapped where gap is not null)),
train_log as (select * from log where hospitalization_id in (select hospitalization_id from train)),
{quantile_ctes("tq", "select code, value from train_log")},
{quantile_ctes("nv", _VALUES)},
clinical as (select * from (values {_CLINICAL}) as c(code, edge)),
clinical_n as (select code, count(*) as n from clinical group by 1),
hybrid as (select code, row_number() over (partition by code order by edge) - 1 as edge_idx, edge from (
  select code, edge from clinical union select e.code, edge from nv_edges e left join clinical_n c using (code) where c.n is null or c.n < 11)),
bin_bounds as (
  select code, case when top = 0 then -1 else edge_idx end as bin, case when edge_idx > 0 then edge end as low, case when edge_idx < top - 1 then next end as high
  from (select code, edge_idx, edge, lead(edge) over (partition by code order by edge_idx) as next, max(edge_idx) over (partition by code) as top from tq_edges) where edge_idx < top or top = 0),
log_bins as materialized (select l.*, b.bin from log l left join bin_bounds b on l.code = b.code and l.value is not null and (low is null or value > low) and (high is null or value <= high)),
{vocabulary_ctes("vocab", False)},
{vocabulary_ctes("vocab_fused", True)},
{tokens_ctes("toks", "vocab", False)},
{tokens_ctes("toks_fused", "vocab_fused", True)},
windows as (select hospitalization_id, (w - 1)::int as window_id, pos as end_pos, ts_us as end_us from (select *, row_number() over (partition by hospitalization_id order by pos) as w from toks where token_id = (select id from vocab where token = 'CLOCK//00:00')) where w <= 7),
label_tokens as (select replace(token, 'LABEL//', '') as label, id as token_id from vocab where starts_with(token, 'LABEL//')),
truth as (select w.hospitalization_id, window_id, h::int as horizon_hours, label, exists (select 1 from toks t where t.hospitalization_id = w.hospitalization_id and t.token_id = l.token_id and t.ts_us > w.end_us and t.ts_us <= w.end_us + h * 3600000000) as actual_positive
  from windows w, (values {", ".join(f"({h})" for h in HORIZONS)}) as hs(h), label_tokens l),
samples as (select w.hospitalization_id, window_id, s::int as sample_id, coalesce(list(t.token_id order by t.pos) filter (t.token_id is not null), []) as tokens
  from windows w cross join range(0, {SAMPLES}) ss(s) left join toks t on t.hospitalization_id = w.hospitalization_id and t.pos > w.end_pos and (t.pos + s) % 2 = 0 group by 1, 2, 3),
clock_ids as (select list(id) as ids from vocab where starts_with(token, 'CLOCK//')),
cut as (select hospitalization_id, window_id, sample_id, h::int as horizon_hours, case when p is null then tokens else tokens[:p] end as tokens from (
  select s.*, h, list_filter(range(1, len(tokens) + 1), lambda i: list_contains(ids, tokens[i]))[h // 4] as p from samples s, (values {", ".join(f"({h})" for h in HORIZONS)}) as hs(h), clock_ids)),
probs as (select hospitalization_id, window_id, horizon_hours, label, avg(case when contains(label, 'mortality') then list_contains(tokens, (select id from vocab where token = 'DISCH//Expired')) else list_contains(tokens, token_id) end::int) as predicted_prob from cut, label_tokens group by 1, 2, 3, 4),
seqs as (select hospitalization_id, list(token_id order by pos) as ids, count(*) as n from toks group by 1),
chunk_rows as (select hospitalization_id, ids, n, start, row_number() over (partition by hospitalization_id order by start) - 1 as chunk from (
  select *, unnest(case when n <= {MAX_LEN} then [0] else generate_series(0, (ceil((n - {MAX_LEN}) / {MAX_LEN - OVERLAP}.0) * {MAX_LEN - OVERLAP})::bigint, {MAX_LEN - OVERLAP}) end) as start from seqs)),
chunk_list as (select hospitalization_id, chunk, start, case when start > 0 then list_concat([5], ids[start + 1:start + {MAX_LEN}])[:{MAX_LEN}] else ids[:{MAX_LEN}] end as ids from chunk_rows),
sim as (select hadm_id, ecg_time, unnest(['1D', '2D_Morphology', '2D_Global']) as branch, unnest([s1, s2, s3]) as value from ecg),
sim_all as (select * from sim where value is not null),
{quantile_ctes("sim", "select branch, value from sim_all", "branch").replace("sim_v as", "sim_w as").replace("from sim_v", "from sim_w")},
follow as (select hospitalization_id, token_id, lead(token_id) over (partition by hospitalization_id order by pos) as next_id from toks qualify next_id is not null),
bigrams as (select token_id, next_id, count(*) as n from follow where hospitalization_id in (select hospitalization_id from train) group by 1, 2),
chain as (select token_id, next_id, n / sum(n) over (partition by token_id) as share from bigrams),
step0 as (select next_id as token_id, sum(c.n * share) as expected from (select t.token_id as last, count(*) * 8.0::double as n from windows w join toks t on t.hospitalization_id = w.hospitalization_id and t.pos = w.end_pos group by 1) c join chain on token_id = last group by 1),
step1 as (select next_id as token_id, sum(expected * share) as expected from step0 join chain using (token_id) group by 1),
step2 as (select next_id as token_id, sum(expected * share) as expected from step1 join chain using (token_id) group by 1),
steps as (select 0::int as step, * from step0 union all select 1::int, * from step1 union all select 2::int, * from step2),
lens as (select len(ids) as len, row_number() over (order by len(ids)) as i from chunk_list),
all_lens as (select list(len order by i) as ls from lens),
greedy as (
  select 1::bigint as i, 0::bigint as batch, ls[1] as used from all_lens where len(ls) > 0
  union all select i + 1, case when used + ls[i + 1] > {BUDGET} then batch + 1 else batch end, case when used + ls[i + 1] > {BUDGET} then ls[i + 1] else used + ls[i + 1] end from greedy, all_lens where i < len(ls)),
preds as (select event_id, event_type as label, case k % 3 when 0 then 8 when 1 then 24 else 48 end as horizon_hours, case event_id % 3 when 0 then 'no_ecg' when 1 then 'fusion_class' else 'all_branches' end as route, (k % 11) / 10.0::double as p, value > case when event_type = 'view' then 245 else 100 end as y from ev)
"""


def _mixed(key: str) -> str:
    """A key of 28 bits with the number d of a draw."""
    return f"(({key} * 48271 + d * 69621 + 1) % 2147483647)"


def _poisson(mean: str, u: str, z: str) -> str:
    tables = "[" + ", ".join("[" + ", ".join(f"{c!r}::double" for c in _poisson_table(m)) + "]" for m in range(1, 9)) + "]"
    return f"case when {mean} <= 0 then 0 when {mean} <= 8 then len(list_filter({tables}[{mean}], lambda c: c < {u})) else greatest(0, floor({mean} + sqrt({mean}) * {z} + ({z} * {z} - 1) / 6 + 0.5)) end"


def _poisson_table(mean: int) -> list[float]:
    found, term = [], math.exp(-mean)
    for k in range(40):
        found.append((found[-1] if found else 0.0) + term)
        term *= mean / (k + 1)
    return found


#: Bootstrap of AUROC: 100 resamples, each count per (group, score, class) weighed by a Poisson number of its digest.
_ROUND = lambda c: f"(((({c} * ({c} + 2 * d + 1)) % 2147483647) * 48271 + d) % 2147483647) as {c}"
BOOTSTRAP = f""", bs as (select label, horizon_hours, p, sum(y::int)::bigint as pos, (count(*) - sum(y::int))::bigint as neg, md5('42/' || label || '/' || horizon_hours || '/' || floor(p * 1e15)::bigint) as h from preds group by 1, 2, 3),
b0 as (select *, d, {", ".join(f"{_mixed(f"('0x' || h[{7 * i + 1}:{7 * i + 7}])::bigint")} as x{i}" for i in range(3))} from bs, range(1, 101) r(d)),
{", ".join(f"b{k} as (select * exclude (x0, x1, x2), {', '.join(_ROUND(f'x{i}') for i in range(3))} from b{k - 1})" for k in (1, 2, 3))},
bu as (select *, (x0 + 0.5::double) / 2147483647 as u, (x1 + 0.5::double) / 2147483647 as v, (x2 + 0.5::double) / 2147483647 as w from b3),
bz as (select *, sqrt(-2 * ln(u)) * cos(2 * pi() * w) as z0, sqrt(-2 * ln(u)) * sin(2 * pi() * w) as z1 from bu),
bp as (select label, horizon_hours, d, p, {_poisson("pos", "u", "z0")} as dp, {_poisson("neg", "v", "z1")} as dn from bz),
br as (select *, sum(dn) over (partition by label, horizon_hours, d order by p rows unbounded preceding) - dn / 2 as below from bp),
ba as (select label, horizon_hours, d, case when sum(dp) > 0 and sum(dn) > 0 then sum(dp * below) / (sum(dp) * sum(dn)) end as auroc from br group by 1, 2, 3)
select label, horizon_hours, {", ".join(f"round(coalesce(quantile_cont(auroc, {q}), 0), 6) as {n}" for q, n in ((0.025, "low"), (0.5, "median"), (0.975, "high")))} from ba group by 1, 2"""


def metric_ctes(by: str) -> str:
    join = lambda t: f"left join {t} using ({by})"
    return f""", ms as (select {by}, p, sum(y::int) as pos, count(*) as n from preds group by all),
mr as (select *, sum(n - pos) over (partition by {by} order by p rows unbounded preceding) - (n - pos) as below, sum(pos) over (partition by {by} order by p desc rows unbounded preceding) as tp, sum(n) over (partition by {by} order by p desc rows unbounded preceding) as seen from ms),
m1 as (select {by}, case when sum(pos) > 0 and sum(n - pos) > 0 then sum(pos * below + pos * (n - pos) * 0.5::double) / (sum(pos)::double * sum(n - pos)) end as auroc, case when sum(pos) > 0 then sum(pos * (tp::double / seen)) / sum(pos) end as auprc, sum(pos)::bigint as n_positive, sum(n - pos)::bigint as n_negative, sum(n)::bigint as n_total from mr group by all),
m2 as (select {by}, avg((p - y::int) * (p - y::int)) as brier from preds group by all),
mb as (select {by}, case when p >= 0.9 then 9 else len(list_filter([0.1::double, 0.2::double, 0.30000000000000004::double, 0.4::double, 0.5::double, 0.6000000000000001::double, 0.7000000000000001::double, 0.8::double, 0.9::double], lambda e: p >= e)) end as bin, count(*) as n, avg(p) as mean_predicted, avg(y::int) as mean_actual from preds group by all),
m3 as (select {by}, sum(abs(mean_predicted - mean_actual) * n) / sum(n) as ece from mb group by all),
metrics as (select {by}, auroc, auprc, brier, ece, n_positive, n_negative, n_total from m1 {join("m2")} {join("m3")})"""


_LH, _RLH = metric_ctes("label, horizon_hours"), metric_ctes("route, label, horizon_hours")
_PREDICTED = ", spreds as (select label, horizon_hours, predicted_prob as p, actual_positive as y from truth join probs using (hospitalization_id, window_id, horizon_hours, label))" + metric_ctes("label, horizon_hours").replace("preds", "spreds")
_EVENTS = "select hospitalization_id, time, code, value, value_cat from raw where src "
_LOG = "select hospitalization_id, event_idx, time, code, value, value_cat from "

_WEIGHED = "regexp_matches(token, '^(LABEL|DISCH|ICD|PROC|DRG)//')"

#: Query name -> what follows the common table expressions.
FINAL: dict[str, str] = {
    "scan_filtered_stays": "select hospitalization_id, count(*) as n_rows from vitals where hospitalization_id in (select hospitalization_id from train) group by 1",
    "id_map_join": "select hadm_id, ecg_time, m.hospitalization_id from ecg join id_map m using (hadm_id)",
    "patient_split": "select patient_id, first_admit, split from split",
    "patient_sample": "select patient_id, first_admit, split from (select *, row_number() over (partition by split order by md5('42/' || patient_id), patient_id) as place, count(*) over (partition by split) as of_split, count(*) over () as of_all from split) where place <= case split when 'test' then 50 - (select sum(greatest(1, floor(50 * (n / total)))) from (select split, count(*) as n, (select count(*) from split) as total from split where split <> 'test' group by 1)) else greatest(1, floor(50 * (of_split / of_all))) end",
    "ecg_similarity_edges": "select branch, edge_idx::int as edge_idx, round(edge, 6) as edge from sim_edges",
    "ecg_similarity_bins": "select hadm_id, ecg_time, branch, value as similarity, (case when top is null then 5 when top = 0 then -1 else least(greatest(0, (select count(*) from sim_edges e where e.branch = s.branch and e.edge < s.value) - 1), top - 1) end)::int as bin from sim_all s left join (select branch, max(edge_idx) as top from sim_edges group by 1) using (branch)",
    "sequence_store": "select hospitalization_id, count(*) as n_events, arg_min(code, event_idx) as first_code, arg_max(code, event_idx) as last_code, count(value) as n_values from log group by 1",
    "decoded_tokens": "select hospitalization_id, pos::int as pos, token, make_timestamp(ts_us) as time from toks join vocab on token_id = id",
    "model_shares": "select token_id::int as token_id, next_id::int as next_id, n, round(n / sum(n) over (partition by token_id), 9) as share from bigrams",
    "model_loss": f"select round(sum(nll * w) / greatest(sum(w), 1), 6) as loss, count(*) as tokens from (select case when f.next_id = 0 then 0 else -ln(coalesce(b.n / b.total, 0) * (1 - 1e-6::double) + 1e-6::double / (select count(*) from vocab)) end as nll, case when f.next_id in (select id from vocab where {_WEIGHED}) then 75.0::double else 1.0::double end as w from follow f left join (select *, sum(n) over (partition by token_id) as total from bigrams) b on b.token_id = f.token_id and b.next_id = f.next_id where f.hospitalization_id not in (select hospitalization_id from train))",
    "shuffled_batches": f"""select new as batch, hospitalization_id, chunk, len as length from (select *, row_number() over (order by md5('42/' || batch), batch) - 1 as new from (select distinct batch from greedy))
      join greedy using (batch) join (select hospitalization_id, chunk::int as chunk, len(ids)::int as len, row_number() over (order by len(ids), md5(hospitalization_id || '/' || chunk)[1:2], hospitalization_id, chunk) as i from chunk_list) using (i)""",
    "dynamic_batches": f"select batch, count(*) as n_chunks, max(len)::int as width, sum(len)::bigint as n_tokens, (max(len) * count(*) - sum(len))::bigint as n_padding from (select g.batch, l.len from greedy g join lens l on l.i = g.i) group by 1",
    "code_profile": "select code, event_count, admission_count, included from profile",
    "quantile_edges": "select code, edge_idx::int as edge_idx, round(edge, 6) as edge from nv_edges",
    "bin_edges_hybrid": "select code, edge_idx::int as edge_idx, round(edge, 6) as edge from hybrid",
    "bin_edges_clinical": "select code, least(len(list_filter(es[2:], lambda e: e < value)), len(es) - 2)::int as bin, count(*) as n from nv_v join (select code, list(edge order by edge) as es from clinical group by 1) using (code) where value is not null group by 1, 2",
    "bin_lookup": "select hospitalization_id, event_idx, code, value, bin::int as bin from log_bins where value is not null",
    "events_demographics": _EVENTS + "in (11, 12, 13)",
    "events_poa_diagnoses": _EVENTS + "= 20",
    "events_locations": _EVENTS + "= 30",
    "events_vitals": _EVENTS + "= 40",
    "events_labs": _EVENTS + "in (50, 60)",
    "events_continuous_medications": _EVENTS + "in (70, 80)",
    "events_intermittent_medications": _EVENTS + "= 90",
    "events_respiratory": _EVENTS + "between 100 and 119",
    "events_assessments": _EVENTS + "= 120",
    "events_code_status": _EVENTS + "= 130",
    "events_positions": _EVENTS + "= 140",
    "events_crrt": _EVENTS + "between 150 and 152",
    "events_ecmo": _EVENTS + "in (160, 161)",
    "events_procedures": _EVENTS + "= 170",
    "events_discharges": _EVENTS + "in (181, 182)",
    "events_billing": _EVENTS + "= 190",
    "event_log_base": _LOG + "base_log",
    "labels_rows": "select hospitalization_id, code, time from row_labels",
    "labels_icu_first": "select hospitalization_id, code, time from icu_labels",
    "labels_prolonged_icu": "select hospitalization_id, code, time from prolonged_labels",
    "labels_resp_escalation": "select hospitalization_id, code, time from escalation_labels",
    "labels_reintubation": "select hospitalization_id, code, time from reintubation_labels",
    "labels_creatinine_rise": "select hospitalization_id, code, time from creatinine_labels",
    "labels_readmission": "select hospitalization_id, code, time from readmission_labels",
    "labels_discharge": "select hospitalization_id, code, time from row_labels where code like 'LABEL//discharge%' or code like 'LABEL//mortality%'",
    "labels_dnr": "select hospitalization_id, code, time from row_labels where code = 'LABEL//dnr'",
    "labels_all": "select hospitalization_id, code, time from labels_all",
    "label_first_occurrence": "select hospitalization_id, code, time from first_labels",
    "log_with_labels": _LOG + "labelled",
    "ecg_window_join": "select hospitalization_id, hadm_id, ecg_time from ecg_in",
    "ecg_route_counts": f"select 'no_ecg' as route, 0::bigint as n_events union all select 'fusion_class', count(*) from ({ecg_events(3)}) union all select 'all_branches', count(*) from ecg_all",
    "ecg_tokens_fusion_class": f"select hospitalization_id, time, code, value from ({ecg_events(3)})",
    "ecg_tokens_all_branches": "select hospitalization_id, time, code, value from ecg_all",
    "clock_tokens": "select hospitalization_id, time, code from clocks",
    "gap_tokens": "select hospitalization_id, event_idx, time, code from log where mod = 'DT'",
    "event_log_full": _LOG + "log",
    "vocabulary": "select token, id::int as id from vocab",
    "vocabulary_fused": "select token, id::int as id from vocab_fused",
    "token_sequences": "select hospitalization_id, pos::int as pos, token_id::int as token_id, ts_us from toks",
    "token_sequences_fused": "select hospitalization_id, pos::int as pos, token_id::int as token_id, ts_us from toks_fused",
    "route_filter": "select hospitalization_id, pos::int as pos, token_id::int as token_id from toks where token_id not in (select id from vocab where starts_with(token, 'ECG//') and not starts_with(token, 'ECG//Class') and not starts_with(token, 'ECG//Prototype/1D') and not starts_with(token, 'ECG//Similarity/1D'))",
    "route_filter_orphans": "select hospitalization_id, pos::int as pos, token_id::int as token_id from (select *, lag(token_id) over (partition by hospitalization_id order by pos) as was from toks) where token_id not in (select id from vocab where starts_with(token, 'ECG//') and not starts_with(token, 'ECG//Class') and not starts_with(token, 'ECG//Prototype/1D') and not starts_with(token, 'ECG//Similarity/1D')) and not (token_id in (select id from vocab where regexp_matches(token, '^Q_-?[0-9]+$')) and coalesce(was in (select id from vocab where starts_with(token, 'ECG//') and not starts_with(token, 'ECG//Class') and not starts_with(token, 'ECG//Prototype/1D') and not starts_with(token, 'ECG//Similarity/1D')), false))",
    "label_mask": "select hospitalization_id, pos::int as pos, token_id::int as token_id, token_id in (select id from vocab where " + _WEIGHED + ") as is_label from toks",
    "sequence_chunks": f"select hospitalization_id, chunk::int as chunk, start::int as start, len(ids)::int as n_ids, list_sum(ids)::bigint as sum_ids, array_to_string(ids, ' ') as ids, (case when start > 0 then len(ids) - {OVERLAP} + 1 else len(ids) end)::int as n_loss from chunk_list",
    "midnight_windows": "select hospitalization_id, window_id, end_pos::int as end_pos, end_us from windows",
    "window_contexts": "select hospitalization_id, window_id, array_to_string(list_reverse(list_reverse(ids[:end_pos + 1])[:64]), ' ') as context from windows join seqs using (hospitalization_id)",
    "horizon_truth": "select hospitalization_id, window_id, horizon_hours, label, actual_positive from truth",
    "clock_truncation": "select hospitalization_id, window_id, sample_id, horizon_hours, array_to_string(tokens, ' ') as tokens from cut",
    "mc_probability": "select hospitalization_id, window_id, horizon_hours, label, round(predicted_prob, 6) as predicted_prob from probs",
    "generation_shares": "select step, token_id::int as token_id, round(expected, 4) as expected, true as within from steps",
    "scored_predictions": "select hospitalization_id, window_id, horizon_hours, label, round(predicted_prob, 6) as predicted_prob, actual_positive from truth join probs using (hospitalization_id, window_id, horizon_hours, label)",
    "prefix_histogram": "select mod as prefix, count(*) as n from log group by 1",
    "label_histogram": "select code, count(*) as n from log where mod = 'LABEL' group by 1 order by n desc, code limit 20",
    "ecg_histogram": "select split_part(split_part(code, '//', 2), '/', 1) as kind, count(*) as n from log where mod = 'ECG' group by 1",
    "sequence_length_stats": "select count(*) as stays, min(n) as least, quantile_cont(n, 0.5) as median, max(n) as most, round(avg(n), 6) as mean from (select count(*) as n from log group by hospitalization_id)",
    "describe_tokens": "select unnest(['count', 'null_count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) as statistic, round(unnest([count(n)::double, 0, avg(n), stddev_samp(n), min(n), quantile_cont(n, 0.25), quantile_cont(n, 0.5), quantile_cont(n, 0.75), max(n)]), 6) as value from seqs",
    "stays_icu_and_vitals": "select hospitalization_id from adt where location_category = 'icu' intersect select hospitalization_id from vitals",
    "token_event_alignment": "select hospitalization_id, pos::int as pos, token, case when token[1] <> '[' or token = '[UNK]' then sum(case when regexp_matches(token, '^Q_-?[0-9]+$') or (token[1] = '[' and token <> '[UNK]') then 0 else 1 end) over (partition by hospitalization_id order by pos)::bigint - 1 end as event_idx from toks join vocab on token_id = id",
    "run_statistics": "select count(distinct hospitalization_id) as stays, count(*) as events, count(*) filter (mod = 'LABEL') as labels, count(*) filter (mod = 'ECG') as ecg_events, count(*) filter (mod = 'CLOCK') as clock_tokens, count(*) filter (mod = 'DT') as gap_tokens from log",
}
_METRICS: dict[str, str] = {
    "metric_bootstrap": BOOTSTRAP,
    "prediction_metrics": _PREDICTED + "select label, horizon_hours, round(auroc, 9) as auroc, round(auprc, 9) as auprc, round(brier, 9) as brier, round(ece, 9) as ece, n_positive, n_negative, n_total from metrics",
    "route_macro": _RLH + "select route, horizon_hours, n_labels, round(macro, 4) as macro, round(base, 4) as macro_base, round(macro - base, 4) as delta, round((macro - base) / base * 100, 4) as percent from (select m.route, m.horizon_hours, count(*) as n_labels, avg(m.auroc) as macro, avg(b.auroc) as base from metrics m join metrics b on b.route = 'no_ecg' and b.label = m.label and b.horizon_hours = m.horizon_hours where m.route <> 'no_ecg' and m.auroc is not null and b.auroc is not null group by 1, 2)",
    "metric_auroc": _LH + "select label, horizon_hours, round(auroc, 6) as auroc from metrics",
    "metric_auprc": _LH + "select label, horizon_hours, round(auprc, 6) as auprc from metrics",
    "metric_brier": _LH + "select label, horizon_hours, round(brier, 9) as brier from metrics",
    "metric_ece": _LH + "select label, horizon_hours, round(ece, 9) as ece from metrics",
    "calibration_curve": _LH + "select label, horizon_hours, bin::int as bin, n, round(mean_predicted, 6) as mean_predicted, round(mean_actual, 6) as mean_actual from mb",
    "metrics_grouped": _LH + "select label, horizon_hours, round(auroc, 9) as auroc, round(auprc, 9) as auprc, round(brier, 9) as brier, round(ece, 9) as ece, n_positive, n_negative, n_total from metrics",
    "prevalence": _LH + "select label, horizon_hours, round(n_positive / n_total, 6) as prevalence from metrics where n_positive >= 20 and auroc is not null",
    "metric_key_parse": _LH + "select 'LABEL//' || label || '_' || horizon_hours || 'h' as key, label, horizon_hours from metrics",
    "metrics_json": _LH + "select label || '_' || horizon_hours || 'h' as key, '{\"auroc\":' || coalesce(round(auroc, 9)::varchar, 'null') || ',\"auprc\":' || coalesce(round(auprc, 9)::varchar, 'null') || ',\"brier\":' || round(brier, 9) || ',\"ece\":' || round(ece, 9) || ',\"n_positive\":' || n_positive || ',\"n_total\":' || n_total || '}' as json from metrics",
    "route_summary": _RLH + "select route, horizon_hours, round(avg(auroc), 4) as mean_auroc, round(avg(auprc), 4) as mean_auprc, round(avg(brier), 4) as mean_brier, count(distinct label) as n_labels from metrics group by 1, 2",
    "route_pivot": _RLH + "select label, horizon_hours, round(a, 6) as no_ecg, round(b, 6) as fusion_class, round(c, 6) as all_branches, round(b - a, 6) as delta_fusion_class, round(c - a, 6) as delta_all_branches from (select label, horizon_hours, max(auroc) filter (route = 'no_ecg') as a, max(auroc) filter (route = 'fusion_class') as b, max(auroc) filter (route = 'all_branches') as c from metrics group by 1, 2)",
    "route_delta": _RLH + "select m.route, m.label, m.horizon_hours, round(m.auroc - b.auroc, 6) as delta_auroc, round(m.auprc - b.auprc, 6) as delta_auprc, round(m.brier - b.brier, 6) as delta_brier, round((m.auroc - b.auroc) / b.auroc * 100, 4) as percent_auroc from metrics m join metrics b on b.route = 'no_ecg' and b.label = m.label and b.horizon_hours = m.horizon_hours where m.route <> 'no_ecg'",
    "top_labels": _RLH + "select label, round(avg(auroc), 6) as mean_auroc from metrics group by 1 order by avg(auroc) desc, label limit 8",
}
_O = {
    "quantile_edges_orders": "with " + quantile_ctes("lq", "select l_returnflag || l_linestatus as code, l_extendedprice as value from lineitem") + " select code, edge_idx::int as edge_idx, round(edge, 6) as edge from lq_edges",
    "patient_split_orders": "with first_admit as (select o_custkey as patient_id, min(o_orderdate) as first_admit from orders group by 1) select patient_id::varchar as patient_id, first_admit, case when rn <= floor(n * 0.77::double) then 'train' when rn <= floor(n * 0.77::double) + floor(n * 0.1::double) then 'val' else 'test' end as split from (select *, row_number() over (order by first_admit, patient_id::varchar) as rn, count(*) over () as n from first_admit)",
    "readmission_orders": "select o_orderkey::varchar as hospitalization_id, 'LABEL//readmit_30d' as code, o_orderdate + interval 5 day as time from orders a where exists (select 1 from orders b where b.o_custkey = a.o_custkey and b.o_orderdate > a.o_orderdate + interval 5 day and b.o_orderdate <= a.o_orderdate + interval 35 day)",
    "event_log_orders": "select o_orderkey::varchar as hospitalization_id, (row_number() over (partition by o_orderkey order by l_shipdate, l_returnflag || l_linestatus, l_quantity) - 1)::int as event_idx, l_shipdate as time, 'VITAL//' || l_returnflag || l_linestatus as code, l_quantity as value from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= o_orderdate",
}
SQL: dict[str, str] = {name: CTES + sql for name, sql in (FINAL | _METRICS).items()} | _O
