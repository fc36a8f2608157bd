"""Order rules against plain Python, ties, and how often tables are read."""

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from stayflow.functions import constants as C
from stayflow.operators import labels
from stayflow.plans import catalogue
from stayflow.sources.adapter import event_catalog, event_ctes
from stayflow.sources.catalog import SCHEMAS, Catalog

T0 = datetime(2024, 1, 1)


def test_the_adapter_reads_all_events(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
    n, users, patients = c.execute(f"with {event_ctes()} select count(*), count(distinct user_id), count(distinct pid) from ev").fetchone()
    assert n == c.execute("select count(*) from events").fetchone()[0] and patients > users
    assert catalogue.run(spark, sf_dir).preds.count() == n
    kinds = {r["code"]: r["count"] for r in labels.readmission(event_catalog(spark, sf_dir), 30, 7).groupBy("code").count().collect()}
    assert kinds["LABEL//readmit_30d"] > kinds["LABEL//readmit_7d"] > 0


def null_first(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def slow_order_labels(adt, resp, labs, ends):
    """{(stay, label): time} by loops over sorted rows."""
    found = {}
    for h, end in ends.items():
        rows = sorted((r[1:] for r in adt if r[0] == h and r[1] is not None), key=lambda r: null_first((r[0], r[2], r[1])))
        icu = [r for r in rows if r[2] == "icu"]
        if icu and rows[0][2] != "icu":
            found[h, "icu_admission"] = icu[0][0]
        for days in (7, 14):
            spent = timedelta()
            for begin, out, _ in icu:
                lasted = (out or end) - begin if (out or end) else timedelta()
                if spent + lasted >= timedelta(days=days):
                    found[h, f"prolonged_icu_{days}d"] = begin + (timedelta(days=days) - spent)
                    break
                spent += lasted
        rows = sorted((r[1:] for r in resp if r[0] == h), key=null_first)
        level = lambda d: C.SEVERITY.get(d, 0)
        for (t0, d0), (t1, d1) in zip(rows, rows[1:], strict=False):
            if t0 is not None and t1 is not None and level(d1) - level(d0) >= 2 and t1 - t0 <= timedelta(hours=24):
                found[h, "resp_escalation"] = t1
                break
        ended, was = None, False
        for t, d in rows if len(rows) >= 3 else []:
            if d == "IMV" and not was and ended is not None and t is not None and t - ended <= timedelta(hours=48):
                found[h, "reintubation_48h"] = t
                break
            if d != "IMV" and was:
                ended = t
            was = d == "IMV"
        rows = sorted((r[1:] for r in labs if r[0] == h), key=null_first)
        hits = [t for t, v in rows if len(rows) >= 2 and rows[0][1] > 0 and v >= rows[0][1] * 1.5 and t is not None]
        if hits:
            found[h, "creatinine_rise"] = min(hits)
    return found


def order_tables(spark, seed):
    rng = random.Random(seed)
    time = lambda hours: None if rng.random() < 0.03 else T0 + timedelta(hours=rng.randint(0, hours))
    stays = [f"h{i}" for i in range(60)]
    ends = {h: T0 + timedelta(days=40) for h in stays}
    adt = [(h, a, rng.choice([None, a and a + timedelta(hours=rng.randint(0, 300))]), rng.choice(["icu", "ward", "icu", None])) for h in stays for _ in range(rng.randint(0, 8)) for a in [time(400)]]
    resp = [(h, time(60), rng.choice(["IMV", "IMV", "Room Air", "NIPPV", "Nasal Cannula", None, "other"])) for h in stays for _ in range(rng.randint(0, 9))]
    labs = [(h, time(30), rng.choice([0.0, 1.0, 1.2, 1.8, 2.0])) for h in stays for _ in range(rng.randint(0, 4))]
    frame = lambda name, columns, rows: spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in columns))
    key, ts = ("hospitalization_id", "string"), "timestamp_ntz"
    t = Catalog(spark, {
        "hospitalization": frame("", [key, ("discharge_dttm", ts)], list(ends.items())),
        "adt": frame("", [key, ("in_dttm", ts), ("out_dttm", ts), ("location_category", "string")], adt).repartition(5),
        "respiratory_support": frame("", [key, ("recorded_dttm", ts), ("device_category", "string")], resp).repartition(5),
        "labs": frame("", [key, ("lab_result_dttm", ts), ("lab_value_numeric", "double")], labs).withColumn("lab_category", F.lit("creatinine")).repartition(5),
    })
    return t, slow_order_labels(adt, resp, labs, ends)


def test_order_rules_against_loops(spark):
    """Times are whole hours, so that many rows have one time."""
    hit = set()
    for seed in range(3):
        t, want = order_tables(spark, seed)
        names = [s.name for s in labels.ORDER_LABELS]
        got = {(r["hospitalization_id"], r["code"].removeprefix("LABEL//")): r["time"] for r in labels.of(t, names).collect()}
        assert got == want
        hit |= {name for _, name in want}
    assert hit == set(names)


def test_a_rule_of_ones_own(spark):
    t, _ = order_tables(spark, 7)
    second = labels.OrderLabel("second_device", "respiratory_support", "recorded_dttm is not null", "recorded_dttm", "own", ("recorded_dttm", "device_category"), lambda rows: F.get(rows, F.lit(1)).recorded_dttm)
    third = labels.Label("any_device", "respiratory_support", "device_category is not null", "recorded_dttm", "own")
    try:
        labels.register(second)
        labels.register(third)
        found = {r["code"]: r["count"] for r in labels.all_labels(t, ("own",)).groupBy("code").count().collect()}
        rows = t["respiratory_support"].where("recorded_dttm is not null").groupBy("hospitalization_id").count()
        assert found["LABEL//second_device"] == rows.where("count > 1").count() and found["LABEL//any_device"] > 0
        assert "second_device" not in labels.names()
    finally:
        del labels.REGISTRY["second_device"], labels.REGISTRY["any_device"]
    assert labels.all_labels(t, ("external",)).collect() == []


def test_each_table_is_read_and_shuffled_once(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Catalog.from_parquet(spark, str(tmp_path))
    leaves = labels.all_labels(t)._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = [leaves.apply(i).relation().location().rootPaths().mkString().rsplit("/", 1)[1] for i in range(leaves.size())]
    for name in ("adt", "respiratory_support", "labs", "vitals", "position", "crrt_therapy", "ecmo_mcs", "medication_admin_continuous", "patient_assessments"):
        assert read.count(f"{name}.parquet") == 1, name
    one = labels.of(t, [s.name for s in labels.REGISTRY.values() if s.table == "respiratory_support"])._jdf.queryExecution().executedPlan().toString()
    assert one.count("Exchange") == 1 and "Window" not in one
