from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SF


def _at(text: str, **more) -> datetime:
    return datetime.fromisoformat(text) + timedelta(**more)


@pytest.fixture(scope="session")
def mini(spark):
    """Three patients with a stay each."""
    from stayflow.sources.catalog import SCHEMAS, Catalog

    admits = {"H001": "2020-03-15 08:30", "H002": "2020-06-01 12:00", "H003": "2021-01-10 06:00"}
    ends = {"H001": "2020-03-18 14:00", "H002": "2020-06-05 10:00", "H003": "2021-01-12 18:00"}
    a, e = {h: _at(t) for h, t in admits.items()}, {h: _at(t) for h, t in ends.items()}
    hours = lambda h, n: a[h] + timedelta(hours=n)
    rows = {
        "patient": [("P001", "White", "Male", None, None), ("P002", "Black", "Female", None, None), ("P003", "Asian", "Male", None, e["H003"])],
        "hospitalization": [("P001", "H001", a["H001"], e["H001"], 65, "Home"), ("P002", "H002", a["H002"], e["H002"], 40, "Home"), ("P003", "H003", a["H003"], e["H003"], 78, "Expired")],
        "adt": [("H001", a["H001"], hours("H001", 12), "ward"), ("H001", hours("H001", 12), e["H001"], "icu"), ("H002", a["H002"], e["H002"], "ward"), ("H003", a["H003"], hours("H003", 6), "ed"), ("H003", hours("H003", 6), e["H003"], "icu")],
        "vitals": [(h, hours(h, 4 * i), c, v + s * i) for h in a for i in range(5) for c, v, s in (("hr", 70.0, 5), ("sbp", 120.0, 3))],
        "labs": [(h, hours(h, 8 * i), hours(h, 8 * i + 0.5), hours(h, 8 * i + 2), c, v + s * i) for h in a for i in range(3) for c, v, s in (("potassium", 4.0, 0.5), ("glucose", 100.0, 20))],
        "medication_admin_continuous": [("H001", hours("H001", 6), "norepinephrine", "vasoactives", 0.1, "mcg", "new"), ("H003", hours("H003", 3), "norepinephrine", "vasoactives", 0.2, "mcg", "new")],
        "medication_admin_intermittent": [("H002", hours("H002", 2), "acetaminophen", "other", 1000.0, "mg", "given")],
        "respiratory_support": [("H001", hours("H001", 14), "Nasal Cannula", None, 0.4, 5.0, None, None, None), ("H003", hours("H003", 8), "IMV", None, 0.8, 8.0, 450.0, 16.0, None)],
        "patient_assessments": [("H001", hours("H001", 1), "gcs_total", 15.0, None), ("H003", hours("H003", 1), "gcs_total", 6.0, None)],
        "code_status": [("P003", hours("H003", 24), "DNR")],
        "position": [("H003", hours("H003", 10), "prone")],
        "hospital_diagnosis": [("H001", "I50.9", "icd10", 1, 1), ("H001", "E11.9", "icd10", 0, 1), ("H002", "J44.1", "icd10", 1, 0), ("H003", "I21.0", "icd10", 1, 1)],
        "patient_procedures": [("H001", "0BH17EZ", "icd10pcs", e["H001"])],
        "crrt_therapy": [("H003", hours("H003", 18), "cvvh", 200.0, 150.0)],
        "ecmo_mcs": [],
    }
    drop = {"respiratory_support": ["tracheostomy"], "code_status": ["hospitalization_id"]}
    tables = {}
    for name, data in rows.items():
        schema = spark.createDataFrame([], SCHEMAS[name]).drop(*drop.get(name, [])).schema
        tables[name] = spark.createDataFrame(data, schema)
    return Catalog(spark, tables)
