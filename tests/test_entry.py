"""The driver's contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from stayflow.plans import catalogue, oracle

ROOT = Path(__file__).resolve().parent.parent
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["hospitalization_id", "event_idx", "time", "code", "value", "value_cat"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) == set(oracle.SQL)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    text = frame.apply(lambda col: col.map(lambda v: "" if v is None or v != v else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)))
    return sorted(text.agg("|".join, axis=1)) if len(text) else []


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # a whole column of nulls has no type of its own
        if got[c].dtype != want[c].dtype and want[c].dtype.kind in "fi" and got[c].dtype.kind in "fi":
            want[c] = want[c].astype(got[c].dtype)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(oracle.SQL)))
def test_queries_without_sql_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_imports_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'event_log_full' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, check=True)
