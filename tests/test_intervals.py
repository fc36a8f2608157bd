"""The sweep of intervals and the buckets of stays."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from stayflow.operators import dataset, insert, metrics, tokens
from stayflow.operators.intervals import interval_join
from stayflow.plans import catalogue
from stayflow.sources import catalog
from stayflow.sources.catalog import Catalog, write_by_stay
from stayflow.sources.store import bucketed, buckets, release, written

T0 = datetime(2024, 1, 1)
SPANS = "patient string, stay string, start timestamp_ntz, end timestamp_ntz"


def test_sweep_against_all_pairs(spark):
    rng = random.Random(3)
    time = lambda: None if rng.random() < 0.05 else T0 + timedelta(hours=rng.randint(0, 5000))
    long = [("a", "forever", datetime(1, 1, 1), datetime(9999, 12, 31)), ("b", "point", T0, T0), ("b", "back", T0 + timedelta(1), T0), (None, "none", T0, T0 + timedelta(9))]
    spans = long + [(rng.choice(["a", "a", "a", "b", None]), f"s{i}", s, s and s + timedelta(hours=rng.choice([0, 1, 30, 500, 3000]))) for i in range(150) for s in [time()]]
    points = [(rng.choice(["a", "a", "b", "c", None]), i, time()) for i in range(400)] + [("b", 900, T0), ("b", 900, T0), ("a", 901, datetime(9999, 12, 31))]
    found = interval_join(spark.createDataFrame(points, "patient string, n int, at timestamp_ntz").repartition(3), spark.createDataFrame(spans, SPANS), "patient", "at", "start", "end", ["stay"])
    assert found.columns == ["patient", "n", "at", "stay"]
    want = [(p, n, at, stay) for p, n, at in points for q, stay, s, e in spans if p is not None and p == q and None not in (at, s, e) and s <= at <= e]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 400


def test_sweep_of_nothing(spark):
    points, spans = spark.createDataFrame([("a", T0)], "patient string, at timestamp_ntz"), spark.createDataFrame([("a", "s", T0, T0)], SPANS)
    assert interval_join(points, spans.limit(0), "patient", "at", "start", "end", ["stay"]).collect() == []
    assert interval_join(points.limit(0), spans, "patient", "at", "start", "end", ["stay"]).collect() == []


def test_a_patient_of_many_stays(spark):
    """100,000 stays and as many rows of one patient: pairs of all would be 10^10."""
    n = 100_000
    hour = F.expr("timestamp_ntz'2000-01-01 00:00:00' + id * interval '1' hour")
    spans = spark.range(n).select(F.lit("hot").alias("patient"), F.col("id").cast("string").alias("stay"), hour.alias("start"), (hour + F.expr("interval '90' minute")).alias("end"))
    points = spark.range(n).select(F.lit("hot").alias("patient"), (hour + F.expr("interval '10' minute")).alias("at"))
    began = time.time()
    assert interval_join(points, spans, "patient", "at", "start", "end", ["stay"]).count() == 2 * n - 1
    assert time.time() - began < 60


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stay_steps_in_buckets_neither_shuffle_nor_sort(spark, sf_dir):
    """From the log on: gaps, encoding, sequences, chunks, windows of a stay."""
    r = catalogue.run(spark, sf_dir)
    seqs = tokens.sequences(r.kept_tokens)
    steps = {
        "log": r.kept_log.where("modality = 'DT'"),
        "tokens": r.tokens,
        "sequences": seqs,
        "chunks": dataset.chunks(seqs, 32, 8),
    }
    for name, df in steps.items():
        assert "Exchange hashpartitioning" not in _plan(df) and "Sort [" not in _plan(df), name
    first = _plan(insert.full_log(r.base, r.stays, r.labels, insert.ecg_events(r.ecg), parts=buckets(spark)))
    assert "REPARTITION_BY_NUM" in first


def test_rows_by_horizon_and_label_are_not_shuffled(spark, sf_dir):
    """They are windows times horizons times labels: each is made where its window is."""
    for name in ("scored_predictions", "mc_probability", "horizon_truth"):
        plan = _plan(catalogue.QUERIES[name](spark, sf_dir))
        assert "horizon_hours" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "horizon_hours" in x], name


def test_metrics_of_predictions_shuffle_counts_per_score(spark, sf_dir, monkeypatch):
    """What metrics read of scored predictions is summed by score where it is made."""
    plans = []
    monkeypatch.setattr(metrics, "written", lambda df, tag: plans.append(_plan(df)) or written(df, tag))
    assert catalogue.QUERIES["prediction_metrics"](spark, sf_dir).count() > 0
    by_score = [x for x in plans[0].splitlines() if "Exchange hashpartitioning" in x and "horizon_hours" in x]
    assert len(by_score) == 1 and "predicted_prob" in by_score[0] and "hospitalization_id" not in by_score[0]


def test_log_and_predictions_are_made_in_buckets(spark, sf_dir):
    """The parts of the log are dealt by stay one after another; the log of them and all up to the predictions shuffle nothing."""
    r = catalogue.run(spark, sf_dir)
    parts = r.log_parts()
    for name, df in {"log": r.log_of(*parts), "windows": r.windows, "predictions": r.scored}.items():
        assert "Exchange hashpartitioning" not in _plan(df), name
    assert r.log_of(*parts).count() == r.kept_log.count() == r.log.count() > 0
    release(*parts)


def test_shuffles_of_a_bucketed_table_are_deleted(spark):
    """They would stay until the driver collects its garbage, beside those of the next table."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    df = spark.range(10_000).select((F.col("id") % 70).alias("key"), "id").repartition(buckets(spark), "key")
    before = files()
    table = bucketed(df, "short", "key", "id")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert table.columns == ["key", "id"] and table.count() == 10_000 and table.groupBy("key").count().count() == 70


def test_buckets_of_several_files_are_right(spark):
    """A table that is not dealt by its key has several files a bucket; windows over it must sort."""
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("hospitalization_id"), (F.lit(1000) - F.col("id")).alias("pos")).repartition(5)
    table = bucketed(df, "odd", "hospitalization_id", "pos")
    seqs = table.groupBy("hospitalization_id").agg(F.collect_list("pos").alias("p")).collect()
    assert sorted(x for r in seqs for x in r["p"]) == sorted(1000 - i for i in range(1000)) and len(seqs) == 7
    ranked = table.withColumn("r", F.row_number().over(Window.partitionBy("hospitalization_id").orderBy("pos"))).collect()
    for h in range(7):
        rows = sorted((x["pos"], x["r"]) for x in ranked if x["hospitalization_id"] == str(h))
        assert [r for _, r in rows] == list(range(1, len(rows) + 1))


def test_loads_by_ids_skip_row_groups(spark, tmp_path, monkeypatch):
    """Of 100,000 rows of 2,000 stays, 1 % of the stays, spread over all files, need a small part of the row groups."""
    rows = spark.range(100_000).selectExpr("concat('s', lpad(cast(id % 2000 as string), 5, '0')) as hospitalization_id", "timestamp_ntz'2024-01-01 00:00:00' + id * interval '1' second as recorded_dttm", "md5(cast(id as string)) as vital_category", "rand(1) as vital_value")
    write_by_stay(rows, str(tmp_path / "vitals.parquet"), row_group=1 << 15)
    t = Catalog.from_parquet(spark, str(tmp_path))
    ids = [f"s{i:05}" for i in range(0, 2000, 100)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = t.for_ids("vitals", [*ids, "unknown", None])
        assert sorted(r["hospitalization_id"] for r in found.collect()) == sorted(i for i in ids for _ in range(50))
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert "PushedFilters: [In(hospitalization_id" in found._jdf.queryExecution().executedPlan().toString()
        scanned = found._jdf.queryExecution().executedPlan()
        found._jdf.queryExecution().toRdd().count()
        assert 0 < leaf.metrics().apply("numOutputRows").value() < 2 * 30_000, scanned.toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    monkeypatch.setattr(catalog, "FEW", 3)
    assert t.for_ids("vitals", ids).count() == 1000 and t.for_ids("vitals", []).count() == 0
