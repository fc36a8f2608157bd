"""The commands of a run, settings and streams."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from stayflow import cli
from stayflow.config import Config
from stayflow.operators import labels, model
from stayflow.plans import runs
from stayflow.sources.adapter import event_catalog
from stayflow.sources.catalog import Catalog, export_artifact, load_artifact, load_json, read_sequences, write_log
from stayflow.streaming.first_hits import event_counts, first_hits


def test_commands_end_to_end(spark, sf_dir, tmp_path):
    config = Config()
    config.data.output = str(tmp_path / "out")
    config.extraction.thresholds = {f: (5, 2) for f in config.extraction.thresholds}
    config.evaluation.n_samples, config.evaluation.max_new_tokens = 3, 40
    config.training.max_len, config.training.overlap, config.training.token_budget = 64, 16, 512
    t = event_catalog(spark, sf_dir)
    results = runs.run_all(spark, config, t)
    assert [r.success for r in results] == [True] * 4 and results[0].metrics["labels"] > 0 and results[1].metrics["tokens"] > 0
    log = spark.read.parquet(f"{config.data.output}/events.parquet")
    assert read_sequences(spark, f"{config.data.output}/events.parquet").count() == log.select("hospitalization_id").distinct().count()
    assert all(k.rpartition("_")[2].endswith("h") for k in load_json(spark, f"{config.data.output}/metrics.json"))
    assert 0 < results[2].metrics["loss"] < 20
    t0 = {n: spark.read.parquet(f"{config.data.output}/{n}.parquet") for n in ("intervals", "metrics", "batches")}
    assert t0["intervals"].count() == t0["metrics"].count() and t0["batches"].agg(F.max("length")).first()[0] <= 64
    for name in ("splits", "code_profile", "bin_edges", "token_edges", "similarity_edges", "vocabulary", "intervals"):
        assert load_artifact(spark, name, config.data.output).count() > 0
    export_artifact(spark, "vocabulary", config.data.output, str(tmp_path / "vocabulary.json"))
    assert spark.read.json(str(tmp_path / "vocabulary.json")).count() == results[1].metrics["vocabulary"]
    with pytest.raises(ValueError, match="no fitting column"):
        spark.range(3).write.parquet(str(tmp_path / "bad" / "splits.parquet"))
        load_artifact(spark, "splits", str(tmp_path / "bad"))
    one, two = (model.generate(spark.createDataFrame([("a", 0, [2])], "hospitalization_id string, window_id int, context_ids array<int>"), spark.read.parquet(f"{config.data.output}/model.parquet"), model.Generation(4, 20)).collect() for _ in range(2))
    assert one == two and len(one) == 4 and all(len(r["tokens"]) <= 20 for r in one)
    table = runs.ablation_run(spark, config, t, ("no_ecg", "all_branches"))
    assert {r["route"] for r in table.select("route").distinct().collect()} == {"no_ecg", "all_branches"}
    known = spark.createDataFrame([("none", 0, 0, [1])], "hospitalization_id string, window_id int, sample_id int, tokens array<int>")
    assert runs.evaluate_run(spark, config, t, known).success  # samples of an engine elsewhere
    assert load_json(spark, f"{config.data.output}/ablation_summary.json")


def test_settings_act(spark, sf_dir, tmp_path):
    t = event_catalog(spark, sf_dir)
    logs = []
    for hours, keep in ((4, False), (12, True)):
        config = Config()
        config.data.output = str(tmp_path / str(hours))
        config.extraction.thresholds = {f: (1, 1) for f in config.extraction.thresholds}
        config.time.clock_hours, config.extraction.keep_unknown_action = hours, keep
        runs.extract_run(spark, config, t)
        log = spark.read.parquet(f"{config.data.output}/events.parquet")
        logs.append({r["code"]: r["n"] for r in log.groupBy("code").agg(F.count("*").alias("n")).collect()})
    assert {c for c in logs[0] if c.startswith("CLOCK//")} == {f"CLOCK//{h:02}:00" for h in range(0, 24, 4)}
    assert {c for c in logs[1] if c.startswith("CLOCK//")} == {"CLOCK//00:00", "CLOCK//12:00"}
    active = [sum(n for c, n in log.items() if c.startswith("MED_CONT//")) for log in logs]
    assert active[1] > active[0]
    rows = t["hospitalization"].select("hospitalization_id").limit(0)
    assert not write_log(rows, str(tmp_path / "none"), keep_empty=False) and not (tmp_path / "none").exists()
    assert write_log(t["hospitalization"], str(tmp_path / "some"), keep_empty=False) and (tmp_path / "some").exists()


def test_effective_defaults():
    c = Config()
    assert (c.training.label_weight, c.evaluation.n_samples, c.evaluation.max_new_tokens, c.evaluation.top_k, c.evaluation.top_p) == (75.0, 8, 500, 50, 0.95)
    assert model.Generation() == model.Generation(8, 500, 1.0, 50, 0.95)


def test_shared_folder(spark, monkeypatch):
    from stayflow.sources import store

    with store.scratch() as keep:
        gone, kept = (store.written(spark.range(n), "test") for n in (3, 4))
        keep(kept)
    assert kept.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FAILED_READ_FILE"):
        spark.read.parquet(gone.written_at).count()
    store.release(kept, spark.range(2))
    with pytest.raises(ValueError), store.scratch() as keep:
        keep(lost := store.written(spark.range(5), "test"))
        raise ValueError
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(lost.written_at)

    class Elsewhere:
        master = "spark://host:7077"

    class Session:
        sparkContext = Elsewhere()
        conf = spark.conf

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            store.shared_dir(Session())
    assert store.qualified(spark, "/x/y") == "file:/x/y" and store.qualified(spark, "file:///x") == "file:/x"


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"split": {"val_fraction": 0.2}, "evaluation": {"horizons": [8]}}))
    c = Config.load(str(path))
    assert c.split.val_fraction == 0.2 and c.evaluation.horizons == (8,) and c.bins.mode == "hybrid"
    c.save(str(tmp_path / "d.json"))
    assert Config.load(str(tmp_path / "d.json")).split.val_fraction == 0.2
    path.write_text(json.dumps({"split": {"nothing": 1}}))
    with pytest.raises(ValueError, match="split.nothing"):
        Config.load(str(path))


def test_cli_help(capsys):
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    assert "extract" in capsys.readouterr().out


def test_catalog_from_folder(spark, mini, tmp_path):
    mini.tables["vitals"].write.parquet(str(tmp_path / "site_vitals.parquet"))
    t = Catalog.from_parquet(spark, str(tmp_path), "site_")
    assert t.has("vitals") and not t.has("labs") and t["vitals"].count() == 30
    kept = t.preload(spark.createDataFrame([("H001",), ("none",)], "hospitalization_id string"), ["vitals"])
    assert kept["vitals"].count() == 10
    kept.release()


def test_streams(spark, mini, tmp_path):
    mini.tables["vitals"].withColumn("vital_value", F.col("vital_value") + 60).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(mini.tables["vitals"].schema).parquet(str(tmp_path / "in"))
    rules = [s for s in labels.ROW_LABELS if s.table == "vitals"]
    query = first_hits(stream, rules).writeStream.outputMode("complete").format("memory").queryName("hits").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["hospitalization_id"], r["code"]) for r in spark.table("hits").collect()}
    assert got == {(h, "LABEL//tachycardia") for h in ("H001", "H002", "H003")}
    timed_rows = mini.tables["vitals"].select("hospitalization_id", F.col("recorded_dttm").cast("timestamp").alias("time"))
    timed = stream.select("hospitalization_id", F.col("recorded_dttm").cast("timestamp").alias("time"))
    query = event_counts(timed).writeStream.outputMode("append").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    # windows that end before the watermark (the latest time less an hour) are closed, with all their events
    last = timed_rows.agg(F.max("time")).first()[0] - timedelta(hours=1)
    closed = timed_rows.groupBy("hospitalization_id", F.window("time", "4 hours")).agg(F.count("*").alias("n")).where(F.col("window.end") <= F.lit(last))
    found = {(r["hospitalization_id"], r["window"]["start"]): r["n"] for r in spark.table("counts").collect()}
    assert found == {(r["hospitalization_id"], r["window"]["start"]): r["n"] for r in closed.collect()} and len(found) > 3
