"""The commands of a run: tables -> event log -> tokens -> predictions and metrics, each stage's result as Parquet."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow.config import Config
from stayflow.functions import constants as C
from stayflow.operators import bins, dataset, extract, insert, labels, metrics, model, profile, reports, split, tokens, windows
from stayflow.sources.catalog import Catalog, StageResult, id_map, load_artifact, read_ecg_csv, save_json, write_log


def _save(df: DataFrame, config: Config, name: str) -> DataFrame:
    path = f"{config.data.output}/{name}.parquet"
    write_log(df, path)
    return df.sparkSession.read.parquet(path)


def _read(spark: SparkSession, config: Config, name: str) -> DataFrame:
    return spark.read.parquet(f"{config.data.output}/{name}.parquet")


def extract_run(spark: SparkSession, config: Config, t: Catalog | None = None) -> StageResult:
    """Split, profile, bin edges and the full event log."""
    began = time.time()
    t = t or Catalog.from_parquet(spark, config.data.tables, config.data.prefix)
    if config.data.ecg_csv:
        t = Catalog(spark, t.tables | {"ecg": read_ecg_csv(spark, config.data.ecg_csv)})
    parts = _save(split.patient_split(t.strict("hospitalization"), config.split.val_fraction), config, "splits")
    chosen = split.sample_patients(parts, config.extraction.n_patients, config.split.seed) if config.extraction.n_patients else parts
    stays = t["hospitalization"].join(chosen.select("patient_id", "split"), "patient_id")
    train = stays.where("split = 'train'").select("hospitalization_id")
    codes = _save(profile.profile(profile.code_counts(t, train), config.extraction.thresholds), config, "code_profile")
    _save(bins.bin_edges(bins.numeric_values(t, train), config.bins.mode, config.bins.n_bins), config, "bin_edges")
    base = extract.base_events(t, None if codes.isEmpty() else codes, stays, config.extraction.keep_unknown_action)
    ecg = None
    if t.has("ecg"):
        _save(bins.ecg_similarity_edges(t["ecg"], config.ecg.n_similarity_bins), config, "similarity_edges")
        ecg = insert.ecg_events(insert.ecg_in_window(t["ecg"], id_map(stays), stays, config.ecg.lookback_days), config.ecg.route)
    found = labels.all_labels(t, config.extraction.label_categories)
    log = _save(insert.full_log(base, stays, found, ecg, edges=config.time.gap_edges, clock_hours=config.time.clock_hours), config, "events")
    numbers = reports.run_statistics(log).first().asDict()
    return StageResult(True, f"{config.data.output}/events.parquet", time.time() - began, numbers)


def tokenize_run(spark: SparkSession, config: Config, t: Catalog | None = None) -> StageResult:
    """Vocabulary and edges of the training part, sequences of all stays."""
    began = time.time()
    t = t or Catalog.from_parquet(spark, config.data.tables, config.data.prefix)
    log, parts = _read(spark, config, "events"), _read(spark, config, "splits")
    train = t["hospitalization"].join(parts.where("split = 'train'"), "patient_id", "left_semi").select("hospitalization_id")
    train_log = log.join(train, "hospitalization_id", "left_semi")
    edges = _save(tokens.train_edges(train_log, config.bins.n_bins), config, "token_edges")
    vocab = _save(tokens.vocabulary(train_log, edges, config.bins.n_bins, config.tokens.fuse, config.tokens.min_count), config, "vocabulary")
    seqs = _save(tokens.sequences(tokens.encoded_rows(log, vocab, edges, config.tokens.fuse)), config, "tokens")
    numbers = seqs.agg(F.count("*").alias("sequences"), F.sum("token_count").alias("tokens")).first().asDict()
    return StageResult(True, f"{config.data.output}/tokens.parquet", time.time() - began, numbers | {"vocabulary": vocab.count()})


def _token_rows(seqs: DataFrame) -> DataFrame:
    items = F.arrays_zip("token_ids", "timestamps_us")
    return seqs.select("hospitalization_id", F.posexplode(items).alias("pos", "x")).select("hospitalization_id", "pos", F.col("x.token_ids").alias("token_id"), F.col("x.timestamps_us").alias("ts_us"))


def _part(spark: SparkSession, config: Config, t: Catalog, name: str) -> DataFrame:
    parts = _read(spark, config, "splits").where(F.col("split") == name)
    ids = t["hospitalization"].join(parts, "patient_id", "left_semi").select("hospitalization_id")
    return _read(spark, config, "tokens").join(ids, "hospitalization_id", "left_semi")


def train_run(spark: SparkSession, config: Config, t: Catalog | None = None) -> StageResult:
    """A model of counted successors, its loss on the validation part, and chunked batches for trainers elsewhere."""
    began, how = time.time(), config.training
    t = t or Catalog.from_parquet(spark, config.data.tables, config.data.prefix)
    vocab = load_artifact(spark, "vocabulary", config.data.output)
    labelled = dataset.label_ids(vocab)
    fit, held = (dataset.label_mask(dataset.filter_route(_token_rows(_part(spark, config, t, p)), vocab, config.ecg.route), labelled) for p in ("train", "val"))
    learned = _save(model.train(fit), config, "model")
    score = model.loss(held, learned, vocab.count(), how.label_weight).first()
    important = [r["id"] for r in labelled.collect()]
    chunked = dataset.chunks(_part(spark, config, t, "train"), how.max_len, how.overlap, important)
    _save(dataset.token_batches(chunked, how.token_budget, how.seed), config, "batches")
    return StageResult(True, f"{config.data.output}/model.parquet", time.time() - began, score.asDict())


def evaluate_run(spark: SparkSession, config: Config, t: Catalog | None = None, samples: DataFrame | None = None) -> StageResult:
    """Windows, truth, probabilities from samples (the count model's, if none are given) and metrics."""
    began, how = time.time(), config.evaluation
    t = t or Catalog.from_parquet(spark, config.data.tables, config.data.prefix)
    vocab, seqs = _read(spark, config, "vocabulary"), _part(spark, config, t, "test")
    rows = _token_rows(seqs)
    ids = {r["token"]: r["id"] for r in vocab.where("token like 'CLOCK//%' or token like 'DISCH//%' or token = '[EOS]'").collect()}
    if windows.MIDNIGHT not in ids:
        return StageResult(False, config.data.output, time.time() - began, {}, [f"{windows.MIDNIGHT} is not in the vocabulary"])
    clocks = [i for name, i in ids.items() if name.startswith("CLOCK//")]
    found = _save(windows.midnight_windows(rows, vocab, how.max_days), config, "windows")
    label_tokens = vocab.where("token like 'LABEL//%'").select(F.expr("substring(token, 8)").alias("label"), F.col("id").alias("token_id"))
    if samples is None:
        stop = tuple(i for name, i in ids.items() if not name.startswith("CLOCK//"))
        limit = max(h // config.time.clock_hours for h in how.horizons)
        wish = model.Generation(how.n_samples, how.max_new_tokens, how.temperature, how.top_k, how.top_p, stop, tuple(clocks), limit)
        samples = model.generate(windows.contexts(found, seqs, how.max_context), _read(spark, config, "model"), wish)
    samples = _save(samples, config, "samples")
    times = windows.label_times(found, rows, label_tokens)
    hits = windows.label_hits(samples, label_tokens, clocks, ids.get(windows.DEATH), how.horizons, config.time.clock_hours)
    scored = _save(windows.scored(hits, times, label_tokens, how.horizons), config, "predictions")
    result = _save(metrics.grouped(scored), config, "metrics")
    if how.n_bootstrap:
        _save(metrics.bootstrap_auroc(scored, n=how.n_bootstrap, confidence=how.confidence), config, "intervals")
    groups = result.count()
    save_json(spark, {r["key"]: r["json"] for r in reports.metrics_json(result).collect()}, f"{config.data.output}/metrics.json")
    return StageResult(True, f"{config.data.output}/metrics.parquet", time.time() - began, {"groups": groups, "windows": found.count()})


def run_all(spark: SparkSession, config: Config, t: Catalog | None = None) -> list[StageResult]:
    """All commands in order; ends at the first that fails."""
    results = []
    for stage in (extract_run, tokenize_run, train_run, evaluate_run):
        results.append(stage(spark, config, t))
        if not results[-1].success:
            break
    return results


def ablation_run(spark: SparkSession, config: Config, t: Catalog | None = None, routes: tuple[str, ...] = tuple(C.ECG_ROUTES)) -> DataFrame:
    """Train and evaluate per waveform route over the same tokens; metrics with a route column, and their summary as JSON."""
    out, parts = config.data.output, None
    for route in routes:
        config.ecg.route = route
        train_run(spark, config, t)
        evaluate_run(spark, config, t)
        own = _save(_read(spark, config, "metrics").withColumn("route", F.lit(route)), config, f"metrics_{route}")
        parts = own if parts is None else parts.unionByName(own)
    save_json(spark, reports.route_summary(parts), f"{out}/ablation_summary.json")
    return parts


def as_text(result: StageResult) -> str:
    return str(asdict(result))
