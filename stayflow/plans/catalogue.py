"""One query per operator of the engine, over the test tables in the shapes of the source tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow.functions import constants as C
from stayflow.functions.expressions import from_micros
from stayflow.operators import bins, dataset, extract, insert, labels, metrics, model, profile, reports, split, tokens, windows
from stayflow.plans.oracle import BUDGET, HORIZONS, MAX_LEN, MIN_EVENTS, MIN_STAYS, OVERLAP, SAMPLES
from stayflow.sources.adapter import event_catalog
from stayflow.sources.catalog import Catalog, id_map, read_sequences, write_log
from stayflow.sources.store import bucketed, buckets, release, shared_dir, written

EVENT = ("hospitalization_id", "time", "code", "value", "value_cat")
LOG = ("hospitalization_id", "event_idx", *EVENT[1:])


class Run:
    """The plans of one run, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def t(self) -> Catalog:
        """Stays are made of all events and joined to everything, so they are written once, in buckets as the log is."""
        made = event_catalog(self.spark, self.sf_dir)
        stays = made["hospitalization"].repartition(buckets(self.spark), "hospitalization_id")
        return Catalog(self.spark, made.tables | {"hospitalization": bucketed(stays, "stays", "hospitalization_id", "admission_dttm")})

    @cached_property
    def stays(self) -> DataFrame:
        return self.t["hospitalization"]

    @cached_property
    def split(self) -> DataFrame:
        return split.patient_split(self.stays)

    @cached_property
    def train(self) -> DataFrame:
        return written(self.stays.join(self.split.where("split = 'train'"), "patient_id", "left_semi").select("hospitalization_id"), "train")

    @cached_property
    def profile(self) -> DataFrame:
        """Few rows that every extractor is joined to: an artifact, written once."""
        return written(profile.profile(profile.code_counts(self.t, self.train), {f: (MIN_EVENTS, MIN_STAYS) for f in C.THRESHOLDS}), "profile")

    @cached_property
    def base(self) -> DataFrame:
        return extract.base_events(self.t, self.profile)

    @cached_property
    def labels(self) -> DataFrame:
        return labels.all_labels(self.t)

    @cached_property
    def ecg(self) -> DataFrame:
        return insert.ecg_in_window(self.t["ecg"], id_map(self.stays), self.stays)

    @cached_property
    def log(self) -> DataFrame:
        return insert.full_log(self.base, self.stays, self.labels, insert.ecg_events(self.ecg))

    @cached_property
    def kept_log(self) -> DataFrame:
        """The log for what reads it several times, in buckets of stays.

        Its parts are dealt by stay one after another, each before it is taken apart into events, so that the shuffles of
        one part at a time lie on disk and the log itself needs none.
        """
        parts = self.log_parts()
        try:
            return bucketed(self.log_of(*parts), "log", "hospitalization_id", "event_idx")
        finally:
            release(*parts)

    def log_parts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Labels, recordings and base events in buckets of stays, the largest last."""
        n = buckets(self.spark)
        labels = bucketed(insert.first_occurrences(self.labels).repartition(n, "hospitalization_id"), "labels", "hospitalization_id", "time")
        ecg = bucketed(self.ecg.repartition(n, "hospitalization_id"), "ecg", "hospitalization_id", "ecg_time")
        base = extract.base_events(self.t, self.profile, parts=n)
        return labels, ecg, bucketed(base, "base", "hospitalization_id", "time")

    def log_of(self, labels: DataFrame, ecg: DataFrame, base: DataFrame) -> DataFrame:
        return insert.full_log(base, self.stays, labels, insert.ecg_events(ecg))

    @cached_property
    def train_log(self) -> DataFrame:
        return self.kept_log.join(self.train, "hospitalization_id", "left_semi")

    @cached_property
    def edges(self) -> DataFrame:
        return written(tokens.train_edges(self.train_log), "edges")

    @cached_property
    def vocab(self) -> DataFrame:
        return written(tokens.vocabulary(self.train_log, self.edges), "vocabulary")

    @cached_property
    def tokens(self) -> DataFrame:
        return tokens.encoded_rows(self.kept_log, self.vocab, self.edges)

    @cached_property
    def kept_tokens(self) -> DataFrame:
        return bucketed(self.tokens, "tokens", "hospitalization_id", "pos")

    @cached_property
    def windows(self) -> DataFrame:
        return bucketed(windows.midnight_windows(self.kept_tokens, self.vocab), "windows", "hospitalization_id", "window_id")

    @cached_property
    def label_tokens(self) -> DataFrame:
        return self.vocab.where(F.col("token").startswith("LABEL//")).select(F.replace("token", F.lit("LABEL//"), F.lit("")).alias("label"), F.col("id").alias("token_id"))

    @cached_property
    def truth(self) -> DataFrame:
        return windows.horizon_truth(self.windows, self.kept_tokens, self.label_tokens, HORIZONS)

    @cached_property
    def samples(self) -> DataFrame:
        """Stand-ins for a model's continuations: every other token of what came next."""
        whole = tokens.sequences(self.kept_tokens).select("hospitalization_id", "token_ids")
        rows = self.windows.join(whole, "hospitalization_id").withColumn("after", F.slice("token_ids", F.col("end_pos") + 2, F.size("token_ids")))
        rows = rows.select("hospitalization_id", "window_id", "end_pos", "after", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))).alias("sample_id"))
        kept = F.filter("after", lambda _, i: (F.col("end_pos") + 1 + i + F.col("sample_id")) % 2 == 0)
        return rows.select("hospitalization_id", "window_id", "sample_id", kept.alias("tokens"))

    def ids(self, *prefixes: str) -> list[int]:
        """Token ids of a few fixed prefixes."""
        test = F.lit(False)
        for p in prefixes:
            test = test | F.col("token").startswith(p)
        return [r["id"] for r in self.vocab.where(test).select("id").collect()]

    def clocks_and_death(self) -> tuple[list[int], int | None]:
        death = self.ids(windows.DEATH)
        return self.ids("CLOCK//"), death[0] if death else None

    @cached_property
    def probabilities(self) -> DataFrame:
        return windows.probabilities(self.samples, self.label_tokens, *self.clocks_and_death(), HORIZONS)

    @cached_property
    def scored(self) -> DataFrame:
        hits = windows.label_hits(self.samples, self.label_tokens, *self.clocks_and_death(), HORIZONS)
        return windows.scored(hits, windows.label_times(self.windows, self.kept_tokens, self.label_tokens), self.label_tokens, HORIZONS)

    @cached_property
    def chunks(self) -> DataFrame:
        return written(dataset.chunks(tokens.sequences(self.kept_tokens), MAX_LEN, OVERLAP, self.ids(*C.LOSS_PREFIXES)), "chunks")

    @cached_property
    def similarity(self) -> DataFrame:
        return bins.ecg_similarity_edges(self.t["ecg"])

    @cached_property
    def model(self) -> DataFrame:
        return model.train(self.kept_tokens.join(self.train, "hospitalization_id", "left_semi"))

    @cached_property
    def preds(self) -> DataFrame:
        k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
        route = F.when(F.col("event_id") % 3 == 0, "no_ecg").when(F.col("event_id") % 3 == 1, "fusion_class").otherwise("all_branches")
        hours = F.when(k % 3 == 0, 8).when(k % 3 == 1, 24).otherwise(48)
        return self.table("events").select(F.col("event_type").alias("label"), hours.alias("horizon_hours"), route.alias("route"), ((k % 11) / F.lit(10.0)).alias("predicted_prob"), (F.col("value") > F.when(F.col("event_type") == "view", 245).otherwise(100)).alias("actual_positive"))

    @cached_property
    def metrics(self) -> DataFrame:
        return metrics.grouped(self.preds)

    @cached_property
    def route_metrics(self) -> DataFrame:
        return metrics.grouped(self.preds, ["route", "label", "horizon_hours"])

    @cached_property
    def orders(self) -> Catalog:
        """Orders as stays of their customers, their lines as measurements."""
        o, line = self.table("orders"), self.table("lineitem")
        stays = o.select(F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderkey").cast("string").alias("hospitalization_id"), F.col("o_orderdate").alias("admission_dttm"), (F.col("o_orderdate") + F.expr("interval '5' day")).alias("discharge_dttm"))
        rows = line.select(F.col("l_orderkey").cast("string").alias("hospitalization_id"), F.col("l_shipdate").alias("recorded_dttm"), F.concat("l_returnflag", "l_linestatus").alias("vital_category"), F.col("l_quantity").alias("vital_value"))
        return Catalog(self.spark, {"hospitalization": stays, "vitals": rows})


@lru_cache(4)
def run(spark: SparkSession, sf_dir: str) -> Run:
    return Run(spark, sf_dir)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _rounded_metrics(df: DataFrame) -> DataFrame:
    """Means over a few hundred rows often end in a 5 at the seventh place, where engines round apart."""
    return rounded(df, "auroc", "auprc", "brier", "ece", places=9)


def _edge_rows(edges: DataFrame) -> DataFrame:
    return rounded(edges.select("code", F.posexplode("edges").alias("edge_idx", "edge")), "edge")


def _joined(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), " ")


def _orders_log(r: Run) -> DataFrame:
    log = extract.vitals(r.orders).join(r.orders["hospitalization"].select("hospitalization_id", "admission_dttm"), "hospitalization_id").where("time >= admission_dttm")
    return extract.ordered(log).select("hospitalization_id", "event_idx", "time", "code", "value")


def _stored(r: Run) -> DataFrame:
    """The log written in two files by the sequence sink and read back as sequences."""
    paths = []
    for i in range(2):
        paths.append(f"{shared_dir(r.spark)}/sequences-{uuid.uuid4().hex}")
        write_log(r.kept_log.where(F.pmod(F.xxhash64("hospitalization_id"), F.lit(2)) == i).select(*LOG), paths[-1])
    found = read_sequences(r.spark, *paths)
    return found.select("hospitalization_id", F.size("events").cast("long").alias("n_events"), F.element_at("events", 1).code.alias("first_code"), F.element_at("events", -1).code.alias("last_code"), F.size(F.filter("events", lambda e: e.value.isNotNull())).cast("long").alias("n_values"))


def _orders_edges(r: Run) -> DataFrame:
    lines = r.table("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("code"), F.col("l_extendedprice").alias("value"))
    return _edge_rows(bins.quantile_edges(lines))


def _route_counts(r: Run) -> DataFrame:
    """Events of each route; the route without waveforms has none."""
    parts = [insert.ecg_events(r.ecg, route).agg(F.count("*").alias("n_events")).select(F.lit(route).alias("route"), "n_events") for route in C.ECG_ROUTES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _generation_shares(r: Run) -> DataFrame:
    """Three tokens for each window and sample, held against the exact probabilities of the model."""
    how = model.Generation(max_new_tokens=3, top_k=0, top_p=1.0)
    contexts = windows.contexts(r.windows, tokens.sequences(r.kept_tokens), 64)
    learned = written(r.model, "model")
    expected = model.step_shares(contexts, learned, how, how.max_new_tokens)
    found = model.generated_shares(model.generate(contexts, learned, how), expected, how.max_new_tokens)
    return rounded(found, "expected", places=4).select("step", "token_id", "expected", "within")


_PLANS: dict[str, Callable[[Run], DataFrame]] = {
    "scan_filtered_stays": lambda r: r.t.for_stays("vitals", r.train).groupBy("hospitalization_id").agg(F.count("*").alias("n_rows")),
    "id_map_join": lambda r: r.t["ecg"].join(id_map(r.stays), "hadm_id").select("hadm_id", "ecg_time", "hospitalization_id"),
    "patient_split": lambda r: r.split,
    "patient_sample": lambda r: split.sample_patients(r.split, 50),
    "code_profile": lambda r: r.profile,
    "quantile_edges": lambda r: _edge_rows(bins.bin_edges(bins.numeric_values(r.t, r.train), "quantile")),
    "bin_edges_hybrid": lambda r: _edge_rows(bins.bin_edges(bins.numeric_values(r.t, r.train))),
    "bin_edges_clinical": lambda r: bins.bin_counts(bins.numeric_values(r.t, r.train), bins.bin_edges(bins.numeric_values(r.t, r.train), "clinical_only")),
    "ecg_similarity_edges": lambda r: rounded(r.similarity.select("branch", F.posexplode("edges").alias("edge_idx", "edge")), "edge"),
    "ecg_similarity_bins": lambda r: bins.with_similarity_bins(r.t["ecg"], r.similarity),
    "bin_lookup": lambda r: bins.with_bins(r.kept_log.where("value is not null"), r.edges).select("hospitalization_id", "event_idx", "code", "value", "bin"),
    **{f"events_{name}": (lambda r, make=make: make(r.t, r.profile).select(*EVENT)) for name, make in extract.EXTRACTORS.items()},
    "event_log_base": lambda r: extract.ordered(r.base).select(*LOG),
    "labels_rows": lambda r: labels.row_labels(r.t),
    "labels_discharge": lambda r: labels.row_labels(r.t, "hospitalization"),
    "labels_dnr": lambda r: labels.row_labels(r.t, "code_status"),
    "labels_icu_first": lambda r: labels.of(r.t, ["icu_admission"]),
    "labels_prolonged_icu": lambda r: labels.of(r.t, ["prolonged_icu_7d", "prolonged_icu_14d"]),
    "labels_resp_escalation": lambda r: labels.of(r.t, ["resp_escalation"]),
    "labels_reintubation": lambda r: labels.of(r.t, ["reintubation_48h"]),
    "labels_creatinine_rise": lambda r: labels.of(r.t, ["creatinine_rise"]),
    "labels_readmission": lambda r: labels.readmission(r.t, 30, 7),
    "labels_all": lambda r: r.labels,
    "label_first_occurrence": lambda r: insert.first_occurrences(r.labels),
    "log_with_labels": lambda r: insert.full_log(r.base, r.stays, r.labels, time_tokens=False).select(*LOG),
    "ecg_window_join": lambda r: r.ecg.select("hospitalization_id", "hadm_id", "ecg_time"),
    **{f"ecg_tokens_{route}": (lambda r, route=route: insert.ecg_events(r.ecg, route).select("hospitalization_id", "time", "code", "value")) for route in ("fusion_class", "all_branches")},
    "ecg_route_counts": _route_counts,
    "clock_tokens": lambda r: insert.clock_events(r.stays).select("hospitalization_id", "time", "code"),
    "gap_tokens": lambda r: r.kept_log.where("modality = 'DT'").select("hospitalization_id", "event_idx", "time", "code"),
    "event_log_full": lambda r: r.log.select(*LOG),
    "vocabulary": lambda r: r.vocab,
    "vocabulary_fused": lambda r: tokens.vocabulary(r.train_log, r.edges, fuse=True),
    "token_sequences": lambda r: r.tokens,
    "token_sequences_fused": lambda r: tokens.encoded_rows(r.kept_log, tokens.vocabulary(r.train_log, r.edges, fuse=True), r.edges, fuse=True),
    "sequence_store": _stored,
    "decoded_tokens": lambda r: tokens.decode(r.kept_tokens, r.vocab).select("hospitalization_id", "pos", "token", from_micros(F.col("ts_us")).alias("time")),
    "model_shares": lambda r: rounded(r.model, "share", places=9),
    "model_loss": lambda r: rounded(model.loss(dataset.label_mask(r.kept_tokens.join(r.train, "hospitalization_id", "left_anti"), dataset.label_ids(r.vocab)), r.model, r.vocab.count()), "loss"),
    "route_filter": lambda r: dataset.filter_route(r.kept_tokens, r.vocab, "fusion_class").select("hospitalization_id", "pos", "token_id"),
    "route_filter_orphans": lambda r: dataset.filter_route(r.kept_tokens, r.vocab, "fusion_class", drop_orphans=True).select("hospitalization_id", "pos", "token_id"),
    "label_mask": lambda r: dataset.label_mask(r.kept_tokens, dataset.label_ids(r.vocab)).select("hospitalization_id", "pos", "token_id", "is_label"),
    "sequence_chunks": lambda r: r.chunks.select("hospitalization_id", "chunk", "start", F.size("ids").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"), _joined("ids").alias("ids"), F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x).alias("n_loss")),
    "dynamic_batches": lambda r: dataset.padded(dataset.token_batches(r.chunks, BUDGET)).groupBy("batch").agg(F.count("*").alias("n_chunks"), F.max(F.size("ids")).alias("width"), F.sum("length").alias("n_tokens"), F.sum(F.size("attention_mask") - F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("n_padding")),
    "shuffled_batches": lambda r: dataset.token_batches(r.chunks, BUDGET, seed=42).select("batch", "hospitalization_id", "chunk", "length"),
    "midnight_windows": lambda r: r.windows,
    "window_contexts": lambda r: windows.contexts(r.windows, tokens.sequences(r.kept_tokens), 64).select("hospitalization_id", "window_id", _joined("context_ids").alias("context")),
    "horizon_truth": lambda r: r.truth,
    "clock_truncation": lambda r: r.samples.select("hospitalization_id", "window_id", "sample_id", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon_hours"), F.array_join(windows.truncate_at_clock(F.col("tokens"), r.ids("CLOCK//"), C.HORIZON_CLOCKS[h]).cast("array<string>"), " ").alias("tokens")) for h in HORIZONS]))),
    "mc_probability": lambda r: rounded(r.probabilities, "predicted_prob"),
    "scored_predictions": lambda r: rounded(r.scored, "predicted_prob").select("hospitalization_id", "window_id", "horizon_hours", "label", "predicted_prob", "actual_positive"),
    "generation_shares": _generation_shares,
    "prediction_metrics": lambda r: _rounded_metrics(metrics.grouped(r.scored)),
    "metric_auroc": lambda r: rounded(metrics.auroc(r.preds), "auroc"),
    "metric_auprc": lambda r: rounded(metrics.auprc(r.preds), "auprc"),
    "metric_brier": lambda r: rounded(metrics.brier(r.preds), "brier", places=9),
    "metric_ece": lambda r: rounded(metrics.ece(r.preds), "ece", places=9),
    "metric_bootstrap": lambda r: rounded(metrics.bootstrap_auroc(r.preds, n=100), "low", "median", "high"),
    "calibration_curve": lambda r: rounded(metrics.calibration(r.preds), "mean_predicted", "mean_actual"),
    "metrics_grouped": lambda r: _rounded_metrics(r.metrics),
    "metrics_json": lambda r: reports.metrics_json(_rounded_metrics(r.metrics)),
    "prefix_histogram": lambda r: reports.prefix_histogram(r.kept_log),
    "label_histogram": lambda r: reports.label_histogram(r.kept_log),
    "ecg_histogram": lambda r: reports.ecg_histogram(r.kept_log),
    "sequence_length_stats": lambda r: rounded(reports.length_stats(r.kept_log), "mean"),
    "describe_tokens": lambda r: rounded(reports.describe(tokens.sequences(r.kept_tokens), "token_count"), "value"),
    "stays_icu_and_vitals": lambda r: reports.stays_with_both(r.t["adt"].where("location_category = 'icu'"), r.t["vitals"]),
    "token_event_alignment": lambda r: reports.align_tokens(r.kept_tokens, r.vocab),
    "run_statistics": lambda r: reports.run_statistics(r.kept_log),
    "prevalence": lambda r: rounded(reports.evaluable(r.metrics), "prevalence").select("label", "horizon_hours", "prevalence"),
    "metric_key_parse": lambda r: reports.parse_metric_keys(r.metrics.select(F.concat(F.lit("LABEL//"), "label", F.lit("_"), F.col("horizon_hours").cast("string"), F.lit("h")).alias("key"))),
    "route_summary": lambda r: reports.route_summary(r.route_metrics),
    "route_pivot": lambda r: rounded(reports.route_pivot(r.route_metrics, list(C.ECG_ROUTES)), "no_ecg", "fusion_class", "all_branches", "delta_fusion_class", "delta_all_branches"),
    "route_delta": lambda r: rounded(rounded(reports.route_delta(r.route_metrics), "delta_auroc", "delta_auprc", "delta_brier"), "percent_auroc", places=4),
    "route_macro": lambda r: rounded(reports.route_macro(r.route_metrics), "macro", "macro_base", "delta", "percent", places=4),
    "top_labels": lambda r: rounded(reports.top_labels(r.route_metrics), "mean_auroc"),
    "quantile_edges_orders": _orders_edges,
    "patient_split_orders": lambda r: split.patient_split(r.orders["hospitalization"]),
    "readmission_orders": lambda r: labels.readmission(r.orders, 30),
    "event_log_orders": _orders_log,
}


def _query(plan: Callable[[Run], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(run(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(plan) for name, plan in _PLANS.items()}
