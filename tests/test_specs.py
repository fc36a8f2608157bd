"""Operators against short specifications in Python, on random inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayflow.functions import constants as C
from stayflow.functions.expressions import age_bucket, bin_of, gap_token, priority
from stayflow.operators import bins, dataset, metrics, model, windows
from stayflow.sources import store


def test_bin_lookup(spark):
    edges = [1.0, 2.0, 4.0]
    cases = [(0.0, 0), (1.0, 0), (2.0, 0), (2.5, 1), (4.0, 1), (9.0, 1), (float("nan"), 1)]
    rows = spark.createDataFrame([(v, edges) for v, _ in cases] + [(3.0, [5.0]), (3.0, []), (None, edges)], "v double, e array<double>")
    got = [r[0] for r in rows.select(bin_of(F.col("e"), F.col("v"))).collect()]
    assert got == [b for _, b in cases] + [-1, None, None]


def test_scalars(spark):
    ages = spark.createDataFrame([(18,), (29,), (30,), (65,), (79,), (80,), (99,)], "a int").select(age_bucket(F.col("a")))
    assert [r[0] for r in ages.collect()] == ["18-29", "18-29", "30-39", "60-69", "70-79", "80+", "80+"]
    codes = spark.createDataFrame([("DEMO//X",), ("ECG//Class/A",), ("LABEL//m",), ("NEW//x",), ("plain",)], "c string").select(priority(F.col("c")))
    assert [r[0] for r in codes.collect()] == [0, 2.5, 3, 2, 2]


def test_gap_buckets(spark):
    def spec(m):
        if m is None or m < 1:
            return None
        for a, b in zip(C.GAP_EDGES, C.GAP_EDGES[1:]):
            if m <= b:
                return f"DT//{a}-{b}"
        return "DT//480+"

    minutes = [None, 0.0, 0.99, 1.0, 4.0, 5.0, 5.01, 15.0, 29.9, 60.0, 61.0, 240.0, 480.0, 481.0]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in minutes], "m double").select(gap_token(F.col("m"))).collect()]
    assert got == [spec(m) for m in minutes]


def test_quantile_edges_equal_numpy(spark):
    rng = random.Random(7)
    values = {f"c{k}": [round(rng.gauss(5, 3), rng.choice([0, 1, 6])) for _ in range(rng.randint(3, 120))] for k in range(30)}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "code string, value double")
    got = {r["code"]: r["edges"] for r in bins.quantile_edges(df).collect()}
    want = {k: np.unique(np.percentile(vs, np.linspace(0, 100, 11))).tolist() for k, vs in values.items() if len(vs) >= 10}
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(got[k], want[k], rtol=0, atol=1e-12) and len(got[k]) == len(want[k])


def test_hybrid_edges(spark):
    df = spark.createDataFrame([("VITAL//hr", float(v)) for v in range(60, 90)] + [("X//y", float(v)) for v in range(20)], "code string, value double")
    got = {r["code"]: r["edges"] for r in bins.bin_edges(df).collect()}
    assert set(C.CLINICAL_EDGES["VITAL//hr"]) < set(got["VITAL//hr"]) and got["VITAL//hr"] == sorted(got["VITAL//hr"])
    assert got["VITAL//sbp"] == C.CLINICAL_EDGES["VITAL//sbp"] and len(got["X//y"]) == 11
    assert got.keys() == {r["code"] for r in bins.bin_edges(df, "anything").collect()}


@pytest.mark.parametrize(("max_len", "overlap"), [(10, 3), (8, 0), (5, 4), (4, 6), (64, 8)])
def test_chunks(spark, max_len, overlap):
    def spec(seq):
        if len(seq) <= max_len or overlap == 0:
            starts = [0]
        else:
            starts, at = [], 0
            while at < len(seq):
                starts.append(at)
                if at + max_len >= len(seq):
                    break
                at += max(max_len - overlap, 1)
        out = []
        for s in starts:
            part = seq[s : s + max_len]
            if s > 0:
                part = ([5] + part)[:max_len]
                loss = [1] + [0] * (overlap - 1) + [1] * (len(part) - overlap) if overlap else [1] * len(part)
            else:
                loss = [1] * len(part)
            out.append((part, loss[: len(part)]))
        return out

    seqs = {f"s{n}": list(range(100, 100 + n)) for n in (1, 4, 5, 9, 10, 11, 17, 18, 40)}
    df = spark.createDataFrame(list(seqs.items()), "hospitalization_id string, token_ids array<int>")
    got = {}
    for r in dataset.chunks(df, max_len, overlap, [101]).orderBy("hospitalization_id", "chunk").collect():
        got.setdefault(r["hospitalization_id"], []).append((r["ids"], r["loss_mask"]))
        assert r["label_mask"] == [t == 101 for t in r["ids"]]
    assert {k: v for k, v in got.items()} == {k: spec(v) for k, v in seqs.items()}


@pytest.mark.parametrize("budget", [7, 30, 100])
def test_batches(spark, budget):
    rng = random.Random(budget)
    rows = [(f"h{i:04d}", 0, [1] * rng.choice([1, 2, 3, 5, 8, 40, 120])) for i in range(400)]
    df = spark.createDataFrame(rows, "hospitalization_id string, chunk int, ids array<int>")
    df = df.withColumns({"label_mask": F.transform("ids", lambda _: F.lit(False)), "loss_mask": F.transform("ids", lambda _: F.lit(1))})
    sizes, used = [[]], 0
    for n in sorted(len(r[2]) for r in rows):
        if sizes[-1] and used + n > budget:
            sizes.append([])
            used = 0
        sizes[-1].append(n)
        used += n
    found = dataset.token_batches(df, budget)
    got = {}
    for r in found.collect():
        got.setdefault(r["batch"], []).append(r["length"])
    assert [sorted(got[b]) for b in sorted(got)] == sizes
    wide = dataset.padded(found).first()
    assert len(wide["ids"]) == wide["width"] == len(wide["attention_mask"]) and sum(wide["attention_mask"]) == wide["length"]


def test_clock_truncation(spark):
    df = spark.createDataFrame([([1, 9, 2, 9, 3, 9],), ([1, 2],), ([],)], "t array<int>")
    cut = [r[0] for r in df.select(windows.truncate_at_clock(F.col("t"), [9], 2)).collect()]
    assert cut == [[1, 9, 2, 9], [1, 2], []]


def test_metrics_against_definitions(spark):
    rng = random.Random(3)
    groups = {"perfect": [(i / 20, i >= 10) for i in range(20)], "one class": [(0.3, True), (0.6, True)], "random": [(rng.choice([0.1, 0.3, 0.30000000000000004, 0.5, 0.9, 1.0]), rng.random() < 0.4) for _ in range(200)]}
    rows = [(g, 8, p, y) for g, v in groups.items() for p, y in v]
    got = {r["label"]: r for r in metrics.grouped(spark.createDataFrame(rows, "label string, horizon_hours int, predicted_prob double, actual_positive boolean")).collect()}
    for g, v in groups.items():
        pos, neg = [p for p, y in v if y], [p for p, y in v if not y]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert got[g]["auroc"] == pytest.approx(want) if want is not None else got[g]["auroc"] is None
        ap, seen, tp = 0.0, 0, 0
        for s in sorted({p for p, _ in v}, reverse=True):
            here = [y for p, y in v if p == s]
            seen, tp = seen + len(here), tp + sum(here)
            ap += sum(here) / max(len(pos), 1) * tp / seen
        assert got[g]["auprc"] == pytest.approx(ap)
        assert got[g]["brier"] == pytest.approx(sum((p - y) ** 2 for p, y in v) / len(v))
        bounds, error = np.linspace(0, 1, 11), 0.0
        for i in range(10):
            inside = [(p, y) for p, y in v if bounds[i] <= p and (p < bounds[i + 1] or i == 9)]
            if inside:
                error += abs(np.mean([p for p, _ in inside]) - np.mean([float(y) for _, y in inside])) * len(inside) / len(v)
        assert got[g]["ece"] == pytest.approx(error)
    assert math.isclose(got["perfect"]["auroc"], 1.0) and got["one class"]["n_negative"] == 0


def test_bootstrap_is_near_and_reproducible(spark):
    rng = random.Random(5)
    rows = [("a", 8, round(rng.random(), 2), rng.random() < 0.5) for _ in range(300)] + [("b", 8, 0.5, True)]
    df = spark.createDataFrame(rows, "label string, horizon_hours int, predicted_prob double, actual_positive boolean")
    one, two = ({r["label"]: tuple(r) for r in metrics.bootstrap_auroc(df.repartition(k), n=200).collect()} for k in (1, 7))
    assert one == two and one["b"][2:] == (0.0, 0.0, 0.0)
    whole = {r["label"]: r["auroc"] for r in metrics.auroc(df).collect()}["a"]
    assert one["a"][2] < whole < one["a"][4] and abs(one["a"][3] - whole) < 0.02


def test_bootstrap_against_resampling(spark):
    """Interval against resamples of rows drawn one by one."""
    rng = np.random.default_rng(1)
    p = np.round(rng.random(2000), 1)
    y = rng.random(2000) < 0.2 + 0.5 * p
    df = spark.createDataFrame([("a", 8, float(a), bool(b)) for a, b in zip(p, y)], "label string, horizon_hours int, predicted_prob double, actual_positive boolean")
    got = metrics.bootstrap_auroc(df, n=400).first()
    found = []
    for _ in range(400):
        at = rng.integers(0, 2000, 2000)
        a, b = p[at][y[at]], p[at][~y[at]]
        found.append(((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()))
    assert np.allclose([got["low"], got["median"], got["high"]], np.quantile(found, [0.025, 0.5, 0.975]), atol=0.006)


@pytest.mark.parametrize("mean", [0, 1, 5, 8, 9, 40, 5000])
def test_poisson_numbers(spark, mean):
    keys, draws = np.random.default_rng(2).integers(0, 1 << 28, (3, 200)), np.arange(1, 101)
    u, w = (metrics.uniform(k, draws) for k in keys[:2])
    got = metrics.poisson(np.full(200, mean), u, np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * w))
    assert abs(got.mean() - mean) <= 0.03 * max(mean, 1) and abs(got.var() - mean) <= 0.05 * max(mean, 1) and got.min() >= 0
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u.ravel(), w.ravel())[0, 1]) < 0.02 and abs(np.corrcoef(u[:, :-1].ravel(), u[:, 1:].ravel())[0, 1]) < 0.02


def test_ranges_are_of_equal_depth_however_scores_lie(spark):
    """99 % of the scores below 0.001: no range holds many more of them than its share."""
    df = spark.range(60_000).selectExpr("'a' as label", "8 as horizon_hours", "case when id % 100 = 0 then rand(1) else rand(2) / 1000 end as predicted_prob", "id % 7 = 0 as actual_positive")
    sizes = metrics.in_ranges(df, metrics.GROUP).groupBy("range").count().toPandas()["count"]
    assert len(sizes) == metrics.RANGES and sizes.max() < 2 * 60_000 / metrics.RANGES


def test_bootstrap_shuffles_scores_not_draws(spark):
    df = spark.range(3000).selectExpr("'a' as label", "8 as horizon_hours", "rand(1) as predicted_prob", "rand(3) < 0.3 as actual_positive")
    plan = metrics.bootstrap_auroc(df, n=500)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "explode" not in below and "Generate" not in below
    found, whole = metrics.bootstrap_auroc(df, n=500).first(), metrics.auroc(df).first()["auroc"]
    assert found["low"] < whole < found["high"] and abs(found["median"] - whole) < 0.01


def test_running_sums_go_through_ranges(spark):
    rng = random.Random(8)
    rows = [("a", None if i % 50 == 0 else 8, rng.choice([rng.random(), 0.25, 0.0, 1.0]), rng.random() < 0.3) for i in range(900)]
    got = {r["horizon_hours"]: r for r in metrics.grouped(spark.createDataFrame(rows, "label string, horizon_hours int, predicted_prob double, actual_positive boolean")).collect()}
    for h in (8, None):
        pos, neg = ([p for _, k, p, y in rows if k == h and y == side] for side in (True, False))
        assert got[h]["auroc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))


def test_quantile_edges_of_hot_and_odd_values(spark):
    rng = random.Random(4)
    values = {"hot": [rng.gauss(80, 1e-3) for _ in range(5000)], "one": [3.5] * 2000, "two": [0.0] * 900 + [1.0] * 901, "few": [1.0] * 9, "huge": [10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(700)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("hot", None), (None, 1.0)], "code string, value double")
    got = {r["code"]: r["edges"] for r in bins.quantile_edges(df, k=64, error=0.02).collect()}
    assert set(got) == {"hot", "one", "two", "huge"}
    for k in got:
        want = np.unique(np.percentile(values[k], np.linspace(0, 100, 11)))
        assert len(want) == len(got[k]) and np.allclose(got[k], want, rtol=1e-12, atol=0)


@pytest.mark.parametrize(("k", "error"), [(8, 0.0), (64, 0.0), (64, 0.05), (4096, 0.003)])
def test_quantile_edges_when_brackets_miss(spark, k, error):
    """Brackets of no width, or of a sketch that is too coarse, miss ranks; edges are exact all the same."""
    rng = np.random.default_rng(k)
    values = {"a": rng.normal(0, 1, 20_000), "b": np.exp(rng.normal(0, 4, 9_000)), "c": rng.integers(0, 40, 9_000).astype(float), "d": np.concatenate([np.full(8_000, 2.5), rng.normal(0, 1, 2_000)])}
    df = spark.createDataFrame([(c, float(v)) for c, vs in values.items() for v in vs], "code string, value double").repartition(4)
    got = {r["code"]: r["edges"] for r in bins.quantile_edges(df, k=k, error=error).collect()}
    for c, vs in values.items():
        assert got[c] == np.unique(np.percentile(vs, np.linspace(0, 100, 11))).tolist(), c


def test_quantile_edges_read_values_twice_and_shuffle_few(spark, tmp_path, monkeypatch):
    spark.range(200_000).selectExpr("concat('c', id % 3) as code", "rand(5) as value").write.parquet(f"{tmp_path}/v.parquet")
    seen = []

    def written(df, tag):
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        paths = [leaves.apply(i).relation().location().rootPaths().mkString() for i in range(leaves.size())]
        seen.append((tag, sum(p.endswith("/v.parquet") for p in paths), store.written(df, tag)))
        return seen[-1][2]

    monkeypatch.setattr(bins, "written", written)
    assert len(bins.quantile_edges(spark.read.parquet(f"{tmp_path}/v.parquet")).collect()) == 3
    assert sum(n for _, n, _ in seen) == 2
    counts = next(df for tag, _, df in seen if tag == "counts")
    assert counts.count() < 200_000 * 0.12


def test_similarity_bins(spark):
    edges = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    rows = spark.createDataFrame([(0.1, edges), (0.5, edges), (0.9, edges), (2.0, edges), (0.3, None)], "v double, e array<double>")
    assert [r[0] for r in rows.select(bins.similarity_bin(F.col("e"), F.col("v"))).collect()] == [0, 2, 4, 4, 5]


def test_loss_weights_masks_and_padding(spark):
    rows = [("a", 0, 2, False, 1), ("a", 1, 7, False, 1), ("a", 2, 8, True, 1), ("a", 3, 9, False, 0), ("a", 4, 0, False, 1)]
    df = spark.createDataFrame(rows, "hospitalization_id string, pos int, token_id int, is_label boolean, loss_mask int")
    known = spark.createDataFrame([(2, 7, 1, 0.5), (7, 8, 1, 0.25), (8, 9, 1, 1.0)], "token_id int, next_id int, n long, share double")
    p = lambda share: -math.log(share * (1 - 1e-6) + 1e-6 / 10)
    got = model.loss(df, known, 10, label_weight=75).first()
    assert got["tokens"] == 4 and got["loss"] == pytest.approx((p(0.5) + 75 * p(0.25)) / (1 + 75 + 0 + 1))
    assert model.loss(df.drop("loss_mask"), known, 10).first()["loss"] == pytest.approx((p(0.5) + 75 * p(0.25) + p(1.0)) / (1 + 75 + 1 + 1))
    assert model.loss(df.limit(0), known, 10).first()["loss"] is None
    assert model.train(df).count() == 4 and model.train(df, keep=1).count() == 4


def test_shuffled_batches(spark):
    df = spark.createDataFrame([(f"h{i:03}", 0, [1] * (1 + i % 9)) for i in range(300)], "hospitalization_id string, chunk int, ids array<int>")
    plain, mixed = (dataset.token_batches(df, 20, seed=s).collect() for s in (None, 3))
    content = lambda rows: sorted(tuple(sorted(r["hospitalization_id"] for r in rows if r["batch"] == b)) for b in {r["batch"] for r in rows})
    assert content(plain) == content(mixed) and {r["batch"] for r in mixed} == set(range(len(content(plain))))
    order = {r["hospitalization_id"]: r["batch"] for r in plain}
    assert [order[r["hospitalization_id"]] for r in mixed] != [r["batch"] for r in mixed]


def test_probabilities_against_samples(spark):
    rng = random.Random(6)
    samples = [("h", w, s, [rng.choice([1, 2, 3, 9, 9, 7]) for _ in range(rng.randint(0, 12))]) for w in range(6) for s in range(4)]
    labels = {"x": 1, "mortality_y": 2, "z": 3, "mortality_w": 4}
    df = spark.createDataFrame(samples, "hospitalization_id string, window_id int, sample_id int, tokens array<int>")
    names = spark.createDataFrame(list(labels.items()), "label string, token_id int")
    for death in (7, None):
        got = {(r["window_id"], r["horizon_hours"], r["label"]): r["predicted_prob"] for r in windows.probabilities(df, names, [9], death).collect()}
        assert len(got) == 6 * 3 * 4
        for (w, h, label), p in got.items():
            hits = []
            for _, ww, _, t in samples:
                if ww == w:
                    clocks = [i for i, x in enumerate(t) if x == 9]
                    cut = t[: clocks[h // 4 - 1] + 1] if len(clocks) >= h // 4 else t
                    hits.append((death if "mortality" in label else labels[label]) in cut)
            assert p == pytest.approx(sum(hits) / 4)


def test_scored_against_tokens(spark):
    """Windows without samples, without a label after them and without tokens in a sample; a sample that is given twice counts
    once as a hit and twice as a sample."""
    rng, hour = random.Random(8), 3_600_000_000
    labels = {"x": 1, "mortality_y": 2, "z": 3}
    made = [(h, w, 4 * w, 12 * hour * w) for h in "abc" for w in range(3)]
    rows = [(h, p, rng.choice([1, 2, 3, 9, 7]), rng.randint(0, 60) * hour) for h in "ab" for p in range(20)]
    samples = [(h, w, s, None if s == 2 else [rng.choice([1, 3, 9, 9, 7, -1, None]) for _ in range(rng.randint(0, 12))]) for h, w, _, _ in made if w for s in range(4)]
    samples.append(samples[0])
    found = spark.createDataFrame(made, "hospitalization_id string, window_id int, end_pos int, end_us long")
    df = spark.createDataFrame(samples, "hospitalization_id string, window_id int, sample_id int, tokens array<int>")
    log = spark.createDataFrame(rows, "hospitalization_id string, pos int, token_id int, ts_us long")
    names = spark.createDataFrame(list(labels.items()), "label string, token_id int")
    for death in (7, None):
        hits, times = windows.label_hits(df, names, [9], death), windows.label_times(found, log, names)
        got = {(r["hospitalization_id"], r["window_id"], r["horizon_hours"], r["label"]): (r["predicted_prob"], r["actual_positive"]) for r in windows.scored(hits, times, names).collect()}
        truth = {tuple(r)[:4]: r["actual_positive"] for r in windows.horizon_truth(found, log, names).collect()}
        assert len(got) == len(truth) == 9 * 3 * 3 and {k: v[1] for k, v in got.items()} == truth
        for (stay, w, h, label), (p, y) in got.items():
            end = 12 * hour * w
            assert y == any(s == stay and t == labels[label] and end < us <= end + h * hour for s, _, t, us in rows)
            mine, wanted = [x for x in samples if x[:2] == (stay, w)], death if "mortality" in label else labels[label]
            true = set()
            for _, _, sample, t in mine:
                clocks = [i for i, x in enumerate(t or []) if x == 9]
                if wanted is not None and wanted in ((t or [])[: clocks[h // 4 - 1] + 1] if len(clocks) >= h // 4 else t or []):
                    true.add(sample)
            assert p == pytest.approx(len(true) / len(mine) if mine else 0)
