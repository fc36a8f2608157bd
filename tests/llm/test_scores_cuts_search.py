"""Quality scores, fill-in-middle and ranked search against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayflow.llm import bits, catalogue, fim, langid, scoring, search

# --- fill-in-middle ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=3000), st.integers(0, 5))
def test_rank_and_select(found, stretch):
    ones = np.array(found * stretch, bool)
    b = bits.Bits(ones)
    assert b.rank(np.arange(len(ones) + 1)).tolist() == np.concatenate([[0], ones.cumsum()]).tolist()
    assert b.select(np.arange(1, ones.sum() + 1)).tolist() == np.flatnonzero(ones).tolist()


TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow_fim(doc_id, text):
    text = text or ""
    tokens = TOKENS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in fim.SENTINELS) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


PARTS = st.lists(st.sampled_from([" ", "\n", "\t ", "\x1f", "a", "bc", "é", "日本", "😀", "<", "S>", "<P", "<M>", " "]), max_size=12).map("".join)


def test_fim_against_brute_force(spark):
    texts = [None, "", " ", "\n\n", "x", " x", "x ", "<P>", "a <S> b", "<", "S>", "a<\n<b", "é 日本 😀 z ", "word " * 60_000, "z" * 300_000]
    drawn: list[str] = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(PARTS)
    def draw(t):
        drawn.append(t)

    draw()
    rows = [(i, t, "own") for i, t in enumerate(texts + drawn)] + [(None, "a b c", "x"), (None, None, "x"), (3, "one two", "x"), (3, "one two", "x"), (-5, "one two three four", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut string").repartition(3)
    found = fim.transform(docs).withColumn("restored", fim.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "", tuple(r["fim"])) for r in found) == sorted((i is None, i, t or "", slow_fim(i, t)) for i, t, _ in rows)
    assert all(r["restored"] == (r["text"] or "") and r["cut"] in ("own", "x") for r in found) and len(found) == len(rows)
    assert {r["fim"]["form"] for r in found} == {"plain", "psm", "spm"}


def test_fim_replaces_its_column_and_takes_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 7)], "doc_id long, text string, fim int")
    assert fim.transform(docs).columns == ["doc_id", "text", "fim"] and fim.transform(docs).first()["fim"]["n"] == 2
    assert fim.transform(docs.limit(0)).collect() == []


# --- quality scores ---


def slow_isotonic(x, y):
    """The greatest mean of stretches that end here or later, over starts here or before."""
    n = len(x)
    return [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_against_the_min_max_formula():
    rng = np.random.default_rng(5)
    for _ in range(20):
        y = rng.integers(0, 2, 30).astype(float)
        at, value = scoring.isotonic(np.arange(30.0), y, np.ones(30))
        fit = slow_isotonic(np.arange(30), y)
        assert np.allclose(np.unique(np.round(value, 9)), np.unique(np.round(fit, 9))) and (np.diff(value) > 0).all() and (np.diff(at) > 0).all()


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    d, m = len(scoring.NAMES), 20_000
    model = scoring.Model(np.zeros(d), np.ones(d), rng.standard_normal((d, m)) / 2, rng.uniform(0, 2 * math.pi, m))
    x = rng.standard_normal((6, d)) * 0.5
    z = model.features(x)[:, 1:]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 2**2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_statistics():
    s = dict(zip(scoring.NAMES, scoring.text_statistics("AB ab ab!\n\nAB ab ab!"), strict=True))
    assert s["log_words"] == math.log1p(6) and s["distinct_words"] == 3 / 6 and s["repeated_lines"] == 0.5 and s["shouted"] == 2 / 6 and s["marked_words"] == 2 / 6
    assert abs(s["upper"] - 4 / 20) < 1e-12 and abs(s["newline"] - 2 / 20) < 1e-12 and s["repeated_pairs"] == 1 - 3 / 5
    assert scoring.text_statistics(None) == scoring.text_statistics("") == scoring.text_statistics(" \n ") == [0.0] * len(scoring.NAMES)
    assert len(scoring.text_statistics("é" * 200_000)) == len(scoring.NAMES)


def direct_scores(texts, ids, labels, folds_of, max_width=1.0, features=256, ridge=1e-4):
    """The same model from all examples at once, without Spark: dense sums, another isotonic regression."""
    d = len(scoring.NAMES)
    x = {i: np.array(scoring.text_statistics(t)) for i, t in zip(ids, texts, strict=True)}
    known = sorted(i for i in labels if i in x)
    e, y = np.stack([x[i] for i in known]), np.array([labels[i] for i in known], float)
    spread = e.std(0)
    rng = np.random.default_rng(42)
    w, b = rng.standard_normal((d, features)) / (max_width * math.sqrt(d)), rng.uniform(0, 2 * math.pi, features)
    lift = lambda s: np.concatenate([np.ones((len(s), 1)), np.cos(np.clip((s - e.mean(0)) / np.where(spread > 1e-9, spread, 1), -5, 5) @ w + b) * math.sqrt(2 / features)], axis=1)
    z, fold = lift(e), np.array([folds_of[i] for i in known])

    def solve(on):
        penalty = np.diag([1e-9, *[ridge] * features]) * max(1.0, on.sum())
        return np.linalg.lstsq(z[on].T @ z[on] + penalty, z[on].T @ y[on], rcond=None)[0]

    raw = np.array([z[i] @ solve(fold != fold[i]) for i in range(len(known))])
    order = np.argsort(raw)
    value = np.array(slow_isotonic(np.arange(len(raw)), y[order]))
    places = [(raw[order][value == v].mean(), v) for v in np.unique(value)]
    at, v = np.array(places).T
    return np.clip(np.interp(lift(np.stack([x[i] for i in ids])) @ solve(np.ones(len(known), bool)), at, v), 0, 1)


def test_quality_query_against_the_direct_solution(spark, sf_dir):
    """The whole query of the table, row by row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~langid.held_out()).select("doc_id", F.col("quality").alias("q"), F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)).alias("fold")).toPandas()
    want = direct_scores(docs["text"].tolist(), docs["doc_id"].tolist(), dict(zip(labels["doc_id"], labels["q"], strict=True)), dict(zip(labels["doc_id"], labels["fold"], strict=True)))
    got = catalogue.op11_quality_score(spark, sf_dir).toPandas().set_index("doc_id").loc[docs["doc_id"]]
    assert np.abs(got["score"].to_numpy() - want).max() < 1e-4
    assert (got["predicted"] == (got["score"] >= 0.7)).all() and got["score"].between(0, 1).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = catalogue.op11_quality_score(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found["predicted"] == found["quality"]).mean() >= 0.97 and len(found) > 50


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Good words here and there.", "a"), (1, "Good words here and there.", "b"), (2, None, "c"), (None, "", "d"), (3, "###" * 50_000, "e"), (4, "$$ $$", "f")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, None), (None, 1), (3, 0), (9, 1)], "doc_id long, quality int")
    stats = scoring.statistics(docs)
    model = scoring.fit(stats, labels)
    rows = scoring.predict(stats, model).collect()
    assert len(rows) == 6 and all(0 <= r["scored"]["score"] <= 1 for r in rows) and {r["score"] for r in rows} == set("abcdef")
    one = [r["scored"] for r in rows if r["doc_id"] == 1]
    assert one[0] == one[1]
    assert [(r["id"], r["y"]) for r in scoring.examples(stats, labels).orderBy("id").collect()] == [(1, 2 / 3), (3, 0.0)]
    none = scoring.predict(stats, scoring.fit(stats, labels.limit(0))).collect()
    assert {tuple(r["scored"]) for r in none} == {(0.5, 0)}
    assert scoring.predict(stats.limit(0), model).collect() == []
    same = scoring.fit(stats, labels.where("doc_id = 3"))
    assert {tuple(r["scored"]) for r in scoring.predict(stats, same).collect()} == {(0.0, 0)}


def test_sums_of_partitions_are_those_of_all(spark):
    rng = np.random.default_rng(2)
    d = len(scoring.NAMES)
    rows = [(i, rng.standard_normal(d).tolist(), float(i % 2)) for i in range(500)]
    model = scoring.Model(np.zeros(d), np.ones(d), rng.standard_normal((d, 16)), rng.uniform(0, 6, 16))
    df = spark.createDataFrame(rows, "id long, x array<double>, y double").repartition(7)
    z, y = model.features(np.array([r[1] for r in rows])), np.array([r[2] for r in rows])
    found = scoring.normal_equations(df, model, 5).sum(0)
    assert np.allclose(found[:, :-1], z.T @ z) and np.allclose(found[:, -1], z.T @ y)


# --- search ---


def slow_search(docs, items, k):
    cut = lambda t: re.findall(search.PATTERN, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = [(i, Counter(cut(t))) for i, t in docs if cut(t)]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    rows = []
    for item, terms in asked.items():
        scored = []
        for i, c in found:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in terms if w in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        rows += [(item, r + 1, i if is_id else None, -s) for r, (s, is_id, i) in enumerate(sorted(scored)[:k])]
    return sorted(rows, key=str)


@pytest.mark.parametrize(("block", "rows", "k", "probes"), [(64, 500_000, 50, 8), (3, 7, 4, 1), (1, 20, 50, 2)])
def test_search_against_brute_force(spark, block, rows, k, probes):
    rng = np.random.default_rng(block)
    words = ["the", "The", "é", "日本", "x1", "straße", "a-b", "q", "zz", "rare", "naïve", "ÉCOLE"]
    text = lambda: " ".join(rng.choice(words, rng.integers(1, 30)).tolist())
    docs = [(i, text()) for i in range(150)] + [(7, "the same"), (7, "the same"), (None, "rare q"), (900, None), (901, ""), (902, " ..! "), (903, "rare " * 5000), (-4, "zz\u0000zz É")]
    docs += [(1000 + i, "equal rows tie") for i in range(60)]
    items = [(i, text()) for i in range(12)] + [(3, "rare more"), (3, "rare more"), (50, None), (51, "!!"), (52, "unknown"), (None, "equal tie"), (53, "tie")]
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), block_docs=block)
    found = search.rank(index, spark.createDataFrame(items, "item_id long, text string"), k=k, probes=probes, batch_rows=rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == slow_search(docs, items, k)


def test_bounds_hold_and_blocks_are_passed_over(spark, sf_dir):
    """No score exceeds its block's bound, and most pairs of blocks and items need no scores."""
    index = search.build(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), block_docs=8)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    best = search.rank(index, items, k=5).groupBy("item_id").agg(F.min("score").alias("least"), F.max("score").alias("most")).toPandas().set_index("item_id")
    weights = search.weighed(index, search.query_terms(items)).toPandas()
    ids = sorted(weights["item"].unique())
    weights["at"] = weights["item"].map({x: n for n, x in enumerate(ids)})
    queries = search.Queries(ids, pa.Table.from_pandas(weights[["at", "term", "w"]]))
    scored = pairs = 0
    for r in index.blocks.collect():
        bound, _ = queries.bounds(pa.array(r["terms"]), np.frombuffer(r["top"], np.int32))
        pairs += len(ids)
        scored += sum(bound[n] >= best["least"][x] for n, x in enumerate(ids))
    assert scored < 0.5 * pairs
    assert index.n_docs == 1000


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.rank(search.build(empty), items).collect() == []
    assert search.rank(search.build(spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, score int")), items.limit(0)).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB1é日😀 .-_\x00", max_size=20)))
def test_numbers_of_terms(texts):
    assert search.term_numbers(pa.array(["x y", *texts], pa.string())[1:]).to_pylist() == [sum(search.term_counts(t.encode()).values()) for t in texts]


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("ab é,日本 x" * 500).encode()
    whole = search.term_counts(text)
    monkeypatch.setattr(search, "SLICE", 50)
    assert search.term_counts(text) == whole
