"""Sampled continuations against exact probabilities and rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayflow.operators import model

MODEL, CONTEXTS = "token_id int, next_id int, share double", "hospitalization_id string, window_id int, context_ids array<int>"


def test_alias_tables_give_the_shares():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 200):
        shares = rng.dirichlet(np.full(n, 0.2))
        keep, other = model._alias(shares.tolist())
        got = np.zeros(n)
        for j in range(n):
            got[j] += keep[j] / n
            got[other[j]] += (1 - keep[j]) / n
        assert np.allclose(got, shares, atol=1e-12)


def slow_successors(rows, how):
    """One token's successors, most likely first, after temperature, top-k and top-p."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    if how.temperature <= 0:
        return {rows[0][0]: 1.0}
    rows = rows[: how.top_k or None]
    w = [p ** (1 / how.temperature) for _, p in rows]
    kept, mass = [], 0.0
    for (t, _), x in zip(rows, w, strict=True):
        kept.append((t, x))
        mass += x / sum(w)
        if mass >= how.top_p:
            break
    return {t: x / sum(x for _, x in kept) for t, x in kept}


@pytest.mark.parametrize("how", [model.Generation(), model.Generation(top_k=3, top_p=0.7, temperature=0.5), model.Generation(temperature=0.0), model.Generation(top_k=0, top_p=1.0, temperature=2.0), model.Generation(top_p=0.0)])
def test_successors(spark, how):
    rng = np.random.default_rng(4)
    table = {t: rng.dirichlet(np.full(9, 0.5)).round(6) for t in range(4)}
    rows = [(t, i, float(p)) for t, ps in table.items() for i, p in enumerate(ps)] + [(9, 1, 1.0), (9, 2, 0.0)]
    got = {}
    for r in model.successors(spark.createDataFrame(rows, MODEL), how).collect():
        got.setdefault(r["token_id"], {})[r["next_id"]] = r["share"]
    assert set(got) == {0, 1, 2, 3, 9}
    for t in got:
        want = slow_successors([(i, p) for k, i, p in rows if k == t and p > 0], how)
        assert got[t] == pytest.approx(want)


def test_samples_follow_the_model_exactly_and_within_bounds(spark):
    rng = np.random.default_rng(5)
    rows = [(t, int(i), float(p)) for t in range(6) for i, p in enumerate(rng.dirichlet(np.full(6, 0.7)))]
    df, how = spark.createDataFrame(rows, MODEL), model.Generation(n_samples=20, max_new_tokens=4, top_k=0, top_p=1.0)
    contexts = spark.createDataFrame([(f"h{i}", i % 3, [1, i % 5]) for i in range(500)], CONTEXTS)
    samples = model.generate(contexts, df, how, steps=3)
    matrix = np.zeros((6, 6))
    for t, i, p in rows:
        matrix[t, i] = p
    mass = np.bincount([i % 5 for i in range(500)], minlength=6) * 20.0
    expected = {(r["step"], r["token_id"]): r["expected"] for r in model.step_shares(contexts, df, how, 4).collect()}
    for step in range(4):
        mass = mass @ matrix
        for t in range(6):
            assert expected[step, t] == pytest.approx(mass[t])
    shares = model.generated_shares(samples, model.step_shares(contexts, df, how, 4), 4).collect()
    assert all(r["within"] for r in shares) and sum(r["n"] for r in shares) == 500 * 20 * 4
    again = model.generate(contexts.repartition(7), df.repartition(3), how, steps=2)
    assert sorted(map(str, samples.collect())) == sorted(map(str, again.collect()))


def test_samples_end(spark):
    """A ring of tokens 0 1 2 3; 7 has no successor and no sample goes beyond what ends it."""
    ring = spark.createDataFrame([(i, (i + 1) % 4, 1.0) for i in range(4)] + [(6, 7, 1.0)], MODEL)
    contexts = spark.createDataFrame([("a", 0, [5, 0]), ("b", 0, [6]), ("c", 0, []), ("d", 0, [99])], CONTEXTS)

    def run(**more):
        how = model.Generation(n_samples=2, **more)
        found = model.generate(contexts, ring, how, steps=3).collect()
        assert len(found) == 8
        return {r["hospitalization_id"]: r["tokens"] for r in found}

    assert run(max_new_tokens=5) == {"a": [1, 2, 3, 0, 1], "b": [7], "c": [], "d": []}
    assert run(max_new_tokens=50, stop=(3,))["a"] == [1, 2, 3]
    assert run(max_new_tokens=50, clocks=(2, 3), clock_limit=3)["a"] == [1, 2, 3, 0, 1, 2]
    assert run(max_new_tokens=0)["a"] == []
    assert model.generate(contexts.limit(0), ring, model.Generation()).collect() == []
    assert model.generate(contexts, ring.limit(0), model.Generation(n_samples=1)).agg(F.sum(F.size("tokens"))).first()[0] == 0
