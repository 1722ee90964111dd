"""The switching model against enumerated state paths, on drawn chains, and as a job."""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import markov
from barloom.operators import diagnostics


def enumerated(x, mu, var, stay):
    """Filtered and smoothed probabilities, moves and log likelihood over all paths."""
    p = np.array([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]])
    start = np.array([p[1, 0], p[0, 1]]) / (p[1, 0] + p[0, 1])
    d = np.exp(-0.5 * (x[:, None] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var)

    def paths(n):
        for path in itertools.product((0, 1), repeat=n):
            w = start[path[0]] * d[0, path[0]]
            for t in range(1, n):
                w *= p[path[t - 1], path[t]] * d[t, path[t]]
            yield path, w

    filtered, smoothed, moves = np.zeros((len(x), 2)), np.zeros((len(x), 2)), np.zeros((2, 2))
    for n in range(1, len(x) + 1):
        for path, w in paths(n):
            filtered[n - 1, path[-1]] += w
    total = filtered[-1].sum()
    for path, w in paths(len(x)):
        for t, s in enumerate(path):
            smoothed[t, s] += w
            if t:
                moves[path[t - 1], s] += w
    return filtered / filtered.sum(1, keepdims=True), smoothed / total, moves / total, np.log(total)


def test_filter_and_smoother_equal_enumeration():
    rng = np.random.default_rng(0)
    x, known = rng.normal(size=(3, 10)), np.ones((3, 10), bool)
    known[1, 7:], known[2, 1:] = False, False
    mu, var = rng.normal(size=(3, 2)), rng.uniform(0.2, 2.0, size=(3, 2))
    stay = rng.uniform(0.2, 0.95, size=(3, 2))
    alpha, gamma, moved, loglik = markov.smooth(x, known, mu, var, stay)
    for i in range(3):
        n = known[i].sum()
        filtered, smoothed, moves, log = enumerated(x[i, :n], mu[i], var[i], stay[i])
        assert np.allclose(alpha[i, :n], filtered, atol=1e-12) and np.allclose(gamma[i, :n], smoothed, atol=1e-12)
        assert np.allclose(moved[i], moves, atol=1e-12) and np.isclose(loglik[i], log)


def chain(rng, n):
    s = np.zeros(n, int)
    for t in range(1, n):
        s[t] = s[t - 1] if rng.random() < 0.97 else 1 - s[t - 1]
    return s, np.where(s == 1, rng.normal(-0.001, 0.03, n), rng.normal(0.001, 0.01, n))


def test_em_finds_drawn_regimes():
    rng = np.random.default_rng(4)
    drawn = [chain(rng, n) for n in (2000, 900, 400)]
    found, logs = markov.fit([x for _, x in drawn] + [np.zeros(50), np.ones(5), np.array([np.nan] * 40)])
    for (s, x), high in zip(drawn, found, strict=False):
        assert ((high > 0.5) == (s == 1)).mean() > 0.85
        alone, log = markov.fit([x])
        assert np.allclose(alone[0], high, atol=1e-6)
    assert found[3:] == [None] * 3 and np.isnan(logs[3:]).all()


def test_likelihood_beats_one_regime():
    rng = np.random.default_rng(9)
    _, x = chain(rng, 800)
    _, logs = markov.fit([x])
    one = (-0.5 * (np.log(2 * np.pi * x.var()) + (x - x.mean()) ** 2 / x.var())).sum()
    assert logs[0] > one + 20


def test_job(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(5):
        n = (600, 500, 20, 300, 1)[k]
        _, x = chain(rng, n)
        rows += [(f"s{k}", i, None if i % 50 == 3 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, d int, log_return double").withColumn("ts", F.date_add(F.lit("2001-01-01").cast("date"), F.col("d"))).drop("d")
    out = diagnostics.markov_regime(df, series=2).toPandas()
    assert len(out) == df.where("log_return is not null").count()
    status = out.groupby("symbol").status.first().to_dict()
    assert [status[f"s{k}"] for k in range(5)] == ["converged", "converged", "fallback", "converged", "fallback"]
    one = df.where("symbol = 's0' and log_return is not null").toPandas().sort_values("ts")
    want, _ = markov.fit([one.log_return.to_numpy()])
    assert np.allclose(out[out.symbol == "s0"].sort_values("ts").prob_regime_high_vol, want[0], atol=1e-9)
    short = out[out.symbol == "s2"].sort_values("ts")
    spread = pd.Series(df.where("symbol = 's2' and log_return is not null").toPandas().sort_values("ts").log_return.to_numpy()).rolling(20).std()
    assert short.prob_regime_high_vol.tolist() == (spread > spread.median()).astype(float).tolist()
    assert np.allclose(out.prob_regime_low_vol + out.prob_regime_high_vol, 1)
    assert diagnostics.markov_regime(df.limit(0)).count() == 0
