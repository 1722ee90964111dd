"""Boosting by distributed histograms against a plain booster that holds all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import boosting as B

FEATURES = [f"f{i}" for i in range(6)]


def rows(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, len(FEATURES)))
    x[:, 5] = rng.integers(0, 3, n)
    score = x[:, 0] + 0.7 * x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.5
    y = np.where(score > 0.5, 2, np.where(score < -0.5, 0, 1))
    return x, y, rng.uniform(0.5, 2.0, n)


def plain(x, y, w, key, cuts, s, model):
    """The same trees grown node by node over all rows; returns margins and the splits' gains."""
    bins = np.column_stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)])
    m, gains = np.zeros((len(x), 3)), []
    for r in range(s.rounds):
        p = np.exp(m) / np.exp(m).sum(1, keepdims=True)
        drawn = B.seen(key, s.seed, r, s.share)
        step = np.zeros_like(m)
        for c in range(3):
            g, h = w * (p[:, c] - (y == c)), w * 2 * p[:, c] * (1 - p[:, c])
            may = B.allowed(s, model, r, c, x.shape[1])

            def grow(at, depth):
                use = at & drawn
                best = None
                for f in np.flatnonzero(may) if depth < s.depth else ():
                    for b in range(cuts.shape[1]):
                        left = use & (bins[:, f] <= b)
                        right = use & (bins[:, f] > b)
                        hl, hr = h[left].sum(), h[right].sum()
                        if hl < s.child or hr < s.child:
                            continue
                        gain = g[left].sum() ** 2 / (hl + s.ridge) + g[right].sum() ** 2 / (hr + s.ridge) - g[use].sum() ** 2 / (h[use].sum() + s.ridge)
                        if gain > B.LEAST_GAIN and (best is None or gain > best[0] + 1e-9):
                            best = gain, f, b
                if best is None:
                    step[at, c] = -s.step * g[use].sum() / (h[use].sum() + s.ridge)
                    return
                gains.append((int(best[1]), best[0]))
                grow(at & (bins[:, best[1]] <= best[2]), depth + 1)
                grow(at & (bins[:, best[1]] > best[2]), depth + 1)

            grow(np.ones(len(x), bool), 0)
        m = m + step
    return m, gains


@pytest.fixture(scope="module")
def table(spark):
    x, y, w = rows()
    data = [(i % 2, i, int(y[i]), float(w[i]), *map(float, x[i])) for i in range(len(x))]
    df = spark.createDataFrame(data, "model int, key long, y int, weight double, " + ", ".join(f"{f} double" for f in FEATURES))
    return df.repartition(5).cache()


def test_equals_a_plain_booster(table, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)
    settings = {0: B.Settings(rounds=5, depth=3, step=0.3, ridge=2.0, child=3.0), 1: B.Settings(rounds=3, depth=2, step=0.2, share=1.0, columns=0.5, ridge=1.0, child=2.0, seed=7)}
    forests = B.fit(table, FEATURES, settings, bins=16)
    got = {r.key: (r.prob_short, r.prob_neutral, r.prob_long) for r in B.predict(table, FEATURES, forests).collect()}
    x, y, w = rows()
    for model, s in settings.items():
        at = np.arange(model, len(x), 2)
        m, gains = plain(x[at], y[at], w[at], at, forests[model].cuts, s, model)
        want = np.exp(m) / np.exp(m).sum(1, keepdims=True)
        assert np.allclose([got[i] for i in at.tolist()], want, atol=1e-9)
        mine = B.importances({model: forests[model]}, FEATURES)
        for f in range(len(FEATURES)):
            own = [g for i, g in gains if i == f]
            assert [round(g, 8) for _, n, g in mine if n == FEATURES[f]] == ([round(float(np.mean(own)), 8)] if own else [])


def test_learns_and_ranks_features(table):
    forests = B.fit(table.withColumn("model", F.lit(0)), FEATURES, {0: B.Settings(rounds=20, step=0.3, ridge=1.0, child=2.0)})
    out = B.predict(table.withColumn("model", F.lit(0)), FEATURES, forests)
    best = F.array_position(F.array(*[F.col(n) == F.greatest(*B.NAMES) for n in B.NAMES]), True) - 1
    assert out.agg(F.avg((best == F.col("y")).cast("double"))).first()[0] > 0.8
    assert max(B.importances(forests, FEATURES), key=lambda r: r[2])[1] == "f0"


def test_odd_models(spark, table):
    one = table.where("y = 2").withColumn("model", F.lit(3)).limit(4).withColumn("f1", F.lit(float("nan"))).withColumn("f2", F.lit(None).cast("double"))
    forests = B.fit(one, FEATURES, {3: B.Settings(rounds=2), 4: B.Settings(rounds=2)})
    assert set(forests) == {3} and not forests[3].gains
    out = B.predict(one.unionByName(one.withColumn("model", F.lit(4))), FEATURES, forests).collect()
    assert all((r.prob_long is None) == (r.model == 4) for r in out)
    assert all(r.prob_long > r.prob_short for r in out if r.model == 3)
    assert B.fit(table.limit(0), FEATURES, {0: B.Settings()}) == {}
