"""The nested walk-forward job: fold series, selection over all features, decisions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import backtest, selection, validation, walkforward
from barloom.plans.panel import labeled

from .test_plain import by_symbol


def test_fold_series_hold_train_gap_and_test(spark):
    df = spark.createDataFrame([("A", i) for i in range(900)], "symbol string, ts int")
    rows = walkforward.fold_series(df).collect()
    want = {(r["fold"], r["ts"], r["part"]) for r in validation.folds(df).collect()}
    assert {(r["fold"], r["ts"], r["part"]) for r in rows if r["part"] in ("train", "test")} == want
    for f in range(5):
        own = sorted(r["ts"] for r in rows if r["fold"] == f)
        assert own == list(range(own[0], own[0] + len(own)))  # contiguous
        assert sum(r["part"] == "gap" for r in rows if r["fold"] == f) == validation.GAP
    assert {r["symbol"] for r in rows} == {f"A#{f}" for f in range(5)}


def test_selection_keeps_six_to_sixteen_transforms():
    """The bounds hold with any number of candidates; among few, the one that drives the label leads."""
    rng = np.random.default_rng(7)
    n = 400
    x = pd.DataFrame({f"f{i:02d}": rng.normal(size=n).cumsum() if i % 2 else rng.normal(size=n) for i in range(40)})
    x["cmf_20"] = rng.normal(size=n)
    y = np.sign(np.concatenate(([0.0], x["cmf_20"].to_numpy()[:-1])) + rng.normal(size=n) * 0.2)
    got = walkforward.chosen(x, y)
    assert selection.LEAST <= len(got) <= selection.MOST and [g[4] for g in got] == list(range(1, len(got) + 1))
    assert walkforward.chosen(x[["f00", "f02", "f04", "f06", "cmf_20"]], y)[0][0] == "cmf_20"
    assert selection.LEAST <= len(walkforward.chosen(x[["f00", "f01", "f02"]], y)) <= selection.MOST
    assert walkforward.chosen(x.head(20), y[:20]) == []


def test_transforms_match_the_windows(spark):
    from barloom.operators import features

    rng = np.random.default_rng(3)
    v = rng.normal(size=80)
    df = spark.createDataFrame([("A", i, float(a)) for i, a in enumerate(v)], "symbol string, ts int, f double")
    rows = by_symbol(features.lag_transforms(df, {"f": 3}))["A"]
    plain = walkforward.transforms(pd.Series(v), 3)
    for kind, name in (("zscaled", "f_zscaled_lag3"), ("momentum", "f_momentum"), ("acceleration", "f_acceleration")):
        assert np.allclose([np.nan if r[name] is None else r[name] for r in rows], plain[kind], equal_nan=True)


def test_mixture_fits_are_spread_whatever_their_bytes(spark):
    """Adaptive execution joins partitions of few bytes: the fits of all series then ran one after another in one task."""
    from barloom.operators import features

    df = spark.createDataFrame([(f"S{j}", i, ((i * 7919 + j) % 101 - 50) / 1000) for j in range(6) for i in range(300)], "symbol string, ts int, log_return double")
    out = features.gmm_regimes(df)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1800


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """All folds take their fits at the same time, and the decided rows are those of one fold after another."""
    import threading

    rng = np.random.default_rng(5)
    n = 600
    names = [f"f{i}" for i in range(3)]
    x = rng.normal(size=(2 * n, 3))
    label = np.sign(np.round(x[:, 0]))
    df = spark.createDataFrame([("AB"[i // n], i % n, 10.0, 10.0, 0.1, float(label[i]), *map(float, x[i])) for i in range(2 * n)], f"symbol string, ts int, close double, close_adj double, local_volatility double, target_label double, {', '.join(c + ' double' for c in names)}")
    flags = spark.createDataFrame([("A#0", 1)], "symbol string, dominant_cycle int")
    monkeypatch.setattr(walkforward.diagnostics, "payload", lambda rows: flags)
    monkeypatch.setattr(walkforward.features, "assemble", lambda rows, flags: (rows, names))
    fit, running, most, lock = walkforward.models.fit, [0], [0], threading.Lock()

    def watched(*a, **k):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return fit(*a, **k)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(walkforward.models, "fit", watched)
    key = lambda rows: sorted((r["symbol"], r["ts"], r["fold"], r["model_raw_target"], r["prob_delta"], r["up_cut"]) for r in rows.collect())
    apart = key(walkforward.run(df, k=2, inner=2, at_once=1, trees=2, depth=2)[0])
    assert most[0] == 1 and len({r[2] for r in apart}) == 2
    assert key(walkforward.run(df, k=2, inner=2, trees=2, depth=2)[0]) == apart
    assert most[0] == 2


def test_walk_forward_decides_every_test_row(spark, sf):
    df = labeled(spark, sf)
    two = [r[0] for r in df.select("symbol").distinct().orderBy("symbol").limit(2).collect()]
    df = df.where(F.col("symbol").isin(two))
    rows, picked, used = walkforward.run(df, k=2, inner=2, trees=3, depth=2)
    series = {}
    for r in picked.collect():
        series.setdefault((r["symbol"], r["fold"]), []).append(r["place"])
    assert len(series) == 4 and all(selection.LEAST <= len(p) <= selection.MOST for p in series.values())
    assert all(1 <= n <= selection.MOST for n in (r["count"] for r in used.groupBy("fold").count().collect()))
    tests = validation.folds(df, 2).where("part = 'test' and target_label is not null")
    assert {(r["symbol"], r["ts"], r["fold"]) for r in rows.collect()} == {(r["symbol"], r["ts"], r["fold"]) for r in tests.collect()}
    for r in rows.collect():
        assert r["model_raw_target"] == (1 if r["prob_delta"] > r["up_cut"] else -1 if r["prob_delta"] < r["down_cut"] else 0)
        assert r["up_cut"] >= 0.04 and r["down_cut"] <= -0.04 and abs(r["prob_short"] + r["prob_neutral"] + r["prob_long"] - 1) < 1e-9
    assert backtest.ledger(rows, rows).count() == rows.where("local_volatility is not null").count()
