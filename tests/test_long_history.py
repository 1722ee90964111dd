"""Pieces with halos and carries against the same columns over whole symbols."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest, features, label, long_history, prep

SIZES = {"rows": 37, "slice_rows": 10}


@pytest.fixture(scope="module")
def series(spark):
    """Two symbols of unequal length with unevenly spaced days, gaps and odd values."""
    rng = np.random.default_rng(11)
    rows = []
    for s, n in (("A", 400), ("B", 23), ("C", 1)):
        day = np.cumsum(rng.choice([1, 1, 1, 2, 40], n))
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            o, c = float(close[i] * (1 + rng.normal(0, 0.005))), float(close[i])
            vpin = None if 50 < i < 200 or rng.random() < 0.7 else float(rng.random())
            sigma = 0.0 if i < 60 or rng.random() < 0.05 else float(rng.uniform(0.005, 0.03))
            rows.append((s, int(day[i]), o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(rng.integers(1, 1000)), 2.0 if i == 90 else 1.0, 0.5 if i % 50 == 7 else 0.0, vpin, sigma, float(rng.integers(-1, 2))))
    df = spark.createDataFrame(rows, "symbol string, day int, open double, high double, low double, close double, volume double, split_factor double, dividend double, daily_vpin double, sigma double, model_raw_target double")
    return df.withColumn("ts", F.date_add(F.lit("1995-01-01").cast("date"), F.col("day"))).drop("day").cache()


@pytest.fixture(scope="module")
def returned(series):
    return prep.returns(prep.adjust(series)).cache()


def same(got, want, tolerance=1e-9):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = (x.select(*sorted(want.columns)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b)
    for c in want.columns:
        if a[c].dtype == float:
            assert (a[c].isna() == b[c].isna()).all(), c
            assert np.allclose(a[c].fillna(0), b[c].fillna(0), rtol=tolerance, atol=tolerance), c
        else:
            assert (a[c] == b[c]).all(), c


def test_rows_are_numbered_and_dealt(series):
    dealt = long_history.deal(series, rows=37, halo=5, ahead=3, slice_rows=10).toPandas()
    own = dealt[dealt._own]
    for s, part in own.groupby("symbol"):
        part = part.sort_values("ts")
        assert part._i.tolist() == list(range(len(part))) and (part._piece == part._i // 37).all()
        for p in range(1, len(part) // 37):
            copies = dealt[(dealt.symbol == s) & (dealt._piece == p) & ~dealt._own]._i.tolist()
            assert sorted(copies) == [i for i in [*range(37 * p - 5, 37 * p), *range(37 * p + 37, 37 * p + 40)] if i < len(part)]


def test_adjust(series):
    same(long_history.adjust(series, **SIZES), prep.adjust(series), 1e-8)


def test_ffill(series):
    same(long_history.ffill_intraday(series, **SIZES), prep.ffill_intraday(series))


def test_volume_price_and_stress(returned):
    same(long_history.volume_price(returned, halo=37, **SIZES), features.volume_price(returned), 1e-8)
    same(long_history.stress(returned, halo=37, **SIZES), features.stress(returned))


@pytest.mark.parametrize("backfill", [True, False])
def test_local_volatility(returned, backfill):
    same(long_history.local_volatility(returned, backfill=backfill, **SIZES), label.local_volatility(returned, backfill=backfill))


def test_ledgers(returned):
    rows = returned.withColumn("local_volatility", F.col("sigma"))
    same(long_history.ledger(rows, **SIZES), backtest.ledger(rows, rows))
    same(long_history.against_benchmark(rows, **SIZES), backtest.against_benchmark(rows, rows))


def test_bounded_families_in_pieces(returned):
    def job(df):
        return features.median_regime(features.oscillators(features.trend(df)))

    same(long_history.piecewise(long_history.deal(returned, rows=120, halo=120, slice_rows=10), job), job(returned), 1e-8)


def test_a_long_symbol_is_spread(spark):
    """One symbol in a hundred pieces: no exchange or window of its rows goes by the symbol alone."""
    n, rows = 200_000, 2_000
    df = spark.range(n).select(F.lit("X").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.sin(F.col("id") * 0.7) / 100).alias("r"))
    dealt = long_history.deal(df, rows=rows, halo=0, slice_rows=1_000)
    assert dealt.groupBy("_piece").count().where(F.col("count") == rows).count() == n // rows
    out = long_history.carried(dealt, {"path": ("product", 1.0 + F.col("r")), "total": ("sum", F.col("r"))})
    last = out.orderBy(F.desc("_i")).first()
    x = np.sin(np.arange(n) * 0.7) / 100
    assert math.isclose(last["total"], x.sum(), abs_tol=1e-9) and math.isclose(last["path"], np.prod(1 + x), rel_tol=1e-9)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.split("\n") if "Window" in line and "_piece" in line and "[symbol" in line]
    assert alone and all("_t_" in line or "_piece#" in line for line in alone)


def test_empty_panel(series):
    assert long_history.adjust(series.limit(0)).count() == 0
    assert long_history.deal(series.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at least"):
        long_history.deal(series, rows=10, halo=11)
