"""Window rules against pandas, causality, golden numbers, helpers and sources."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.functions import windows as W
from barloom.operators import backtest, diagnostics, evaluation, features, label, models, prep, selection, validation
from barloom.sources import bars as src


def walk(n=200, symbols=("A", "B"), seed=42):
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        o = c * np.exp(rng.normal(0, 0.005, n))
        out.append(
            pd.DataFrame(
                {
                    "symbol": s,
                    "ts": pd.date_range("2020-01-01", periods=n).date,
                    "open": o,
                    "high": np.maximum(o, c) * 1.01,
                    "low": np.minimum(o, c) * 0.98,
                    "close": c,
                    "volume": rng.integers(100_000, 999_999, n).astype(float),
                    "mkt_return": rng.normal(0, 0.01, n),
                }
            )
        )
    return pd.concat(out)


@pytest.fixture(scope="module")
def frame():
    return walk()


def panel(spark, pdf):
    return prep.returns(prep.adjust(prep.repair(spark.createDataFrame(pdf))))


def by_symbol(df):
    pdf = df.toPandas().sort_values(["symbol", "ts"])
    return {s: g.reset_index(drop=True) for s, g in pdf.groupby("symbol")}


def test_rolling_rules_match_pandas(spark, frame):
    holes = frame.assign(x=np.where(np.arange(len(frame)) % 17 == 3, np.nan, frame["close"]))
    df = spark.createDataFrame(holes).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    df = df.withColumns({"m": W.mean("x", 5), "s": W.std("x", 5, 1), "k": W.skew("close", 20), "q": W.kurtosis("close", 20), "f": W.ffill("x"), "z": W.zscore("close", 10, 1)})
    for s, g in by_symbol(df).items():
        p = holes[holes.symbol == s].reset_index(drop=True)
        want = {
            "m": p.x.rolling(5).mean(), "s": p.x.shift(1).rolling(5).std(), "k": p.close.rolling(20).skew(), "q": p.close.rolling(20).kurt(), "f": p.x.ffill(),
            "z": (p.close - p.close.shift(1).rolling(10).mean()) / (p.close.shift(1).rolling(10).std() + 1e-8),
        }
        for c, x in want.items():
            assert np.allclose(g[c].astype(float), x, equal_nan=True, rtol=1e-8, atol=1e-8), c


def test_ewm_columns_match_pandas(spark, frame):
    df = features.macd(label.local_volatility(panel(spark, frame)))
    for g in by_symbol(df).values():
        assert np.allclose(g.local_volatility, g.log_return.ewm(span=20, min_periods=2).std().bfill())
        fast, slow = (g.close_adj.ewm(span=k, adjust=False).mean() for k in (12, 26))
        assert np.allclose(g.macd_dist, fast / slow - 1)


def test_ewm_of_long_and_gappy_series(spark):
    """5,000 rows cross many blocks; nulls in front and inside keep the deviation's rules, a null keeps the mean."""
    rng = np.random.default_rng(8)
    x = rng.normal(0.001, 0.02, 5000)
    x[[0, 1, 777, 778, 4000]] = np.nan
    rows = [("A", i, None if np.isnan(v) else float(v), float(100 + np.nan_to_num(x)[: i + 1].sum())) for i, v in enumerate(x)] + [("B", i, None, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "symbol string, ts int, r double, p double")
    got = label.with_ewm(df, {"s": ("r", 20, "std"), "m": ("p", 26, "mean"), "n": ("r", 12, "mean")}).orderBy("symbol", "ts").toPandas()
    a = got[got.symbol == "A"]
    assert np.allclose(a.s.to_numpy(float), pd.Series(x).ewm(span=20, min_periods=2).std(), rtol=1e-10, equal_nan=True)
    assert np.allclose(a.m, pd.Series([r[3] for r in rows[:5000]]).ewm(span=26, adjust=False).mean(), rtol=1e-12)
    assert a.n.isna().tolist()[:3] == [True, True, False] and a.n.notna()[2:].all()
    b = got[got.symbol == "B"]
    assert b.s.isna().all() and b.n.isna().all() and (b.m == 1).all()


def test_cutoffs_are_exact_medians(spark):
    rng = np.random.default_rng(5)
    rows = []
    for fold, n in ((0, 4001), (1, 500), (2, 12), (3, 0)):
        d = np.round(rng.normal(0.05, 0.3, n), 2 if fold == 0 else 6)  # fold 0 is full of ties
        rows += [(fold, float(v)) for v in d] + [(fold, 0.0)]
    got = {r["fold"]: r for r in models.thresholds(spark.createDataFrame(rows, "fold int, prob_delta double")).collect()}
    assert set(got) == {0, 1, 2, 3}
    for fold, r in got.items():
        d = np.array([v for f, v in rows if f == fold])
        up, down = d[d > 0], d[d < 0]
        assert r["up_cut"] == pytest.approx(max(0.04, np.median(up) if len(up) > 10 else 0.04), abs=1e-15)
        assert r["down_cut"] == pytest.approx(min(-0.04, np.median(down) if len(down) > 10 else -0.04), abs=1e-15)


def test_pairs_and_correlations_match_plain_counts(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=300)
    near = np.abs(x[:, None] - x[None, :]) < 0.7
    both = near[:-1, :-1] & near[1:, 1:]
    assert stats.close_pairs(x[:-1], x[1:], 0.7) == int(np.triu(both, 1).sum())
    tied = np.repeat([0.0, 1.0, 2.0], 20)
    assert stats.close_pairs(tied, tied[::-1].copy(), 0.5) == int(np.triu((tied[:, None] == tied) & (tied[::-1][:, None] == tied[::-1]), 1).sum())
    wide = pd.DataFrame(rng.normal(size=(500, 5)) + 1e4, columns=list("abcde"))
    wide["e"] = 3.0
    wide.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(wide.astype(object).where(wide.notna(), None), "a double, b double, c double, d double, e double")
    full = wide.dropna()
    want = full[list("abcd")].corr().to_numpy()
    r = selection.correlation_matrix(df, list("abcde"))
    assert np.allclose(r[:4, :4], want, atol=1e-10) and r[4, :4].tolist() == [0] * 4


def test_features_do_not_look_ahead_and_symbols_stay_apart(spark, frame):
    cut = 150
    changed = frame.copy()
    late = changed.groupby("symbol").cumcount() >= cut
    changed.loc[late.to_numpy(), ["open", "high", "low", "close"]] *= 1.5
    a, names = features.assemble(panel(spark, frame))
    b, _ = features.assemble(panel(spark, changed))
    c, _ = features.assemble(panel(spark, frame[frame.symbol == "A"].sample(frac=1, random_state=1)))
    a, b, c = by_symbol(a), by_symbol(b), by_symbol(c)
    for s in a:
        assert np.allclose(a[s][names][:cut].astype(float), b[s][names][:cut].astype(float), equal_nan=True)
    assert np.allclose(a["A"][names].astype(float), c["A"][names].astype(float), equal_nan=True)


def test_flags_gate_families(spark, frame):
    flags = spark.createDataFrame([("A", True), ("B", False)], "symbol string, has_long_trend boolean")
    rest = {f: F.lit(True) for _, f in features.ROUTES if f and f != "has_long_trend"}
    df, _ = features.assemble(panel(spark, frame), flags.withColumns(rest))
    got = by_symbol(df.select("symbol", "ts", "ret_5", "wavelet_approx_a3"))
    assert got["A"].ret_5.notna().sum() > 100 and got["B"].ret_5.isna().all() and got["B"].wavelet_approx_a3.notna().any()


def test_symbols_get_their_own_lags_and_order(spark, frame):
    flags = spark.createDataFrame([("A", [1, 5, 7], 0.3), ("B", [5, 20], 1.0)], "symbol string, dynamic_lags array<int>, optimal_d double")
    flags = flags.withColumns({f: F.lit(True) for _, f in features.ROUTES if f})
    df, names = features.assemble(panel(spark, frame), flags)
    got = by_symbol(df.select("symbol", "ts", "ret_7", "rvol_7", "zscore_20", "rsi_14", "`frac_diff_d0.30`", "macd_dist", "gmm_prob_bull"))
    assert len(names) == len(set(names))
    for c, a, b in (("ret_7", 1, 0), ("rvol_7", 1, 0), ("zscore_20", 0, 1), ("rsi_14", 1, 1), ("frac_diff_d0.30", 1, 0), ("macd_dist", 1, 1), ("gmm_prob_bull", 1, 1)):
        assert (got["A"][c].notna().any(), got["B"][c].notna().any()) == (a, b), c


def test_last_labels_are_null(spark, frame):
    out = by_symbol(label.triple_barrier(label.local_volatility(panel(spark, frame)), h=5))
    for g in out.values():
        assert g.target_label[-5:].isna().all() and g.target_label[:-5].notna().all()
        assert set(g.target_label.dropna()) <= {-1.0, 0.0, 1.0}


def test_both_barriers_at_once_is_neutral(spark):
    rows = [("A", f"2020-01-0{i}", 10.0, 0.0) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "symbol string, ts string, close_adj double, local_volatility double").withColumn("ts", F.col("ts").cast("date"))
    assert [r["target_label"] for r in label.triple_barrier(df).orderBy("ts").collect()] == [0.0, 0.0] + [None] * 5


def test_folds_purge_and_sizes(spark):
    df = spark.range(1996).select(F.lit("A").alias("symbol"), F.col("id").alias("ts"))
    parts = validation.folds(df).toPandas()
    tests = parts[parts.part == "test"]
    assert len(tests) == 1660 and set(tests.groupby("fold").size()) == {332}
    for f in range(5):
        train, test = (parts[(parts.fold == f) & (parts.part == p)].i for p in ("train", "test"))
        assert test.min() - train.max() > 5 and len(train) <= 745 and not set(train) & set(test)


def test_class_weights_balance(spark):
    df = spark.createDataFrame([("A", 0, y) for y in [1.0] * 6 + [-1.0] * 2], "symbol string, fold int, target_label double")
    got = validation.class_weights(df).groupBy("target_label").agg(F.sum("weight").alias("w")).collect()
    assert len(got) == 2 and all(math.isclose(r["w"], 4.0) for r in got)


def test_report_of_published_counts(spark):
    """The nine published counts give the published report."""
    counts = {(-1, -1): 101, (-1, 0): 469, (-1, 1): 117, (0, -1): 37, (0, 0): 134, (0, 1): 27, (1, -1): 95, (1, 0): 521, (1, 1): 154}
    rows = [k for k, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "true_target int, model_raw_target int")
    got = {r["class"]: r for r in evaluation.report(df).collect()}
    want = {"-1": (0.4335, 0.1470, 0.2196), "0": (0.1192, 0.6768, 0.2027), "1": (0.5168, 0.2000, 0.2884), "macro": (0.3565, 0.3413, 0.2369), "weighted": (0.4346, 0.2350, 0.2496)}
    for k, (p, r, f) in want.items():
        assert (round(got[k]["precision"], 4), round(got[k]["recall"], 4), round(got[k]["f1"], 4)) == (p, r, f)
    assert round(got["accuracy"]["precision"], 4) == 0.2350 and got["accuracy"]["support"] == 1655
    assert [tuple(r) for r in evaluation.confusion(df).orderBy("true").collect()] == [(-1, 101, 469, 117), (0, 37, 134, 27), (1, 95, 521, 154)]


def test_annualised_return(spark):
    got = spark.range(1).select(backtest.annualized(F.lit(-0.4705), F.lit(1655)).alias("a")).first()["a"]
    assert round(got, 4) == -0.0923


def test_ledger_trades_the_next_day(spark, frame):
    df = label.local_volatility(panel(spark, frame)).withColumn("model_raw_target", F.when(F.dayofmonth("ts") % 2 == 0, 1.0).otherwise(-1.0))
    for g in by_symbol(backtest.ledger(df, df)).values():
        assert g.active_position[0] == 0 and (g.active_position[1:].to_numpy() == g.model_raw_target[:-1].to_numpy()).all()
        assert np.allclose(g.equity, 100_000 * (1 + g.net_return).cumprod())
        assert np.allclose(g.drawdown, g.equity / g.equity.cummax() - 1)


def test_adjustment_compounds_splits_and_dividends(spark):
    rows = [("A", "2020-01-01", 10.0, 1.0, 0.0), ("A", "2020-01-02", 5.5, 0.5, 0.0), ("A", "2020-01-03", 5.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "symbol string, ts string, close double, split_factor double, dividend double").withColumns({c: F.col("close") for c in ("open", "high", "low")})
    assert [round(r["close_adj"], 8) for r in prep.adjust(df).orderBy("ts").collect()] == [10.0, 11.0, 11.0]


def test_flat_columns_go(spark, frame):
    df, gone = prep.drop_flat(spark.createDataFrame(frame.assign(still=0.0, split_factor=1.0)))
    assert gone == ["still"] and "split_factor" in df.columns and "still" not in df.columns


def test_selection_screens(spark, frame):
    df = label.triple_barrier(label.local_volatility(features.volume_price(features.market_context(panel(spark, frame)))))
    df = df.withColumn("copy", F.col("cmf_20") * 2)
    names = ["cmf_20", "copy", "mkt_relative_return", "obv_zscore_20"]
    assert {r["feature"] for r in selection.correlation_screen(df, names).where("dropped").collect()} == {"copy"}
    assert "copy" not in selection.vif_screen(df, names)
    got = selection.select(df, names).collect()
    assert got and "copy" not in {r["feature"] for r in got}
    few = spark.createDataFrame([(f"f{i}", i / 1000) for i in range(4)] + [("cmf_x", 0.2)], "feature string, mi double")
    assert [r["feature"] for r in selection.prioritised(few).orderBy("place").collect()] == ["cmf_x", "f3", "f2", "f1", "f0"]


def test_tails_and_tests():
    assert math.isclose(stats.normal_tail(1.959963985), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.t_tail(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.f_tail(3.325834530, 5, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(stats.chi2_tail(11.07049769, 5), 0.05, rel_tol=1e-6)
    rng = np.random.default_rng(0)
    noise, path = rng.normal(size=600), np.cumsum(rng.normal(size=600))
    assert stats.adf_p(noise) < 0.01 and stats.adf_p(path) > 0.05 and stats.kpss_p(path) <= 0.01 < stats.kpss_p(noise)
    chaos = [0.3]
    for _ in range(599):
        chaos.append(3.99 * chaos[-1] * (1 - chaos[-1]))
    assert stats.bds_two(noise)[1] > 0.01 and stats.bds_two(np.array(chaos))[1] < 1e-6
    y = np.sign(noise)
    assert stats.nearest_information(noise, y) > 0.4 and stats.nearest_information(rng.normal(size=600), y) < 0.1
    cause = np.concatenate(([0.0, 0.0], noise[:-2])) + 0.1 * rng.normal(size=600)
    assert stats.granger(cause, noise)[0] < 1e-6
    assert stats.dominant_cycle(np.sin(np.arange(400) * 2 * np.pi / 8)) == 8
    blocks = np.kron(np.eye(4), np.full((5, 5), 0.9)) + 0.1 * np.eye(20)
    assert len(set(stats.ward_clusters(np.sqrt(0.5 * (1 - blocks)), 4)[::5])) == 4 and len(stats.medoids(blocks, 4)) == 4


def test_diagnostics_of_short_series(spark, frame):
    short = panel(spark, frame.groupby("symbol").head(20))
    row = diagnostics.payload(short).orderBy("symbol").first()
    assert list(row["dynamic_lags"]) == [1, 3, 5] and row["optimal_d"] == 1.0 and row["dominant_cycle"] == 10


def test_threshold_grid_without_trades(spark):
    df = spark.createDataFrame([(0.1, 0.1, 0)] * 30, "prob_long double, prob_short double, true_target int")
    assert models.threshold_grid(df).collect() == []


def test_files_round_trip(spark, frame, tmp_path):
    df = spark.createDataFrame(frame).select("symbol", "ts", "open", "high", "low", "close", "volume")
    for fmt in ("parquet", "csv"):
        path = f"{tmp_path}/{fmt}"
        src.write_bars(df, path, fmt)
        back = spark.read.option("header", True).option("inferSchema", True).format(fmt).load(path)
        assert back.count() == df.count() and set(back.columns) == set(df.columns)
    plain = f"{tmp_path}/plain"
    df.write.parquet(plain)
    assert src.read_bars(spark, plain, start="2020-01-10", end="2020-01-12").count() == 6
    with pytest.raises(ValueError):
        src.read_or(df.limit(0), df.limit(0))
    spark.createDataFrame([("a", 0.2, 0.0, 3), ("b", 0.5, 0.1, 5)], src.IMPORTANCE).write.option("header", True).csv(f"{tmp_path}/gain")
    assert [r["feature"] for r in src.read_importance(spark, f"{tmp_path}/gain", 1).collect()] == ["b"]
