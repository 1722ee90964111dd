"""Tests from sums of products against tests that hold the series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.operators import diagnostics, regressions, selection


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s, n in (("A", 400), ("B", 60), ("C", 12), ("D", 3)):
        x = rng.normal(size=n)
        smooth = np.convolve(rng.normal(size=n + 19), np.ones(20) / 20, "valid")
        y = np.sign(np.round(np.roll(x, 2) * 0.8 + rng.normal(size=n)))
        for i in range(n):
            rows.append((s, i, float(y[i]), float(x[i]), float(1e6 + 1e3 * rng.normal()), float(smooth[i]), 7.0, None if i % 31 == 5 else float(rng.normal()), float(rng.normal() * (1 + 2 * abs(smooth[i]) * 10)) / 100))
    df = spark.createDataFrame(rows, "symbol string, d int, target_label double, cause double, large double, smooth double, flat double, `with.dot` double, log_return double")
    return df.withColumn("ts", F.date_add(F.lit("2001-01-01").cast("date"), F.col("d"))).drop("d").cache()


def test_nested_f_equals_least_squares(panel):
    names = ["cause", "large", "smooth", "flat", "with.dot"]
    got = {(r.symbol, r.feature): r for r in regressions.granger_screen(panel, names).collect()}
    for s, part in panel.toPandas().sort_values("ts").groupby("symbol"):
        kept = part.dropna(subset=["target_label", *names])
        for f in names:
            if len(kept) < 2:
                continue
            p, k = stats.granger(kept["target_label"].to_numpy(), kept[f].to_numpy())
            assert got[s, f].p == pytest.approx(p, abs=1e-6 if f == 'flat' else 1e-9) and (got[s, f].lag == k or p > 0.999), (s, f)
            assert got[s, f].causal == (p < 0.05)
    assert got["A", "cause"].causal and not got["A", "flat"].causal


def test_equals_the_screen_by_groups(panel):
    names = ["cause", "large", "smooth"]
    a, b = ({(r.symbol, r.feature): r for r in job(panel, names).collect()} for job in (regressions.granger_screen, selection.granger_screen))
    assert all(a[k].p == pytest.approx(b[k].p, abs=1e-9) for k in b if k[0] in "AB")


def test_arch(panel):
    a, b = ({r.symbol: r for r in job(panel).collect()} for job in (regressions.arch, diagnostics.arch))
    assert set(a) == set(b)
    for s, r in b.items():
        for c in ("arch_lm", "arch_p", "leverage"):
            assert a[s][c] == pytest.approx(r[c], abs=1e-9), (s, c)
        assert (a[s].has_arch_effect, a[s].has_asymmetric_vol) == (r.has_arch_effect, r.has_asymmetric_vol)


def test_empty(panel):
    assert regressions.granger_screen(panel.limit(0), ["cause"]).count() == 0 and regressions.arch(panel.limit(0)).count() == 0
