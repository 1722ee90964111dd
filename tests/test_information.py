"""Information of two continuous series against a version over all pairs."""

import math
import time

import numpy as np
import pytest

from barloom.functions import stats
from barloom.operators import diagnostics


def digamma(m):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, m))


def all_pairs(x, y, k=3):
    x, y = x / x.std(), y / y.std()
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1][:, None]
    nx, ny = (((v < r) | (v == 0)).sum(axis=1) for v in (dx, dy))
    n = len(x)
    return max(0.0, digamma(n) + digamma(k) - np.mean([digamma(a) + digamma(b) for a, b in zip(nx, ny, strict=True)]))


@pytest.mark.parametrize("kind", ["independent", "linked", "ties", "lagged"])
def test_equals_all_pairs(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=300)
    y = {"independent": rng.normal(size=300), "linked": x**2 + 0.1 * rng.normal(size=300), "ties": np.round(x + rng.normal(size=300), 1), "lagged": np.roll(x, 1)}[kind]
    if kind == "ties":
        x = np.round(x, 1)
    assert stats.paired_information(x, y) == pytest.approx(all_pairs(x, y), abs=1e-12)


def test_known_value_and_growth():
    rng = np.random.default_rng(1)
    z = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 20_000)
    began = time.time()
    assert stats.paired_information(z[:, 0], z[:, 1]) == pytest.approx(-0.5 * np.log(1 - 0.64), abs=0.03)
    assert time.time() - began < 30
    assert stats.paired_information(np.ones(50), np.arange(50.0)) == 0.0 and stats.paired_information(np.arange(3.0), np.arange(3.0)) == 0.0


def test_student_tails_by_quadrature(spark):
    rows = [(0.3, 1), (1.7, 2), (2.0, 5), (-2.0, 30), (1.98, 101), (0.0, 7), (None, 9)]
    got = [r[0] for r in spark.createDataFrame(rows, "t double, d int").coalesce(1).select(diagnostics.t_tails("t", "d")).collect()]
    for (t, d), p in zip(rows, got, strict=True):
        if t is None:
            assert p is None
            continue
        x = np.linspace(0, abs(t), 200_001)
        f = np.exp(math.lgamma((d + 1) / 2) - math.lgamma(d / 2)) / math.sqrt(d * math.pi) * (1 + x * x / d) ** (-(d + 1) / 2)
        assert abs(p - (1 - 2 * np.trapezoid(f, x))) < 1e-8
