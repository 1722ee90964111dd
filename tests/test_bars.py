"""Bars of odd trades against plain Python; a panel reads the trades no more than once for bars and benchmark."""

import datetime

import numpy as np
import pytest

from barloom.operators import models
from barloom.plans.model_queries import MODEL_FEATURES, model_panel
from barloom.plans.panel import panel
from barloom.sources import bars as src

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "price")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Orders that share a day, a line number and a part, orders without a key, lines without day or part, a part without type."""
    rng = np.random.default_rng(5)
    days = [datetime.datetime(2020, 1, d) for d in (1, 2, 3)] + [None]
    rows = []
    for i in range(600):
        day, key = days[rng.integers(0, 4)], int(rng.integers(-3, 6))
        rows.append((None if key == 5 and day != days[2] else key, int(rng.integers(0, 7)), int(rng.integers(0, 2)), int(rng.integers(1, 3)), float(rng.integers(1, 4)), float(rng.integers(0, 11)) / 100, float(rng.integers(0, 9)) / 100, day))
    rows += [(None, 1, 3, 1, 2.0, 0.0, 0.01 * i, days[0]) for i in range(4)]  # a type whose orders all lack their key
    folder = tmp_path_factory.mktemp("odd")
    lines = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(rows, lines).write.parquet(f"{folder}/lineitem.parquet")
    types = {0: "A", 1: "A", 2: "B", 3: "C", 4: None, 5: "B"}
    spark.createDataFrame(list(types.items()), "p_partkey long, p_type string").write.parquet(f"{folder}/part.parquet")
    return str(folder), types


def test_odd_trades(spark, odd):
    folder, types = odd
    groups = {}
    for r in src.trades(spark, folder).collect():
        if r["l_partkey"] in types:
            groups.setdefault((types[r["l_partkey"]], r["ts"]), []).append(r)

    def order(r):
        return tuple((r[c] is not None, r[c] if r[c] is not None else 0) for c in KEY)

    want = {}
    for k, rows in groups.items():
        prices = [r["price"] for r in rows]
        want[k] = (min(rows, key=order)["price"], max(prices), min(prices), max(rows, key=order)["price"], sum(r["l_quantity"] for r in rows))
    got = {(r["symbol"], r["ts"]): tuple(r[c] for c in ("open", "high", "low", "close", "volume")) for r in src.bars_from_trades(spark, folder).collect()}
    assert got == want and {("C", datetime.date(2020, 1, 1)), (None, None)} <= set(got)


def test_trades_are_not_read_again(spark, sf):
    """What a panel or a trained model returns reads written tables, however often it is evaluated."""
    out, _ = models.train_folds(model_panel(spark, sf), MODEL_FEATURES, k=2, learner="boosted", rounds=1)
    for df in (panel(spark, sf), out):
        assert df.inputFiles() and not [f for f in df.inputFiles() if "lineitem" in f]
