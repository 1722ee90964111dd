"""The sampler on plain functions and on the panel's learners."""

import math
import threading
import time

import numpy as np
import pytest

from barloom.operators import models, search
from barloom.plans.model_queries import MODEL_FEATURES, model_panel


def bowl(p):
    r = search.BOOSTED
    return sum((r[n].unit(p[n]) - c) ** 2 for n, c in (("step", 0.8), ("ridge", 0.2), ("share", 0.5)))


def test_trials_stay_in_range_and_repeat():
    a, b = (search.search(bowl, search.BOOSTED, trials=30, seed=s) for s in (1, 1))
    assert [t["parameters"] for t in a] == [t["parameters"] for t in b]
    for t in a:
        p = t["parameters"]
        assert p["rounds"] in (40, 60, 80, 100, 120) and p["depth"] in (2, 3, 4) and p["child"] in range(4, 13)
        assert 0.02 <= p["step"] <= 0.07 and 3 <= p["ridge"] <= 20 and 0.65 <= p["share"] <= 0.85


def test_beats_chance():
    """Over seeds, forty trials end nearer to the least loss than forty random ones."""
    found, chance = [], []
    for seed in range(12):
        found.append(min(t["loss"] for t in search.search(bowl, search.BOOSTED, trials=40, seed=seed)))
        rng = np.random.default_rng(seed)
        chance.append(min(bowl({n: r.value(rng.random()) for n, r in search.BOOSTED.items()}) for _ in range(40)))
    assert np.mean(found) < 0.6 * np.mean(chance)


def test_budget_and_workers():
    seen, lock = [], threading.Lock()

    def slow(p):
        with lock:
            seen.append(threading.get_ident())
            mine = len(seen)
        time.sleep(0.05)
        return math.nan if mine == 2 else bowl(p)

    out = search.search(slow, search.BOOSTED, trials=12, at_once=4)
    assert [t["trial"] for t in out] == list(range(12)) and len(set(seen)) > 1
    assert sum(math.isinf(t["loss"]) for t in out) == 1
    assert len(search.search(slow, search.BOOSTED, trials=12, seconds=0.0)) == 1
    with pytest.raises(ZeroDivisionError):
        search.search(lambda p: 1 / 0, search.BOOSTED, trials=2)


def test_forest_search_is_no_worse_than_the_list(spark, sf):
    df = model_panel(spark, sf).cache()
    found = search.tune_forest(df, MODEL_FEATURES, trials=8, seconds=300).collect()
    listed = models.tune(df, MODEL_FEATURES, parameters=models.PARAMETERS[::2]).first()
    assert len(found) == 8 and found[0].loss <= min(r.loss for r in found)
    assert found[0].loss <= listed.loss + 0.005


def test_boosted_search(spark, sf):
    space = {"rounds": search.Range(2, 4, step=2), "depth": search.Range(1, 2, step=1), "step": search.Range(0.1, 0.3, log=True)}
    df = model_panel(spark, sf).where("symbol in ('ECONOMY', 'MEDIUM')")
    out = search.tune_boosted(df, MODEL_FEATURES, k=2, space=space, bins=16, trials=2).collect()
    assert [sorted(r.asDict()) for r in out] == [["depth", "loss", "rounds", "step", "trial"]] * 2
    assert all(0.8 < r.loss < math.log(3) + 0.1 for r in out) and out[0].loss <= out[1].loss
