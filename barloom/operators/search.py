"""Parameter search within a budget: trials are drawn where good ones are dense and bad ones are not (tree-structured Parzen estimates).

Every trial's parameters come from two mixtures of bells around the parameters tried so far, one over the best quarter and one over the rest;
of CANDIDATES draws from the first, the one with the greatest ratio of both densities is tried. Trials run `at_once` side by side without waiting
for each other; those still running count among the rest, so that no two look at the same place. With one at a time a seed gives the
same trials again.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import models
from barloom.operators.validation import class_weights, folds
from barloom.sources.bars import written

START, CANDIDATES, GOOD = 4, 24, 0.25


@dataclass(frozen=True)
class Range:
    """A parameter's range; log: even on the logarithm; step: a whole number, low + a multiple of step."""

    low: float
    high: float
    log: bool = False
    step: int = 0

    def unit(self, value: float) -> float:
        """Where a value stands from 0 to 1."""
        if self.log:
            return math.log(value / self.low) / math.log(self.high / self.low)
        return (value - self.low) / (self.high - self.low)

    def value(self, at: float) -> float | int:
        at = min(1.0, max(0.0, at))
        if self.log:
            return self.low * (self.high / self.low) ** at
        found = self.low + (self.high - self.low) * at
        return int(self.low + round((found - self.low) / self.step) * self.step) if self.step else found


#: Of the boosted learner and of the forest.
BOOSTED = {
    "rounds": Range(40, 120, step=20),
    "depth": Range(2, 4, step=1),
    "step": Range(0.02, 0.07, log=True),
    "share": Range(0.65, 0.85),
    "columns": Range(0.65, 0.85),
    "ridge": Range(3.0, 20.0, log=True),
    "child": Range(4, 12, step=1),
}
FOREST = {"trees": Range(10, 20, step=5), "depth": Range(2, 4, step=1), "share": Range(0.65, 0.85), "leaf": Range(4, 12, step=1)}


class _Mixture:
    """Bells around points in 0..1, as wide as the gap to their neighbours, and one wide bell over all."""

    def __init__(self, points: np.ndarray) -> None:
        self.at = np.sort(np.append(points, 0.5))
        ends = np.concatenate(([0.0], self.at, [1.0]))
        self.wide = np.clip(np.maximum(ends[1:-1] - ends[:-2], ends[2:] - ends[1:-1]), 1.0 / (1 + len(self.at)), 1.0)
        self.wide[np.flatnonzero(self.at == 0.5)[0]] = 1.0

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        own = rng.integers(0, len(self.at), n)
        out = rng.normal(self.at[own], self.wide[own])
        while (bad := (out < 0) | (out > 1)).any():
            out[bad] = rng.normal(self.at[own[bad]], self.wide[own[bad]])
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        def below(z: np.ndarray) -> np.ndarray:
            return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) for v in z])

        inside = below((1 - self.at) / self.wide) - below(-self.at / self.wide)
        z = (x[:, None] - self.at) / self.wide
        return np.log(np.maximum((np.exp(-0.5 * z * z) / self.wide / inside).mean(axis=1), 1e-300))


def propose(space: dict[str, Range], tried: list[tuple[dict, float]], running: list[dict], rng: np.random.Generator) -> dict:
    """The next trial's parameters. tried: parameters and losses of the finished trials."""
    if len(tried) < START:
        return {n: r.value(rng.random()) for n, r in space.items()}
    ranked = sorted(tried, key=lambda t: t[1])
    k = max(1, math.ceil(GOOD * len(ranked)))
    good, rest = [p for p, _ in ranked[:k]], [p for p, _ in ranked[k:]] + running
    out = {}
    for name, r in space.items():
        best, others = (_Mixture(np.array([r.unit(p[name]) for p in part])) for part in (good, rest))
        draws = best.draw(rng, CANDIDATES)
        draws = np.array([r.unit(r.value(d)) for d in draws])
        out[name] = r.value(float(draws[np.argmax(best.log_density(draws) - others.log_density(draws))]))
    return out


def search(loss: Callable[[dict], float], space: dict[str, Range], trials: int = 12, seconds: float = 120.0, at_once: int = 1, seed: int = 42, spark=None) -> list[dict]:
    """Finished trials (trial, parameters, loss, seconds) in the order they began; none begins after `seconds`.

    The first trial always runs. A trial whose loss is not finite counts as worst.
    """
    rng, lock, began = np.random.default_rng(seed), threading.Lock(), time.monotonic()
    done: list[dict] = []
    running: dict[int, dict] = {}
    next_trial = iter(range(trials))

    def work() -> None:
        while True:
            with lock:
                i = next(next_trial, None)
                if i is None or i and time.monotonic() - began > seconds:
                    return
                running[i] = parameters = propose(space, [(t["parameters"], t["loss"]) for t in done], list(running.values()), rng)
            at = time.monotonic()
            try:
                found = loss(parameters)
            finally:
                with lock:
                    del running[i]
            with lock:
                done.append({"trial": i, "parameters": parameters, "loss": found if math.isfinite(found) else math.inf, "seconds": time.monotonic() - at})

    job = inheritable_thread_target(spark)(work) if spark is not None else work
    with ThreadPoolExecutor(at_once) as pool:
        for f in [pool.submit(job) for _ in range(at_once)]:
            f.result()
    return sorted(done, key=lambda t: t["trial"])


def tune_forest(df: DataFrame, features: list[str], k: int = 3, space: dict[str, Range] | None = None, **budget) -> DataFrame:
    """(trial, trees, depth, share, leaf, loss), best first: mean weighted log loss of forests over k inner purged folds."""
    parts = class_weights(folds(written(df.where("target_label is not null"), "labelled"), k, max_train=None), by=("fold", "part")).persist()
    spark = df.sparkSession

    def loss(p: dict) -> float:
        total = 0.0
        for f in range(k):
            own = parts.where(F.col("fold") == f)
            model = models.fit(own.where("part = 'train'"), features, p["trees"], p["depth"], p["share"], p["leaf"])
            scored = models.probabilities(model, own.where("part = 'test'"), features)
            total += scored.agg(models.weighted_log_loss(models.true_probability(), F.col("weight"))).first()[0]
        return total / k

    found = search(loss, space or FOREST, spark=spark, **budget)
    parts.unpersist()
    rows = [(t["trial"], *(t["parameters"][n] for n in ("trees", "depth", "share", "leaf")), t["loss"]) for t in found]
    return spark.createDataFrame(rows, "trial int, trees int, depth int, share double, leaf int, loss double").orderBy("loss", "trial")


def tune_boosted(df: DataFrame, features: list[str], k: int = 3, space: dict[str, Range] | None = None, bins: int = 64, **budget) -> DataFrame:
    """(trial, the parameters, loss), best first, of softmax boosting: a trial's inner folds grow together in the same jobs."""
    from barloom.operators import boosting

    space = space or BOOSTED
    parts = boosting.keyed(class_weights(folds(written(df.where("target_label is not null"), "labelled"), k, max_train=None), by=("fold", "part"))).persist()
    cuts = boosting.quantile_cuts(parts.where("part = 'train'"), features, bins)

    def loss(p: dict) -> float:
        forests = boosting.fit(parts.where("part = 'train'"), features, {f: boosting.Settings(**p) for f in range(k)}, bins, cuts)
        scored = boosting.predict(parts.where("part = 'test'"), features, forests)
        per = scored.groupBy("fold").agg(models.weighted_log_loss(models.true_probability(), F.col("weight")).alias("l"))
        return per.agg(F.avg("l")).first()[0]

    found = search(loss, space, spark=df.sparkSession, **budget)
    parts.unpersist()
    kinds = {n: "int" if r.step else "double" for n, r in space.items()}
    rows = [(t["trial"], *(t["parameters"][n] for n in space), t["loss"]) for t in found]
    return df.sparkSession.createDataFrame(rows, "trial int, " + ", ".join(f"{n} {kind}" for n, kind in kinds.items()) + ", loss double").orderBy("loss", "trial")
