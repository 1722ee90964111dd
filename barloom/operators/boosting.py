"""Softmax gradient boosting by distributed histograms, for many models at once.

Rows carry the number of the model that they train (a fold, a trial, or both), so one pass serves every model: a level of all trees of a round
is one job. Features are cut at quantiles of each model's own rows (a mergeable sketch); a task adds up gradients and hessians by
(model, class, node, feature, bin), Spark sums these histograms, splits are found where the sums are, and only the best split of each node comes to
the driver. What is broadcast are the trees. Gradients follow from the rows' margins, which a written table keeps every REFRESH
rounds, so neither lineage nor the trees to apply grow, and a lost executor reads that table again.

Gain of a split: GL^2/(HL + ridge) + GR^2/(HR + ridge) - G^2/(H + ridge), with at least `child` hessian on both sides; a leaf's
value is -step * G/(H + ridge). Importance is the mean gain of a feature's splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from barloom.operators.validation import FOLDS, class_weights, folds
from barloom.sources.bars import written

CLASSES, BINS, REFRESH = 3, 64, 10
NAMES = ("prob_short", "prob_neutral", "prob_long")
LEAST_GAIN, LEAST_HESSIAN = 1e-6, 1e-16


@dataclass(frozen=True)
class Settings:
    """What one model is grown with; share and columns are the parts of rows and of features that a tree sees."""

    rounds: int = 20
    depth: int = 3
    step: float = 0.05
    share: float = 0.8
    columns: float = 0.8
    ridge: float = 5.0
    child: float = 6.0
    seed: int = 42


@dataclass
class Forest:
    """Trees as heaps: feature (-1 for a leaf), bin (rows of a greater bin go right) and value of every node, by tree and class."""

    cuts: np.ndarray
    settings: Settings
    features: list[np.ndarray] = field(default_factory=list)
    bins: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)
    gains: list[tuple[int, float]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Missing features count as 0."""
        x = np.where(np.isnan(x), 0.0, x)
        return np.column_stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]).astype(np.uint8)

    def margins(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), CLASSES))
        for r in range(first, len(self.features)):
            for c in range(CLASSES):
                out[:, c] += self.values[r][c][descend(bins, self.features[r][c], self.bins[r][c], self.settings.depth)]
        return out


def descend(bins: np.ndarray, feature: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    """The node that each row reaches after so many steps."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(steps):
        f = feature[node]
        right = bins[rows, np.maximum(f, 0)] > at[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def seen(key: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    """Which rows a round's trees see: by a hash of the row's key, so a repeated task sees the same."""
    x = key.astype(np.uint64) + np.uint64((seed * 1_000_003 + round_) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # a 64-bit finaliser
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) < np.uint64(int(share * (1 << 53)))


def allowed(settings: Settings, model: int, round_: int, c: int, k: int) -> np.ndarray:
    """Which features a tree may split on."""
    n = max(1, round(settings.columns * k))
    out = np.zeros(k, bool)
    out[np.random.default_rng((settings.seed, model, round_, c)).permutation(k)[:n]] = True
    return out


def best_splits(g: np.ndarray, h: np.ndarray, ridge: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, ...]:
    """bin, gain, left gradient and hessian, and both totals, of each row's histogram; the first bin wins a tie."""
    gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    gt, ht = gl[:, -1], hl[:, -1]
    gl, hl = gl[:, :-1], hl[:, :-1]
    gr, hr = gt[:, None] - gl, ht[:, None] - hl
    gain = gl**2 / (hl + ridge[:, None]) + gr**2 / (hr + ridge[:, None]) - (gt**2 / (ht + ridge))[:, None]
    gain[(hl < child[:, None]) | (hr < child[:, None])] = -np.inf
    at = gain.argmax(axis=1)
    rows = np.arange(len(g))
    return at, gain[rows, at], gl[rows, at], hl[rows, at], gt, ht


def quantile_cuts(rows: DataFrame, features: list[str], bins: int = BINS) -> dict[int, np.ndarray]:
    """For each model its features' cut points, ascending, filled up with infinity: one row a model comes to the driver."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    sketches = [F.percentile_approx(F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0)), at, F.lit(10_000)).alias(f"c{i}") for i, f in enumerate(features)]
    out = {}
    for r in rows.groupBy("model").agg(*sketches).collect():
        cuts = np.full((len(features), bins - 1), np.inf)
        for i in range(len(features)):
            own = np.unique(r[f"c{i}"])
            cuts[i, : len(own)] = own
        out[r["model"]] = cuts
    return out


def _matrix(batch: pa.RecordBatch, k: int, column: str, kind: type) -> np.ndarray:
    values = batch.column(column).flatten() if kind is not np.uint8 else b"".join(batch.column(column).to_pylist())
    flat = np.frombuffer(values, np.uint8) if kind is np.uint8 else values.to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(-1, k)


_ROW = "model int, key long, y int, w double, bins binary, m array<double>"


def _tables(rows: DataFrame, features: list[str], forests: dict[int, Forest]) -> DataFrame:
    """Rows with their bins and margins of 0."""
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    given = rows.select(F.col("model").cast("int").alias("model"), "key", F.col("y").cast("int").alias("y"), F.col("weight").cast("double").alias("w"), x.alias("x"))
    shared = rows.sparkSession.sparkContext.broadcast(forests)  # models x features x bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, model = _matrix(batch, len(features), "x", np.float64), batch.column("model").to_numpy()
            bins = np.zeros(x.shape, np.uint8)
            for m in np.unique(model).tolist():
                bins[model == m] = shared.value[m].binned(x[model == m])
            zero = pa.array(np.zeros((len(x), CLASSES)).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("model", "key", "y", "w")), pa.array([b.tobytes() for b in bins], pa.binary()), zero], ["model", "key", "y", "w", "bins", "m"])

    return given.mapInArrow(run, _ROW)


def _kept(df: DataFrame) -> DataFrame:
    return written(df, "boosting").persist(StorageLevel.MEMORY_AND_DISK)


def _moved(rows: DataFrame, forests: dict[int, Forest], k: int, first: int) -> DataFrame:
    """Rows whose margins include the trees from round `first` on."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, m, model = _matrix(batch, k, "bins", np.uint8), _matrix(batch, CLASSES, "m", np.float64), batch.column("model").to_numpy()
            m = m.copy()
            for i in np.unique(model).tolist():
                m[model == i] += shared.value[i].margins(bins[model == i], first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("model", "key", "y", "w", "bins")), pa.array(m.tolist(), pa.list_(pa.float64()))], ["model", "key", "y", "w", "bins", "m"])

    return rows.mapInArrow(run, _ROW)


def _level(rows: DataFrame, forests: dict[int, Forest], growing: dict[int, list[tuple[np.ndarray, np.ndarray]]], k: int, first: int, round_: int, level: int, bins: int) -> list:
    """The best split of every node of a level: one job over all models and classes."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((forests, growing))
    width = 1 << level

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests, growing = shared.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            model = batch.column("model").to_numpy()
            for i in np.unique(model).tolist():
                if i not in growing:
                    continue
                at = np.flatnonzero((model == i) & seen(batch.column("key").to_numpy(), forests[i].settings.seed, round_, forests[i].settings.share))
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                x = _matrix(part, k, "bins", np.uint8)
                m = _matrix(part, CLASSES, "m", np.float64) + forests[i].margins(x, first)
                p, y, w = softmax(m), part.column("y").to_numpy(), part.column("w").to_numpy()
                cell = x.astype(np.int64) + np.arange(k) * bins
                for c in range(CLASSES):
                    node = descend(x, *growing[i][c], level) - (width - 1)
                    own = np.flatnonzero(node >= 0)  # rows of nodes that were not split stay above
                    g = w * (p[:, c] - (y == c))
                    h = w * np.maximum(2.0 * p[:, c] * (1.0 - p[:, c]), LEAST_HESSIAN)
                    index = (cell[own] + (node[own] * k * bins)[:, None]).ravel()
                    total = sums.setdefault((i, c), np.zeros((2, width * k * bins)))
                    for j, v in enumerate((g, h)):
                        total[j] += np.bincount(index, np.repeat(v[own], k), width * k * bins)
        for (i, c), total in sums.items():
            both = total.reshape(2, width * k, bins).transpose(1, 0, 2).reshape(width * k, 2 * bins)
            used = np.flatnonzero(both[:, bins:].any(axis=1))
            n = len(used)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 2 * bins, pa.int32()), pa.array(both[used].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i), pa.int32()), pa.array(np.full(n, c), pa.int32()), pa.array(used // k, pa.int32()), pa.array(used % k, pa.int32()), listed], ["model", "cls", "node", "feature", "gh"])

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = shared.value[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            gh = _matrix(batch, 2 * bins, "gh", np.float64)
            model, cls, feature = (batch.column(c).to_numpy() for c in ("model", "cls", "feature"))
            own = [forests[i].settings for i in model.tolist()]
            at, gain, gl, hl, g, h = best_splits(gh[:, :bins], gh[:, bins:], np.array([s.ridge for s in own]), np.array([s.child for s in own]))
            open_ = {(i, c): allowed(forests[i].settings, i, round_, c, k) for i, c in set(zip(model.tolist(), cls.tolist(), strict=True))}
            may = np.array([open_[i, c][f] for i, c, f in zip(model.tolist(), cls.tolist(), feature.tolist(), strict=True)])
            gain = np.where(may, gain, -np.inf)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("model", "cls", "node", "feature")), pa.array(at.astype(np.int32)), *map(pa.array, (gain, gl, hl, g, h))], ["model", "cls", "node", "feature", "bin", "gain", "gl", "hl", "g", "h"])

    sums = rows.mapInArrow(histograms, "model int, cls int, node int, feature int, gh array<double>")
    total = sums.groupBy("model", "cls", "node", "feature").agg(Summarizer.sum(array_to_vector("gh")).alias("gh")).withColumn("gh", vector_to_array("gh"))
    found = total.mapInArrow(splits, "model int, cls int, node int, feature int, bin int, gain double, gl double, hl double, g double, h double")
    best = found.groupBy("model", "cls", "node").agg(F.max_by(F.struct("feature", "bin", "gain", "gl", "hl", "g", "h"), F.struct("gain", -F.col("feature"))).alias("s"))
    out = best.select("model", "cls", "node", "s.*").collect()
    shared.unpersist()
    return out


def fit(rows: DataFrame, features: list[str], settings: dict[int, Settings], bins: int = BINS, cuts: dict[int, np.ndarray] | None = None) -> dict[int, Forest]:
    """A forest for every model of rows (model, key, y from 0 to 2, weight, features); key tells rows apart in the draws.

    Rows without a class or weight go. A model of one class, or whose rows are too few for any split, gets single leaves.
    """
    if bins > 256:
        raise ValueError("a bin is one byte")
    rows = rows.where(F.col("y").isNotNull() & F.col("weight").isNotNull() & F.col("model").isin(*settings))
    cuts = cuts or quantile_cuts(rows, features, bins)
    forests = {i: Forest(cuts[i], s) for i, s in settings.items() if i in cuts}
    if not forests:
        return {}
    k, first = len(features), 0
    table = _kept(_tables(rows, features, forests))
    for r in range(max(f.settings.rounds for f in forests.values())):
        live = {i: f for i, f in forests.items() if r < f.settings.rounds}
        size = {i: (2 << f.settings.depth) - 1 for i, f in live.items()}
        growing = {i: [(np.full(size[i], -1), np.zeros(size[i], np.int64)) for _ in range(CLASSES)] for i in live}
        values = {i: np.zeros((CLASSES, size[i])) for i in live}
        for level in range(max(f.settings.depth for f in live.values())):
            now = {i: t for i, t in growing.items() if level < live[i].settings.depth}
            split = False
            for s in _level(table, forests, now, k, first, r, level, bins):
                own, node = live[s.model].settings, (1 << level) - 1 + s.node
                value = lambda g, h: -own.step * g / (h + own.ridge)  # noqa: B023, E731
                values[s.model][s.cls][node] = value(s.g, s.h)
                if s.gain > LEAST_GAIN:
                    feature, at = growing[s.model][s.cls]
                    feature[node], at[node] = s.feature, s.bin
                    values[s.model][s.cls][2 * node + 1], values[s.model][s.cls][2 * node + 2] = value(s.gl, s.hl), value(s.g - s.gl, s.h - s.hl)
                    live[s.model].gains.append((s.feature, s.gain))
                    split = True
            if not split:
                break
        for i, f in live.items():
            f.features.append(np.array([t[0] for t in growing[i]]))
            f.bins.append(np.array([t[1] for t in growing[i]]))
            f.values.append(values[i])
        if (r + 1) % REFRESH == 0:
            moved = _kept(_moved(table, forests, k, first))
            moved.count()
            table.unpersist()
            table, first = moved, r + 1
    table.unpersist()
    return forests


def predict(df: DataFrame, features: list[str], forests: dict[int, Forest]) -> DataFrame:
    """df (with model) and prob_short, prob_neutral, prob_long; rows of a model that has no forest get nulls."""
    quoted = [F.col(f"`{c}`") for c in df.columns]
    x = F.array(*[(F.col(f"`{f}`") if f in df.columns else F.lit(None)).cast("double") for f in features])
    given = df.select(F.struct(*quoted).alias("row"), F.col("model").cast("int").alias("model"), x.alias("x"))
    schema = StructType([given.schema["row"], *_parse_datatype_string("p array<double>").fields])
    shared = df.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, len(features), "x", np.float64)
            model = batch.column("model").fill_null(-1).to_numpy()
            out: list = [None] * len(x)
            for i in np.unique(model).tolist():
                if i in shared.value:
                    at, f = np.flatnonzero(model == i), shared.value[i]
                    for j, p in zip(at.tolist(), softmax(f.margins(f.binned(x[at]))).tolist(), strict=True):
                        out[j] = p
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.list_(pa.float64()))], ["row", "p"])

    return given.mapInArrow(run, schema).select("row.*", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(NAMES)])


def importances(forests: dict[int, Forest], features: list[str]) -> list[tuple[int, str, float]]:
    """(model, feature, mean gain of its splits) of the features that a model splits on."""
    out = []
    for i, f in sorted(forests.items()):
        own: dict[int, list[float]] = {}
        for at, gain in f.gains:
            own.setdefault(at, []).append(gain)
        out += [(i, features[at], float(np.mean(g))) for at, g in sorted(own.items())]
    return out


def keyed(df: DataFrame, model: str = "fold") -> DataFrame:
    return df.withColumns({"model": F.col(model), "key": F.xxhash64("symbol", "ts"), "y": (F.col("target_label") + 1).cast("int")})


def train_folds(df: DataFrame, features: list[str], k: int = FOLDS, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(out-of-sample probabilities of every fold's test rows, gain of each feature in each fold): all folds grow together."""
    wide = written(df.where("target_label is not null"), "boosting")  # read for the cuts, the training and the test rows
    parts = keyed(folds(wide, k))
    train = class_weights(parts.where("part = 'train'"), by=("fold",))
    forests = fit(train, features, {f: settings for f in range(k)})
    gains = df.sparkSession.createDataFrame(importances(forests, features), "fold int, feature string, gain double")
    return predict(parts.where("part = 'test'"), features, forests).drop("model", "key", "y"), gains
