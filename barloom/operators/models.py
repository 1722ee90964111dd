"""Tree ensembles per fold, out-of-fold probabilities, cutoffs and decisions.

Learners on the pooled panel are pyspark.ml's random forest and, one class against the rest, its gradient-boosted trees; their values
differ from those of a boosting library.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.validation import class_weights, folds
from barloom.sources.bars import written

CLASSES = (-1.0, 0.0, 1.0)
#: The fixed list that tuning tries: trees, depth, share of rows, least rows of a leaf.
PARAMETERS = [(t, d, s, m) for t in (10, 20) for d in (2, 3, 4) for s, m in ((0.7, 4), (0.85, 10))]


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing features count as 0; the label becomes 0, 1, 2."""
    filled = df.withColumns({f: F.coalesce(F.col(f) if f in df.columns else F.lit(None).cast("double"), F.lit(0.0)) for f in features})
    out = VectorAssembler(inputCols=features, outputCol="features").transform(filled)
    return out.withColumn("label", F.col("target_label") + 1.0) if "target_label" in df.columns else out


def fit(train: DataFrame, features: list[str], trees: int = 20, depth: int = 4, share: float = 0.8, leaf: int = 5, seed: int = 42) -> RandomForestClassificationModel:
    """train has target_label and weight."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, subsamplingRate=share, minInstancesPerNode=leaf, weightCol="weight", seed=seed)
    return forest.fit(assembled(train, features))


def probabilities(model: RandomForestClassificationModel, df: DataFrame, features: list[str]) -> DataFrame:
    """df with prob_short, prob_neutral, prob_long; absent classes get 0."""
    p = vector_to_array("probability")
    out = model.transform(assembled(df, features)).withColumn("_p", p)
    named = {n: F.coalesce(F.try_element_at("_p", F.lit(i + 1)), F.lit(0.0)) for i, n in enumerate(("prob_short", "prob_neutral", "prob_long"))}
    return out.withColumns(named).drop("features", "rawPrediction", "probability", "prediction", "_p", "label")


@dataclass
class Boosted:
    """A boosted model of each class against the rest; None where a class is the only one."""

    parts: dict[int, GBTClassificationModel | None]

    def importances(self, k: int) -> np.ndarray:
        known = [m.featureImportances.toArray() for m in self.parts.values() if m is not None]
        return np.mean(known, axis=0) if known else np.zeros(k)


def fit_boosted(train: DataFrame, features: list[str], rounds: int = 10, depth: int = 3, step: float = 0.1, share: float = 0.8, leaf: int = 5, seed: int = 42) -> Boosted:
    """Boosted trees of every class present, side by side; train has target_label and weight."""
    data = assembled(train, features).select("features", "label", "weight").persist()
    classes = sorted(int(r[0]) for r in data.select("label").distinct().collect())
    booster = GBTClassifier(labelCol="_own", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=share, minInstancesPerNode=leaf, seed=seed)

    @inheritable_thread_target(train.sparkSession)
    def one(c: int) -> GBTClassificationModel | None:
        return booster.fit(data.withColumn("_own", (F.col("label") == c).cast("double"))) if len(classes) > 1 else None

    with ThreadPoolExecutor(3) as pool:
        parts = dict(zip(classes, pool.map(one, classes), strict=True))
    data.unpersist()
    return Boosted(parts)


def boosted_probabilities(model: Boosted, df: DataFrame, features: list[str]) -> DataFrame:
    """df with prob_short, prob_neutral, prob_long: each class's own probability over their sum; absent classes get 0."""
    out = assembled(df, features)
    for c, part in model.parts.items():
        if part is None:
            out = out.withColumn(f"_p{c}", F.lit(1.0))
        else:
            out = part.transform(out).withColumn(f"_p{c}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    total = sum((F.col(f"_p{c}") for c in model.parts), F.lit(0.0))
    named = {n: F.col(f"_p{i}") / total if i in model.parts else F.lit(0.0) for i, n in enumerate(("prob_short", "prob_neutral", "prob_long"))}
    return out.withColumns(named).drop("features", "label", *[f"_p{c}" for c in model.parts])


def train_folds(df: DataFrame, features: list[str], k: int = 5, learner: str = "forest", **settings) -> tuple[DataFrame, DataFrame]:
    """(out-of-sample probabilities of every fold's test rows, importance of each feature in each fold) of "forest" or "boosted" trees."""
    df = written(df.where("target_label is not null"), "labelled")  # read for the fits and, once the folds are let go, by what is returned
    parts = folds(df, k).persist()
    out, gains = [], []
    for f in range(k):
        own = parts.where(F.col("fold") == f)
        train, test = class_weights(own.where("part = 'train'"), by=("fold",)), own.where("part = 'test'")
        if learner == "boosted":
            model = fit_boosted(train, features, **settings)
            out.append(boosted_probabilities(model, test, features))
            weights = model.importances(len(features))
        else:
            model = fit(train, features, **settings)
            out.append(probabilities(model, test, features))
            weights = model.featureImportances.toArray()
        gains += [(f, name, float(g)) for name, g in zip(features, weights, strict=True)]
    parts.unpersist()
    spark = df.sparkSession
    return union(out), spark.createDataFrame(gains, "fold int, feature string, gain double")


def union(frames: list[DataFrame]) -> DataFrame:
    """The folds' rows under one another."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def weighted_log_loss(p: Column, w: Column, floor: float = 2.220446049250313e-16) -> Column:
    return F.sum(-F.ln(F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))) * w) / F.sum(w)


def true_probability(label: str = "target_label") -> Column:
    y = F.col(label)
    return F.when(y == 1, F.col("prob_long")).when(y == -1, F.col("prob_short")).otherwise(F.col("prob_neutral"))


def tune(df: DataFrame, features: list[str], k: int = 3, parameters: list[tuple] | None = None, at_once: int = 4) -> DataFrame:
    """Mean weighted log loss over k inner folds of each listed parameter set, best first; at_once fits run side by side."""
    parts = folds(written(df.where("target_label is not null"), "labelled"), k, max_train=None)  # rows and weights read it
    parts = class_weights(parts, by=("fold", "part")).persist()
    spark = df.sparkSession

    @inheritable_thread_target(spark)
    def loss(job: tuple[int, int]) -> tuple[int, float]:
        j, f = job
        trees, depth, share, leaf = tried[j]
        own = parts.where(F.col("fold") == f)
        model = fit(own.where("part = 'train'"), features, trees, depth, share, leaf)
        scored = probabilities(model, own.where("part = 'test'"), features)
        return j, scored.agg(weighted_log_loss(true_probability(), F.col("weight"))).first()[0]

    tried = parameters or PARAMETERS
    with ThreadPoolExecutor(at_once) as pool:
        losses = list(pool.map(loss, [(j, f) for j in range(len(tried)) for f in range(k)]))
    parts.unpersist()
    rows = [(j, *tried[j], sum(v for i, v in losses if i == j) / k) for j in range(len(tried))]
    return spark.createDataFrame(rows, "set int, trees int, depth int, share double, leaf int, loss double").orderBy("loss", "set")


def oof_average(frames: list[DataFrame]) -> DataFrame:
    """Mean probabilities of rows that were predicted at least once."""
    return union(frames).groupBy("symbol", "ts").agg(*[F.avg(c).alias(c) for c in ("prob_short", "prob_neutral", "prob_long")], F.count("*").alias("times"))


def side_medians(df: DataFrame, by: tuple[str, ...], cells: int = 4096) -> DataFrame:
    """Of each group and sign of prob_delta: rows and the exact median of its size, in two steps of counts.

    Counts by equal cells of the size tell in which cells the two middle rows lie; of these cells alone the distinct sizes are counted.
    No group is ordered or collected whole.
    """
    size = F.abs("prob_delta")
    keys = [*by, "up"]
    rows = df.where("prob_delta <> 0").select(*by, (F.col("prob_delta") > 0).alias("up"), size.alias("size"), F.floor(F.least(size, F.lit(1.0)) * cells).alias("cell"))

    def placed(counts: DataFrame, group: list[str], order: str) -> DataFrame:
        own = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("k").over(own), F.lit(0)))

    def holds(start: Column) -> Column:
        low, high = F.floor((F.col("n") - 1) / 2) - start, F.floor(F.col("n") / 2) - start
        return (low < F.col("before") + F.col("k")) & (high >= F.col("before"))

    counts = placed(rows.groupBy(*keys, "cell").agg(F.count("*").alias("k")), keys, "cell")
    counts = counts.withColumn("n", F.sum("k").over(Window.partitionBy(*keys))).where(holds(F.lit(0)))
    middle = counts.select(*keys, "cell", "n", F.col("before").alias("start"))
    values = placed(rows.join(middle, [*keys, "cell"]).groupBy(*keys, "cell", "n", "start", "size").agg(F.count("*").alias("k")), [*keys, "cell"], "size")
    return values.where(holds(F.col("start"))).groupBy(*keys).agg(F.max("n").alias("n"), ((F.min("size") + F.max("size")) / 2).alias("median"))


def thresholds(df: DataFrame, by: tuple[str, ...] = ("fold",), margin: float = 0.04, least: int = 10) -> DataFrame:
    """up_cut and down_cut of each group: the median of positive and of negative prob_delta where there are more than
    `least`, else the margin; never nearer to 0 than the margin."""
    half = F.greatest(F.when(F.col("n") > least, F.col("median")).otherwise(margin), F.lit(margin))
    sides = side_medians(df, by).groupBy(*by).agg(F.max(F.when(F.col("up"), half)).alias("up_cut"), F.max(F.when(~F.col("up"), half)).alias("down_cut"))
    every = df.select(*by).distinct().join(sides, list(by), "left")
    return every.select(*by, F.coalesce("up_cut", F.lit(margin)).alias("up_cut"), (-F.coalesce("down_cut", F.lit(margin))).alias("down_cut"))


def decide(df: DataFrame, cuts: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    d = F.col("prob_delta")
    signal = F.when(d > F.col("up_cut"), 1.0).when(d < F.col("down_cut"), -1.0).otherwise(0.0)
    return df.join(cuts, list(by)).withColumn("model_raw_target", signal)


def threshold_grid(df: DataFrame, steps: int = 12, low: float = 0.38, high: float = 0.60, least: int = 20) -> DataFrame:
    """The pair of cutoffs (long, short) of a grid that scores best: hit rate of the trades, less where they cover under 10 %.

    Rows first shrink to counts by (grid cells the long and the short probability pass, true class), so the grid is tried
    on a few hundred rows however long the table is. Short wins where both pass; ties go to the first in grid order.
    """
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]

    def passed(c: str) -> Column:
        return sum((F.col(c) > F.lit(g)).cast("int") for g in grid)

    cells = df.select(passed("prob_long").alias("a"), passed("prob_short").alias("b"), F.col("true_target").cast("int").alias("y"))
    cells = cells.groupBy("a", "b", "y").agg(F.count("*").alias("k"))
    pairs = F.array(*[F.struct(F.lit(i).alias("l"), F.lit(j).alias("s")) for i in range(steps) for j in range(steps)])
    tried = cells.select("*", F.explode(pairs).alias("g"))
    signal = F.when(F.col("b") > F.col("g.s"), -1).when(F.col("a") > F.col("g.l"), 1).otherwise(0)
    scored = tried.withColumn("signal", signal).groupBy("g").agg(
        F.sum("k").alias("rows"),
        F.sum(F.when(F.col("signal") != 0, F.col("k")).otherwise(0)).alias("trades"),
        F.sum(F.when((F.col("signal") != 0) & (F.col("signal") == F.col("y")), F.col("k")).otherwise(0)).alias("hits"),
    )
    scored = scored.where(F.col("trades") >= least)
    coverage = F.col("trades") / F.col("rows")
    score = F.col("hits") / F.col("trades") * F.least(F.lit(1.0), coverage / 0.10)
    at = F.array(*[F.lit(g) for g in grid])
    best = scored.withColumn("score", score).agg(F.min_by(F.struct("g", "score"), F.struct(-F.col("score"), "g.l", "g.s")).alias("x")).where("x is not null")
    return best.select(F.element_at(at, F.col("x.g.l") + 1).alias("th_long"), F.element_at(at, F.col("x.g.s") + 1).alias("th_short"), F.col("x.score").alias("score"))


