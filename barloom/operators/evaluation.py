"""Classification reports, signal shares, feature consensus and importance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABELS = (-1, 0, 1)


def confusion(df: DataFrame) -> DataFrame:
    """true, and the counts of each predicted class: pred_short, pred_neutral, pred_long. Absent true classes count 0."""
    cells = [
        F.count(F.when((F.col("true_target") == t) & (F.col("model_raw_target") == p), 1)).alias(f"c{i}{j}") for i, t in enumerate(LABELS) for j, p in enumerate(LABELS)
    ]
    row = df.agg(*cells)
    rows = F.array(
        *[F.struct(F.lit(t).alias("true"), F.col(f"c{i}0").alias("pred_short"), F.col(f"c{i}1").alias("pred_neutral"), F.col(f"c{i}2").alias("pred_long")) for i, t in enumerate(LABELS)]
    )
    return row.select(F.inline(rows))


def report(df: DataFrame) -> DataFrame:
    """class (-1, 0, 1, accuracy, macro, weighted), precision, recall, f1, support; from one aggregate row."""
    y, p = F.col("true_target"), F.col("model_raw_target")
    counts = [F.count("*").alias("n")]
    for i, k in enumerate(LABELS):
        counts += [F.count(F.when((y == k) & (p == k), 1)).alias(f"hit{i}"), F.count(F.when(y == k, 1)).alias(f"true{i}"), F.count(F.when(p == k, 1)).alias(f"pred{i}")]
    row = df.agg(*counts)

    def safe(a, b):
        return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))

    classes = []
    for i, k in enumerate(LABELS):
        hit, true, pred = F.col(f"hit{i}"), F.col(f"true{i}"), F.col(f"pred{i}")
        classes.append((str(k), safe(hit, pred), safe(hit, true), safe(2 * hit, true + pred), true))
    n = F.col("n")
    accuracy = safe(F.col("hit0") + F.col("hit1") + F.col("hit2"), n)

    def over(j: int, weighted: bool):
        parts = [c[j] * (c[4] if weighted else F.lit(1.0)) for c in classes]
        return safe(reduce(lambda a, b: a + b, parts), n if weighted else F.lit(3.0))

    lines = classes + [("accuracy", accuracy, accuracy, accuracy, n)]
    lines += [(name, over(1, w), over(2, w), over(3, w), n) for name, w in (("macro", False), ("weighted", True))]
    made = [F.struct(F.lit(a).alias("class"), b.alias("precision"), c.alias("recall"), d.alias("f1"), e.alias("support")) for a, b, c, d, e in lines]
    return row.select(F.inline(F.array(*made)))


def signal_distribution(df: DataFrame) -> DataFrame:
    """fold and the percentage of each signal."""
    s = F.col("model_raw_target")
    share = {"pct_short": -1, "pct_neutral": 0, "pct_long": 1}
    return df.groupBy("fold").agg(*[(100.0 * F.count(F.when(s == k, 1)) / F.count("*")).alias(n) for n, k in share.items()])


def consensus(selected: DataFrame) -> DataFrame:
    """(feature, folds): in how many folds each feature was selected."""
    return selected.groupBy("feature").agg(F.count_distinct("fold").alias("folds")).orderBy(F.desc("folds"), "feature")


def importance(gains: DataFrame, top_n: int = 15) -> DataFrame:
    """Mean and deviation over folds of each feature's share of its fold's gain; the top_n features are the report."""
    share = gains.withColumn("share", F.try_divide("gain", F.sum("gain").over(Window.partitionBy("fold"))))
    out = share.groupBy("feature").agg(
        F.avg("share").alias("mean_importance"), F.coalesce(F.stddev_samp("share"), F.lit(0.0)).alias("std_importance"), F.count_distinct("fold").alias("fold_count")
    )
    return out.orderBy(F.desc("mean_importance"), "feature").limit(top_n)
