"""Purged time-ordered folds and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS, GAP, MAX_TRAIN, BUFFER = 5, 5, 750, 60


def indexed(df: DataFrame) -> DataFrame:
    """df with i, the 0-based position within the symbol, and n, the symbol's rows."""
    by = Window.partitionBy("symbol")
    return df.withColumns({"i": F.row_number().over(by.orderBy("ts")) - 1, "n": F.count("*").over(by)})


def fold_start(fold: Column, folds: int) -> Column:
    size = F.floor(F.col("n") / (folds + 1))
    return (F.col("n") - folds * size + fold * size).cast("int")


def folds(df: DataFrame, k: int = FOLDS, gap: int = GAP, max_train: int | None = MAX_TRAIN, buffer: int = 0) -> DataFrame:
    """Rows of df once for each fold they serve, with fold and part: train, buffer or test.

    Fold f tests rows [start, start + size), size = n // (k + 1). It trains on the last max_train rows before start, of which
    those within gap rows of start are purged. buffer keeps the last rows of train once more, for features of the test.
    """
    at = indexed(df).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size = F.floor(F.col("n") / (k + 1)).cast("int")
    at = at.withColumns({"_start": fold_start(F.col("fold"), k), "_size": size})
    i, start = F.col("i"), F.col("_start")
    first = F.greatest(F.lit(0), start - max_train) if max_train else F.lit(0)
    train = (i >= first) & (i < start - gap)
    test = (i >= start) & (i < start + F.col("_size"))
    parts = [F.when(train, "train"), F.when(test, "test")]
    if buffer:
        # the last rows of what remains of train
        parts.append(F.when(train & (i >= start - gap - buffer), "buffer"))
    at = at.withColumn("part", F.explode(F.array_compact(F.array(*parts))))
    return at.where(F.col("_size") > 0).drop("_start", "_size", "n")


def class_weights(df: DataFrame, label: str = "target_label", by: tuple[str, ...] = ("symbol", "fold")) -> DataFrame:
    """Weight n / (classes present * rows of the class) of every row's class within its group, from aggregated counts."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("_k"))
    groups = counts.groupBy(*by).agg(F.sum("_k").alias("_n"), F.count("*").alias("_classes"))
    weights = counts.join(groups, list(by)).select(*by, label, (F.col("_n") / (F.col("_classes") * F.col("_k"))).alias("weight"))
    return df.join(weights, [*by, label])
