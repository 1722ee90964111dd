"""Volatility-scaled triple-barrier labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import bfill, frame, keys, w

#: A weight that a double no longer notices next to 1 is exp(-NEGLIGIBLE).
NEGLIGIBLE = 40.0


def with_ewm(df: DataFrame, jobs: dict[str, tuple[str, int, str]]) -> DataFrame:
    """Exponentially weighted columns: name -> (source, span, "std" or "mean").

    std: bias-corrected over adjusted weights, null before two values; mean: the plain recursion, a null keeping the value before.
    A sum of decaying weights is taken within blocks of so many rows that what stood before the block in front no longer
    counts in a double: weights relative to the block's first row stay finite, and each row adds the last sum of the block
    in front, decayed. All of it is window sums in Spark.
    """
    df = df.withColumn("_i", (F.row_number().over(w()) - 1).cast("double"))
    for name, (source, span, kind) in jobs.items():
        keep = 1.0 - 2.0 / (span + 1.0)
        x, known = F.col(source), F.col(source).isNotNull().cast("double")
        value = F.coalesce(x, F.lit(0.0))
        parts = {"w": known, "x": value} | ({"w2": known, "x2": value * value} if kind == "std" else {})
        df = _decayed(df, {f"_{k}": (c, keep * keep if k == "w2" else keep) for k, c in parts.items()}, math.ceil(NEGLIGIBLE / -math.log(keep)))
        if kind == "std":
            weight = F.nullif(F.col("_w"), F.lit(0.0))
            m = F.col("_x") / weight
            biased = F.greatest(F.col("_x2") / weight - m * m, F.lit(0.0))
            square = weight * weight
            share = square / F.nullif(square - F.col("_w2"), F.lit(0.0))
            out = F.when(F.count(x).over(frame(Window.unboundedPreceding, 0)) >= 2, F.sqrt(biased * share))
        else:
            over, age = frame(Window.unboundedPreceding, 0), keep * F.pow(F.lit(keep), F.col("_i"))
            start, weight = F.first(value).over(over) * age, F.first(known).over(over) * age
            out = ((1.0 - keep) * F.col("_x") + start) / F.nullif((1.0 - keep) * F.col("_w") + weight, F.lit(0.0))
        df = df.withColumn(name, out).drop(*[f"_{k}" for k in parts])
    return df.drop("_i")


def _decayed(df: DataFrame, sums: dict[str, tuple[Column, float]], rows: int) -> DataFrame:
    """name -> (x, keep): the sum over a symbol's rows so far of x * keep^age, by blocks of `rows` rows."""
    block, place = F.floor(F.col("_i") / rows), F.col("_i") % rows
    df = df.withColumns({"_block": block, "_place": place})
    inside = Window.partitionBy(*keys(), "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = {n: F.sum(x * F.pow(F.lit(keep), -F.col("_place"))).over(inside) * F.pow(F.lit(keep), F.col("_place")) for n, (x, keep) in sums.items()}
    df = df.withColumns(own)
    last = F.col("_place") == rows - 1
    before = {n: F.coalesce(F.last(F.when(last, F.col(n)), ignorenulls=True).over(frame(Window.unboundedPreceding, -1)), F.lit(0.0)) for n in sums}
    carried = {n: F.col(n) + before[n] * F.pow(F.lit(keep), F.col("_place") + 1) for n, (_, keep) in sums.items()}
    return df.withColumns(carried).drop("_block", "_place")


def local_volatility(df: DataFrame, span: int = 20, backfill: bool = True) -> DataFrame:
    """EWM deviation of log_return. Backfilling gives the first rows the first known value, which looks a row or two ahead."""
    df = with_ewm(df, {"local_volatility": ("log_return", span, "std")})
    return df.withColumn("local_volatility", F.coalesce("local_volatility", bfill("local_volatility"))) if backfill else df


def triple_barrier(df: DataFrame, h: int = 5, up: float = 1.0, down: float = 1.0) -> DataFrame:
    """Which barrier the next h closes touch first: 1, -1, or 0 for neither or both at once; with return and time of touch.

    The last h rows of a symbol, and rows without a price or volatility, have no label.
    """
    later = F.collect_list(F.struct("ts", F.col("close_adj").alias("p"))).over(frame(1, h))
    p0, s = F.col("close_adj"), F.col("local_volatility")
    df = df.withColumn("_later", later)
    hits = {
        "_up": F.array_position(F.transform("_later", lambda x: x["p"] >= p0 * (1.0 + F.lit(up) * s)), True),
        "_down": F.array_position(F.transform("_later", lambda x: x["p"] <= p0 * (1.0 - F.lit(down) * s)), True),
    }
    df = df.withColumns(hits)
    u, d = F.col("_up"), F.col("_down")
    label = F.when((u > 0) & ((d == 0) | (u < d)), 1.0).when((d > 0) & ((u == 0) | (d < u)), -1.0).otherwise(0.0)
    known = (F.size("_later") == h) & p0.isNotNull() & s.isNotNull()
    df = df.withColumn("target_label", F.when(known, label))
    at = F.when(F.col("target_label") == 1.0, u).when(F.col("target_label") == -1.0, d).otherwise(F.lit(h))
    touch = F.try_element_at("_later", at.cast("int"))
    return df.withColumns(
        {
            "target_barrier_return": F.when(F.col("target_label").isNotNull(), touch["p"] / p0 - 1.0),
            "barrier_touch_time": F.when(F.col("target_label").isNotNull(), touch["ts"]),
        }
    ).drop("_later", "_up", "_down")


def distribution(df: DataFrame) -> DataFrame:
    return df.where("target_label is not null").groupBy("symbol", F.col("target_label").cast("int").alias("label")).agg(F.count("*").alias("support"))
