"""Lag regressions from sums of products: the series never leave Spark, small matrices do.

A nested F test or an ARCH test needs only the products of a target with its own and another series' lags, summed over the rows: one
aggregate with partial sums for every (symbol, feature), whatever the length of the history. Tests with fewer lags use some rows more at a
series' start; these first rows (at most `most`) are kept beside the sums. What is solved in Python is one matrix of at most 2 + 2 * most
columns a (symbol, feature).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.functions.windows import lag, w

#: Directions of a matrix of products with less than this share of its largest eigenvalue hold rounding only.
RANK = 1e-13


def products(names: list[str]) -> Column:
    """The upper triangle of sums of products of columns, row by row."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return F.array(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)) for a, b in pairs])


def square(values: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = values
    return out + np.triu(out, 1).T


def residual(g: np.ndarray, target: int, on: list[int]) -> float:
    """Sum of squared residuals of a column on others, from the matrix of their products."""
    a, b = g[np.ix_(on, on)], g[on, target]
    size = np.sqrt(np.maximum(np.diag(a), 1e-300))
    value, vector = np.linalg.eigh(a / np.outer(size, size))
    part = (vector.T @ (b / size))[value > RANK * max(value.max(), 1e-300)]
    return max(0.0, float(g[target, target] - (part**2 / value[value > RANK * max(value.max(), 1e-300)]).sum()))


def nested_f(g: np.ndarray, first: list[np.ndarray], n: int, most: int) -> tuple[float, int]:
    """(least p, its lag) of F tests that 1..most lags of x help to predict y. Columns: 1, y, y's lags, x's lags.

    g: products over the rows from `most` on; first: the rows 1..most - 1 (lags before the series are 0); n: rows of the series.
    """
    best = (1.0, 1)
    for k in range(1, most + 1):
        free = n - k - 1 - 2 * k
        if free <= 0:
            break
        own = g + sum((np.outer(z, z) for z in first[k - 1 :]), np.zeros_like(g))
        small_on = [0, *range(2, 2 + k)]
        small, full = residual(own, 1, small_on), residual(own, 1, [*small_on, *range(2 + most, 2 + most + k)])
        if full > 0:
            p = stats.f_tail((small - full) / k / (full / free), k, free)
            if p < best[0]:
                best = (p, k)
    return best


def lag_sums(df: DataFrame, features: list[str], most: int) -> DataFrame:
    """symbol, feature, n, g, first: what nested_f needs of every feature, from rows without a null in any of them.

    Series are centred and scaled by their deviation first, which changes no test and keeps the sums exact to many digits.
    """
    given = df.select("symbol", "ts", F.array(F.col("target_label").cast("double"), *[F.col(f"`{f}`").cast("double") for f in features]).alias("_z"))
    rows = given.where(~F.exists("_z", lambda v: v.isNull()))  # one condition: a filter a column makes Catalyst derive conditions without end
    each = [F.get("_z", F.lit(i)) for i in range(len(features) + 1)]
    scale = rows.groupBy("symbol").agg(
        F.count("*").alias("_n"), F.array(*[F.struct(F.avg(c).alias("m"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias("s")) for c in each]).alias("_scale")
    )
    scaled = rows.join(scale, "symbol").select("symbol", "ts", "_n", F.zip_with("_z", "_scale", lambda v, c: (v - c["m"]) / c["s"]).alias("_z"))
    with_lags = scaled.select("symbol", "ts", "_n", F.get("_z", F.lit(0)).alias("_y"), F.slice("_z", 2, len(features)).alias("_v")).withColumn("_i", F.row_number().over(w()) - 1)
    lags, none = range(1, most + 1), F.array(*[F.lit(0.0)] * len(features))
    with_lags = with_lags.withColumns({f"_v{k}": F.coalesce(lag("_v", k), none) for k in lags} | {f"y{k}": F.coalesce(lag("_y", k), F.lit(0.0)) for k in lags})
    long = with_lags.where("_i > 0").select("symbol", "_n", "_i", F.lit(1.0).alias("one"), F.col("_y").alias("y"), *[f"y{k}" for k in lags], F.posexplode(F.arrays_zip(*[F.col(f"_v{k}") for k in lags])).alias("_f", "_x"))
    long = long.withColumns({f"x{k}": F.coalesce(F.col(f"_x._v{k}"), F.lit(0.0)) for k in lags})
    z = ["one", "y", *[f"y{k}" for k in lags], *[f"x{k}" for k in lags]]
    early = F.collect_list(F.struct("_i", F.array(*z).alias("z")))
    named = F.get(F.array(*map(F.lit, features)), F.col("_f"))
    sums = long.where(F.col("_i") >= most).groupBy("symbol", "_f").agg(F.max("_n").alias("n"), products(z).alias("g"))
    heads = long.where(F.col("_i") < most).groupBy("symbol", "_f").agg(F.array_sort(early)["z"].alias("first"), F.max("_n").alias("_m"))
    both = heads.join(sums, ["symbol", "_f"], "left").withColumns({"n": F.coalesce("n", "_m"), "g": F.coalesce("g", F.array(*[F.lit(0.0)] * (len(z) * (len(z) + 1) // 2)))})
    return both.withColumn("feature", named).drop("_f", "_m")


def granger_screen(df: DataFrame, features: list[str], most: int = 5, limit: float = 0.05) -> DataFrame:
    """symbol, feature, p, lag, causal: selection.granger_screen from sums of products, for any number of features."""
    k = 2 + 2 * most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for g, first, n in zip(batch.column("g").to_pylist(), batch.column("first").to_pylist(), batch.column("n").to_pylist(), strict=True):
                found.append(nested_f(square(np.array(g), k), [np.array(z) for z in first], n, most))
            p = [f[0] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("symbol"), batch.column("feature"), pa.array(p, pa.float64()), pa.array([f[1] for f in found], pa.int32()), pa.array([v < limit for v in p], pa.bool_())],
                ["symbol", "feature", "p", "lag", "causal"],
            )

    return lag_sums(df, features, most).select("symbol", "feature", "n", "g", "first").mapInArrow(run, "symbol string, feature string, p double, lag int, causal boolean")


def arch(df: DataFrame, lags: int = 5) -> DataFrame:
    """diagnostics.arch from sums of products: symbol, arch_lm, arch_p, has_arch_effect, leverage, has_asymmetric_vol."""
    rows = df.where("log_return is not null").select("symbol", "ts", F.col("log_return").alias("r"))
    mean = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg(F.col("r") * F.col("r")), F.lit(0.0)), F.lit(1.0)).alias("_m"))
    rows = rows.join(mean, "symbol").withColumns({"e": F.col("r") * F.col("r") / F.col("_m") - 1.0, "one": F.lit(1.0), "_i": F.row_number().over(w()) - 1, "_before": lag("r")})
    rows = rows.withColumns({f"e{k}": F.coalesce(lag("e", k), F.lit(0.0)) for k in range(1, lags + 1)})
    z = ["one", "e", *[f"e{k}" for k in range(1, lags + 1)]]
    counts = rows.groupBy("symbol").agg(F.max("n").alias("n"), F.corr(F.col("_before"), F.col("r") * F.col("r")).alias("leverage"))
    sums = rows.where(F.col("_i") >= lags).groupBy("symbol").agg(products(z).alias("g"))
    sums = counts.join(sums, "symbol", "left").withColumn("g", F.coalesce("g", F.array(*[F.lit(0.0)] * (len(z) * (len(z) + 1) // 2))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lm, p = [], []
            for g, n in zip(batch.column("g").to_pylist(), batch.column("n").to_pylist(), strict=True):
                a = square(np.array(g), len(z))
                total = a[1, 1] - a[0, 1] ** 2 / a[0, 0] if a[0, 0] else 0.0
                known = n >= 30 and total > 0
                lm.append(a[0, 0] * (1 - residual(a, 1, [0, *range(2, len(z))]) / total) if known else 0.0)
                p.append(stats.chi2_tail(lm[-1], lags) if n >= 30 else 1.0)
            leverage = [v if n >= 30 else 0.0 for v, n in zip(batch.column("leverage").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            columns = [pa.array(c, pa.float64()) for c in (lm, p, leverage)]
            flags = [pa.array([v is not None and test(v) for v in c], pa.bool_()) for c, test in ((p, lambda v: v < 0.05), (leverage, lambda v: v < -0.1))]
            yield pa.RecordBatch.from_arrays([batch.column("symbol"), columns[0], columns[1], flags[0], columns[2], flags[1]], ["symbol", "arch_lm", "arch_p", "has_arch_effect", "leverage", "has_asymmetric_vol"])

    schema = "symbol string, arch_lm double, arch_p double, has_arch_effect boolean, leverage double, has_asymmetric_vol boolean"
    return sums.mapInArrow(run, schema)
