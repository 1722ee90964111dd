"""Statistics of each symbol's series: distribution, memory, cycles, integration, volatility, volume, book, complexity.

One row a symbol. Sums and ranks are Spark's; regressions and transforms of one symbol's daily history run as small numpy
groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from barloom.functions import markov, stats
from barloom.functions.windows import EPS, diff, lag, std
from barloom.operators.features import _pattern, jumps

#: Series that one task fits together.
SERIES = 16


def _by() -> Window:
    return Window.partitionBy("symbol")


def two_sided(z: Column) -> Column:
    """P(|Z| > |z|) by Abramowitz and Stegun's 7.1.26, good to 2e-7."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return series * F.exp(-x * x)


@F.pandas_udf(DoubleType())
def t_tails(t: pd.Series, d: pd.Series) -> pd.Series:
    """P(|T| > |t|) for Student's T of d degrees; null without a t."""
    return pd.Series([stats.t_tail(a, b) if a == a and b > 0 else None for a, b in zip(t.astype(float), d.astype(float), strict=True)], dtype=float)


def distribution(df: DataFrame, least: int = 30) -> DataFrame:
    """Moments, bias-corrected skewness and kurtosis (3 for a normal), and the Jarque-Bera test."""
    n = F.col("n")
    rows = df.groupBy("symbol").agg(
        F.count("log_return").alias("n"), F.avg("log_return").alias("mean"), F.stddev_samp("log_return").alias("std"), F.skewness("log_return").alias("_s"), F.kurtosis("log_return").alias("_k")
    )
    rows = rows.where(n >= least)
    rows = rows.withColumns(
        {
            "skewness": F.col("_s") * F.sqrt(n * (n - 1)) / (n - 2),
            "kurtosis": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_k") + 6) + 3.0,
            "jarque_bera": n / 6.0 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4.0),
        }
    )
    rows = rows.withColumn("jarque_bera_p", F.exp(-F.col("jarque_bera") / 2.0))
    return rows.withColumns({"is_leptokurtic": F.col("kurtosis") > 3.0, "reject_normality": F.col("jarque_bera_p") < 0.05}).drop("_s", "_k")


def acf(df: DataFrame, most: int = 30) -> DataFrame:
    """symbol, n, acf (array over lags 1..most): all lags from one window and one aggregate."""
    x = F.col("log_return") - F.avg("log_return").over(_by())
    rows = df.where("log_return is not null").withColumn("_x", x)
    rows = rows.select("symbol", "_x", *[lag("_x", k).alias(f"_l{k}") for k in range(1, most + 1)])
    square = F.sum(F.col("_x") * F.col("_x"))
    values = F.array(*[F.sum(F.col("_x") * F.col(f"_l{k}")) / square for k in range(1, most + 1)])
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), values.alias("acf"))


def acf_lags(df: DataFrame, most: int = 30, least: int = 50) -> DataFrame:
    """symbol, dynamic_lags: the first five significant lags (else 1, 3, 5) with 1, 5 and 20."""
    rows = acf(df, most)
    usable = F.slice(F.col("acf"), 1, F.least(F.lit(most), F.floor(F.col("n") / 3).cast("int")))
    bound = 1.96 / F.sqrt("n")
    places = F.filter(F.transform(usable, lambda v, i: F.when(F.abs(v) > bound, i + 1)), lambda v: v.isNotNull())
    usual = F.array(F.lit(1), F.lit(3), F.lit(5))
    found = F.when(F.size(places) > 0, F.slice(places, 1, 5)).otherwise(usual)
    both = F.array_sort(F.array_distinct(F.concat(found, F.array(F.lit(1), F.lit(5), F.lit(20)))))
    return rows.select("symbol", F.when(F.col("n") < least, usual).otherwise(both).alias("dynamic_lags"))


def variance_ratio(df: DataFrame, k: int) -> DataFrame:
    """Lo-MacKinlay ratio of k-row to one-row variance, its heteroskedastic z and p."""
    rows = df.where("close_adj is not null").withColumn("_p", F.ln("close_adj"))
    rows = rows.withColumns({"_r": diff("_p"), "_rk": diff("_p", k), "_t": F.count("*").over(_by())})
    rows = rows.withColumn("_mu", F.avg("_r").over(_by()))
    rows = rows.withColumn("_e", F.pow(F.col("_r") - F.col("_mu"), 2))
    pairs = {f"_d{j}": F.col("_e") * lag("_e", j) for j in range(1, k)}
    out = rows.withColumns(pairs).groupBy("symbol").agg(
        F.max("_t").alias("t"),
        F.sum("_e").alias("s1"),
        F.sum(F.pow(F.col("_rk") - k * F.col("_mu"), 2)).alias("sk"),
        *[F.coalesce(F.sum(f"_d{j}"), F.lit(0.0)).alias(f"d{j}") for j in range(1, k)],
    )
    t = F.col("t")
    m = k * (t - k) * (1 - F.lit(k) / (t - 1))
    vr = F.col("sk") / m / (F.col("s1") / (t - 2))
    phi = sum(F.lit((2.0 * (k - j) / k) ** 2) * F.col(f"d{j}") for j in range(1, k)) / (F.col("s1") * F.col("s1"))
    out = out.where(t > k + 2).withColumns({"vr": vr, "z": F.when(phi > 0, (vr - 1.0) / F.sqrt(phi)).otherwise(0.0)})
    return out.select("symbol", "vr", "z", two_sided(F.col("z")).alias("p"))


def hurst_dfa(df: DataFrame) -> DataFrame:
    """Detrended fluctuation exponent: each scale's segments are regressed by Spark's aggregates, then scales by their logs."""
    rows = df.where("log_return is not null")
    rows = rows.withColumns({"_i": F.row_number().over(_by().orderBy("ts")) - 1, "_n": F.count("*").over(_by()), "_x": F.col("log_return") - F.avg("log_return").over(_by())})
    rows = rows.withColumn("_y", F.sum("_x").over(_by().orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    top = F.log10(F.floor(F.col("_n") / 4))
    scales = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.floor(F.pow(F.lit(10.0), 1.0 + (top - 1.0) * i / 14.0) + 1e-9).cast("int"))
    cut = rows.where("_n >= 40").withColumn("scale", F.explode(F.array_distinct(scales)))
    cut = cut.withColumn("segment", F.floor(F.col("_i") / F.col("scale")))
    cut = cut.where((F.col("segment") + 1) * F.col("scale") <= F.col("_n"))
    at = F.col("_i") - F.col("segment") * F.col("scale")
    parts = cut.groupBy("symbol", "scale", "segment").agg(F.regr_syy("_y", at).alias("yy"), F.regr_sxy("_y", at).alias("xy"), F.regr_sxx("_y", at).alias("xx"))
    rest = F.sqrt(F.greatest(F.lit(0.0), F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")) / F.col("scale"))
    flow = parts.groupBy("symbol", "scale").agg(F.avg(rest).alias("f")).where("f > 0")
    out = flow.groupBy("symbol").agg(F.regr_slope(F.ln("f"), F.ln("scale")).alias("hurst"))
    return df.select("symbol").distinct().join(out, "symbol", "left").select("symbol", F.coalesce("hurst", F.lit(0.5)).alias("hurst"))


def _per_symbol(df: DataFrame, columns: list[str], schema: str, job) -> DataFrame:
    """job(arrays in time order) -> values, for each symbol."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        out = job(*[pdf[c].to_numpy(float) for c in columns])
        return pd.DataFrame([[pdf["symbol"].iloc[0], *out]], columns=["symbol", *names])

    return df.select("symbol", "ts", *columns).groupBy("symbol").applyInPandas(run, f"symbol string, {schema}")


def _known(x: np.ndarray) -> np.ndarray:
    return x[~np.isnan(x)]


def cycle(df: DataFrame) -> DataFrame:
    return _per_symbol(df, ["close_adj"], "dominant_cycle int", lambda p: [stats.dominant_cycle(_known(p))])


def optimal_d(df: DataFrame) -> DataFrame:
    return _per_symbol(df, ["close_adj"], "optimal_d double, price_stationary boolean, memory_corr double", lambda p: stats.optimal_d(_known(p)))


def arch(df: DataFrame) -> DataFrame:
    def job(r: np.ndarray) -> list:
        r = _known(r)
        if len(r) < 30:
            return [0.0, 1.0, False, 0.0, False]
        lm, p = stats.arch_lm(r)
        leverage = float(np.corrcoef(r[:-1], r[1:] ** 2)[0, 1])
        return [lm, p, p < 0.05, leverage, leverage < -0.1]

    return _per_symbol(df, ["log_return"], "arch_lm double, arch_p double, has_arch_effect boolean, leverage double, has_asymmetric_vol boolean", job)


def jump_share(df: DataFrame, window: int = 20) -> DataFrame:
    rows = df.where("log_return is not null")
    rows = jumps(rows, window).groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.sum((F.col("jump_diffusion_component") > 0.25).cast("int")).alias("_k"),
        F.avg("jump_diffusion_component").alias("mean_jump_ratio"),
    )
    enough = F.col("n") >= 2 * window
    return rows.select(
        "symbol", F.coalesce(enough & (F.col("_k") > F.col("n") * 0.05), F.lit(False)).alias("has_volatility_jumps"), F.when(enough, F.col("mean_jump_ratio")).otherwise(0.0).alias("mean_jump_ratio")
    )


def _average_rank(c: str) -> Column:
    own = Window.partitionBy("symbol").orderBy(c)
    ties = F.count("*").over(Window.partitionBy("symbol", c))
    return F.rank().over(own) + (ties - 1) / 2.0


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """symbol, n, rho, t of the rank correlation of two columns."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("symbol", a, b)
    rows = rows.withColumns({"_a": _average_rank(a), "_b": _average_rank(b)})
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("rho"))
    return out.withColumn("t", F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))))


def volume(df: DataFrame, least: int = 30) -> DataFrame:
    """Rank correlation of volume and the size of returns (to 1e-10, so that equal moves tie); p from Student's t."""
    rows = spearman(df.withColumn("_size", F.round(F.abs("log_return"), 10)), "volume", "_size").where(F.col("n") >= least)
    p = t_tails(F.col("t"), F.col("n") - 2)
    return rows.select("symbol", F.col("rho").alias("vol_ret_corr"), ((p < 0.05) & (F.col("rho") > 0.1)).alias("is_volume_significant"))


def book(df: DataFrame) -> DataFrame:
    """Whether yesterday's micro-price deviation ranks with today's return, and whether the spread is stationary."""
    rows = df.withColumns({"_dev": F.coalesce(lag(F.coalesce(F.col("micro_mid_deviation"), F.lit(0.0))), F.lit(0.0)), "_r": F.coalesce("log_return", F.lit(0.0))})
    rho = spearman(rows, "_dev", "_r").select("symbol", F.col("rho").alias("micro_dev_corr"), ((t_tails(F.col("t"), F.col("n") - 2) < 0.05) & (F.abs("rho") > 0.05)).alias("micro_deviation_sig"))
    spread = _per_symbol(df, ["l2_spread"], "l2_spread_stationary boolean", lambda s: [stats.adf_p(np.nan_to_num(s)) < 0.05 if len(s) >= 50 else False])
    return rho.join(spread, "symbol")


def nonlinear(df: DataFrame) -> DataFrame:
    """BDS test of the residuals of a first-order autoregression, and the mutual information of a return and the one before."""

    def job(r: np.ndarray) -> list:
        r = _known(r)
        if len(r) < 50:
            return [0.0, 1.0, False, 0.0]
        m = np.column_stack((np.ones(len(r) - 1), r[:-1]))
        beta, _ = stats.least_squares(m, r[1:])
        e = r[1:] - m @ beta
        stat, p = stats.bds_two((e - e.mean()) / (e.std() + EPS))
        return [stat, p, p < 0.05, stats.paired_information(r[:-1], r[1:])]

    return _per_symbol(df, ["log_return"], "bds double, bds_p double, is_nonlinear boolean, mutual_information_lag1 double", job)


def permutation_entropy(df: DataFrame, least: int = 30) -> DataFrame:
    rows = df.where("log_return is not null")
    r = F.col("log_return")
    rows = rows.withColumn("_p", F.when(lag(r, 2).isNotNull(), _pattern(lag(r, 2), lag(r), r)))
    counts = rows.where("_p is not null").groupBy("symbol", "_p").agg(F.count("*").alias("k"))
    total = F.sum("k").over(_by())
    shares = counts.select("symbol", "k", (F.col("k") / total).alias("q"))
    out = shares.groupBy("symbol").agg(F.sum("k").alias("n"), (-F.sum(F.col("q") * F.log2(F.col("q") + EPS)) / math.log2(6.0)).alias("e"))
    e = F.when(F.col("n") + 2 >= least, F.col("e")).otherwise(1.0)
    return out.select("symbol", e.alias("permutation_entropy"), ((F.col("n") + 2 >= least) & (e > 0.85)).alias("is_high_complexity"))


def regime(df: DataFrame) -> DataFrame:
    """symbol, ts, prob_regime_high_vol: 1 where the 20-row deviation exceeds the symbol's median of it."""
    rows = df.withColumn("_s", std("log_return", 20))
    half = rows.groupBy("symbol").agg(F.percentile("_s", 0.5).alias("_half"))
    high = F.coalesce((F.col("_s") > F.col("_half")).cast("double"), F.lit(0.0))
    return rows.join(half, "symbol").select("symbol", "ts", high.alias("prob_regime_high_vol"), (1.0 - high).alias("prob_regime_low_vol"))


def markov_regime(df: DataFrame, series: int = SERIES) -> DataFrame:
    """symbol, ts, prob_regime_low_vol, prob_regime_high_vol, status: filtered probabilities of a two-regime switching mean and variance.

    Maximum likelihood by EM, `series` symbols (or folds of symbols) in one array. Where EM does not converge, and for fewer than 30 returns
    or returns that do not vary, the 20-row deviation against its median decides instead (status "fallback", else "converged"). Rows without a
    return have no regime.
    """
    rows = df.where("log_return is not null").select("symbol", "ts", "log_return")
    n = rows.select("symbol").distinct().count()
    batch = F.pmod(F.xxhash64("symbol"), F.lit(max(1, -(-n // series))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["symbol", "ts"], kind="stable")
        parts = [p for _, p in pdf.groupby("symbol", sort=False)]
        found, _ = markov.fit([p["log_return"].to_numpy(float) for p in parts])
        out = []
        for p, high in zip(parts, found, strict=True):
            status = "fallback" if high is None else "converged"
            if high is None:
                spread = p["log_return"].rolling(20).std()
                high = (spread > spread.median()).to_numpy(float)
            out.append(p.assign(prob_regime_low_vol=1.0 - high, prob_regime_high_vol=high, status=status))
        return pd.concat(out)[["symbol", "ts", "prob_regime_low_vol", "prob_regime_high_vol", "status"]]

    kind = df.schema["ts"].dataType.simpleString()
    schema = f"symbol string, ts {kind}, prob_regime_low_vol double, prob_regime_high_vol double, status string"
    return rows.withColumn("_batch", batch).groupBy("_batch").applyInPandas(run, schema)


def payload(df: DataFrame) -> DataFrame:
    """symbol, dynamic_lags, optimal_d, dominant_cycle and the ten routing flags; a join of one-row-a-symbol tables."""
    short = variance_ratio(df, 3).select("symbol", ((F.col("vr") < 1) & (F.col("p") < 0.05)).alias("has_short_reversion"))
    long = variance_ratio(df, 20).select("symbol", ((F.col("vr") > 1) & (F.col("p") < 0.05)).alias("has_long_trend"))
    tables = [
        short,
        long,
        optimal_d(df).select("symbol", "optimal_d"),
        cycle(df),
        arch(df).select("symbol", F.col("has_arch_effect").alias("has_vol_clustering"), "has_asymmetric_vol"),
        jump_share(df).select("symbol", F.col("has_volatility_jumps").alias("has_vol_jumps")),
        volume(df).select("symbol", "is_volume_significant"),
        nonlinear(df).select("symbol", "is_nonlinear"),
        permutation_entropy(df).select("symbol", "is_high_complexity"),
    ]
    has_book = {"micro_mid_deviation", "l2_spread"} <= set(df.columns)
    if has_book:
        tables.append(book(df).select("symbol", "micro_deviation_sig"))
    out = acf_lags(df)
    for t in tables:
        out = out.join(t, "symbol", "left")
    out = out.withColumn("has_l2_orderbook", F.lit(has_book))
    flags = ["has_long_trend", "has_short_reversion", "has_vol_clustering", "has_asymmetric_vol", "is_volume_significant", "is_nonlinear", "has_vol_jumps", "is_high_complexity", "has_l2_orderbook", "micro_deviation_sig"]
    if not has_book:
        out = out.withColumn("micro_deviation_sig", F.lit(False))
    return out.select("symbol", "dynamic_lags", F.coalesce("optimal_d", F.lit(1.0)).alias("optimal_d"), F.coalesce("dominant_cycle", F.lit(10)).alias("dominant_cycle"), *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])
