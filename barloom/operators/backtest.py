"""Next-day, volatility-targeted, cost-aware ledgers and their summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import bfill, frame, lag, ratio

FRICTION = 20 / 10_000
TARGET_VOLATILITY = 0.15
DAYS = 252


def ledger(signals: DataFrame, bars: DataFrame, capital: float = 100_000.0, target: float = TARGET_VOLATILITY, friction: float = FRICTION) -> DataFrame:
    """A row a (symbol, ts): today's position is yesterday's signal, scaled by target over yesterday's volatility, at most 1.

    signals (symbol, ts, model_raw_target) meet bars (symbol, ts, close_adj, local_volatility) by key; rows with a null go.
    """
    rows = signals.select("symbol", "ts", "model_raw_target").join(bars.select("symbol", "ts", "close_adj", "local_volatility"), ["symbol", "ts"], "left")
    rows = rows.na.drop()
    rows = rows.withColumns(
        {
            "daily_asset_return": F.coalesce(ratio(F.col("close_adj"), lag("close_adj")) - 1.0, F.lit(0.0)),
            "active_position": F.coalesce(lag("model_raw_target"), F.lit(0.0)),
            "_sigma": F.nullif(lag("local_volatility"), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("_sigma", F.coalesce("_sigma", bfill("_sigma")))
    scale = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(target / math.sqrt(DAYS)) / F.col("_sigma")))
    rows = rows.withColumn("weight", F.when(F.col("_sigma").isNotNull(), scale * F.col("active_position")))
    rows = rows.withColumn("turnover", F.coalesce(F.abs(F.col("weight") - lag("weight")), F.lit(0.0)))
    rows = rows.withColumn("costs", F.col("turnover") * friction)
    rows = rows.withColumn("net_return", F.col("weight") * F.col("daily_asset_return") - F.col("costs"))
    past = frame(Window.unboundedPreceding, 0)
    rows = rows.withColumn("equity", capital * F.product(1.0 + F.col("net_return")).over(past))
    peak = F.max("equity").over(past)
    return rows.withColumn("drawdown", (F.col("equity") - peak) / peak).drop("_sigma")


def summary(rows: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """symbol, rows, total, annualized, sharpe, max_drawdown."""
    total = F.max_by("equity", "ts") / capital - 1.0
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("rows"), total.alias("total"), F.avg("net_return").alias("_mean"), F.stddev_samp("net_return").alias("_std"), F.min("drawdown").alias("max_drawdown")
    )
    return out.select(
        "symbol",
        "rows",
        "total",
        annualized(F.col("total"), F.col("rows")).alias("annualized"),
        (F.col("_mean") / (F.col("_std") + 1e-9) * math.sqrt(DAYS)).alias("sharpe"),
        "max_drawdown",
    )


def annualized(total, rows):
    return F.pow(1.0 + total, F.lit(float(DAYS)) / rows) - 1.0


def against_benchmark(signals: DataFrame, bars: DataFrame, friction: float = FRICTION) -> DataFrame:
    """Unweighted positions on raw closes, next to buying and holding."""
    rows = signals.select("symbol", "ts", "model_raw_target").join(bars.select("symbol", "ts", "close"), ["symbol", "ts"])
    rows = rows.withColumns({"asset_return": F.coalesce(ratio(F.col("close"), lag("close")) - 1.0, F.lit(0.0)), "position": F.coalesce(lag("model_raw_target"), F.lit(0.0))})
    rows = rows.withColumn("costs", F.coalesce(F.abs(F.col("position") - lag("position")), F.lit(0.0)) * friction)
    rows = rows.withColumn("strat_net_return", F.col("position") * F.col("asset_return") - F.col("costs"))
    past = frame(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"equity_strategy": F.product(1.0 + F.col("strat_net_return")).over(past), "equity_benchmark": F.product(1.0 + F.col("asset_return")).over(past)})
    peak = F.max("equity_strategy").over(past)
    return rows.withColumn("drawdown", (F.col("equity_strategy") - peak) / peak)


def fold_starts(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "fold").agg(F.min("ts").alias("first_ts"))
