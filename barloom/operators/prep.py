"""Joins, audit, adjustment, returns and order books of bar panels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import EPS, bfill, ffill, frame, lag, ratio, safe_ln, strict_greatest, strict_least

#: Days of benchmark bars that a broadcast may carry (a century of trading days); more are joined by shuffle.
MAX_BROADCAST_DAYS = 30_000


def market_return(market: DataFrame) -> DataFrame:
    """Log return over the benchmark's own calendar. The benchmark has one row a day, so a single ordered pass is small."""
    before = F.lag("mkt_close").over(Window.partitionBy(F.lit(0)).orderBy("ts"))
    return market.withColumn("mkt_return", safe_ln(ratio(F.col("mkt_close"), before)))


def market_join(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Bars next to the benchmark's columns of the day; days that either lacks go. Broadcast only if its size is small."""
    small = market.limit(MAX_BROADCAST_DAYS + 1).count() <= MAX_BROADCAST_DAYS
    return bars.join(F.broadcast(market) if small else market, "ts").na.drop(subset=["mkt_return"])


def ffill_intraday(df: DataFrame) -> DataFrame:
    """Columns named after intraday or vpin keep their last value, 0 before the first."""
    names = [c for c in df.columns if "intraday" in c or "vpin" in c]
    return df.withColumns({c: F.coalesce(ffill(c), F.lit(0.0)) for c in names})


def dedup(df: DataFrame, *order: str) -> DataFrame:
    """One row a (symbol, ts): the last by the given order. Hashing by symbol alone lets later windows reuse the exchange."""
    last = Window.partitionBy("symbol", "ts").orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


def repair(df: DataFrame) -> DataFrame:
    """High and low cover open and close; rows need a positive low and a volume that is not negative."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    fixed = df.withColumns({"high": strict_greatest(F.col("high"), top), "low": strict_least(F.col("low"), bottom)})
    return fixed.where("low > 0 and volume >= 0")


def adjust(df: DataFrame) -> DataFrame:
    """Forward adjustment for splits and dividends: close_adj compounds from the first close; the others scale with it.

    close_adj is kept to 1e-8, which takes the rounding noise of long products out of candles whose high equals their low.
    """
    if "split_factor" not in df.columns:
        df = df.withColumn("split_factor", F.lit(1.0))
    if "dividend" not in df.columns:
        df = df.withColumn("dividend", F.lit(0.0))
    growth = ratio(F.col("close") + F.col("dividend"), lag("close") * F.col("split_factor"))
    past = frame(Window.unboundedPreceding, 0)
    df = df.withColumn("_growth", growth)
    compounded = F.round(F.first("close").over(past) * F.product("_growth").over(past), 8)
    df = df.withColumn("close_adj", F.coalesce(F.when(F.col("_growth").isNotNull(), compounded), F.col("close")))
    scale = ratio(F.col("close_adj"), F.col("close"))
    return df.withColumns({f"{c}_adj": F.col(c) * scale for c in ("open", "high", "low")}).drop("_growth")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]


def flat_columns(df: DataFrame, keep: tuple[str, ...] = ("split_factor", "dividend", "target_label"), floor: float = 1e-8) -> DataFrame:
    """(column, flat): a numeric column is flat with a deviation below the floor or at most one value. One aggregate row."""
    names = [c for c in numeric_columns(df) if c not in keep]
    tests = [
        F.coalesce((F.stddev_samp(c) < floor) | (F.min(c) == F.max(c)) | (F.count(c) == 0), F.lit(False)).alias(c) for c in names
    ]
    row = df.agg(*tests)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("flat")) for c in names])
    return row.select(F.inline(pairs))


def drop_flat(df: DataFrame) -> tuple[DataFrame, list[str]]:
    gone = sorted(r["column"] for r in flat_columns(df).where("flat").collect())  # one row a column
    return df.drop(*gone), gone


def audit_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """symbol, initial_bars, clean_bars."""
    a = before.groupBy("symbol").agg(F.count("*").alias("initial_bars"))
    b = after.groupBy("symbol").agg(F.count("*").alias("clean_bars"))
    return a.join(b, "symbol", "left").withColumn("clean_bars", F.coalesce("clean_bars", F.lit(0).cast("long")))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, rows, first, last) of a panel in one pass."""
    names = [c for c in df.columns if c != "ts"]
    row = df.agg(
        F.count("*").alias("_rows"), F.min("ts").alias("_first"), F.max("ts").alias("_last"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in names]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.col("_rows").alias("rows"), F.col("_first").alias("first"), F.col("_last").alias("last")) for c in names])
    return row.select(F.inline(pairs))


def returns(df: DataFrame) -> DataFrame:
    c, o = F.col("close_adj"), F.col("open_adj")
    return df.withColumns(
        {
            "log_return": safe_ln(ratio(c, lag("close_adj"))),
            "overnight_return": safe_ln(ratio(o, lag("close_adj"))),
            "intraday_return": safe_ln(ratio(c, o)),
            "hl_log_range": safe_ln(ratio(F.col("high_adj"), F.col("low_adj"))),
        }
    )


def book_l2(df: DataFrame, levels: int = 10) -> DataFrame:
    """Mid, spread, imbalance and micro-price of a book of several levels, deeper ones weighing exp(-(i - 1) / 2)."""
    found = [i for i in range(1, levels + 1) if {f"bid_price_{i}", f"ask_price_{i}"} <= set(df.columns)]
    if len(found) < 2:
        return df
    decay = {i: math.exp(-0.5 * (i - 1)) for i in found}
    size = {s: sum(F.col(f"{s}_size_{i}") * decay[i] for i in found) for s in ("bid", "ask")}
    value = {s: sum(F.col(f"{s}_price_{i}") * (F.col(f"{s}_size_{i}") * decay[i]) for i in found) for s in ("bid", "ask")}
    both = size["bid"] + size["ask"] + EPS
    micro = (value["bid"] / (size["bid"] + EPS) * size["ask"] + value["ask"] / (size["ask"] + EPS) * size["bid"]) / both
    mid = (F.col("bid_price_1") + F.col("ask_price_1")) / 2.0
    return df.withColumns(
        {
            "mid_price": mid,
            "l2_spread": F.col("ask_price_1") - F.col("bid_price_1"),
            "order_imbalance_depth": (size["bid"] - size["ask"]) / both,
            "micro_price_depth": micro,
            "micro_mid_deviation": micro - mid,
        }
    )


def book_l1(df: DataFrame) -> DataFrame:
    """The same from the best quotes alone; used where there is no deeper book."""
    if not {"best_bid", "best_ask", "bid_size", "ask_size"} <= set(df.columns):
        return df
    b, a, sb, sa = (F.col(c) for c in ("best_bid", "best_ask", "bid_size", "ask_size"))
    both, mid = sb + sa + EPS, (b + a) / 2.0
    micro = (b * sa + a * sb) / both
    return df.withColumns(
        {"mid_price": mid, "micro_price": micro, "l2_spread": a - b, "micro_mid_deviation": micro - mid, "order_imbalance_depth": (sb - sa) / both}
    )


def daily_microstructure(ticks: DataFrame) -> DataFrame:
    """Order flow of each (symbol, day) from ticks (symbol, ts, seq, close, high, low, volume).

    A tick's volume is bought if the close did not fall since the tick before, across days too. No task orders a whole
    symbol: each day's last close is found by a partial aggregate and handed to the next day as its seed, so windows
    run within (symbol, day).
    """
    df = ticks.withColumn("day", F.to_date("ts"))
    at = F.struct("ts", "seq")
    closes = df.groupBy("symbol", "day").agg(F.max_by("close", at).alias("last"))
    seeds = closes.select("symbol", "day", F.lag("last").over(Window.partitionBy("symbol").orderBy("day")).alias("seed"))
    day = Window.partitionBy("symbol", "day").orderBy("ts", "seq")
    before = F.coalesce(F.lag("close").over(day), F.col("seed"))
    flow = df.join(seeds, ["symbol", "day"]).withColumn("signed", F.when(F.coalesce(F.col("close") - before, F.lit(0.0)) >= 0, F.col("volume")).otherwise(-F.col("volume")))
    out = flow.groupBy("symbol", F.col("day").alias("ts")).agg(
        F.avg("signed").alias("intraday_ofi_mean"),
        F.coalesce(F.stddev_samp("signed"), F.lit(0.0)).alias("intraday_ofi_std"),
        F.sum("signed").alias("intraday_ofi_sum"),
        F.sum("volume").alias("intraday_vol_sum"),
        F.count("*").alias("intraday_tick_count"),
        F.max("high").alias("intraday_high"),
        F.min("low").alias("intraday_low"),
    )
    return out.withColumn("daily_vpin", F.abs("intraday_ofi_sum") / (F.col("intraday_vol_sum") + EPS))


def join_micro(bars: DataFrame, micro: DataFrame) -> DataFrame:
    """Daily order flow next to the bars; days without ticks carry the last values on."""
    return ffill_intraday(bars.join(micro, ["symbol", "ts"], "left"))


def target_rows(df: DataFrame, required: list[str]) -> DataFrame:
    return df.where(F.col("target_label").isNotNull()).na.drop(subset=required)


def sigma_backfilled(column: str):
    return F.coalesce(F.col(column), bfill(column))


