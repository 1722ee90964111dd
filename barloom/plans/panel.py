"""The panel that the registered queries run on: bars built from trades, audited, adjusted, next to the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.windows import rounded
from barloom.operators import label, prep
from barloom.sources import bars as src

LAYER_COLUMNS = ["open_adj", "high_adj", "low_adj", "close_adj"]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars_from_trades(spark, sf_dir)


def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.adjust(prep.repair(bars(spark, sf_dir)))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted bars with benchmark return and log returns: what every feature family reads.

    Bars and benchmark are written once: however often a job reads the panel, it reads the trades no more.
    """
    market = prep.market_return(src.written(src.market_bars(spark, sf_dir), "market")).select("ts", "mkt_close", "mkt_return")
    joined = prep.market_join(prep.repair(src.written(bars(spark, sf_dir), "bars")), market)
    return prep.returns(prep.adjust(joined)).drop("split_factor", "dividend")


def with_book(df: DataFrame) -> DataFrame:
    """A two-level book by fixed arithmetic on the bar; the data has none."""
    v = F.col("volume")
    return df.withColumns(
        {
            "bid_price_1": F.col("low"),
            "ask_price_1": F.col("high"),
            "bid_size_1": v * 0.4,
            "ask_size_1": F.abs(F.col("close") - F.col("open")) * 10.0 + 1.0,
            "bid_price_2": F.col("low") - 0.5,
            "ask_price_2": F.col("high") + 0.5,
            "bid_size_2": v * 0.3,
            "ask_size_2": v * 0.2 + 1.0,
        }
    )


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.triple_barrier(label.local_volatility(panel(spark, sf_dir)))


def shown(df: DataFrame, digits: int | dict[str, int], *names: str) -> DataFrame:
    at = digits if isinstance(digits, dict) else dict.fromkeys(names, digits)
    return df.select("symbol", "ts", *[c for n in names for c in rounded(at[n], n)])
