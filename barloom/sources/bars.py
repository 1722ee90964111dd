"""Bars from trades, benchmark bars, ticks, and file sources and sinks."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
IMPORTANCE = T.StructType(
    [T.StructField("feature", T.StringType()), T.StructField("mean_importance", T.DoubleType()), T.StructField("std_importance", T.DoubleType()), T.StructField("fold_count", T.LongType())]
)
LABELLED = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in ("close_adj", "local_volatility", "target_label", "target_barrier_return")]
    + [T.StructField("barrier_touch_time", T.DateType())]
)
_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price() -> Column:
    return F.lit(100) * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))


def _at() -> Column:
    return F.struct(*[F.col(c) for c in _ORDER], F.col("price"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(*_ORDER, "l_discount", "l_tax", "l_shipdate")
    return lines.select(*_ORDER, F.to_date("l_shipdate").alias("ts"), price().alias("price"))


def bars_from_trades(spark: SparkSession, sf_dir: str, symbol: str = "p_type") -> DataFrame:
    """Daily bars of each symbol: first, highest, lowest and last price and the traded quantity.

    part is joined by key; Spark broadcasts it by its own size check or shuffles both sides. A pass of hash aggregates gives each
    bar's range, quantity and first and last order; the full order of trades is looked up in the lines of these two orders
    alone, as an aggregate over structs sorts all that it reads. Orders without a key come first.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    every, typed, order = trades(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"), F.col("l_orderkey")
    ranges = {"high": F.max("price"), "low": F.min("price"), "volume": F.sum("l_quantity")}
    orders = {"_first": F.min(order), "_last": F.max(order), "_unkeyed": F.max(order.isNull())}
    found = written(every.join(part, typed).groupBy("symbol", "ts").agg(*[c.alias(n) for n, c in (ranges | orders).items()]), "bar-ranges")
    found = found.select(F.col("symbol").alias("_symbol"), F.col("ts").alias("_ts"), *ranges, F.when(~F.col("_unkeyed"), F.col("_first")).alias("_first"), "_last")
    near = every.join(found.select(F.explode(F.array("_first", "_last")).alias("_key")), order.eqNullSafe(F.col("_key")), "left_semi").join(part, typed)
    ends = near.join(found, F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("ts").eqNullSafe(F.col("_ts")))
    ends = ends.where(order.eqNullSafe(F.col("_first")) | order.eqNullSafe(F.col("_last")))
    same = [F.first(n).alias(n) for n in ranges]
    out = ends.groupBy("symbol", "ts").agg(F.min_by("price", _at()).alias("open"), F.max_by("price", _at()).alias("close"), *same)
    return out.select("symbol", "ts", "open", "high", "low", "close", "volume")


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One benchmark bar a day over all trades; the close is the quantity-weighted mean price."""
    return trades(spark, sf_dir).groupBy("ts").agg(
        (F.sum(F.col("price") * F.col("l_quantity")) / F.sum("l_quantity")).alias("mkt_close"),
        F.sum("l_quantity").alias("mkt_volume"),
        F.max("price").alias("mkt_high"),
        F.min("price").alias("mkt_low"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday ticks: symbol, ts, seq, close, high, low, volume."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        value.alias("close"),
        value.alias("high"),
        value.alias("low"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a date range with a fixed schema, so that neither inference nor other columns cost a pass."""
    reader = spark.read.schema(BAR)
    df = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    if start:
        df = df.where(F.col("ts") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("ts") <= F.lit(end).cast("date"))
    return df


def read_or(primary: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """The primary source, or the second if it is empty; an error if there is neither."""
    if not primary.isEmpty():
        return primary
    if second is None or second.isEmpty():
        raise ValueError("no bars in the source")
    return second


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a temporary one only in a local session without it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        atexit.register(shutil.rmtree, root[7:], True)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: cuts its lineage, and a lost executor reads it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """A labelled table of csv files with a header, its days parsed, in time order within each symbol."""
    return spark.read.schema(LABELLED).option("header", True).csv(path).orderBy("symbol", "ts")


def write_bars(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Files partitioned by symbol, a year of a symbol in one task; csv carries a header."""
    writer = df.repartition("symbol", F.year("ts")).write.mode("overwrite").partitionBy("symbol")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_importance(spark: SparkSession, path: str, top_n: int = 15) -> DataFrame:
    return spark.read.schema(IMPORTANCE).option("header", True).csv(path).orderBy(F.desc("mean_importance"), "feature").limit(top_n)
