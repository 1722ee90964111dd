"""Tables bucketed and sorted by symbol and partitioned by year: windows and joins by symbol read them without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import shared_path

BUCKETS = 64


def save(df: DataFrame, name: str | None = None, path: str | None = None, buckets: int = BUCKETS) -> str:
    """Write df (symbol, ts and any columns but `year`) as a table of the session's catalog; its name.

    Rows are dealt by bucket and year, as the buckets are cut, so each bucket of a year is one file, written by one task: a symbol's history
    spreads over as many tasks as it has years. An existing table of that name is an error. Rows of equal keys are all kept, a null
    symbol has a bucket too, and a null ts stands in a partition of its own.
    """
    name = name or f"bars_{uuid.uuid4().hex}"
    path = path or shared_path(df.sparkSession, name)
    dated = df.withColumn("year", F.year("ts"))
    dealt = dated.repartition(F.pmod(F.hash("symbol"), F.lit(buckets)), F.col("year"))
    dealt.write.format("parquet").option("path", path).partitionBy("year").bucketBy(buckets, "symbol").sortBy("symbol", "ts").saveAsTable(name)
    return name


def read(spark: SparkSession, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The table's rows in a range of days, its ends included; only the years of the range are listed and read.

    Joins of two such tables by (symbol, ts) keep their buckets if spark.sql.requireAllClusterKeysForCoPartition is false.
    """
    df = spark.table(name)
    if start is not None:
        first = F.lit(start).cast("date")
        df = df.where((F.col("ts") >= first) & (F.col("year") >= F.year(first)))
    if end is not None:
        last = F.lit(end).cast("date")
        df = df.where((F.col("ts") <= last) & (F.col("year") <= F.year(last)))
    return df.drop("year")
