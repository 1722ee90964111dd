"""Order flow of ticks as a stream: slices of time close at the watermark, in (ts, seq) order whatever the order of arrival.

All state is that of a windowed aggregate: a slice's ticks, released and forgotten once the watermark passes its end. Slices
leave in order of time, so what one hands to the next is one close a symbol, kept as a small table beside the results.
No Python worker takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.windows import EPS

#: Ticks as they arrive; a row without a symbol only moves the watermark.
TICK = "symbol string, ts timestamp, seq long, close double, high double, low double, volume double"


def tick_slices(ticks: DataFrame, late: str = "1 day", width: str = "1 hour") -> DataFrame:
    """One row for each (symbol, start) of a slice: sums that need no tick outside it, its first tick and last close.

    ticks may be a stream or a table. On a stream a slice comes out once no tick may be more than `late` behind; later ones are
    dropped by the watermark. width divides a day. Ticks without ts have no slice. A tick whose close or whose predecessor's
    close within the slice is null counts as bought.
    """
    at = F.struct("ts", "seq", "close", "high", "low", "volume")
    kept = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    rows = kept.agg(
        F.array_sort(F.collect_list(at)).alias("t"),
        F.count("*").alias("n"),
        F.count("volume").alias("m"),
        F.sum("volume").alias("vol"),
        F.sum(F.col("volume") * F.col("volume")).alias("sq"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
    )
    t = F.col("t")

    def signed(tick, i):
        up = F.coalesce(tick["close"] - F.get(t, i - 1)["close"], F.lit(0.0)) >= 0
        return F.when(i == 0, 0.0).otherwise(F.coalesce(F.when(up, tick["volume"]).otherwise(-tick["volume"]), F.lit(0.0)))

    rest = F.aggregate(F.transform(t, signed), F.lit(0.0), lambda a, x: a + x)
    ends = [F.get(t, F.lit(0))["close"].alias("first_close"), F.get(t, F.lit(0))["volume"].alias("first_volume"), F.element_at(t, -1)["close"].alias("last")]
    return rows.select("symbol", F.col("w.start").alias("start"), rest.alias("rest"), *ends, "n", "m", "vol", "sq", "high", "low")


def seeded(slices: DataFrame, carry: DataFrame) -> DataFrame:
    """The slices with the sign of their first tick settled: against the slice before, or carry (symbol, last) before all of them."""
    before = F.lag("last").over(Window.partitionBy("symbol").orderBy("start"))
    rows = slices.withColumn("before", before).join(carry.select("symbol", F.col("last").alias("carried")), "symbol", "left")
    up = F.coalesce(F.col("first_close") - F.coalesce("before", "carried"), F.lit(0.0)) >= 0
    first = F.coalesce(F.when(up, F.col("first_volume")).otherwise(-F.col("first_volume")), F.lit(0.0))
    return rows.select("symbol", "start", (F.col("rest") + first).alias("signed"), "n", "m", "vol", "sq", "high", "low")


def run_ticks(ticks: DataFrame, path: str, late: str = "1 day", width: str = "1 hour") -> str | None:
    """Take in what has arrived and return the watermark: days before it are whole in read_days(path).

    ticks is a stream (columns of TICK), path a folder that all executors share. A further call goes on where the last one
    ended. Each micro-batch writes its own folders, slices/batch=i and carry/i, from carry/i-1 alone, so a batch that is
    repeated after a failure writes the same again.
    """
    spark = ticks.sparkSession

    def step(batch: DataFrame, i: int) -> None:
        s = batch.sparkSession
        raw = f"{path}/raw/{i}"
        batch.where("symbol is not null").write.mode("overwrite").parquet(raw)  # the aggregate runs once
        new = s.read.schema(batch.schema).parquet(raw)
        carry = s.read.schema("symbol string, last double, start timestamp").parquet(f"{path}/carry/{i - 1}") if i else s.createDataFrame([], "symbol string, last double, start timestamp")
        seeded(new, carry).write.mode("overwrite").parquet(f"{path}/slices/batch={i}")
        last = carry.unionByName(new.select("symbol", "last", "start")).groupBy("symbol").agg(F.max_by("last", "start").alias("last"), F.max("start").alias("start"))
        last.write.mode("overwrite").parquet(f"{path}/carry/{i}")
        for old in (raw, f"{path}/carry/{i - 2}"):
            _delete(s, old)

    query = tick_slices(ticks, late, width).writeStream.foreachBatch(step).outputMode("append")
    query = query.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    marks = [p["eventTime"].get("watermark") for p in query.recentProgress if p.get("eventTime")]
    return marks[-1] if marks else None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """symbol, ts (day) and the day's order flow from the slices that have come out so far."""
    schema = "symbol string, start timestamp, signed double, n long, m long, vol double, sq double, high double, low double"
    rows = spark.read.schema(schema).parquet(f"{path}/slices/*")
    m, s = F.sum("m"), F.sum("signed")
    spread = F.greatest((F.sum("sq") - s * s / F.nullif(m, F.lit(0))) / F.nullif(m - 1, F.lit(0)), F.lit(0.0))
    signed = F.when(m > 0, s)
    return rows.groupBy("symbol", F.to_date("start").alias("ts")).agg(
        (s / F.nullif(m, F.lit(0))).alias("intraday_ofi_mean"),
        F.coalesce(F.when(m > 1, F.sqrt(spread)), F.lit(0.0)).alias("intraday_ofi_std"),
        signed.alias("intraday_ofi_sum"),
        F.sum("vol").alias("intraday_vol_sum"),
        F.sum("n").alias("intraday_tick_count"),
        F.max("high").alias("intraday_high"),
        F.min("low").alias("intraday_low"),
        (F.abs(signed) / (F.sum("vol") + EPS)).alias("daily_vpin"),
    )
