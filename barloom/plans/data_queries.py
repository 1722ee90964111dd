"""Registered queries of sources, preparation and labels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import rounded
from barloom.operators import label, prep
from barloom.plans.panel import bars, labeled, panel, shown, with_book
from barloom.plans.feature_queries import L2_STEPS
from barloom.plans.sql import BARS, BOOK, JOINED, MARKET, P, PANEL, PAST, TRADES, adjust
from barloom.plans.sql import shown as sql_shown
from barloom.sources import bars as src
from barloom.sources import bucketed
from barloom.streaming import ticks as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            SQL[job.__name__] = sql
        return job

    return add


BAR_NAMES = ["open", "high", "low", "close", "volume"]


@query(sql_shown(BARS, "bars", 6, BAR_NAMES))
def src_bars(spark, sf_dir):
    return shown(bars(spark, sf_dir), 6, *BAR_NAMES)


@query(sql_shown(BARS, "bars", 6, BAR_NAMES) + " WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def src_bars_range(spark, sf_dir):
    between = F.col("ts").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-31").cast("date"))
    return shown(src.read_or(bars(spark, sf_dir).where(between), bars(spark, sf_dir)), 6, *BAR_NAMES)


@query(sql_shown(BARS, "bars", 6, BAR_NAMES) + " WHERE ts BETWEEN DATE '1995-07-01' AND DATE '1996-12-31'")
def src_bucketed_range(spark, sf_dir):
    """Bars saved in buckets of symbols and partitions of years; a range of days read from it."""
    name = bucketed.save(bars(spark, sf_dir), buckets=8)
    return shown(bucketed.read(spark, name, "1995-07-01", "1996-12-31"), 6, *BAR_NAMES)


@query(sql_shown(f"{TRADES}, {MARKET}", "market", 6, ["mkt_close", "mkt_volume", "mkt_high", "mkt_low"], keys="ts"))
def src_market(spark, sf_dir):
    return src.market_bars(spark, sf_dir).select("ts", *rounded(6, "mkt_close", "mkt_volume", "mkt_high", "mkt_low"))


@query(sql_shown(f"{TRADES}, {MARKET}", "market", 6, ["mkt_close", "mkt_volume"], keys="ts"))
def src_second_source(spark, sf_dir):
    """The benchmark's first source has no rows, so the second is read."""
    market = src.market_bars(spark, sf_dir)
    return src.read_or(market.where("ts < date'1900-01-01'"), market).select("ts", *rounded(6, "mkt_close", "mkt_volume"))


@query(sql_shown(BARS, "bars", 6, BAR_NAMES) + " WHERE ts >= DATE '1995-01-01'")
def src_write_table(spark, sf_dir):
    """Bars written as files of each symbol and read again from a first day on."""
    path = src.shared_path(spark, "bars")
    src.write_bars(bars(spark, sf_dir), path)
    return shown(src.read_bars(spark, path, start="1995-01-01"), 6, *BAR_NAMES)


@query(sql_shown(f"{BARS}, {MARKET}, {JOINED}", "joined", 6, ["close", "mkt_close", "mkt_return"]))
def prep_market_join(spark, sf_dir):
    market = prep.market_return(src.market_bars(spark, sf_dir))
    return shown(prep.market_join(bars(spark, sf_dir), market), 6, "close", "mkt_close", "mkt_return")


@query(sql_shown(f"{TRADES}, {MARKET}", "market_r", 8, ["mkt_return"], keys="ts"))
def prep_mkt_return(spark, sf_dir):
    return prep.market_return(src.market_bars(spark, sf_dir)).select("ts", *rounded(8, "mkt_return"))


_TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS close, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"
_MICRO = f"""{_TICKS},
flow AS (SELECT *, CAST(ts AS DATE) AS day, CASE WHEN coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) >= 0 THEN volume ELSE -volume END AS signed FROM ticks),
micro AS (SELECT symbol, day AS ts, avg(signed) AS intraday_ofi_mean, coalesce(stddev_samp(signed), 0) AS intraday_ofi_std, sum(signed) AS intraday_ofi_sum,
  sum(volume) AS intraday_vol_sum, count(*) AS intraday_tick_count, max(close) AS intraday_high, min(close) AS intraday_low,
  abs(sum(signed)) / (sum(volume) + 1e-8) AS daily_vpin FROM flow GROUP BY symbol, day)"""
MICRO_NAMES = ["intraday_ofi_mean", "intraday_ofi_std", "intraday_ofi_sum", "intraday_vol_sum", "intraday_tick_count", "intraday_high", "intraday_low", "daily_vpin"]


@query(sql_shown(_MICRO, "micro", 6, MICRO_NAMES))
def prep_daily_microstructure(spark, sf_dir):
    return shown(prep.daily_microstructure(src.ticks(spark, sf_dir)), 6, *MICRO_NAMES)


@query(sql_shown(_MICRO, "micro", 6, MICRO_NAMES))
def stream_daily_microstructure(spark, sf_dir):
    """The table's ticks as four deliveries, each tick up to twelve hours late, through the stream; a closing mark releases the rest."""
    path = src.shared_path(spark, "ticks")
    ticks = src.ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_timestamp("ts") + F.pmod(F.xxhash64("seq"), F.lit(12 * 3600))
    low, high = ticks.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts")) + 12 * 3600).first()
    read = spark.readStream.schema(stream.TICK)
    if low is not None:
        part = F.floor((arrival - low) * 4 / (high - low + 1))
        for i in range(4):
            ticks.where(part == i).write.mode("append").parquet(f"{path}/in")
            stream.run_ticks(read.parquet(f"{path}/in"), path)
    mark = spark.range(1).select(*[F.lit((high or 0) + 3 * 86400).cast("timestamp").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in ticks.schema])
    mark.write.mode("append").parquet(f"{path}/in")
    stream.run_ticks(read.parquet(f"{path}/in"), path)
    return shown(stream.read_days(spark, path), 6, *MICRO_NAMES)


@query(
    sql_shown(
        f"{BARS}, holes AS (SELECT symbol, ts, CASE WHEN day(ts) % 4 = 0 THEN volume END AS daily_vpin FROM bars)",
        "holes",
        6,
        ["daily_vpin"],
        {"filled": f"coalesce(last_value(daily_vpin IGNORE NULLS) OVER ({P} {PAST}), 0)"},
    ).replace("round(daily_vpin::DOUBLE", "round(filled::DOUBLE")
)
def prep_ffill(spark, sf_dir):
    """Volumes of every fourth day under a name that is carried forward."""
    holes = bars(spark, sf_dir).select("symbol", "ts", F.when(F.dayofmonth("ts") % 4 == 0, F.col("volume")).alias("daily_vpin"))
    return shown(prep.ffill_intraday(holes), 6, "daily_vpin")


_DAYS = """days AS (SELECT symbol, ts FROM micro),
gap AS (SELECT days.*, m.intraday_ofi_mean, m.daily_vpin FROM days LEFT JOIN micro m ON m.symbol = days.symbol AND m.ts = days.ts AND day(m.ts) % 3 <> 0)"""


@query(
    sql_shown(
        f"{_MICRO}, {_DAYS}",
        "gap",
        6,
        ["intraday_ofi_mean", "daily_vpin"],
        {"f1": f"last_value(intraday_ofi_mean IGNORE NULLS) OVER ({P} {PAST})", "f2": f"last_value(daily_vpin IGNORE NULLS) OVER ({P} {PAST})"},
    ).replace("round(intraday_ofi_mean::DOUBLE", "round(coalesce(f1, 0)::DOUBLE").replace("round(daily_vpin::DOUBLE", "round(coalesce(f2, 0)::DOUBLE")
)
def prep_join_micro(spark, sf_dir):
    """Order flow joined to the days of the ticks; every third day of the month is left without, then filled."""
    micro = prep.daily_microstructure(src.ticks(spark, sf_dir))
    days = micro.select("symbol", "ts")
    known = micro.where(F.dayofmonth("ts") % 3 != 0).select("symbol", "ts", "intraday_ofi_mean", "daily_vpin")
    return shown(prep.join_micro(days, known), 6, "intraday_ofi_mean", "daily_vpin")


@query(
    f"""WITH {TRADES}, keyed AS (SELECT l_suppkey::VARCHAR AS symbol, ts, price, l_orderkey, l_linenumber, l_partkey, l_quantity FROM trades),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, price DESC) AS k FROM keyed)
SELECT symbol, ts, l_orderkey, l_linenumber, round(price, 6) AS price FROM ranked WHERE k = 1"""
)
def prep_dedup(spark, sf_dir):
    keyed = src.trades(spark, sf_dir).withColumn("symbol", F.col("l_suppkey").cast("string"))
    kept = prep.dedup(keyed, "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "price")
    return kept.select("symbol", "ts", "l_orderkey", "l_linenumber", F.round("price", 6).alias("price"))


@query(
    f"""WITH {BARS}, broken AS (SELECT symbol, ts, open, close, volume - 60 AS volume, CASE WHEN day(ts) = 7 THEN open - 1 ELSE high END AS high,
  CASE WHEN day(ts) = 9 THEN close + 1 WHEN day(ts) = 11 THEN -1 ELSE low END AS low FROM bars)
SELECT symbol, ts, round(greatest(high, open, close), 6) AS high, round(least(low, open, close), 6) AS low FROM broken
WHERE least(low, open, close) > 0 AND volume >= 0"""
)
def prep_repair(spark, sf_dir):
    day = F.dayofmonth("ts")
    broken = bars(spark, sf_dir).withColumns(
        {
            "volume": F.col("volume") - 60,
            "high": F.when(day == 7, F.col("open") - 1).otherwise(F.col("high")),
            "low": F.when(day == 9, F.col("close") + 1).when(day == 11, -1.0).otherwise(F.col("low")),
        }
    )
    return shown(prep.repair(broken), 6, "high", "low")


_ACTIONS = "CASE WHEN ts = DATE '1996-06-17' THEN 2.0 ELSE 1.0 END::DOUBLE AS split_factor, CASE WHEN day(ts) = 15 AND month(ts) = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS dividend"


def acted(spark, sf_dir):
    """Bars with a split on one date and a dividend every 15th of March."""
    return bars(spark, sf_dir).withColumns(
        {
            "split_factor": F.when(F.col("ts") == F.lit("1996-06-17").cast("date"), 2.0).otherwise(1.0),
            "dividend": F.when((F.dayofmonth("ts") == 15) & (F.month("ts") == 3), 1.0).otherwise(0.0),
        }
    )


@query(sql_shown(f"{BARS}, {adjust('bars', _ACTIONS)}", "adj", 6, ["close_adj", "open_adj", "high_adj", "low_adj"]))
def prep_adjust(spark, sf_dir):
    return shown(prep.adjust(acted(spark, sf_dir)), 6, "close_adj", "open_adj", "high_adj", "low_adj")


@query(
    f"""WITH {BARS}, u AS (UNPIVOT (SELECT open, high, low, close, volume, 0.0::DOUBLE AS still FROM bars) ON COLUMNS(*) INTO NAME "column" VALUE v)
SELECT "column", (stddev_samp(v) < 1e-8 OR min(v) = max(v)) AS flat FROM u GROUP BY 1"""
)
def prep_flat_columns(spark, sf_dir):
    return prep.flat_columns(bars(spark, sf_dir).withColumn("still", F.lit(0.0)))


@query(f"WITH {BARS} SELECT symbol, count(*) AS initial_bars, count(*) FILTER (WHERE volume >= 60) AS clean_bars FROM bars GROUP BY symbol")
def prep_audit_stats(spark, sf_dir):
    raw = bars(spark, sf_dir).withColumn("volume", F.col("volume") - 60)
    return prep.audit_stats(raw, prep.repair(raw))


@query(
    f"""WITH {PANEL}, lab AS (SELECT log_return, overnight_return, mkt_return, CASE WHEN volume > 100 THEN volume END AS volume, ts FROM panel)
SELECT "column", nulls, rows, first, last FROM (SELECT count(*) AS rows, min(ts) AS first, max(ts) AS last, count(*)-count(log_return) AS log_return,
count(*)-count(overnight_return) AS overnight_return, count(*)-count(mkt_return) AS mkt_return, count(*)-count(volume) AS volume FROM lab)
UNPIVOT (nulls FOR "column" IN (log_return, overnight_return, mkt_return, volume))"""
)
def prep_null_profile(spark, sf_dir):
    df = panel(spark, sf_dir).select("ts", "log_return", "overnight_return", "mkt_return", F.when(F.col("volume") > 100, F.col("volume")).alias("volume"))
    return prep.null_profile(df)


RETURN_NAMES = ["log_return", "overnight_return", "intraday_return", "hl_log_range"]


@query(sql_shown(PANEL, "panel", 8, RETURN_NAMES))
def prep_returns(spark, sf_dir):
    return shown(panel(spark, sf_dir), 8, *RETURN_NAMES)


L2_NAMES = ["mid_price", "l2_spread", "order_imbalance_depth", "micro_price_depth", "micro_mid_deviation"]


@query(sql_shown(f"{PANEL}, {BOOK}", "book", 6, L2_NAMES, *L2_STEPS))
def prep_book_l2(spark, sf_dir):
    return shown(prep.book_l2(with_book(panel(spark, sf_dir))), 6, *L2_NAMES)


L1_NAMES = ["mid_price", "micro_price", "l2_spread", "micro_mid_deviation", "order_imbalance_depth"]


@query(
    sql_shown(
        PANEL,
        "panel",
        6,
        L1_NAMES,
        {"bb": "low", "ba": "high", "sb": "volume * 0.4", "sa": "abs(close - open) * 10 + 1"},
        {"mid_price": "(bb + ba) / 2", "micro_price": "(bb*sa + ba*sb) / (sb + sa + 1e-8)", "l2_spread": "ba - bb", "order_imbalance_depth": "(sb - sa) / (sb + sa + 1e-8)"},
        {"micro_mid_deviation": "micro_price - mid_price"},
    )
)
def prep_book_l1(spark, sf_dir):
    book = with_book(panel(spark, sf_dir)).select(
        "symbol", "ts", F.col("bid_price_1").alias("best_bid"), F.col("ask_price_1").alias("best_ask"), F.col("bid_size_1").alias("bid_size"), F.col("ask_size_1").alias("ask_size")
    )
    return shown(prep.book_l1(book), 6, *L1_NAMES)


# exact while 1/q^i is finite: about 7,000 bars a symbol
_Q = 19.0 / 21.0
_EWM = (
    {"i": f"row_number() OVER ({P})"},
    {"g": f"CASE WHEN log_return IS NOT NULL THEN pow({_Q!r}, -i) END"},
    {
        "n": f"count(log_return) OVER ({P} {PAST})",
        "w1": f"sum(g) OVER ({P} {PAST})",
        "w2": f"sum(g*g) OVER ({P} {PAST})",
        "mx": f"sum(g*log_return) OVER ({P} {PAST})",
        "mxx": f"sum(g*log_return*log_return) OVER ({P} {PAST})",
    },
    {"sig": "CASE WHEN n >= 2 THEN sqrt(greatest(0, (mxx/w1 - pow(mx/w1, 2)) / (1 - w2/w1/w1))) END"},
    {"local_volatility": f"coalesce(sig, first_value(sig IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"},
)
_LEADS = {f"p{k}": f"lead(close_adj, {k}) OVER ({P})" for k in range(1, 6)} | {f"t{k}": f"lead(ts, {k}) OVER ({P})" for k in range(1, 6)}


def _first(op: str, bound: str) -> str:
    return "CASE " + " ".join(f"WHEN p{k} {op} {bound} THEN {k}" for k in range(1, 6)) + " ELSE 99 END"


BARRIER = (
    *_EWM,
    _LEADS,
    {"fu": _first(">=", "close_adj * (1 + local_volatility)"), "fd": _first("<=", "close_adj * (1 - local_volatility)")},
    {"target_label": "CASE WHEN p5 IS NOT NULL AND local_volatility IS NOT NULL THEN (CASE WHEN fu < fd THEN 1.0 WHEN fd < fu THEN -1.0 ELSE 0.0 END)::DOUBLE END"},
    {"hit": "CASE WHEN target_label = 1 THEN fu WHEN target_label = -1 THEN fd WHEN target_label = 0 THEN 5 END"},
    {"target_barrier_return": "[p1, p2, p3, p4, p5][hit] / close_adj - 1", "barrier_touch_time": "[t1, t2, t3, t4, t5][hit]"},
)


@query(sql_shown(PANEL, "panel", 8, ["local_volatility"], *_EWM))
def label_ewm_vol(spark, sf_dir):
    return shown(label.local_volatility(panel(spark, sf_dir)), 8, "local_volatility")


@query(sql_shown(PANEL, "panel", 6, ["target_label", "target_barrier_return"], *BARRIER, keys="symbol, ts, barrier_touch_time"))
def label_triple_barrier(spark, sf_dir):
    return labeled(spark, sf_dir).select("symbol", "ts", "barrier_touch_time", *rounded(6, "target_label", "target_barrier_return"))


def _chained(source: str, *steps: dict[str, str]) -> str:
    from barloom.plans.sql import chain

    parts, name = chain(PANEL, source, *steps)
    return f"WITH {parts}, labeled AS (SELECT * FROM {name})"


LABELED = _chained("panel", *BARRIER)


@query(f"{LABELED} SELECT symbol, target_label::INT AS label, count(*) AS support FROM labeled WHERE target_label IS NOT NULL GROUP BY 1, 2")
def label_distribution(spark, sf_dir):
    return label.distribution(labeled(spark, sf_dir))


@query(f"{LABELED} SELECT symbol, ts, round(target_label, 6) AS target_label FROM labeled WHERE target_label IS NOT NULL AND log_return IS NOT NULL")
def prep_target_rows(spark, sf_dir):
    return shown(prep.target_rows(labeled(spark, sf_dir), ["log_return"]), 6, "target_label")




_FILED = ["close_adj", "local_volatility", "target_label", "target_barrier_return"]


@query(f"{LABELED} SELECT symbol, ts, barrier_touch_time, {', '.join(f'round({c}, 6) AS {c}' for c in _FILED)} FROM labeled")
def src_labelled_csv(spark, sf_dir):
    """The labelled table written as csv and read again."""
    path = src.shared_path(spark, "labelled")
    src.write_bars(labeled(spark, sf_dir).select("symbol", "ts", *_FILED, "barrier_touch_time"), path, "csv")
    return src.read_labelled(spark, path).select("symbol", "ts", "barrier_touch_time", *rounded(6, *_FILED))
