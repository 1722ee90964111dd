"""Registered queries of histories of any length: the columns of other queries by pieces and carries, checked by the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import long_history as L
from barloom.plans import data_queries, feature_queries, model_queries
from barloom.plans.panel import bars, panel, shown

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(like: str):
    """Register a job whose rows are those of another query."""

    def add(job):
        QUERIES[job.__name__] = job
        SQL[job.__name__] = next(m.SQL[like] for m in (data_queries, feature_queries, model_queries) if like in m.SQL)
        return job

    return add


@query("prep_adjust")
def long_adjust(spark, sf_dir):
    return shown(L.adjust(data_queries.acted(spark, sf_dir)), 6, "close_adj", "open_adj", "high_adj", "low_adj")


@query("prep_ffill")
def long_ffill(spark, sf_dir):
    holes = bars(spark, sf_dir).select("symbol", "ts", F.when(F.dayofmonth("ts") % 4 == 0, F.col("volume")).alias("daily_vpin"))
    return shown(L.ffill_intraday(holes), 6, "daily_vpin")


@query("label_ewm_vol")
def long_ewm_vol(spark, sf_dir):
    return shown(L.local_volatility(panel(spark, sf_dir)), 8, "local_volatility")


@query("feat_volume_price")
def long_volume_price(spark, sf_dir):
    return shown(L.volume_price(panel(spark, sf_dir)), 6, "cmf_20", "cmf_slope_5", "obv_zscore_20", "obv_slope_5", "vpt_zscore_20", "cmf_price_divergence")


@query("feat_stress")
def long_stress(spark, sf_dir):
    return shown(L.stress(panel(spark, sf_dir)), 6, "asym_ratio_20", "drawdown_20", "drawdown_velocity")


@query("bt_ledger")
def long_ledger(spark, sf_dir):
    return shown(L.ledger(model_queries.oos(spark, sf_dir)), 6, *model_queries.LEDGER_NAMES)


@query("bt_equity_vs_benchmark")
def long_equity_vs_benchmark(spark, sf_dir):
    return shown(L.against_benchmark(model_queries.oos(spark, sf_dir)), 9, *model_queries.BENCH_NAMES)
