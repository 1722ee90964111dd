"""Bucketed tables: plans without shuffles, pruned years, whole rows."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import features
from barloom.plans.panel import panel
from barloom.sources import bucketed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def saved(spark, sf):
    df = panel(spark, sf)
    return bucketed.save(df, buckets=4), df


def test_features_without_exchange(spark, saved):
    name, df = saved
    got = features.baseline(bucketed.read(spark, name))
    assert "Exchange" not in _plan(got)
    columns = ["symbol", "ts", "geo_body_ratio", "overnight_gap"]
    key = lambda r: (r.symbol, r.ts)
    want = features.baseline(df).select(*columns).collect()
    assert sorted(got.select(*columns).collect(), key=key) == sorted(want, key=key)


def test_range_reads_its_years_only(spark, saved):
    name, df = saved
    got = bucketed.read(spark, name, "1995-03-01", "1996-02-10")
    filters = next(line for line in _plan(got).splitlines() if "PartitionFilters" in line)
    assert "year" in filters.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert {f.split("year=")[1][:4] for f in spark.table(name).where("year in (1995, 1996)").inputFiles()} >= {"1995", "1996"}
    assert got.count() == df.where("ts between date'1995-03-01' and date'1996-02-10'").count() > 0


def test_join_by_symbol_and_day_without_exchange(spark, saved):
    name, df = saved
    signals = bucketed.save(df.select("symbol", "ts", (F.col("close") > F.col("open")).alias("up")), buckets=4)
    for key, value in (("spark.sql.requireAllClusterKeysForCoPartition", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    try:
        joined = bucketed.read(spark, name).join(bucketed.read(spark, signals), ["symbol", "ts"])
        assert "Exchange" not in _plan(joined)
        assert joined.count() == df.count()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_odd_rows(spark):
    rows = spark.sql("SELECT * FROM VALUES ('A', date'2001-01-01', 1.0D), ('A', date'2001-01-01', 1.0D), (NULL, date'2001-01-02', 2.0D), ('B', NULL, NULL) t(symbol, ts, close)")
    assert sorted(map(str, bucketed.read(spark, bucketed.save(rows, buckets=3)).collect())) == sorted(map(str, rows.collect()))
    assert bucketed.read(spark, bucketed.save(rows.where("false"))).count() == 0
