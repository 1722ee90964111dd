"""Ranks and neighbour information by ranges of values against versions that hold each group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.operators import features, ranks, selection

FEATURES = ["smooth", "tied", "hot", "flat", "with.dot"]


@pytest.fixture(scope="module")
def many_parts(spark):
    """Every shuffle keeps its partitions, so that groups spread over several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(4)
    out = []
    for s, n in (("A", 300), ("B", 90), ("C", 2), ("D", 1)):
        x = rng.normal(size=n)
        y = np.where(np.arange(n) == 5, 9.0, np.sign(np.round(x + rng.normal(size=n))))  # a class of one row
        hot = np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n))
        hot[:2] = [-0.0, 0.0][:n]
        dot = np.where(np.arange(n) % 37 == 3, np.nan, rng.normal(size=n))
        out.append(pd.DataFrame({"symbol": s, "d": np.arange(n), "target_label": y, "smooth": x, "tied": np.round(rng.normal(size=n)), "hot": hot, "flat": 7.0, "with.dot": dot}))
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def df(many_parts, pdf):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    made = many_parts.createDataFrame(rows, "symbol string, d int, target_label double, smooth double, tied double, hot double, flat double, `with.dot` double")
    return made.withColumn("ts", F.date_add(F.lit("2001-01-01").cast("date"), F.col("d"))).cache()


def test_average_ranks(df, pdf):
    long = ranks.exploded(df, FEATURES, "symbol", "ts", "d")
    known = pdf.dropna().reset_index(drop=True)
    for by, group in ((["_f"], None), (["symbol", "_f"], "symbol")):
        got = {(r.symbol, r.d, r._f): r["rank"] for r in ranks.average_ranks(long, by, ["symbol", "ts"]).collect()}
        assert len(got) == len(known) * len(FEATURES)
        for i, f in enumerate(FEATURES):
            want = (known.groupby(group)[f] if group else known[f]).rank()
            assert [got[s, d, i] for s, d in zip(known.symbol, known.d)] == want.tolist()


def test_a_value_of_most_rows_spreads(df):
    ones = df.sparkSession.range(40_000).select(F.lit("f").alias("g"), F.lit(1.0).alias("value"), "id")
    assert ranks.placed(ones, ["g"], ["value", "id"]).groupBy("_part").count().count() == 7
    assert {r[0] for r in ranks.average_ranks(ones, ["g"], ["id"]).select("rank").distinct().collect()} == {20_000.5}


def test_medoids_and_fallback(df, pdf):
    known = pdf.dropna()
    for most in (2, 3):
        want = stats.medoids(stats.correlation(stats.ranks(known[FEATURES].to_numpy())), most)
        assert ranks.rank_medoids(df, FEATURES, most) == [FEATURES[i] for i in want]
    whole = FEATURES[:4]
    a, b = ({(r.symbol, r.feature): (r.rho, r.place) for r in job(df, whole, 4).collect()} for job in (ranks.rank_fallback, selection.rank_fallback))
    assert set(a) == set(b)
    assert all(a[k][0] == pytest.approx(b[k][0], abs=1e-9) if b[k][0] is not None else a[k][0] is None for k in b)
    assert all(a[k][1] == b[k][1] for k in b)


def test_digamma(many_parts):
    rows = many_parts.range(1, 3000).select("id", ranks.digamma(F.col("id")).alias("v")).collect()
    harmonic = np.concatenate(([0.0], np.cumsum(1 / np.arange(1, 3000)))) - 0.5772156649015329
    assert max(abs(r.v - harmonic[r.id - 1]) for r in rows) < 1e-12


def test_nearest_information(df, pdf):
    long = ranks.exploded(df, FEATURES, "symbol", "ts", "target_label")
    known = pdf.dropna()
    pooled = {r._f: r.mi for r in ranks.nearest_information(long, ["_f"], ["symbol", "ts"]).collect()}
    for i, f in enumerate(FEATURES):
        assert pooled[i] == pytest.approx(stats.nearest_information(known[f].to_numpy(), known.target_label.to_numpy()), abs=1e-9), f
    each = {(r.symbol, r._f): r.mi for r in ranks.nearest_information(long, ["symbol", "_f"], ["ts"]).collect()}
    for s, part in known.groupby("symbol"):
        for i, f in enumerate(FEATURES):
            assert each[s, i] == pytest.approx(stats.nearest_information(part[f].to_numpy(), part.target_label.to_numpy()), abs=1e-9), (s, f)


def test_screens_equal_those_by_groups(df, pdf):
    a, b = ({(r.symbol, r.feature): r for r in job(df.where("symbol in ('A', 'B')"), ["smooth", "hot"]).collect()} for job in (ranks.lagged_information, selection.lagged_information))
    assert set(a) == set(b) and all(a[k].mi == pytest.approx(b[k].mi, abs=1e-9) and a[k].lag == b[k].lag and a[k].accepted == b[k].accepted for k in b)
    known = pdf.dropna()
    want = {f: stats.nearest_information(known[f].to_numpy(), known.target_label.to_numpy()) for f in FEATURES if f != "flat"}
    got = {r.feature: r for r in ranks.information_rank(df, FEATURES).collect()}
    assert set(got) == set(want) and all(got[f].mi == pytest.approx(want[f], abs=1e-9) for f in want)
    assert sorted(want, key=lambda f: (-want[f], f)) == sorted(got, key=lambda f: got[f].place)


def test_transforms(df):
    two = df.where("symbol in ('A', 'B')")
    wide = features.lag_transforms(two, dict.fromkeys(("smooth", "hot"), 1))
    names = [f"{f}_{t}" for f in ("smooth", "hot") for t in ("zscaled_lag1", "momentum", "acceleration")]
    part = wide.toPandas()
    got = {r.feature: r.mi for r in ranks.transforms_rank(two, ["smooth", "hot"]).collect()}
    assert set(got) == set(names)
    for n in names:
        known = part.dropna(subset=[n])
        assert got[n] == pytest.approx(stats.nearest_information(known[n].to_numpy(), known.target_label.to_numpy()), abs=1e-9), n


def test_empty(df):
    none = df.where("false")
    assert ranks.rank_medoids(none, FEATURES, 2) == [] and ranks.rank_fallback(none, FEATURES).count() == 0
    assert ranks.information_rank(none, FEATURES).count() == 0 and ranks.lagged_information(none, FEATURES).count() == 0
