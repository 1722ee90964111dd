"""The tick stream against the batch job: order of arrival, repeated batches, late ticks, odd rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from barloom.operators import prep
from barloom.plans.data_queries import MICRO_NAMES
from barloom.streaming import ticks as stream

T0 = dt.datetime(2024, 3, 1)


def _rows(n=400, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        ts = T0 + dt.timedelta(minutes=r.randrange(5 * 1440) // 7 * 7)  # many ticks share a time
        c = float(r.randrange(5))
        out.append(("a" if r.random() < 0.7 else "b", ts, i, c, c + 1, c - 1, float(r.randrange(9)) if r.random() > 0.1 else None))
    return out


def _deliver(spark, path, rows):
    spark.createDataFrame(rows, stream.TICK).coalesce(2).write.mode("append").parquet(f"{path}/in")
    return stream.run_ticks(spark.readStream.schema(stream.TICK).parquet(f"{path}/in"), path)


def _mark(spark, path, days):
    return _deliver(spark, path, [(None, T0 + dt.timedelta(days=days), None, None, None, None, None)])


def _table(df):
    return {(r["symbol"], r["ts"]): [None if r[c] is None else round(float(r[c]), 9) for c in MICRO_NAMES] for r in df.collect()}


def test_equals_batch_in_any_order(spark, tmp_path):
    rows = _rows()
    path = f"file://{tmp_path}/s"
    order = sorted(rows, key=lambda t: t[1] + dt.timedelta(minutes=random.Random(t[2]).randrange(700)))
    for i in range(0, len(order), 130):
        _deliver(spark, path, order[i : i + 130])
    part = stream.read_days(spark, path)
    want = _table(prep.daily_microstructure(spark.createDataFrame(rows, stream.TICK)))
    mark = _mark(spark, path, 30)
    assert part.count() > 0 and mark.startswith("2024-03-30")
    assert _table(stream.read_days(spark, path)) == want


def test_days_before_the_watermark_are_final(spark, tmp_path):
    rows = sorted(_rows(), key=lambda t: t[1])
    path = f"file://{tmp_path}/s"
    mark = _deliver(spark, path, rows[:300])
    want = _table(prep.daily_microstructure(spark.createDataFrame(rows, stream.TICK)))
    got = {k: v for k, v in _table(stream.read_days(spark, path)).items() if str(k[1]) < mark[:10]}
    assert got and got == {k: v for k, v in want.items() if str(k[1]) < mark[:10]}


def test_late_ticks_empty_stream_and_null_times(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    tick = lambda day, c, v=1.0: ("a", T0 + dt.timedelta(days=day), 0, c, c, c, v)
    _mark(spark, path, 0)  # nothing but a mark
    assert stream.read_days(spark, path).count() == 0
    _deliver(spark, path, [tick(0, 2.0), tick(3, 1.0), ("a", None, 1, 9.0, 9.0, 9.0, 1.0)])
    _deliver(spark, path, [tick(0, 5.0)])  # behind the watermark
    _mark(spark, path, 30)
    got = {r["ts"].day: (r["intraday_ofi_sum"], r["intraday_tick_count"], r["intraday_ofi_std"]) for r in stream.read_days(spark, path).collect()}
    assert got == {1: (1.0, 1, 0.0), 4: (-1.0, 1, 0.0)}


def test_a_repeated_batch_writes_the_same(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    _deliver(spark, path, _rows())
    _mark(spark, path, 30)
    before = _table(stream.read_days(spark, path))
    last = max(int(p.name) for p in (tmp_path / "s" / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "s" / "checkpoint" / "commits" / str(last)).unlink()
    (tmp_path / "s" / "checkpoint" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    stream.run_ticks(spark.readStream.schema(stream.TICK).parquet(f"{path}/in"), path)
    assert _table(stream.read_days(spark, path)) == before


def test_no_python_worker_and_one_shuffle(spark, tmp_path):
    rows = spark.createDataFrame(_rows(20), stream.TICK)
    plan = stream.tick_slices(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
    assert stream.tick_slices(rows).agg(F.sum("n")).first()[0] == 20
