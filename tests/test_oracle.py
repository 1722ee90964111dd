"""Every registered query of the library against its SQL on DuckDB."""

import duckdb
import pytest

from barloom.plans import data_queries, diag_queries, feature_queries, long_queries, model_queries, wide_queries

JOBS = {n: (m.QUERIES[n], m.SQL.get(n)) for m in (data_queries, feature_queries, diag_queries, model_queries, long_queries, wide_queries) for n in m.QUERIES}
SLOW = {"sel_lagged_mi_wide", "sel_mi_rank_wide", "sel_hrp_medoids_wide", "model_softmax", "eval_softmax_importance", "model_search", "model_tune", "model_train", "model_boosted", "feat_routed", "bt_walk_forward", "sel_fold_transforms"}  # test_ranks, test_plain and test_walkforward run what they do


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _sorted(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in JOBS.items() if sql))
def test_matches_sql(spark, sf, duck, name):
    job, sql = JOBS[name]
    df = job(spark, sf)
    got = _sorted([tuple(r) for r in df.collect()], df.columns)
    q = duck.execute(sql)
    want = _sorted(q.fetchall(), [d[0] for d in q.description])
    assert sorted(df.columns) == sorted(d[0] for d in q.description)
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in JOBS.items() if not sql and n not in SLOW))
def test_runs_without_sql(spark, sf, name):
    assert JOBS[name][0](spark, sf).count() > 0
