"""Registered screens of all assembled features at once (the mixtures aside), by ranges of values instead of groups of whole series."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import rounded
from barloom.operators import features as X
from barloom.operators import ranks as K
from barloom.plans import feature_queries
from barloom.plans.data_queries import LABELED
from barloom.plans.panel import labeled
from barloom.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
NAMES = [c for f, _ in X.ROUTES if f not in (X.gmm_regimes, X.book_dynamics) for c in feature_queries.FAMILIES[f"feat_{f.__name__}"][1]]


def query(sql: str | None = None):
    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            SQL[job.__name__] = sql
        return job

    return add


def wide(spark, sf_dir):
    """symbol, ts, target_label and the features as SQL gives them, and their names."""
    df, names = X.assemble(labeled(spark, sf_dir), without=(X.gmm_regimes,))
    digits = {n: 3 - 3 * (n in feature_queries._LARGE) for n in names}
    return src.written(df.select("symbol", "ts", "target_label", *[c for n in names for c in rounded(digits[n], n)]), "wide"), names


_LONG = f"""{LABELED}, assembled AS ({feature_queries.SQL['feat_assembled']}),
j AS (SELECT assembled.*, target_label FROM assembled JOIN labeled USING (symbol, ts) WHERE target_label IS NOT NULL AND {" AND ".join(f"{n} IS NOT NULL" for n in NAMES)}),
l AS (UNPIVOT j ON {", ".join(NAMES)} INTO NAME feature VALUE value)"""


@query(
    f"""{_LONG}, k AS (SELECT symbol, feature, rank() OVER (PARTITION BY symbol, feature ORDER BY value) + (count(*) OVER (PARTITION BY symbol, feature, value) - 1)/2.0 AS a,
  rank() OVER (PARTITION BY symbol, feature ORDER BY target_label) + (count(*) OVER (PARTITION BY symbol, feature, target_label) - 1)/2.0 AS b FROM l),
r AS (SELECT symbol, feature, round(abs(corr(a, b)), 6) AS rho FROM k GROUP BY 1, 2) SELECT symbol, feature, CASE WHEN isnan(rho) THEN NULL ELSE rho END AS rho FROM r"""
)
def sel_rank_correlation_wide(spark, sf_dir):
    """What sel_fallback_wide ranks: the rank correlation of every feature with the label, for each symbol."""
    df, names = wide(spark, sf_dir)
    return K.rank_fallback(df, names, len(names)).select("symbol", "feature", *rounded(6, "rho"))


@query(
    f"""{_LONG}, k AS (SELECT feature, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1)/2.0 AS a FROM l)
SELECT feature, count(*) AS n, sum((a*2)::BIGINT % 1000003)::BIGINT AS digest, max(a)::DOUBLE AS highest, round(sum(a * value) / sum(a), 2)::DOUBLE AS weighted FROM k GROUP BY 1"""
)
def sel_pooled_ranks_wide(spark, sf_dir):
    """Average ranks of every feature over the pooled symbols, summed up."""
    df, names = wide(spark, sf_dir)
    ranks = K.average_ranks(K.exploded(df.where("target_label is not null"), names, "symbol", "ts"), ["_f"], ["symbol", "ts"])
    weighted = F.sum(F.col("rank") * F.col("value")) / F.sum("rank")
    out = ranks.groupBy("_f").agg(F.count("*").alias("n"), F.sum((F.col("rank") * 2).cast("long") % 1000003).alias("digest"), F.max("rank").alias("highest"), weighted.alias("weighted"))
    return K.named(out, names).select("feature", "n", "digest", "highest", *rounded(2, "weighted"))


@query()
def sel_hrp_medoids_wide(spark, sf_dir):
    """The medoids of the rank clusters of all features."""
    df, names = wide(spark, sf_dir)
    kept = K.rank_medoids(df, names)
    return spark.createDataFrame([(n, n in kept) for n in names], "feature string, kept boolean")


@query()
def sel_lagged_mi_wide(spark, sf_dir):
    df, names = wide(spark, sf_dir)
    return K.lagged_information(df, names).select("symbol", "feature", *rounded(6, "mi"), "lag", "accepted")


@query()
def sel_mi_rank_wide(spark, sf_dir):
    """Information of the lag transforms of all features over the pooled symbols."""
    df, names = wide(spark, sf_dir)
    return K.transforms_rank(df, names).select("feature", *rounded(6, "mi"), "place")
