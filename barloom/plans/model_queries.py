"""Registered queries of folds, weights, models, evaluation and back-tests, with their SQL.

Where no trained model is the subject, probabilities follow a fixed formula of mkt_rs_cum_20, so that SQL can check the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.functions.windows import rounded
from barloom.operators import backtest, boosting, evaluation, models, search, validation, walkforward
from barloom.operators import features as X
from barloom.plans.data_queries import BARRIER
from barloom.plans.panel import labeled, shown
from barloom.plans.sql import P, PANEL, PAST, chain, lag, total
from barloom.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
MODEL_FEATURES = ["mkt_relative_return", "mkt_rs_cum_20", "mkt_vol_ratio_20", "cmf_20", "obv_zscore_20", "vol_directional_bias", "net_pressure_ratio", "kurtosis_20"]


def query(sql: str | None = None):
    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            SQL[job.__name__] = sql
        return job

    return add


def scored(spark, sf_dir):
    """Labeled rows with probabilities by formula: delta = x / (1 + |x|), x = 5 mkt_rs_cum_20."""
    df = X.market_context(labeled(spark, sf_dir))
    x = 5.0 * F.coalesce(F.col("mkt_rs_cum_20"), F.lit(0.0))
    df = df.withColumn("prob_delta", F.round(x / (1.0 + F.abs(x)), 8))
    d = F.col("prob_delta")
    return df.withColumns({"prob_long": (1.0 + d) / 3.0, "prob_short": (1.0 - d) / 3.0, "prob_neutral": F.lit(1.0) - (1.0 + d) / 3.0 - (1.0 - d) / 3.0})


def oos(spark, sf_dir):
    """Test rows of five folds with their decisions: the out-of-sample frame."""
    df = validation.folds(scored(spark, sf_dir).where("target_label is not null")).where("part = 'test'")
    out = models.decide(df, models.thresholds(df, ("symbol", "fold")), ("symbol", "fold"))
    return out.withColumn("true_target", F.col("target_label"))


_PARTS, _NAME = chain(
    PANEL,
    "panel",
    *BARRIER,
    {"x5": f"5 * coalesce({total('r', 20)} - {total('mkt_return', 20)}, 0)"},
    {"prob_delta": "round(x5 / (1 + abs(x5)), 8)"},
    {"prob_long": "(1 + prob_delta)/3", "prob_short": "(1 - prob_delta)/3", "prob_neutral": "1 - (1 + prob_delta)/3 - (1 - prob_delta)/3"},
)
SCORED = f"WITH {_PARTS}, scored AS (SELECT * FROM {_NAME} WHERE target_label IS NOT NULL)"
FOLDED = f"""{SCORED},
numbered AS (SELECT * EXCLUDE (i, n), row_number() OVER ({P}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM scored),
placed AS (SELECT *, n // 6 AS t, n - 5*(n//6) + fold*(n//6) AS start FROM numbered, range(5) f(fold)),
folds AS (SELECT *, fold::INT AS k, i >= greatest(0, start-750) AND i < start-5 AS train, i >= start AND i < start+t AS test FROM placed)"""
OOS = f"""{FOLDED},
cuts AS (SELECT symbol, k,
  greatest(0.04, CASE WHEN count(*) FILTER (WHERE prob_delta > 0) > 10 THEN median(prob_delta) FILTER (WHERE prob_delta > 0) ELSE 0.04 END)::DOUBLE AS up_cut,
  least(-0.04, CASE WHEN count(*) FILTER (WHERE prob_delta < 0) > 10 THEN median(prob_delta) FILTER (WHERE prob_delta < 0) ELSE -0.04 END)::DOUBLE AS down_cut
  FROM folds WHERE test GROUP BY symbol, k),
oos AS (SELECT folds.*, up_cut, down_cut, CASE WHEN prob_delta > up_cut THEN 1.0 WHEN prob_delta < down_cut THEN -1.0 ELSE 0.0 END::DOUBLE AS signal
  FROM folds JOIN cuts USING (symbol, k) WHERE test)"""


@query(f"{FOLDED} SELECT symbol, k AS fold, 'train' AS part, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM folds WHERE train GROUP BY 1, 2 UNION ALL SELECT symbol, k, 'test', count(*), min(ts), max(ts) FROM folds WHERE test GROUP BY 1, 2")
def cv_purged_folds(spark, sf_dir):
    parts = validation.folds(scored(spark, sf_dir).where("target_label is not null"))
    return parts.groupBy("symbol", "fold", "part").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"{FOLDED} SELECT symbol, k AS fold, count(*) FILTER (WHERE train AND i >= start - 65) AS buffer_rows, count(*) FILTER (WHERE test) AS test_rows, min(ts) FILTER (WHERE test) AS first_test FROM folds GROUP BY 1, 2")
def cv_test_buffer(spark, sf_dir):
    parts = validation.folds(scored(spark, sf_dir).where("target_label is not null"), buffer=validation.BUFFER)
    part = F.col("part")
    return parts.groupBy("symbol", "fold").agg(
        F.count(F.when(part == "buffer", 1)).alias("buffer_rows"), F.count(F.when(part == "test", 1)).alias("test_rows"), F.min(F.when(part == "test", F.col("ts"))).alias("first_test")
    )


@query(
    f"""{FOLDED}, c AS (SELECT symbol, k, target_label, count(*) AS m FROM folds WHERE train GROUP BY 1, 2, 3)
SELECT symbol, k AS fold, target_label::INT AS label, round(sum(m) OVER w / (count(*) OVER w * m), 6) AS weight FROM c WINDOW w AS (PARTITION BY symbol, k)"""
)
def cv_class_weights(spark, sf_dir):
    parts = validation.folds(scored(spark, sf_dir).where("target_label is not null")).where("part = 'train'")
    weighted = validation.class_weights(parts)
    return weighted.select("symbol", "fold", F.col("target_label").cast("int").alias("label"), F.round("weight", 6).alias("weight")).distinct()


@query(
    f"""{FOLDED}, c AS (SELECT *, count(*) OVER (PARTITION BY symbol, k) / (3.0::DOUBLE * count(*) OVER (PARTITION BY symbol, k, target_label)) AS w0 FROM folds WHERE test),
p AS (SELECT symbol, k, w0 * 3 / cls AS w, CASE WHEN target_label = 1 THEN prob_long WHEN target_label = -1 THEN prob_short ELSE prob_neutral END AS pt FROM c
  JOIN (SELECT symbol, k, count(DISTINCT target_label) AS cls FROM folds WHERE test GROUP BY 1, 2) USING (symbol, k))
SELECT symbol, k AS fold, round(sum(-ln(pt) * w) / sum(w), 6) AS loss FROM p GROUP BY 1, 2"""
)
def model_weighted_logloss(spark, sf_dir):
    test = validation.folds(scored(spark, sf_dir).where("target_label is not null")).where("part = 'test'")
    weighted = validation.class_weights(test)
    return weighted.groupBy("symbol", "fold").agg(F.round(models.weighted_log_loss(models.true_probability(), F.col("weight")), 6).alias("loss"))


@query(
    f"""{FOLDED}, f AS (SELECT symbol, ts, prob_long, prob_short, prob_neutral FROM folds WHERE test OR (train AND i >= start - 65))
SELECT symbol, ts, round(avg(prob_short), 9) AS prob_short, round(avg(prob_neutral), 9) AS prob_neutral, round(avg(prob_long), 9) AS prob_long, count(*) AS times FROM f GROUP BY 1, 2"""
)
def model_oof_average(spark, sf_dir):
    parts = validation.folds(scored(spark, sf_dir).where("target_label is not null"), buffer=validation.BUFFER)
    keep = ["symbol", "ts", "prob_short", "prob_neutral", "prob_long"]
    frames = [parts.where(F.col("part") == p).select(*keep) for p in ("test", "buffer")]
    out = models.oof_average(frames)
    return out.select("symbol", "ts", *rounded(9, "prob_short", "prob_neutral", "prob_long"), "times")


@query(f"{OOS} SELECT symbol, k AS fold, round(up_cut, 6) AS up_cut, round(down_cut, 6) AS down_cut FROM cuts")
def model_thresholds(spark, sf_dir):
    test = validation.folds(scored(spark, sf_dir).where("target_label is not null")).where("part = 'test'")
    return models.thresholds(test, ("symbol", "fold")).select("symbol", "fold", *rounded(6, "up_cut", "down_cut"))


@query(f"{OOS} SELECT symbol, ts, k AS fold, signal AS model_raw_target, target_label AS true_target FROM oos")
def model_decide(spark, sf_dir):
    return oos(spark, sf_dir).select("symbol", "ts", "fold", "model_raw_target", "true_target")


@query(f"{OOS} SELECT k AS fold, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM oos GROUP BY 1")
def model_oos_union(spark, sf_dir):
    rows = oos(spark, sf_dir)
    both = models.union([rows.where(F.col("fold") == f) for f in range(validation.FOLDS)])
    return both.groupBy("fold").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    f"""{OOS}, grid AS (SELECT l.range AS li, s.range AS si, 0.38::DOUBLE + (0.60::DOUBLE - 0.38::DOUBLE) * l.range / 11 AS tl, 0.38::DOUBLE + (0.60::DOUBLE - 0.38::DOUBLE) * s.range / 11 AS tsh FROM range(12) l, range(12) s),
sc AS (SELECT li, si, tl, tsh, count(*) AS n, count(*) FILTER (WHERE prob_short > tsh OR prob_long > tl) AS trades,
  count(*) FILTER (WHERE (prob_short > tsh AND target_label = -1) OR (prob_short <= tsh AND prob_long > tl AND target_label = 1)) AS hits FROM oos, grid GROUP BY ALL),
b AS (SELECT *, hits/trades * least(1.0, trades/n/0.10) AS score FROM sc WHERE trades >= 20 ORDER BY score DESC, li, si LIMIT 1)
SELECT round(tl, 6) AS th_long, round(tsh, 6) AS th_short, round(score, 6) AS score FROM b"""
)
def model_threshold_grid(spark, sf_dir):
    return models.threshold_grid(oos(spark, sf_dir)).select(*rounded(6, "th_long", "th_short", "score"))


def model_panel(spark, sf_dir):
    df = labeled(spark, sf_dir)
    for family in (X.market_context, X.volume_price, X.signed_volatility, X.candle_pressure, X.moments):
        df = family(df)
    return df.select("symbol", "ts", "target_label", *MODEL_FEATURES)


@query()
def model_train(spark, sf_dir):
    out, _ = models.train_folds(model_panel(spark, sf_dir), MODEL_FEATURES)
    return out.select("symbol", "ts", "fold", *rounded(6, "prob_short", "prob_neutral", "prob_long"), "target_label")


@query()
def model_boosted(spark, sf_dir):
    """The same folds with boosted trees, one class against the rest."""
    out, _ = models.train_folds(model_panel(spark, sf_dir), MODEL_FEATURES, learner="boosted")
    return out.select("symbol", "ts", "fold", *rounded(6, "prob_short", "prob_neutral", "prob_long"), "target_label")


def wide_panel(spark, sf_dir):
    """The labelled panel with every assembled family (the mixtures aside) and the columns' names."""
    wide, names = X.assemble(labeled(spark, sf_dir), without=(X.gmm_regimes,))
    return wide.select("symbol", "ts", "target_label", *names), names


@query()
def model_softmax(spark, sf_dir):
    """Boosted trees of all classes at once (softmax) on all assembled features, every outer fold's model in the same jobs."""
    out, _ = boosting.train_folds(*wide_panel(spark, sf_dir))
    return out.select("symbol", "ts", "fold", *rounded(6, *boosting.NAMES), "target_label")


@query()
def eval_softmax_importance(spark, sf_dir):
    """Share of gain of every feature by the folds' boosted models: mean, deviation, folds."""
    _, gains = boosting.train_folds(*wide_panel(spark, sf_dir))
    return evaluation.importance(gains).select("feature", *rounded(6, "mean_importance", "std_importance"), "fold_count")


@query()
def model_search(spark, sf_dir):
    """Twelve trials of a forest's parameters, each drawn from what the earlier ones showed; any time that takes, so that rows repeat."""
    out = search.tune_forest(model_panel(spark, sf_dir), MODEL_FEATURES, seconds=float("inf"))
    return out.select("trial", "trees", "depth", *rounded(6, "share"), "leaf", *rounded(3, "loss"))


@query()
def model_tune(spark, sf_dir):
    return models.tune(model_panel(spark, sf_dir), MODEL_FEATURES)


@query(f"{OOS} SELECT t.v AS true, count(*) FILTER (WHERE target_label = t.v AND signal = -1) AS pred_short, count(*) FILTER (WHERE target_label = t.v AND signal = 0) AS pred_neutral, count(*) FILTER (WHERE target_label = t.v AND signal = 1) AS pred_long FROM oos, (VALUES (-1), (0), (1)) t(v) GROUP BY t.v")
def eval_confusion(spark, sf_dir):
    return evaluation.confusion(oos(spark, sf_dir))


@query(
    f"""{OOS}, c AS (SELECT t.v, count(*) FILTER (WHERE target_label = v AND signal = v) AS h, count(*) FILTER (WHERE target_label = v) AS y, count(*) FILTER (WHERE signal = v) AS p, count(*) AS n FROM oos, (VALUES (-1), (0), (1)) t(v) GROUP BY t.v),
m AS (SELECT *, coalesce(h/nullif(p, 0), 0) AS pr, coalesce(h/nullif(y, 0), 0) AS re, coalesce(2*h/nullif(y+p, 0), 0) AS f FROM c),
o AS (SELECT v::VARCHAR AS class, pr AS precision, re AS recall, f AS f1, y AS support FROM m
UNION ALL SELECT 'accuracy', sum(h)/any_value(n), sum(h)/any_value(n), sum(h)/any_value(n), any_value(n) FROM m
UNION ALL SELECT 'macro', avg(pr), avg(re), avg(f), any_value(n) FROM m
UNION ALL SELECT 'weighted', sum(pr*y)/any_value(n), sum(re*y)/any_value(n), sum(f*y)/any_value(n), any_value(n) FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM o"""
)
def eval_report(spark, sf_dir):
    return evaluation.report(oos(spark, sf_dir)).select("class", *rounded(6, "precision", "recall", "f1"), "support")


@query(f"{OOS} SELECT k AS fold, round(100.0::DOUBLE * avg((signal = -1)::INT), 6) AS pct_short, round(100.0::DOUBLE * avg((signal = 0)::INT), 6) AS pct_neutral, round(100.0::DOUBLE * avg((signal = 1)::INT), 6) AS pct_long FROM oos GROUP BY 1")
def eval_signal_distribution(spark, sf_dir):
    return evaluation.signal_distribution(oos(spark, sf_dir)).select("fold", *rounded(6, "pct_short", "pct_neutral", "pct_long"))


_GAIN_FEATURES = ["mkt_relative_return", "mkt_rs_cum_20", "prob_delta", "local_volatility"]


def gains(spark, sf_dir):
    """A stand-in for importances that SQL can compute: the absolute correlation of each feature with the label in train."""
    df = validation.folds(scored(spark, sf_dir).where("target_label is not null")).where("part = 'train'")
    wide = df.groupBy("fold").agg(*[F.abs(F.corr(f, "target_label")).alias(f) for f in _GAIN_FEATURES])
    return wide.unpivot("fold", _GAIN_FEATURES, "feature", "gain")


_GAINS = f"""{FOLDED}, named AS (SELECT *, r - mkt_return AS mkt_relative_return, {total('r', 20)} - {total('mkt_return', 20)} AS cum FROM scored),
feats AS (SELECT folds.k, folds.train, folds.target_label, folds.prob_delta, folds.local_volatility, mkt_relative_return, folds.x5raw AS mkt_rs_cum_20 FROM
  (SELECT *, r - mkt_return AS mkt_relative_return, cum20 AS x5raw FROM folds) folds),
wide AS (SELECT k AS fold, abs(corr(mkt_relative_return, target_label)) AS mkt_relative_return, abs(corr(mkt_rs_cum_20, target_label)) AS mkt_rs_cum_20,
  abs(corr(prob_delta, target_label)) AS prob_delta, abs(corr(local_volatility, target_label)) AS local_volatility FROM feats WHERE train GROUP BY k),
gains AS (UNPIVOT wide ON mkt_relative_return, mkt_rs_cum_20, prob_delta, local_volatility INTO NAME feature VALUE gain)"""
_GAINS = _GAINS.replace(f"named AS (SELECT *, r - mkt_return AS mkt_relative_return, {total('r', 20)} - {total('mkt_return', 20)} AS cum FROM scored),\n", "")
_GAINS = _GAINS.replace(SCORED, SCORED.replace(f"5 * coalesce({total('r', 20)} - {total('mkt_return', 20)}, 0) AS x5", f"5 * coalesce({total('r', 20)} - {total('mkt_return', 20)}, 0) AS x5, {total('r', 20)} - {total('mkt_return', 20)} AS cum20"))


@query(f"{_GAINS}, picked AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY gain DESC, feature) AS k FROM gains) SELECT feature, count(DISTINCT fold) AS folds FROM picked WHERE k <= 2 GROUP BY 1")
def eval_consensus(spark, sf_dir):
    from pyspark.sql import Window

    ranked = gains(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("gain"), "feature")))
    return evaluation.consensus(ranked.where("k <= 2"))


@query(
    f"""{_GAINS}, s AS (SELECT *, gain / sum(gain) OVER (PARTITION BY fold) AS share FROM gains)
SELECT feature, round(avg(share), 6) AS mean_importance, round(coalesce(stddev_samp(share), 0), 6) AS std_importance, count(DISTINCT fold) AS fold_count FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""
)
def eval_importance(spark, sf_dir):
    return evaluation.importance(gains(spark, sf_dir)).select("feature", *rounded(6, "mean_importance", "std_importance"), "fold_count")


@query(f"{_GAINS}, s AS (SELECT *, gain / sum(gain) OVER (PARTITION BY fold) AS share FROM gains) SELECT feature, round(avg(share), 6) AS mean_importance, count(DISTINCT fold) AS fold_count FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def src_importance(spark, sf_dir):
    """The importance summary written as csv, the three best read again."""
    path = src.shared_path(spark, "importance")
    evaluation.importance(gains(spark, sf_dir)).select("feature", "mean_importance", "std_importance", "fold_count").write.option("header", True).csv(path)
    return src.read_importance(spark, path, 3).select("feature", *rounded(6, "mean_importance"), "fold_count")


_TV = 0.15 / math.sqrt(252)
LEDGER = f"""{OOS},
l0 AS (SELECT symbol, ts, signal, close_adj, close, local_volatility FROM oos WHERE local_volatility IS NOT NULL),
l1 AS (SELECT *, coalesce(close_adj / {lag('close_adj')} - 1, 0) AS daily_asset_return, coalesce({lag('signal')}, 0) AS active_position, nullif({lag('local_volatility')}, 0) AS sg FROM l0),
l2 AS (SELECT *, coalesce(sg, first_value(sg IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sg2 FROM l1),
l3 AS (SELECT *, CASE WHEN sg2 IS NOT NULL THEN greatest(0, least(1, {_TV!r} / sg2)) * active_position END AS weight FROM l2),
l4 AS (SELECT *, coalesce(abs(weight - {lag('weight')}), 0) AS turnover FROM l3),
l5 AS (SELECT *, turnover * 0.002 AS costs, weight * daily_asset_return - turnover * 0.002 AS net_return FROM l4),
l6 AS (SELECT *, 100000.0::DOUBLE * product(1 + net_return) OVER ({P} {PAST}) AS equity FROM l5),
ledger AS (SELECT *, (equity - max(equity) OVER ({P} {PAST})) / max(equity) OVER ({P} {PAST}) AS drawdown FROM l6)"""
LEDGER_NAMES = ["daily_asset_return", "active_position", "weight", "turnover", "costs", "net_return", "equity", "drawdown"]


@query(f"{LEDGER} SELECT symbol, ts, " + ", ".join(f"round({c}::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in LEDGER_NAMES) + " FROM ledger")
def bt_ledger(spark, sf_dir):
    rows = oos(spark, sf_dir)
    return shown(backtest.ledger(rows, rows), 6, *LEDGER_NAMES)


@query(
    f"""{LEDGER}, a AS (SELECT symbol, count(*) AS rows, last(equity ORDER BY ts) / 100000.0::DOUBLE - 1 AS total, avg(net_return) AS m, stddev_samp(net_return) AS s, min(drawdown) AS max_drawdown FROM ledger GROUP BY symbol)
SELECT symbol, rows, round(total, 6) AS total, round(pow(1 + total, 252.0::DOUBLE/rows) - 1, 6) AS annualized, round(m/(s+1e-9)*sqrt(252.0::DOUBLE), 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM a"""
)
def bt_summary(spark, sf_dir):
    rows = oos(spark, sf_dir)
    return backtest.summary(backtest.ledger(rows, rows)).select("symbol", "rows", *rounded(6, "total", "annualized", "sharpe", "max_drawdown"))


BENCH_NAMES = ["asset_return", "position", "costs", "strat_net_return", "equity_strategy", "equity_benchmark", "drawdown"]


@query(
    f"""{OOS},
b1 AS (SELECT symbol, ts, coalesce(close / {lag('close')} - 1, 0) AS asset_return, coalesce({lag('signal')}, 0) AS position FROM oos),
b2 AS (SELECT *, coalesce(abs(position - {lag('position')}), 0) * 0.002 AS costs FROM b1),
b3 AS (SELECT *, position * asset_return - costs AS strat_net_return FROM b2),
b4 AS (SELECT *, product(1 + strat_net_return) OVER ({P} {PAST}) AS equity_strategy, product(1 + asset_return) OVER ({P} {PAST}) AS equity_benchmark FROM b3),
b5 AS (SELECT *, (equity_strategy - max(equity_strategy) OVER ({P} {PAST})) / max(equity_strategy) OVER ({P} {PAST}) AS drawdown FROM b4)
SELECT symbol, ts, """
    + ", ".join(f"round({c}::DOUBLE, 9) + 0.0::DOUBLE AS {c}" for c in BENCH_NAMES)
    + " FROM b5"
)
def bt_equity_vs_benchmark(spark, sf_dir):
    rows = oos(spark, sf_dir)
    return shown(backtest.against_benchmark(rows, rows), 9, *BENCH_NAMES)


@query(f"{OOS} SELECT symbol, k AS fold, min(ts) AS first_ts FROM oos GROUP BY 1, 2")
def bt_fold_starts(spark, sf_dir):
    return backtest.fold_starts(oos(spark, sf_dir))


@query()
def bt_walk_forward(spark, sf_dir):
    """From the labelled panel to the ledger: diagnostics, routing, selection over all features, fit and cutoffs in every outer fold."""
    rows, _, _ = walkforward.run(labeled(spark, sf_dir))
    return shown(backtest.ledger(rows, rows), 6, *LEDGER_NAMES)


@query()
def sel_fold_transforms(spark, sf_dir):
    """What every series selects from all assembled features (unrouted, at their usual lags) in each outer fold's training rows."""
    rows = walkforward.fold_series(labeled(spark, sf_dir))
    wide, names = X.assemble(rows, without=(X.gmm_regimes,))
    picked = walkforward.select_transforms(wide.where("part = 'train'"), names)
    return picked.select(F.split("symbol", "#")[0].alias("symbol"), "fold", "feature", "lag", "kind", *rounded(6, "mi"), "place")
