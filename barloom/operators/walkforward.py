"""The nested walk-forward job: for every outer fold diagnostics, routed features, selection, transforms, fit, cutoffs, decisions.

All (symbol, fold) pairs go through diagnostics, features and selection at once: a fold's rows of a symbol are a series of their own, under
the key symbol#fold. Models are pooled over symbols, one a fold, on the transforms that most symbols selected.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.functions.windows import EPS
from barloom.operators import diagnostics, features, models, selection, validation
from barloom.sources import bars as src

#: Rows before the training rows that features may look back on.
LEAD = 150
KINDS = ("zscaled", "momentum", "acceleration")


def fold_series(df: DataFrame, k: int = validation.FOLDS) -> DataFrame:
    """Every fold's own contiguous rows (lead, train, gap, test by part) with fold and the key symbol#fold in symbol."""
    at = validation.indexed(df).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    size, start, i = F.floor(F.col("n") / (k + 1)).cast("int"), validation.fold_start(F.col("fold"), k), F.col("i")
    first = F.greatest(F.lit(0), start - validation.MAX_TRAIN)
    part = F.when(i < first, "lead").when(i < start - validation.GAP, "train").when(i < start, "gap").otherwise("test")
    rows = at.where((size > 0) & (i >= first - LEAD) & (i < start + size)).withColumn("part", part)
    return rows.withColumns({"asset": F.col("symbol"), "symbol": F.concat_ws("#", "symbol", "fold")}).drop("i", "n")


def transforms(x: pd.Series, lag: int) -> dict[str, pd.Series]:
    """A feature's lagged z-score, its relative change since the lag, and that change's change."""
    before = x.shift(lag)
    momentum = (x - before) / (before.abs() + EPS)
    return {"zscaled": (before - before.rolling(20).mean()) / (before.rolling(20).std() + EPS), "momentum": momentum, "acceleration": momentum.diff()}


def chosen(x: pd.DataFrame, y: np.ndarray) -> list[tuple[str, int, str, float, int]]:
    """(feature, lag, kind, information, place) of the 6 to 16 transforms that one series selects."""
    found = selection.screen(x, y)
    made = {(f, lag, kind): t for f, lag, _ in found for kind, t in transforms(x[f], lag).items()}
    wide = pd.DataFrame(made).dropna() if made else pd.DataFrame()
    if len(wide) < 30:
        return []
    label = y[wide.index.to_numpy()]
    scores = {c: stats.nearest_information(wide[c].to_numpy(float), label) for c in wide.columns if wide[c].std() > 1e-8}
    ranked = sorted(scores, key=lambda c: (-scores[c], c))
    marked = [c for c in ranked if any(w in c[0] for w in selection.PRIORITY) and scores[c] > selection.MI_LIMIT * 0.5]
    both = list(dict.fromkeys(marked + [c for c in ranked if scores[c] > selection.MI_LIMIT]))
    kept = ranked[: selection.LEAST] if len(both) < selection.LEAST else both[: selection.MOST]
    return [(*c, scores[c], i + 1) for i, c in enumerate(kept)]


def select_transforms(train: DataFrame, names: list[str]) -> DataFrame:
    """symbol (the key), fold, feature, lag, kind, mi, place for every series of training rows; features known on less than half of them are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        own = pdf[[*names, "target_label"]].dropna(axis=1, thresh=-(-len(pdf) // 2)).dropna().reset_index(drop=True)
        columns = [c for c in names if c in own.columns]
        rows = chosen(own[columns].astype(float), own["target_label"].to_numpy(float)) if "target_label" in own.columns and len(own) > 40 else []
        return pd.DataFrame([(pdf["symbol"].iloc[0], pdf["fold"].iloc[0], *r) for r in rows], columns=["symbol", "fold", "feature", "lag", "kind", "mi", "place"])

    return train.select("symbol", "fold", "ts", "target_label", *names).groupBy("symbol", "fold").applyInPandas(run, "symbol string, fold int, feature string, lag int, kind string, mi double, place int")


def consensus(picked: DataFrame, most: int = selection.MOST) -> DataFrame:
    """fold, feature, lag, kind: the transforms that most symbols of a fold selected, each feature with its most frequent lag."""
    best = Window.partitionBy("fold", "feature").orderBy(F.desc("n"), "lag")
    lags = picked.groupBy("fold", "feature", "lag").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(best)).where("r = 1").select("fold", "feature", "lag")
    votes = picked.groupBy("fold", "feature", "kind").agg(F.count("*").alias("symbols"), F.avg("mi").alias("mi"))
    order = Window.partitionBy("fold").orderBy(F.desc("symbols"), F.desc("mi"), "feature", "kind")
    return votes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).join(lags, ["fold", "feature"])


def run(df: DataFrame, k: int = validation.FOLDS, inner: int = 3, at_once: int = 5, **settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(out-of-sample decisions, what each series selected, what each fold's model uses) of a labelled panel.

    Nothing that a fold fits looks past its training rows: diagnostics, selection, weights, cutoffs (from out-of-fold probabilities of
    inner purged folds) and the model. Tables between the steps are written to the shared folder. at_once folds are fitted side by side, as
    each is a few hundred short jobs.
    """
    spark = df.sparkSession

    def put(table: DataFrame, name: str) -> DataFrame:
        path = src.shared_path(spark, name)
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    rows = put(fold_series(df, k), "fold-series")
    flags = diagnostics.payload(rows.where("part = 'train'").drop("fold", "part", "asset")).drop("dominant_cycle")
    wide, names = features.assemble(rows, put(flags, "payload"))
    plain = {n: n.replace(".", "_") for n in names}
    names = list(plain.values())
    wide = put(wide.withColumnsRenamed(plain).select("symbol", "asset", "ts", "fold", "part", "close", "close_adj", "local_volatility", "target_label", *names), "fold-features")
    picked = put(select_transforms(wide.where("part = 'train'"), names), "selected")
    used = put(consensus(picked), "used")

    @inheritable_thread_target(spark)
    def decided(f: int) -> DataFrame | None:
        own = used.where(F.col("fold") == f).orderBy("place").collect()
        if not own:
            return None
        lags = {r["feature"]: r["lag"] for r in own}
        inputs = [f"{r['feature']}_zscaled_lag{r['lag']}" if r["kind"] == "zscaled" else f"{r['feature']}_{r['kind']}" for r in own]
        base = features.lag_transforms(wide.where(F.col("fold") == f), lags).where("target_label is not null")
        base = base.select("symbol", "asset", "ts", "fold", "part", "close", "close_adj", "local_volatility", "target_label", *inputs).persist()
        train = validation.class_weights(base.where("part = 'train'"), by=("fold",))
        inside = validation.folds(train.drop("fold", "part"), inner, max_train=None).persist()
        scored = []
        for j in range(inner):
            one = inside.where(F.col("fold") == j)
            scored.append(models.probabilities(models.fit(one.where("part = 'train'"), inputs, **settings), one.where("part = 'test'"), inputs).select("symbol", "ts", "prob_short", "prob_neutral", "prob_long"))
        oof = models.oof_average(scored).select(F.lit(f).alias("fold"), (F.col("prob_long") - F.col("prob_short")).alias("prob_delta"))
        cuts = put(models.thresholds(oof), "cuts")
        model = models.fit(train, inputs, **settings)
        test = models.probabilities(model, base.where("part = 'test'"), inputs).withColumn("prob_delta", F.col("prob_long") - F.col("prob_short"))
        rows = models.decide(test, cuts).select(
            F.col("asset").alias("symbol"), "ts", "fold", "model_raw_target", "prob_short", "prob_neutral", "prob_long", "prob_delta", F.col("target_label").alias("true_target"), "close", "close_adj", "local_volatility", "up_cut", "down_cut"
        )
        rows = put(rows, "decided")
        inside.unpersist()
        base.unpersist()
        return rows

    with ThreadPoolExecutor(at_once) as pool:
        out = [rows for rows in pool.map(decided, range(k)) if rows is not None]
    return models.union(out), picked, used
