"""Feature screens: correlation, information in bins, priorities; and the whole chain for each symbol."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import stats

#: Words that mark direction-bearing features (fixed values).
PRIORITY = (
    "mkt_relative", "mkt_rs", "mkt_rolling_beta", "mkt_divergence", "cmf", "obv", "vpt", "net_pressure", "vol_directional", "signed_expansion", "liq_amihud", "kurtosis_20",
)
MI_LIMIT, LEAST, MOST, CLUSTERS, CORRELATION, MAX_VIF = 0.01, 6, 16, 14, 0.85, 6.0


def gramian(df: DataFrame, features: list[str]) -> tuple[np.ndarray, int]:
    """(sums of products of the centred features, rows) over rows without nulls.

    Every partition multiplies its rows into one k x k matrix; Spark adds the matrices up, element by element.
    """
    rows = df.select(*features).na.drop()
    means = rows.agg(F.count("*"), *[F.avg(f) for f in features]).first()
    n, centre = means[0], np.array([m or 0.0 for m in means[1:]])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(features), len(features)))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in range(len(features))]) - centre
            total += x.T @ x
        i, j = np.triu_indices(len(features))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])

    out = np.zeros((len(features), len(features)))
    for r in rows.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out, n


def correlation_matrix(df: DataFrame, features: list[str]) -> np.ndarray:
    """Pearson's r of every pair, 0 where a feature does not vary."""
    s, _ = gramian(df, features)
    scale = np.sqrt(np.diag(s))
    return np.divide(s, np.outer(scale, scale), out=np.eye(len(features)), where=np.outer(scale, scale) > 0)


def correlation_screen(df: DataFrame, features: list[str], limit: float = CORRELATION) -> DataFrame:
    """(feature, strongest, dropped): dropped if any earlier column, dropped or not, correlates beyond the limit."""
    r = np.abs(correlation_matrix(df, features))
    strongest = [float(r[:j, j].max(initial=0.0)) for j in range(len(features))]
    rows = [(f, x, x > limit) for f, x in zip(features, strongest, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, strongest double, dropped boolean")


def vif_screen(df: DataFrame, features: list[str], limit: float = MAX_VIF) -> list[str]:
    """Features left after the correlation and variance-inflation screens; the matrix is k x k, however long the table."""
    r = correlation_matrix(df, features)
    left = np.flatnonzero(~stats.correlated_with_earlier(r))
    return [features[left[i]] for i in stats.vif_keep(r[np.ix_(left, left)], limit)]


def long_form(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    return df.unpivot([*keys], features, "feature", "value")


def binned_information(rows: DataFrame, bins: int = 10, by: tuple[str, ...] = ("feature",), label: str = "target_label") -> DataFrame:
    """Mutual information of binned values and the label, in nats, for each group of long rows.

    Bins are equal-width between the group's least and greatest value, so that one aggregate finds them and one partial
    aggregate of (group, bin, label) counts carries all the rest.
    """
    rows = rows.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    ends = rows.groupBy(*by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    wide = F.col("_hi") - F.col("_lo")
    cell = F.when(wide > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("_lo")) / wide * bins))).otherwise(0)
    counts = rows.join(ends, list(by)).withColumn("_b", cell).groupBy(*by, "_b", label).agg(F.count("*").alias("k"))

    def over(*more: str) -> Column:
        return F.sum("k").over(Window.partitionBy(*by, *more))

    counts = counts.withColumns({"_n": over(), "_nb": over("_b"), "_ny": over(label)})
    k, n = F.col("k"), F.col("_n")
    return counts.groupBy(*by).agg(F.sum(k / n * F.ln(k * n / (F.col("_nb") * F.col("_ny")))).alias("mi"))


def regime_information(rows: DataFrame, limit: float = MI_LIMIT) -> DataFrame:
    """feature, mi_high_vol, mi_low_vol, mi_all, accepted, for long rows with prob_regime_high_vol."""
    by = binned_information(rows.withColumn("_high", F.col("prob_regime_high_vol") > 0.5), by=("feature", "_high"))
    split = by.groupBy("feature").agg(F.max(F.when(F.col("_high"), F.col("mi"))).alias("mi_high_vol"), F.max(F.when(~F.col("_high"), F.col("mi"))).alias("mi_low_vol"))
    both = split.join(binned_information(rows).withColumnRenamed("mi", "mi_all"), "feature")
    accepted = (F.coalesce("mi_high_vol", F.lit(0.0)) > limit) | (F.coalesce("mi_low_vol", F.lit(0.0)) > limit)
    return both.withColumn("accepted", accepted)


def prioritised(scores: DataFrame, limit: float = MI_LIMIT) -> DataFrame:
    """(feature, mi, place) of the selected: priority features over half the limit first, then others over it, by mi.

    Fewer than LEAST: the best LEAST by mi alone; more than MOST: the first MOST.
    """
    marked = F.col("feature").rlike("|".join(PRIORITY))
    tier = F.when(marked & (F.col("mi") > limit * 0.5), 0).when(F.col("mi") > limit, 1)
    all_rows = Window.partitionBy(F.lit(0))  # one row a feature
    ranked = scores.withColumn("tier", tier)
    ranked = ranked.withColumns(
        {"n": F.count("tier").over(all_rows), "a": F.row_number().over(all_rows.orderBy(F.col("tier").asc_nulls_last(), F.desc("mi"), "feature")), "b": F.row_number().over(all_rows.orderBy(F.desc("mi"), "feature"))}
    )
    few = F.col("n") < LEAST
    place = F.when(few, F.col("b")).otherwise(F.col("a"))
    kept = F.when(few, F.col("b") <= LEAST).otherwise(F.col("tier").isNotNull() & (F.col("a") <= MOST))
    return ranked.where(kept).select("feature", "mi", place.alias("place"))


def correlated(a: str, b: str) -> Column:
    """Pearson's r, null where a side does not vary (the built-in one then divides by zero in ANSI mode)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def rank_fallback(df: DataFrame, features: list[str], most: int = 5) -> DataFrame:
    """symbol, feature, rho: the features whose ranks correlate best with the label, for each symbol."""
    rows = long_form(df.where("target_label is not null"), features, "symbol", "ts", "target_label").where("value is not null")

    def rank(c: str) -> Column:
        own = Window.partitionBy("symbol", "feature")
        return F.rank().over(own.orderBy(c)) + (F.count("*").over(Window.partitionBy("symbol", "feature", c)) - 1) / 2.0

    rows = rows.withColumns({"_a": rank("value"), "_b": rank("target_label")})
    rho = rows.groupBy("symbol", "feature").agg(F.abs(correlated("_a", "_b")).alias("rho"))
    top = Window.partitionBy("symbol").orderBy(F.desc("rho"), "feature")
    return rho.withColumn("place", F.row_number().over(top)).where(F.col("place") <= most)


def hrp_medoids(df: DataFrame, features: list[str], most: int = CLUSTERS) -> DataFrame:
    """symbol, feature: one feature of each Ward cluster of rank-correlation distances, for every symbol."""
    rows = df.select("symbol", "ts", *features).na.drop()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = stats.medoids(stats.correlation(stats.ranks(pdf[features].to_numpy(float))), most)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "feature": [features[i] for i in kept]})

    return rows.groupBy("symbol").applyInPandas(run, "symbol string, feature string")


def _screen(df: DataFrame, features: list[str], schema: str, job) -> DataFrame:
    """job(feature values, label) in time order for every (symbol, feature): one shuffle of the long form."""
    rows = long_form(df.select("symbol", "ts", "target_label", *features).na.drop(), features, "symbol", "ts", "target_label")
    names = [f.split()[0] for f in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        out = job(pdf["value"].to_numpy(float), pdf["target_label"].to_numpy(float))
        return pd.DataFrame([[pdf["symbol"].iloc[0], pdf["feature"].iloc[0], *out]], columns=["symbol", "feature", *names])

    return rows.groupBy("symbol", "feature").applyInPandas(run, f"symbol string, feature string, {schema}")


def granger_screen(df: DataFrame, features: list[str], most: int = 5, limit: float = 0.05) -> DataFrame:
    """symbol, feature, p, lag, causal: the best of F tests that 1..most lags of the feature help to predict the label."""

    def job(x: np.ndarray, y: np.ndarray) -> list:
        p, k = stats.granger(y, x, most)
        return [p, k, p < limit]

    return _screen(df, features, "p double, lag int, causal boolean", job)


def lagged_information(df: DataFrame, features: list[str], most: int = 5, limit: float = MI_LIMIT) -> DataFrame:
    """symbol, feature, mi, lag, accepted: the most informative of lags 1..most (first rows count as 0)."""

    def job(x: np.ndarray, y: np.ndarray) -> list:
        mi, k = max((stats.nearest_information(np.concatenate((np.zeros(k), x[:-k])), y), -k) for k in range(1, most + 1))
        return [mi, -k, mi > limit]

    return _screen(df, features, "mi double, lag int, accepted boolean", job)


def information_rank(df: DataFrame, features: list[str]) -> DataFrame:
    """symbol, feature, mi, place: features that vary, by what they tell about the label."""

    def job(x: np.ndarray, y: np.ndarray) -> list:
        return [stats.nearest_information(x, y) if len(x) > 1 and x.std(ddof=1) > 1e-8 else None]

    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("mi"), "feature"))
    return _screen(df, features, "mi double", job).where("mi is not null").withColumn("place", place)


def screen(x: pd.DataFrame, y: np.ndarray) -> list[tuple[str, int, str]]:
    """(feature, lag, how) that survive redundancy and prediction screens on one symbol's rows."""
    names = [c for c in x.columns if x[c].std() >= 1e-8]
    values = x[names].to_numpy(float)
    r = stats.correlation(values)
    left = np.flatnonzero(~stats.correlated_with_earlier(r, CORRELATION))
    left = left[stats.vif_keep(r[np.ix_(left, left)], MAX_VIF)]
    left = left[stats.medoids(stats.correlation(stats.ranks(values[:, left])), CLUSTERS)]
    out = []
    for j in left:
        p, k = stats.granger(y, values[:, j])
        if p < 0.05:
            out.append((names[j], k, "granger"))
            continue
        best, at = 0.0, k
        for lag in range(1, 6):
            mi = stats.nearest_information(np.concatenate((np.zeros(lag), values[:-lag, j])), y)
            if mi > best:
                best, at = mi, lag
        if best > MI_LIMIT:
            out.append((names[j], at, "information"))
    if len(out) < 3:
        have = {o[0] for o in out}
        rho = np.abs(stats.correlation(np.column_stack((stats.ranks(values[:, left]), stats.ranks(y))))[-1, :-1])
        out += [(names[left[j]], 1, "rank") for j in np.argsort(-rho, kind="stable")[:5] if names[left[j]] not in have]
    return out


def select(df: DataFrame, features: list[str]) -> DataFrame:
    """symbol, feature, lag, how: the screens in order for every symbol at once, one small group of daily rows each."""
    rows = df.select("symbol", "ts", "target_label", *features).na.drop()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        found = screen(pdf[features], pdf["target_label"].to_numpy(float)) if len(pdf) > 30 else []
        return pd.DataFrame([(pdf["symbol"].iloc[0], *f) for f in found], columns=["symbol", "feature", "lag", "how"])

    return rows.groupBy("symbol").applyInPandas(run, "symbol string, feature string, lag int, how string")
