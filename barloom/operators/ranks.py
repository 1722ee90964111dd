"""Ranks and neighbours of groups that no task could sort alone: rows dealt by ranges of value, small tables of what lies before each part.

placed() range-partitions rows by (group, value, id): the id keeps equal values apart, so that a value which a third of all rows hold
still spreads over many tasks. A part then counts its own rows in order, and one summary row a (part, group) says how many came before;
only these summaries are ever ordered by group alone. Values on the edge of a part may go on in the next one: their counts are
put together from the summaries.

All jobs take long rows (keys, `value`), leave out null values, and give no rows for none. NaN counts as the largest value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.functions.windows import lag, partitioned
from barloom.operators.features import lag_transforms
from barloom.operators.long_history import PIECE, deal, own_rows, piecewise
from barloom.operators.selection import CLUSTERS, MI_LIMIT, correlated, gramian
from barloom.sources.bars import written

_BEFORE = (Window.unboundedPreceding, -1)
_EULER = 0.5772156649015329


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with _part: parts follow each other in the order of (by, order)."""
    return rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())


def _own(by: list[str]) -> WindowSpec:
    return Window.partitionBy("_part", *by)


def _earlier(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("_part").rowsBetween(*_BEFORE)


def average_ranks(rows: DataFrame, by: list[str], ids: list[str]) -> DataFrame:
    """rows with `rank`, the place from 1 of their value in its group; equal values share the mean of their places."""
    rows = rows.where("value is not null").withColumn("value", F.col("value") + F.lit(0.0))  # -0.0 and 0.0 tie
    own = _own(by).orderBy("value")
    counted = placed(rows, by, ["value", *ids]).withColumns({"_less": F.rank().over(own) - 1, "_ties": F.count("*").over(own.rangeBetween(0, 0))})
    counted = written(counted, "ranks")
    parts = counted.groupBy("_part", *by).agg(
        F.count("*").alias("_n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.min_by("_ties", "value").alias("_at_lo"), F.max_by("_ties", "value").alias("_at_hi")
    )
    parts = parts.withColumn("_first", F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0)))
    ends = F.array(
        F.struct(F.col("_lo").alias("v"), F.col("_first").alias("less"), F.col("_at_lo").alias("ties")),
        F.when(F.col("_hi") > F.col("_lo"), F.struct(F.col("_hi").alias("v"), (F.col("_first") + F.col("_n") - F.col("_at_hi")).alias("less"), F.col("_at_hi").alias("ties"))),
    )
    edges = parts.select(*by, F.explode(F.array_compact(ends)).alias("e")).groupBy(*by, F.col("e.v").alias("v")).agg(F.min("e.less").alias("less"), F.sum("e.ties").alias("ties"))
    for end in ("_lo", "_hi"):
        parts = parts.join(edges.select(*by, F.col("v").alias(end), F.struct("less", "ties").alias(f"_e{end}")), [*by, end])
    at = F.when(F.col("value") == F.col("_lo"), F.col("_e_lo")).when(F.col("value") == F.col("_hi"), F.col("_e_hi")).otherwise(F.struct((F.col("_first") + F.col("_less")).alias("less"), F.col("_ties").alias("ties")))
    joined = counted.join(parts.select("_part", *by, "_lo", "_hi", "_first", "_e_lo", "_e_hi"), ["_part", *by]).withColumn("_at", at)
    return joined.select(*rows.columns, (F.col("_at.less") + (F.col("_at.ties") + 1) / 2.0).alias("rank"))


def exploded(df: DataFrame, features: list[str], *keys: str) -> DataFrame:
    """Long rows (keys, _f, value), _f being the place in features, of rows without a null in any feature."""
    rows = df.select(*keys, F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("_z"))
    rows = rows.where(~F.exists("_z", lambda v: v.isNull()))  # one condition: a filter a column makes Catalyst derive conditions without end
    return rows.select(*keys, F.posexplode("_z").alias("_f", "value"))


def named(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumn("feature", F.get(F.array(*map(F.lit, features)), F.col("_f"))).drop("_f")


def rank_medoids(df: DataFrame, features: list[str], most: int = CLUSTERS) -> list[str]:
    """One feature of each Ward cluster of rank correlations over the pooled rows; the driver sees one k x k matrix."""
    keys = ["symbol", "ts"]
    ranks = average_ranks(exploded(df, features, *keys), ["_f"], keys)
    wide = ranks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_f", "rank")))["rank"].alias("_z"))  # one value a feature
    columns = [f"r{i}" for i in range(len(features))]
    s, n = gramian(wide.select(*[F.get("_z", F.lit(i)).alias(c) for i, c in enumerate(columns)]), columns)
    scale = np.sqrt(np.diag(s))
    r = np.divide(s, np.outer(scale, scale), out=np.zeros_like(s), where=np.outer(scale, scale) > 0)
    return [features[i] for i in stats.medoids(r, most)] if n else []


def rank_fallback(df: DataFrame, features: list[str], most: int = 5) -> DataFrame:
    """symbol, feature, rho, place: selection.rank_fallback of any number of features, for symbols of any length.

    The label takes few values, so its ranks come from counts; rows are those without a null in any feature.
    """
    keys = ["symbol", "ts", "target_label"]
    ranks = average_ranks(exploded(df.where("target_label is not null"), features, *keys), ["symbol", "_f"], ["ts"])
    counts = ranks.where("_f = 0").groupBy("symbol", "target_label").agg(F.count("*").alias("_n"))
    less = F.coalesce(F.sum("_n").over(Window.partitionBy("symbol").orderBy("target_label").rowsBetween(*_BEFORE)), F.lit(0))
    labels = counts.select("symbol", "target_label", (less + (F.col("_n") + 1) / 2.0).alias("_label"))
    rho = ranks.join(labels, ["symbol", "target_label"]).groupBy("symbol", "_f").agg(F.abs(correlated("rank", "_label")).alias("rho"))
    top = Window.partitionBy("symbol").orderBy(F.desc("rho"), "feature")
    return named(rho, features).withColumn("place", F.row_number().over(top)).where(F.col("place") <= most).select("symbol", "feature", "rho", "place")


def digamma(n: Column) -> Column:
    """psi of a positive whole number: harmonic sums up to 15, beyond them the series, exact to 1e-13."""
    n = F.greatest(n, F.lit(1)).cast("double")
    sums, total = [], -_EULER
    for i in range(1, 16):
        sums.append(F.lit(total))
        total += 1.0 / i
    s = 1 / (n * n)
    series = F.ln(n) - 0.5 / n - s * (F.lit(1 / 12) - s * (F.lit(1 / 120) - s * (F.lit(1 / 252) - s / 240)))
    return F.when(n <= 15, F.get(F.array(*sums), (n - 1).cast("int"))).otherwise(series)


def _neighbours(rows: DataFrame, by: list[str], ids: list[str], k: int) -> DataFrame:
    """rows with _m (rows of the group), _q = least(k, _m - 1) and _r, the distance to the _q-th nearest value of the group."""
    own = _own(by).orderBy("value", *ids)
    cut = placed(rows, by, ["value", *ids]).withColumns({"_i": F.row_number().over(own), "_here": F.count("*").over(_own(by))})
    cut = written(cut.withColumn("_d", F.col("_here") - F.col("_i") + 1).drop("_here"), "near")
    last = F.array_sort(F.collect_list(F.when(F.col("_d") <= k, F.col("value"))))  # k values at most
    first = F.array_sort(F.collect_list(F.when(F.col("_i") <= k, F.col("value"))))
    parts = cut.groupBy("_part", *by).agg(F.count("*").alias("_n"), last.alias("_last"), first.alias("_first"))
    by_part = Window.partitionBy(*by).orderBy("_part")  # a part holds a row at least, so k parts hold k values
    parts = parts.select(
        "_part", *by, F.sum("_n").over(Window.partitionBy(*by)).alias("_m"),
        F.flatten(F.collect_list("_last").over(by_part.rowsBetween(-k, -1))).alias("_before"),
        F.flatten(F.collect_list("_first").over(by_part.rowsBetween(1, k))).alias("_after"),
    )
    near = cut.join(parts, ["_part", *by])
    left = {0: F.col("value")} | {j: F.coalesce(F.lag("value", j).over(own), F.get("_before", F.size("_before") - j + F.col("_i") - 1)) for j in range(1, k + 1)}
    right = {0: F.col("value")} | {j: F.coalesce(F.lead("value", j).over(own), F.get("_after", (j - F.col("_d")).cast("int"))) for j in range(1, k + 1)}
    near = near.withColumns({f"_l{j}": c for j, c in left.items()} | {f"_g{j}": c for j, c in right.items()}).withColumn("_q", F.least(F.lit(k), F.col("_m") - 1))

    def reach(q: int) -> Column:  # of the windows of q neighbours, the one that reaches least far
        each = [F.when(F.col(f"_l{j}").isNotNull() & F.col(f"_g{q - j}").isNotNull(), F.greatest(F.col("value") - F.col(f"_l{j}"), F.col(f"_g{q - j}") - F.col("value"))) for j in range(q + 1)]
        return F.least(*each)

    radius = F.lit(None).cast("double")
    for q in range(1, k + 1):
        radius = F.when(F.col("_q") == q, reach(q)).otherwise(radius)
    return near.select(*rows.columns, "_m", "_q", radius.alias("_r"))


def nearest_information(rows: DataFrame, by: list[str], ids: list[str], label: str = "target_label", k: int = 3) -> DataFrame:
    """by, mi: stats.nearest_information of every group of long rows, no task holding a group.

    Neighbours within a class come from parts in order of value; the points inside each radius are counted by sorting both ends of
    the radius in among the points, and adding up the points of the parts before. by and ids together tell rows apart.
    """
    rows = rows.where(F.col("value").isNotNull() & F.col(label).isNotNull()).select(*by, *ids, label, F.col("value").cast("double").alias("value"))
    near = _neighbours(rows, [*by, label], ids, k).withColumn("_r", F.col("_r") * (1 - 1e-10))  # the neighbour itself stays outside
    point = F.struct(F.col("value").alias("v"), F.lit(1).alias("o"))
    ends = [F.when(F.col("_m") > 1, F.struct((F.col("value") + s * F.col("_r")).alias("v"), F.lit(1 + s).alias("o"))) for s in (-1, 1)]
    points = near.withColumn("_e", F.explode(F.array_compact(F.array(point, *ends)))).select(*by, *ids, "_m", "_q", F.col("_e.v").alias("_v"), F.col("_e.o").alias("_o"))
    point = (F.col("_o") == 1).cast("int")
    inside = F.sum(point).over(_own(by).orderBy("_v", "_o", *ids).rowsBetween(Window.unboundedPreceding, 0))
    counted = written(placed(points, by, ["_v", "_o", *ids]).withColumn("_inside", inside), "inside")
    parts = counted.groupBy("_part", *by).agg(F.sum(point).alias("_n"))
    parts = parts.select("_part", *by, F.coalesce(F.sum("_n").over(_earlier(by)), F.lit(0)).alias("_first"))
    ends = counted.where("_o <> 1").join(parts, ["_part", *by])
    each = ends.groupBy(*by, *ids, "_m", "_q").agg(F.sum((F.col("_o") - 1) * (F.col("_first") + F.col("_inside"))).alias("_inside"))
    mean = F.avg(digamma(F.col("_q")) - digamma(F.col("_m")) - digamma(F.col("_inside")))
    found = each.groupBy(*by).agg(F.greatest(F.lit(0.0), digamma(F.count("*")) + mean).alias("mi"))
    return rows.select(*by).distinct().join(found, by, "left").withColumn("mi", F.coalesce("mi", F.lit(0.0)))


def _ranked(rows: DataFrame, features: list[str]) -> DataFrame:
    rows = written(rows.where("value is not null"), "long")
    varied = rows.groupBy("_f").agg(F.stddev_samp("value").alias("s")).where("s > 1e-8").select("_f")
    mi = nearest_information(rows.join(varied, "_f", "left_semi"), ["_f"], ["symbol", "ts"])
    return named(mi, features).withColumn("place", F.row_number().over(Window.orderBy(F.desc("mi"), "feature")))  # one row a feature


def information_rank(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, mi, place: features that vary, by what they tell about the label over the pooled rows."""
    return _ranked(exploded(df.where("target_label is not null"), features, "symbol", "ts", "target_label"), features)


def transforms_rank(df: DataFrame, features: list[str], k: int = 1) -> DataFrame:
    """information_rank of the three lag transforms of every feature: computed on long rows, so the plan has three columns, not hundreds."""
    names = (f"zscaled_lag{k}", "momentum", "acceleration")
    long = _dealt(df, features).select("symbol", "ts", "target_label", "_i", "_piece", "_own", F.posexplode("_z").alias("_g", "x"))
    with partitioned(*PIECE, "_g"):
        moved = own_rows(lag_transforms(long, {"x": k}))
    each = moved.select("symbol", "ts", "target_label", "_g", F.posexplode(F.array(*[F.col(f"x_{n}") for n in names])).alias("_t", "value"))
    return _ranked(each.withColumn("_f", F.col("_g") * 3 + F.col("_t")).drop("_g", "_t"), [f"{f}_{n}" for f in features for n in names])


def _dealt(df: DataFrame, features: list[str]) -> DataFrame:
    """Labelled rows without a null in any feature, in pieces with halos, the features in one array."""
    z = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return deal(df.where("target_label is not null").select("symbol", "ts", "target_label", z.alias("_z")).where(~F.exists("_z", lambda v: v.isNull())))


def lagged_information(df: DataFrame, features: list[str], most: int = 5, limit: float = MI_LIMIT) -> DataFrame:
    """symbol, feature, mi, lag, accepted: the most informative of lags 1..most of every feature (first rows count as 0)."""
    none = F.array(*[F.lit(0.0)] * len(features))
    lagged = piecewise(_dealt(df, features), lambda d: d.withColumn("_lags", F.array(*[F.coalesce(lag("_z", k), none) for k in range(1, most + 1)])))
    each = lagged.select("symbol", "ts", "target_label", F.posexplode("_lags").alias("_k", "_z")).select("symbol", "ts", "target_label", (F.col("_k") + 1).alias("lag"), F.posexplode("_z").alias("_f", "value"))
    mi = nearest_information(each, ["symbol", "_f", "lag"], ["ts"])
    best = mi.groupBy("symbol", "_f").agg(F.max(F.struct("mi", (-F.col("lag")).alias("k"))).alias("b")).select("symbol", "_f", F.col("b.mi").alias("mi"), (-F.col("b.k")).alias("lag"))
    return named(best, features).select("symbol", "feature", "mi", "lag", (F.col("mi") > limit).alias("accepted"))
