"""Panels whose symbols hold more rows than one task should order: pieces of equal size, and prefix scans with carries.

deal() numbers the rows of every symbol and cuts them into pieces of `rows` rows. Counts of time slices, added up in time order, give each
slice the number of its first row, so that no task orders more than a slice to number it. A piece also gets the last `halo` rows
before it (and the first `ahead` after it), so every frame of at most as many rows reads in a piece what it reads in the whole symbol:
piecewise() runs any job of bounded windows that way.

Unbounded frames need what came before the piece: carried() sums each piece up in one row (sum, product, first, last or next value),
scans these rows in order, and joins the carry back. Recursions with decay carry an affine map, equity and its peak a product and a maximum.
Only tables of one row a slice or piece are ever windowed by symbol alone: 100 of them for ten million rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import bfill, frame, lag, partitioned, ratio, running
from barloom.operators import features, label
from barloom.operators.backtest import DAYS, FRICTION, TARGET_VOLATILITY
from barloom.sources.bars import shared_path

#: Rows of a piece, rows before it that come along, and rows of a time slice in the densest symbol.
ROWS, HALO, SLICE_ROWS = 100_000, 250, 20_000
PIECE = ("symbol", "_piece")
_BEFORE = (Window.unboundedPreceding, -1)


def _seconds() -> Column:
    return F.unix_timestamp(F.col("ts").cast("timestamp"))


def slice_width(df: DataFrame, rows: int = SLICE_ROWS) -> int:
    """Seconds in which the densest symbol has about so many rows: one number from one aggregate."""
    spans = df.groupBy("symbol").agg(F.count("*").alias("n"), (F.max(_seconds()) - F.min(_seconds())).alias("span"))
    densest = spans.agg(F.max(F.col("n") / F.greatest(F.col("span"), F.lit(1)))).first()[0]
    return max(1, int(rows / densest)) if densest else 1


def numbered(df: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """df with _i, the place of each row in its symbol from 0. symbol and ts are not null, ts is unique in a symbol."""
    cut = df.withColumn("_slice", F.floor(_seconds() / slice_width(df, slice_rows)))
    counts = cut.groupBy("symbol", "_slice").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("symbol").orderBy("_slice").rowsBetween(*_BEFORE))
    first = counts.select("symbol", "_slice", F.coalesce(earlier, F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("symbol", "_slice").orderBy("ts"))
    return cut.withColumn("_place", place).join(first, ["symbol", "_slice"]).withColumn("_i", F.col("_first") + F.col("_place") - 1).drop("_slice", "_first", "_place")


def deal(df: DataFrame, rows: int = ROWS, halo: int = HALO, ahead: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """df with _i, _piece and _own (false: a copy that only gives frames their neighbours), written to the shared folder.

    The written table cuts the lineage: what is carried and what it is carried to read the same rows.
    """
    if max(halo, ahead) > rows:
        raise ValueError("a piece must hold at least the rows that its neighbours need")
    own, place = F.floor(F.col("_i") / rows), F.col("_i") % rows
    pieces = F.array_compact(F.array(own, F.when(place >= rows - halo, own + 1), F.when((place < ahead) & (own > 0), own - 1)))
    dealt = numbered(df, slice_rows).withColumn("_home", own).withColumn("_piece", F.explode(pieces)).withColumn("_own", F.col("_piece") == F.col("_home")).drop("_home")
    path = shared_path(df.sparkSession, "dealt")
    dealt.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_i", "_piece", "_own")


def piecewise(dealt: DataFrame, job) -> DataFrame:
    """job(df) of windows of at most HALO rows, in every piece; the copies are dropped."""
    with partitioned(*PIECE):
        return own_rows(job(dealt))


def _both(op, a: Column, b: Column) -> Column:
    """op(a, b), or the one that is known."""
    return F.coalesce(op(a, b), a, b)


def _pieces(first: int, last: int) -> Window:
    return Window.partitionBy("symbol").orderBy("_piece").rowsBetween(first, last)


def carried(dealt: DataFrame, jobs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Columns over all rows of a symbol so far: name -> (kind, x).

    sum, product: over the rows up to this one, nulls left out; last: the latest known value; first: the value of the first row, known or
    not; next: the earliest known value from this row on.
    """
    own, summary, carry, out = F.col("_own"), {}, {}, {}
    with partitioned(*PIECE):
        for name, (kind, x) in jobs.items():
            mine, at = F.when(own, x), F.when(own & x.isNotNull(), F.col("_i"))
            local, total, before = f"_l_{name}", f"_t_{name}", F.col(f"_t_{name}")
            if kind in ("sum", "product"):
                agg = F.sum if kind == "sum" else F.product
                out[local], summary[total], carry[total] = running(agg(mine)), agg(mine), agg(before).over(_pieces(*_BEFORE))
            elif kind == "last":
                out[local], summary[total] = F.last(mine, True).over(frame(Window.unboundedPreceding, 0)), F.max_by(x, at)
                carry[total] = F.last(before, True).over(_pieces(*_BEFORE))
            elif kind == "first":
                out[local] = F.first(F.when(own, F.struct(x.alias("x"))), True).over(frame(Window.unboundedPreceding, 0))
                summary[total] = F.min_by(F.struct(x.alias("x")), F.when(own, F.col("_i")))
                carry[total] = F.first(before, True).over(_pieces(*_BEFORE))
            elif kind == "next":
                out[local], summary[total] = bfill(x), F.min_by(x, at)
                carry[total] = F.first(before, True).over(_pieces(1, Window.unboundedFollowing))
            else:
                raise ValueError(f"no scan of kind {kind}")
    sums = dealt.groupBy(*PIECE).agg(*[c.alias(n) for n, c in summary.items()])
    sums = sums.select(*PIECE, *[c.alias(n) for n, c in carry.items()])
    joined = dealt.withColumns(out).join(sums, list(PIECE))
    done = {}
    for name, (kind, _) in jobs.items():
        a, b = F.col(f"_t_{name}"), F.col(f"_l_{name}")
        if kind == "sum":
            done[name] = _both(lambda x, y: x + y, a, b)
        elif kind == "product":
            done[name] = _both(lambda x, y: x * y, a, b)
        elif kind == "first":
            done[name] = F.coalesce(a, b)["x"]
        else:
            done[name] = F.coalesce(b, a)
    return joined.withColumns(done).drop(*out, *carry)


def adjust(df: DataFrame, **sizes: int) -> DataFrame:
    """prep.adjust for histories of any length: the running product and the first close are carried."""
    for c, default in (("split_factor", 1.0), ("dividend", 0.0)):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(default))
    dealt = deal(df, **({"halo": 1} | sizes))
    with partitioned(*PIECE):
        dealt = dealt.withColumn("_growth", ratio(F.col("close") + F.col("dividend"), lag("close") * F.col("split_factor")))
    rows = carried(dealt, {"_start": ("first", F.col("close")), "_path": ("product", F.col("_growth"))})
    compounded = F.round(F.col("_start") * F.col("_path"), 8)
    rows = rows.withColumn("close_adj", F.coalesce(F.when(F.col("_growth").isNotNull(), compounded), F.col("close")))
    scale = ratio(F.col("close_adj"), F.col("close"))
    return own_rows(rows.withColumns({f"{c}_adj": F.col(c) * scale for c in ("open", "high", "low")}).drop("_growth", "_start", "_path"))


def ffill_intraday(df: DataFrame, **sizes: int) -> DataFrame:
    """prep.ffill_intraday for histories of any length: a gap of any length reads the last known value before it."""
    names = [c for c in df.columns if "intraday" in c or "vpin" in c]
    rows = carried(deal(df, **({"halo": 0} | sizes)), {f"_f_{c}": ("last", F.col(c)) for c in names})
    return own_rows(rows.withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.lit(0.0)) for c in names}).drop(*[f"_f_{c}" for c in names]))


def volume_price(df: DataFrame, **sizes: int) -> DataFrame:
    """features.volume_price: z-scores and slopes of running sums do not change with what is added to the sum, so pieces need no carry."""
    return piecewise(deal(df, **sizes), features.volume_price)


def stress(df: DataFrame, **sizes: int) -> DataFrame:
    """features.stress with the carried path of growth, which its drawdowns are measured on."""
    dealt = deal(df, **sizes)
    growth = 1.0 + F.coalesce(F.col("log_return"), F.lit(0.0))
    rows = carried(dealt, {"_path": ("product", growth)})
    with partitioned(*PIECE):  # a copy before the piece has the path that the piece's own growth leads back to
        entry = F.first(F.when(F.col("_own"), F.col("_path") / growth), True).over(frame(Window.unboundedPreceding, Window.unboundedFollowing))
        after = F.product(F.when(~F.col("_own"), growth)).over(frame(1, Window.unboundedFollowing))
        rows = rows.withColumn("_path", F.when(F.col("_own"), F.col("_path")).otherwise(entry / F.coalesce(after, F.lit(1.0))))
    return piecewise(rows, features.stress)


def local_volatility(df: DataFrame, span: int = 20, backfill: bool = True, rows: int = ROWS, **sizes: int) -> DataFrame:
    """label.local_volatility: decayed sums of a piece, plus the decayed sum at the end of the piece before, which is an affine map of
    the one before it: as a piece shrinks a sum by keep^rows, only the few pieces count whose share a double still notices."""
    keep, x = 1.0 - 2.0 / (span + 1.0), F.when(F.col("_own"), F.col("log_return"))
    known, value = x.isNotNull().cast("double"), F.coalesce(x, F.lit(0.0))
    parts = {"w": (known, keep), "x": (value, keep), "w2": (known, keep * keep), "x2": (value * value, keep)}
    dealt = deal(df, rows=rows, **({"halo": 0} | sizes))
    with partitioned(*PIECE):
        local = dealt.withColumn("_row", F.col("_i")).withColumn("_i", (F.col("_i") % rows).cast("double"))
        local = label._decayed(local, {f"_{k}": v for k, v in parts.items()}, math.ceil(label.NEGLIGIBLE / -math.log(keep)))
        local = local.withColumn("_seen", running(F.count(x)))
    last = F.struct(*[f"_{k}" for k in parts])
    ends = local.groupBy(*PIECE).agg(F.max_by(last, "_i").alias("_end"), F.count(x).alias("_count"))
    most = math.ceil(label.NEGLIGIBLE / (-math.log(keep) * rows)) + 1
    near = F.collect_list("_end").over(_pieces(-most, -1))
    shrink = {k: v[1] ** rows for k, v in parts.items()}

    def entering(k: str) -> Column:
        return F.aggregate("_near", F.lit(0.0), lambda s, e: s * shrink[k] + e[f"_{k}"])

    carry = {f"_c_{k}": entering(k) for k in parts}
    ends = ends.withColumns({"_near": near, "_c_seen": F.coalesce(F.sum("_count").over(_pieces(*_BEFORE)), F.lit(0))}).withColumns(carry).select(*PIECE, *carry, "_c_seen")
    full = local.join(ends, list(PIECE))
    full = full.withColumns({f"_{k}": F.col(f"_{k}") + F.col(f"_c_{k}") * F.pow(F.lit(v[1]), F.col("_i") + 1) for k, v in parts.items()})
    weight = F.nullif(F.col("_w"), F.lit(0.0))
    m = F.col("_x") / weight
    square = weight * weight
    spread = F.greatest(F.col("_x2") / weight - m * m, F.lit(0.0)) * square / F.nullif(square - F.col("_w2"), F.lit(0.0))
    full = full.withColumn("local_volatility", F.when(F.col("_seen") + F.col("_c_seen") >= 2, F.sqrt(spread))).withColumn("_i", F.col("_row"))
    full = full.drop("_row", "_seen", "_c_seen", *[f"_{k}" for k in parts], *carry)
    if backfill:
        full = carried(full, {"_next": ("next", F.col("local_volatility"))}).withColumn("local_volatility", F.col("_next")).drop("_next")
    return own_rows(full)


def _compounded(rows: DataFrame, paths: dict[str, tuple[Column, float]], peak_of: str) -> DataFrame:
    """name -> start * the product of (1 + x) so far, and drawdown, the distance of peak_of from its highest value so far.

    A piece's summary is its product and the highest value of its own path from 1; in the scan, the path at a piece's entry scales the latter.
    """
    own = F.col("_own")
    with partitioned(*PIECE):
        local = rows.withColumns({f"_p_{n}": running(F.product(F.when(own, 1.0 + x))) for n, (x, _) in paths.items()})
    sums = local.groupBy(*PIECE).agg(*[F.product(F.when(own, 1.0 + x)).alias(f"_e_{n}") for n, (x, _) in paths.items()], F.max(F.when(own, F.col(f"_p_{peak_of}"))).alias("_top"))
    sums = sums.withColumns({f"_e_{n}": F.product(f"_e_{n}").over(_pieces(*_BEFORE)) for n in paths})
    top = F.max(F.coalesce(F.col(f"_e_{peak_of}"), F.lit(1.0)) * F.col("_top")).over(_pieces(*_BEFORE))
    sums = sums.withColumn("_top", top)
    full = local.join(sums, list(PIECE))
    full = full.withColumns({n: start * _both(lambda a, b: a * b, F.col(f"_e_{n}"), F.col(f"_p_{n}")) for n, (_, start) in paths.items()})
    with partitioned(*PIECE):
        peak = F.greatest(running(F.max(F.when(own, F.col(peak_of)))), F.col("_top") * paths[peak_of][1])
        full = full.withColumn("drawdown", (F.col(peak_of) - peak) / peak)
    return full.drop("_top", *[f"_{k}_{n}" for n in paths for k in "pe"])


def ledger(signals: DataFrame, capital: float = 100_000.0, target: float = TARGET_VOLATILITY, friction: float = FRICTION, **sizes: int) -> DataFrame:
    """backtest.ledger of signals (symbol, ts, model_raw_target, close_adj, local_volatility) that stand next to each other already."""
    kept = signals.select("symbol", "ts", "model_raw_target", "close_adj", "local_volatility").na.drop()
    dealt = deal(kept, **({"halo": 2} | sizes))
    with partitioned(*PIECE):
        dealt = dealt.withColumns(
            {
                "daily_asset_return": F.coalesce(ratio(F.col("close_adj"), lag("close_adj")) - 1.0, F.lit(0.0)),
                "active_position": F.coalesce(lag("model_raw_target"), F.lit(0.0)),
                "_sigma": F.nullif(lag("local_volatility"), F.lit(0.0)),
            }
        )
    full = carried(dealt, {"_known": ("next", F.col("_sigma"))})
    scale = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(target / math.sqrt(DAYS)) / F.col("_known")))
    full = full.withColumn("weight", F.when(F.col("_known").isNotNull(), scale * F.col("active_position")))
    with partitioned(*PIECE):
        full = full.withColumn("turnover", F.coalesce(F.abs(F.col("weight") - lag("weight")), F.lit(0.0)))
    full = full.withColumn("costs", F.col("turnover") * friction)
    full = full.withColumn("net_return", F.col("weight") * F.col("daily_asset_return") - F.col("costs"))
    return own_rows(_compounded(full, {"equity": (F.col("net_return"), capital)}, "equity").drop("_sigma", "_known"))


def against_benchmark(signals: DataFrame, friction: float = FRICTION, **sizes: int) -> DataFrame:
    """backtest.against_benchmark of signals (symbol, ts, model_raw_target, close) that stand next to each other already."""
    dealt = deal(signals.select("symbol", "ts", "model_raw_target", "close"), **({"halo": 2} | sizes))
    with partitioned(*PIECE):
        full = dealt.withColumns({"asset_return": F.coalesce(ratio(F.col("close"), lag("close")) - 1.0, F.lit(0.0)), "position": F.coalesce(lag("model_raw_target"), F.lit(0.0))})
        full = full.withColumn("costs", F.coalesce(F.abs(F.col("position") - lag("position")), F.lit(0.0)) * friction)
    full = full.withColumn("strat_net_return", F.col("position") * F.col("asset_return") - F.col("costs"))
    return own_rows(_compounded(full, {"equity_strategy": (F.col("strat_net_return"), 1.0), "equity_benchmark": (F.col("asset_return"), 1.0)}, "equity_strategy"))
