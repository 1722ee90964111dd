"""Window helpers with the missing-value rules of rolling statistics: a full frame of values, or null.

All frames share one specification (partition by symbol, order by ts), so any number of them costs one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-8


_KEYS: ContextVar[tuple[str, ...]] = ContextVar("keys", default=("symbol",))


def keys() -> tuple[str, ...]:
    return _KEYS.get()


@contextmanager
def partitioned(*columns: str) -> Iterator[None]:
    """Windows made inside run within these columns instead of within a whole symbol."""
    before = _KEYS.set(columns)
    try:
        yield
    finally:
        _KEYS.reset(before)


def w() -> WindowSpec:
    return Window.partitionBy(*keys()).orderBy("ts")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by these columns over a fixed number of partitions, at least two a core.

    Adaptive execution joins small partitions by their bytes, which leaves a few MB of rows to one core even where each group is a fit;
    an exchange whose number is given stays as it is.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def frame(first: int, last: int) -> WindowSpec:
    return w().rowsBetween(first, last)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(_c(x), k).over(w())


def diff(x: Column | str, k: int = 1) -> Column:
    return _c(x) - lag(x, k)


def roll(x: Column | str, n: int, agg: Callable[[Column], Column], shift: int = 0, least: int | None = None) -> Column:
    """agg over the n rows that end `shift` rows back; null until `least` (default n) of them hold a value."""
    over = frame(-(n - 1) - shift, -shift)
    x = _c(x)
    return F.when(F.count(x).over(over) >= (n if least is None else least), agg(x).over(over))


def mean(x: Column | str, n: int, shift: int = 0) -> Column:
    return roll(x, n, F.avg, shift)


def std(x: Column | str, n: int, shift: int = 0) -> Column:
    return roll(x, n, F.stddev_samp, shift)


def total(x: Column | str, n: int, shift: int = 0) -> Column:
    return roll(x, n, F.sum, shift)


def zscore(x: Column | str, n: int, shift: int = 0) -> Column:
    return (_c(x) - mean(x, n, shift)) / (std(x, n, shift) + EPS)


def roll2(x: Column, y: Column, n: int, agg: Callable[[Column, Column], Column]) -> Column:
    over = frame(-(n - 1), 0)
    both = x + y
    return F.when(F.count(both).over(over) == n, agg(x, y).over(over))


def skew(x: Column | str, n: int) -> Column:
    """Bias-corrected skewness, from the population form."""
    return roll(x, n, F.skewness) * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurtosis(x: Column | str, n: int) -> Column:
    """Bias-corrected excess kurtosis, from the population form."""
    return (roll(x, n, F.kurtosis) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def ffill(x: Column | str) -> Column:
    return F.last(_c(x), ignorenulls=True).over(frame(Window.unboundedPreceding, 0))


def bfill(x: Column | str) -> Column:
    return F.first(_c(x), ignorenulls=True).over(frame(0, Window.unboundedFollowing))


def running(agg: Column) -> Column:
    return agg.over(frame(Window.unboundedPreceding, 0))


def strict_greatest(*xs: Column) -> Column:
    """Null if any argument is (greatest skips nulls)."""
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, F.greatest(*xs))


def strict_least(*xs: Column) -> Column:
    return -strict_greatest(*[-x for x in xs])


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def safe_ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def rounded(digits: int, *names: str) -> list[Column]:
    """Columns rounded for reports; adding 0 turns -0 into 0."""
    return [(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) for n in names]
