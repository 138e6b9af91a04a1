"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

EPS = 1e-8


def shard_window():
    """The window of one shard (see operators/frame.py): bounded, ordered by position."""
    return Window.partitionBy("symbol", "shard").orderBy("rn")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def back(k: int):
    """The current row and the k-1 before it."""
    return shard_window().rowsBetween(1 - k, 0)


def rows(first: int, last: int):
    return shard_window().rowsBetween(first, last)


def lag(c: str | Column, k: int = 1) -> Column:
    return F.lag(col(c), k).over(shard_window())


def lead(c: str | Column, k: int = 1) -> Column:
    return F.lead(col(c), k).over(shard_window())


def enough(c: str | Column, k: int, expr: Column, needed: int | None = None) -> Column:
    """``expr`` once the k-row frame holds ``needed`` (default k) non-null values."""
    need = k if needed is None else needed
    return F.when(F.count(col(c)).over(back(k)) >= need, expr)


def rolling(fn, c: str | Column, k: int, needed: int | None = None) -> Column:
    return enough(c, k, fn(col(c)).over(back(k)), needed)


def sorted_quantile(a: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted array; null when it is empty."""
    at = (F.size(a) - 1) * q
    low = F.floor(at).cast("int")
    x, y = F.get(a, low), F.get(a, F.ceil(at).cast("int"))
    return x + (y - x) * (at - low)


def sorted_over(c: str, frame) -> Column:
    """Sorted values of a frame: much cheaper than an exact percentile per row."""
    return F.sort_array(F.collect_list(c).over(frame))


def median_over(c: str, frame) -> Column:
    return sorted_quantile(sorted_over(c, frame), 0.5)


def ratio(a, b) -> Column:
    """Division that yields null instead of raising on a zero divisor."""
    return F.try_divide(col(a), col(b))


def correlation(x: str, y: str, frame) -> Column:
    """Correlation of two columns that are null together; null without spread.

    The built-in one divides by the spread, which raises on a constant frame.
    """
    spread = F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)
    return F.try_divide(F.covar_pop(x, y).over(frame), spread)


def flag(condition: Column) -> Column:
    """0/1 with null counted as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def zscale(a: Column) -> Column:
    """z-normalised array: population deviation, guarded by EPS."""
    n = F.size(a)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total / n

    def scaled(m: Column) -> Column:
        var = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n
        return F.transform(
            F.array(F.sqrt(var)),
            lambda sd: F.transform(a, lambda x: (x - m) / (sd + F.lit(EPS))),
        )[0]

    return F.transform(F.array(mean), scaled)[0]


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
