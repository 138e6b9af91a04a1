"""Statistics, transitions and durations of regime runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.exprs import EPS, lag, ratio
from tidemark.operators.frame import SIZE, core_rows, grouped_quantile, running, with_halo
from tidemark.session import cut


def regime_statistics(df: DataFrame, c: str = "market_regime", size: int = SIZE) -> DataFrame:
    """Per symbol and regime; needs ``rn``, ``n``, ``close`` and ``log_return``.

    The drawdown runs over the regime's own rows, joined end to end.
    """
    peaks = running(df, {"_peak": ("max", F.col("close"))}, size=size, keys=("symbol", c))
    return (
        peaks.groupBy("symbol", c)
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            (F.count(F.lit(1)) / F.max("n")).alias("frequency"),
            F.avg("log_return").alias("mean_return"),
            F.stddev_samp("log_return").alias("volatility"),
            F.min(ratio("close", "_peak") - 1).alias("max_drawdown"),
        )
        .withColumn("sharpe", F.col("mean_return") / (F.col("volatility") + EPS) * F.sqrt(F.lit(252.0)))
    )


def regime_counts(df: DataFrame, c: str = "market_regime") -> DataFrame:
    return df.groupBy("symbol", c).count()


def transitions(df: DataFrame, c: str = "market_regime", size: int = SIZE) -> DataFrame:
    """Where the regime changes, and how many days the run that ended had lasted."""
    framed = with_halo(df.select("symbol", "ts", "rn", "n", c), before=2, size=size)
    framed = framed.withColumn("_from", lag(c)).withColumn(
        "_new", (F.col("rn") == 1) | (F.col(c) != F.col("_from"))
    )
    # The latest change strictly before each row.
    framed = core_rows(framed.withColumn("_before", F.when(lag("_new"), lag("ts"))))
    runs = running(framed, {"_start": ("last", F.col("_before"))}, size=size)
    return runs.filter(F.col("_new") & (F.col("rn") > 1)).select(
        "symbol", "ts", F.col("_from").alias("from_regime"), F.col(c).alias("to_regime"),
        F.date_diff("ts", "_start").alias("duration_days"),
    )


def run_lengths(df: DataFrame, c: str, size: int = SIZE) -> DataFrame:
    """One row per run of equal values: (symbol, value, start, rows)."""
    framed = with_halo(df.select("symbol", "rn", "n", c), before=1, size=size)
    marked = core_rows(framed.withColumn("_new", (F.col("rn") == 1) | (F.col(c) != lag(c))))
    runs = running(marked, {"_start": ("max", F.when(F.col("_new"), F.col("rn")))}, size=size)
    return runs.groupBy("symbol", c, F.col("_start").alias("start_rn")).agg(F.count(F.lit(1)).alias("rows"))


def regime_durations(df: DataFrame, c: str = "market_regime", size: int = SIZE) -> DataFrame:
    runs = cut(run_lengths(df, c, size))
    stats = runs.groupBy("symbol", c).agg(
        F.avg("rows").alias("mean"),
        F.stddev_pop("rows").alias("std"),
        F.min("rows").alias("min"),
        F.max("rows").alias("max"),
    )
    return stats.join(grouped_quantile(runs, ["symbol", c], "rows", 0.5, "median"), ["symbol", c])


def drawdown(df: DataFrame, c: str = "close", size: int = SIZE) -> DataFrame:
    """Running maximum, running product of growth, and drawdown of a positive series."""
    framed = with_halo(df, before=1, size=size)
    grown = core_rows(framed.withColumn("_g", F.coalesce(ratio(c, lag(c)), F.lit(1.0))))
    out = running(grown, {"running_max": ("max", F.col(c)), "_log": ("sum", F.log("_g"))}, size=size)
    return out.withColumns(
        {"running_growth": F.exp("_log"), "drawdown": ratio(F.col(c), "running_max") - 1}
    ).drop("_log", "_g")
