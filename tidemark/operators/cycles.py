"""Autocorrelation, peaks and cycle summaries. Series are tables (symbol, rn, n, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import CycleConfig
from tidemark.functions.exprs import lag, lead, ratio, rows
from tidemark.operators.frame import SIZE, core_rows, position, running, with_halo
from tidemark.session import cut


def series_of(positioned: DataFrame, c: str = "close", size: int = SIZE) -> DataFrame:
    """Non-null values of a column, numbered anew."""
    kept = positioned.filter(F.col(c).isNotNull()).select("symbol", "ts", F.col(c).alias("value"))
    return position(kept, size=size)


# ---- autocorrelation -------------------------------------------------------------------


def _lagged(series: DataFrame, max_lag: int, size: int) -> DataFrame:
    """(symbol, n, lag, x, y): every row with each of its predecessors up to ``max_lag``.

    The rows are exploded right before a map-side aggregation and never shuffled.
    """
    framed = with_halo(series, before=max_lag, size=size)
    past = F.reverse(F.collect_list("value").over(rows(-max_lag, 0)))
    held = core_rows(framed.withColumn("_past", past))
    return held.select("symbol", "n", F.col("value").alias("x"), F.posexplode("_past").alias("lag", "y"))


def _correlation() -> Column:
    """Null without spread, where the built-in correlation would raise."""
    return ratio(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))


def acf(series: DataFrame, config: CycleConfig = CycleConfig(), size: int = SIZE) -> DataFrame:
    """Pearson correlation of the series with itself at lags 1..max_lag, for series long enough."""
    k = config.max_lag
    pairs = _lagged(series.filter(F.col("n") >= k), k, size).filter("lag > 0")
    return pairs.groupBy("symbol", F.col("lag").cast("long").alias("lag")).agg(_correlation().alias("acf"))


def pacf(series: DataFrame, config: CycleConfig = CycleConfig(), size: int = SIZE) -> DataFrame:
    """Partial autocorrelation: lag 1 by correlation, others by the Yule-Walker equations.

    The autocovariances of a series (max_lag + 1 numbers) are solved by the Levinson
    recursion, folded over the lags inside one row.
    """
    k = config.max_lag
    series = cut(series.filter(F.col("n") >= k))
    means = series.groupBy("symbol").agg(F.avg("value").alias("_mean"))
    centred = series.join(means, "symbol").withColumn("value", F.col("value") - F.col("_mean")).drop("_mean")
    pairs = _lagged(centred, k, size)
    per_lag = pairs.groupBy("symbol", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("g"), _correlation().alias("r"))
    per = per_lag.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("lag", "g"))).alias("_g"),
        F.max(F.when(F.col("lag") == 1, F.col("r"))).alias("_first"),
    )
    gamma = F.transform("_g", lambda s: s["g"])

    def bind(c: Column, fn) -> Column:
        return F.get(F.transform(F.array(c), fn), F.lit(0))

    def step(s: Column, i: Column) -> Column:
        g = F.col("gamma")
        known = F.zip_with(s["phi"], F.reverse(F.slice(g, 2, i - 1)), lambda a, b: a * b)
        top = F.get(g, i) - F.aggregate(known, F.lit(0.0), lambda t, x: t + x)
        return bind(
            F.coalesce(F.try_divide(top, s["v"]), F.lit(0.0)),
            lambda c: F.struct(
                F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - c * b), F.array(c)).alias("phi"),
                (s["v"] * (1 - c * c)).alias("v"),
                F.concat(s["out"], F.array(c)).alias("out"),
            ),
        )

    solved = per.withColumn("gamma", gamma).withColumn("_r1", F.coalesce(ratio(F.get("gamma", F.lit(1)), F.get("gamma", F.lit(0))), F.lit(0.0)))
    start = F.struct(
        F.array("_r1").alias("phi"),
        (F.get("gamma", F.lit(0)) * (1 - F.col("_r1") * F.col("_r1"))).alias("v"),
        F.array("_first").alias("out"),
    )
    last = F.least(F.lit(k), F.size("gamma") - 1)
    solved = solved.withColumn("_s", F.when(last >= 2, F.aggregate(F.sequence(F.lit(2), last), start, step)).otherwise(start))
    return solved.select("symbol", F.posexplode("_s.out").alias("_i", "pacf")).select(
        "symbol", (F.col("_i") + 1).cast("long").alias("lag"), "pacf"
    )


def significant_lags(table: DataFrame, c: str, config: CycleConfig = CycleConfig()) -> DataFrame:
    return table.filter(F.abs(c) > config.threshold)


# ---- peaks -----------------------------------------------------------------------------


def peaks(series: DataFrame, height: float | None = None, size: int = SIZE) -> DataFrame:
    """Strict local maxima by ``rn``; of a flat top the middle row, rounded down.

    A flat top may be of any length: its end is found by a backward scan.
    """
    framed = core_rows(
        with_halo(series.select("symbol", "rn", "n", "value"), before=1, after=1, size=size)
        .withColumn("_before", lag("value")).withColumn("_after", lead("value"))
    )
    turn = F.when(
        F.col("_after").isNull() | (F.col("_after") != F.col("value")), F.struct(F.col("rn").alias("rn"), F.col("_after").alias("next"))
    )
    ends = running(framed, {"_end": ("last", turn)}, reverse=True, size=size)
    top = (F.col("value") > F.col("_before")) & (F.col("_end.next") < F.col("value"))
    if height is not None:
        top = top & (F.col("value") >= height)
    middle = F.floor((F.col("rn") + F.col("_end.rn")) / 2)
    return ends.filter(top).select("symbol", middle.alias("rn"), "value")


def _scan(values: np.ndarray, start: int, step: int, level: float) -> tuple[int, float]:
    """First index from ``start`` whose value exceeds ``level``, and the minimum before it."""
    part = values[start::step] if step > 0 or start >= 0 else values[:0]
    above = np.flatnonzero(part > level)
    stop = int(above[0]) if len(above) else -1
    seen = part[:stop] if stop >= 0 else part
    return stop, float(seen.min()) if len(seen) else np.inf


def prominences(series: DataFrame, tops: DataFrame, block: int = 1024) -> DataFrame:
    """Prominence of each peak: height over the higher of the two valley floors.

    A valley reaches to the nearest strictly higher value or the border. Values are packed in
    blocks; a peak searches its own block, then the (max, min) heads of the other blocks, and
    finishes inside the one block that ends the valley.
    """
    blk = F.floor((F.col("rn") - 1) / block)
    base = cut(series.select("symbol", "rn", "value").withColumn("blk", blk))
    packed = base.groupBy("symbol", "blk").agg(
        F.min("rn").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))), lambda s: s["value"]).alias("values")
    )
    heads = base.groupBy("symbol", "blk").agg(F.max("value").alias("hi"), F.min("value").alias("lo")).groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("blk", "hi", "lo"))).alias("heads")
    )
    grouped = tops.withColumn("blk", blk).groupBy("symbol", "blk").agg(F.collect_list(F.struct("rn", "value")).alias("tops"))

    def sides(batches):
        for pdf in batches:
            out = []
            for symbol, b, first, values, tops_, heads_ in zip(pdf["symbol"], pdf["blk"], pdf["first"], pdf["values"], pdf["tops"], pdf["heads"]):
                v = np.asarray(values, dtype=float)
                ids = np.array([h["blk"] for h in heads_])
                hi = np.array([h["hi"] for h in heads_])
                lo = np.array([h["lo"] for h in heads_])
                mine = int(np.flatnonzero(ids == b)[0])
                for top in tops_:
                    at, level = int(top["rn"] - first), float(top["value"])
                    for step in (-1, 1):
                        start = at + step
                        inside = v[:at][::-1] if step < 0 else v[start:]
                        stop, floor = _scan(inside, 0, 1, level)
                        target = -1
                        if stop < 0:
                            h, l, i = (hi[:mine][::-1], lo[:mine][::-1], ids[:mine][::-1]) if step < 0 else (hi[mine + 1 :], lo[mine + 1 :], ids[mine + 1 :])
                            over = np.flatnonzero(h > level)
                            n = int(over[0]) if len(over) else len(h)
                            floor = min(floor, float(l[:n].min()) if n else np.inf, level)
                            target = int(i[n]) if len(over) else -1
                        out.append((symbol, int(top["rn"]), level, step, min(floor, level), target))
            yield pd.DataFrame(out, columns=["symbol", "rn", "value", "side", "floor", "target"])

    schema = "symbol string, rn long, value double, side int, floor double, target long"
    joined = packed.join(grouped, ["symbol", "blk"]).join(heads, "symbol")
    found = joined.select("symbol", "blk", "first", "values", "tops", "heads").mapInPandas(sides, schema)
    rest = found.join(
        packed.select("symbol", F.col("blk").alias("target"), "values"), ["symbol", "target"], "left"
    )
    towards = F.when(F.col("side") < 0, F.reverse("values")).otherwise(F.col("values"))
    # The valley's part of the last block: the values before the first higher one.
    fold = F.aggregate(
        towards,
        F.struct(F.lit(False).alias("done"), F.lit(float("inf")).alias("low")),
        lambda s, x: F.when(s["done"] | (x > F.col("value")), F.struct(F.lit(True).alias("done"), s["low"].alias("low"))).otherwise(
            F.struct(F.lit(False).alias("done"), F.least(s["low"], x).alias("low"))
        ),
        lambda s: s["low"],
    )
    floors = rest.withColumn("floor", F.least("floor", fold))
    return floors.groupBy("symbol", "rn", "value").agg((F.max("value") - F.max("floor")).alias("prominence"))


def cycle_peaks(acf_table: DataFrame, config: CycleConfig = CycleConfig(), size: int = SIZE) -> DataFrame:
    """Peaks of the autocorrelation: candidate periods."""
    n = F.lit(config.max_lag).cast("long")
    series = acf_table.select("symbol", F.col("lag").alias("rn"), n.alias("n"), F.col("acf").alias("value"))
    return peaks(series, config.threshold, size).select("symbol", F.col("rn").alias("lag"), F.col("value").alias("acf"))


def dominant_periods(spectrum: DataFrame, config: CycleConfig = CycleConfig(), size: int = SIZE) -> DataFrame:
    """Up to ten spectral peaks whose prominence reaches the deviation of the power.

    ``spectrum`` has (symbol, k, period, power) with contiguous k per symbol.
    """
    spectrum = cut(spectrum)
    edges = spectrum.groupBy("symbol").agg(
        F.min("k").alias("_k0"), F.count(F.lit(1)).alias("n"), F.stddev_pop("power").alias("_limit")
    )
    series = cut(
        spectrum.join(edges, "symbol").select("symbol", (F.col("k") - F.col("_k0") + 1).alias("rn"), "n", F.col("power").alias("value"))
    )
    strong = prominences(series, peaks(series, size=size)).join(edges, "symbol").filter(F.col("prominence") >= F.col("_limit"))
    named = strong.select("symbol", (F.col("rn") + F.col("_k0") - 1).alias("k"), "prominence").join(spectrum, ["symbol", "k"])
    w = Window.partitionBy("symbol").orderBy(F.desc("power"), "k")
    return named.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= config.top_periods)


def summarize(acf_peaks: DataFrame, dominant: DataFrame, wavelet_peaks: DataFrame | None = None) -> DataFrame:
    """All detected cycles as (symbol, method, period_days, strength), by period."""
    out = acf_peaks.select(
        "symbol", F.lit("autocorrelation").alias("method"), F.col("lag").cast("double").alias("period_days"), F.col("acf").alias("strength")
    ).unionByName(dominant.select("symbol", F.lit("spectral").alias("method"), F.col("period").alias("period_days"), F.col("power").alias("strength")))
    if wavelet_peaks is not None:
        out = out.unionByName(
            wavelet_peaks.select("symbol", F.lit("wavelet").alias("method"), F.col("scale").cast("double").alias("period_days"), F.lit(None).cast("double").alias("strength"))
        )
    return out.orderBy("symbol", "period_days", "method")
