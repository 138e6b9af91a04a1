"""Rolling features. Each family adds columns to a framed table (see frame.py).

Families only use bounded frames, so one shuffle by (symbol, shard) serves all of them and
Catalyst prunes whatever a query does not select. The recursive features (EMA, MACD), the
run lengths and whatever looks at a whole series come from :func:`scans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import FeatureConfig
from tidemark.functions.exprs import EPS, back, correlation, enough, flag, lag, ratio, rolling, rows, sorted_over, sorted_quantile
from tidemark.operators.frame import SIZE, core_rows, ema, streak, with_halo
from tidemark.operators.quality import atr, with_returns_and_range
from tidemark.session import cut

#: Longest chain of frames: 252-row rank of a 20-row deviation of a one-row return.
WARMUP = 252 + 20 + 1


def base(framed: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Level one: one-row differences, then the moments of every window."""
    gain = F.coalesce(F.greatest(F.col("close") - lag("close"), F.lit(0.0)), F.lit(0.0))
    loss = F.coalesce(F.greatest(lag("close") - F.col("close"), F.lit(0.0)), F.lit(0.0))
    df = with_returns_and_range(framed).withColumns(
        {
            "range": F.col("high") - F.col("low"),
            "volume_change": ratio(F.col("volume"), lag("volume")) - 1,
            "dollar": F.col("close") * F.col("volume"),
            "gain": gain,
            "loss": loss,
        }
    )
    df = df.withColumn("flow", F.coalesce(F.signum("log_return") * F.col("volume"), F.lit(0.0)))
    return moments(df, config.windows)


#: What is kept per column and window: n count, s sum, q squared deviations, hi, lo.
MOMENTS = {
    "close": "n s q hi lo", "log_return": "n s q", "volume": "n s q", "high": "n hi", "low": "n lo", "range": "n s",
    "dollar": "n s", "gain": "s", "loss": "s", "flow": "s",
}


def at(c: str, kind: str, w: int) -> Column:
    return F.col(f"_{c}_{kind}_{w}")


def moments(df: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """Window statistics, where a window twice as long as another reuses it.

    Two adjacent halves merge with one look-back (counts and sums add, deviations merge by
    the two-sample formula), so a row costs the same for 80 rows as for 10.
    """
    done: list[int] = []
    direct = {}
    for w in sorted(set(windows)):
        if w % 2 == 0 and w // 2 in windows:
            continue
        done.append(w)
        frame = back(w)
        for c, kinds in MOMENTS.items():
            makers = {
                "n": F.count(c).over(frame), "s": F.sum(c).over(frame), "hi": F.max(c).over(frame), "lo": F.min(c).over(frame),
                "q": F.var_pop(c).over(frame) * F.count(c).over(frame),
            }
            direct.update({f"_{c}_{k}_{w}": makers[k] for k in kinds.split()})
    df = df.withColumns(direct)
    for w in sorted(set(windows) - set(done)):
        half = w // 2
        both = {}
        for c, kinds in MOMENTS.items():
            new = {k: at(c, k, half) for k in kinds.split()}
            old = {k: lag(at(c, k, half), half) for k in kinds.split()}
            zero = F.lit(0.0)
            for k in new:
                if k == "n":
                    both[f"_{c}_n_{w}"] = new[k] + F.coalesce(old[k], F.lit(0))
                elif k == "s":
                    both[f"_{c}_s_{w}"] = F.when(new[k].isNotNull() | old[k].isNotNull(), F.coalesce(new[k], zero) + F.coalesce(old[k], zero))
                elif k == "q":
                    away = ratio(new["s"], new["n"]) - ratio(old["s"], old["n"])
                    apart = away * away * new["n"] * old["n"] / F.greatest(new["n"] + old["n"], F.lit(1))
                    both[f"_{c}_q_{w}"] = F.coalesce(new[k], zero) + F.coalesce(old[k], zero) + F.coalesce(apart, zero)
                else:
                    both[f"_{c}_{k}_{w}"] = (F.greatest if k == "hi" else F.least)(new[k], old[k])
        df = df.withColumns(both)
    return df


def known(c: str, w: int, expr: Column, needed: int | None = None) -> Column:
    return F.when(at(c, "n", w) >= (w if needed is None else needed), expr)


def mean_of(c: str, w: int, needed: int | None = None) -> Column:
    return known(c, w, ratio(at(c, "s", w), at(c, "n", w)), needed)


def deviation_of(c: str, w: int, needed: int | None = None) -> Column:
    n = at(c, "n", w)
    return known(c, w, F.when(n >= 2, F.sqrt(at(c, "q", w) / F.greatest(n - 1, F.lit(1)))), needed)


def price(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    level = {"atr_14": atr(14)}
    for w in config.windows:
        half = max(1, w // 2)
        level[f"momentum_{w}"] = ratio("close", lag("close", w)) - 1
        level[f"volatility_{w}"] = deviation_of("log_return", w, half)
        level[f"sma_{w}"] = mean_of("close", w, half)
    df = df.withColumns(level)
    derived = {}
    for w in config.windows:
        high, low = known("high", w, at("high", "hi", w)), known("low", w, at("low", "lo", w))
        derived[f"price_to_sma_{w}"] = (F.col("close") - F.col(f"sma_{w}")) / (F.col("atr_14") + EPS)
        derived[f"high_low_range_{w}"] = ratio(high - low, "close")
        derived[f"range_expansion_{w}"] = F.col("range") / (mean_of("range", w) + EPS)
        derived[f"pct_from_high_{w}"] = ratio("close", high) - 1
        derived[f"pct_from_low_{w}"] = ratio("close", low) - 1
    derived["intraday_range"] = ratio("range", "close")
    derived["intraday_position"] = (F.col("close") - F.col("low")) / (F.col("range") + EPS)
    derived["open_to_close"] = ratio(F.col("close") - F.col("open"), "open")
    derived["gap"] = ratio(F.col("open") - lag("close"), lag("close"))
    return df.withColumns(derived)


def volume(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    v = F.col("volume")
    paired = F.col("log_return").isNotNull() & F.col("volume_change").isNotNull()
    df = df.withColumns({"_x": F.when(paired, F.col("log_return")), "_y": F.when(paired, F.col("volume_change"))})
    df = df.withColumns({f"_sorted_{w}": sorted_over("volume", back(w)) for w in config.windows})
    level = {}
    for w in config.windows:
        level[f"volume_zscore_{w}"] = (v - mean_of("volume", w)) / (deviation_of("volume", w) + EPS)
        level[f"volume_surge_{w}"] = known("volume", w, v / (sorted_quantile(F.col(f"_sorted_{w}"), 0.5) + EPS))
        # The difference of two running sums w rows apart is the sum over the last w rows.
        level[f"obv_slope_{w}"] = F.when(F.col("rn") > w, at("flow", "s", w) / w)
        level[f"vwap_{w}"] = known("dollar", w, at("dollar", "s", w) / (at("volume", "s", w) + EPS))
    for w in (10, 20, 40):
        level[f"price_volume_corr_{w}"] = enough("_x", w, correlation("_x", "_y", back(w)))
    df = df.withColumns(level).drop("_x", "_y", *[f"_sorted_{w}" for w in config.windows])
    return df.withColumns(
        {f"price_to_vwap_{w}": F.col("close") / (F.col(f"vwap_{w}") + EPS) - 1 for w in config.windows}
    )


def structure(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    c = F.col("close")
    level = {}
    for w in config.windows:
        mean, dev = mean_of("close", w), deviation_of("close", w)
        level[f"bb_width_{w}"] = 2 * dev / (mean + EPS)
        level[f"bb_position_{w}"] = (c - mean) / (2 * dev + EPS)
        strength = (at("gain", "s", w) / w) / (at("loss", "s", w) / w + EPS)
        level[f"rsi_{w}"] = F.when(F.col("rn") >= w, 100 - 100 / (1 + strength))
        high, low = known("high", w, at("high", "hi", w)), known("low", w, at("low", "lo", w))
        level[f"stoch_k_{w}"] = (c - low) / (high - low + EPS) * 100
    for w in (10, 20, 40):
        if w in config.windows:
            top, bottom = known("close", w, at("close", "hi", w)), known("close", w, at("close", "lo", w))
        else:
            top, bottom = rolling(F.max, "close", w), rolling(F.min, "close", w)
        level[f"pullback_from_high_{w}"] = (c - top) / (top + EPS)
        level[f"rally_from_low_{w}"] = (c - bottom) / (bottom + EPS)
    df = df.withColumns(level)
    return df.withColumns({f"stoch_d_{w}": rolling(F.avg, f"stoch_k_{w}", 3) for w in config.windows})


def local_extrema(df: DataFrame, reach: int = 5) -> DataFrame:
    """Centre of +-5 rows. Looks ahead, so it is an event column and not a model feature."""
    around = rows(-reach, reach)
    inside = (F.col("rn") > reach) & (F.col("rn") <= F.col("n") - reach)
    return df.withColumns(
        {
            "local_high_5": flag(inside & (F.col("high") == F.max("high").over(around))),
            "local_low_5": flag(inside & (F.col("low") == F.min("low").over(around))),
        }
    )


def rank_of_last(c: str, window: int) -> Column:
    """Percentile rank (0..1) of the newest of ``window`` values, ties averaged.

    Twice the smaller values plus the equal ones plus one, halved; the newest equals itself.
    """
    score = F.aggregate(
        F.collect_list(c).over(back(window)), F.lit(0),
        lambda s, x: s + F.when(x < F.col(c), 2).when(x == F.col(c), 1).otherwise(0),
    )
    return enough(c, window, (score + 1) * 50.0 / window / 100)


def multiscale(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Needs the price family."""
    means = [f"sma_{w}" for w in (5, 10, 20, 40) if w in config.windows]
    out = {}
    if len(means) >= 2:
        out["trend_alignment"] = sum(
            flag(F.col(a) > F.col(b)) for a, b in zip(means, means[1:])
        ) / F.lit(float(len(means) - 1))
    if 20 in config.windows:
        out["volatility_regime"] = rank_of_last("volatility_20", 252)
    if len(config.windows) >= 2:
        out["momentum_consistency"] = sum(
            flag(F.col(f"momentum_{w}") > 0) for w in config.windows
        ) / F.lit(float(len(config.windows)))
    return df.withColumns(out)


def curvature_weights(k: int) -> list[float]:
    """Row of the least-squares inverse that yields the quadratic coefficient on 0..k-1."""
    import numpy as np

    return np.linalg.pinv(np.vander(np.arange(k, dtype=float), 3))[0].tolist()


def shape(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    w = config.shape_window
    c, frame = F.col("close"), back(w)
    weights = F.array(*[F.lit(x) for x in curvature_weights(w)])
    products = F.zip_with(F.collect_list("close").over(frame), weights, lambda x, y: x * y)
    return df.withColumns(
        {
            f"shape_position_{w}": enough(
                c, w, (c - F.avg(c).over(frame)) / (F.stddev_samp(c).over(frame) + EPS)
            ),
            f"shape_slope_{w}": enough(c, w, F.regr_slope(c, F.col("rn").cast("double")).over(frame)),
            f"shape_curvature_{w}": enough(
                c, w, F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
            ),
            "return_zscore": return_zscore(w),
        }
    )


def sax_extremes(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.min("return_zscore").alias("_lo"), F.max("return_zscore").alias("_hi"))


def sax_symbol(bins: int) -> Column:
    x, lo, hi = F.col("return_zscore"), F.col("_lo"), F.col("_hi")
    # A series without spread is widened by a thousandth on both sides, as binning does.
    pad = F.when(hi == lo, F.when(lo == 0, F.lit(0.001)).otherwise(F.abs(lo) * 0.001)).otherwise(0.0)
    width = (hi - lo + 2 * pad) / bins
    symbol = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((x - lo + pad) / width) - 1))
    return F.when(x.isNotNull(), symbol.cast("int"))


def with_sax(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width, right-closed bins over the whole series' extremes. Takes core rows."""
    return df.join(sax_extremes(df), "symbol").withColumn("sax_symbol", sax_symbol(bins)).drop("_lo", "_hi")


def risk_adjusted(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    return df.withColumns(
        {
            f"risk_adjusted_return_{w}": F.col(f"momentum_{w}") / (F.col(f"volatility_{w}") + EPS)
            for w in (5, 10, 20)
            if w in config.windows
        }
    )


def divergence_parts(df: DataFrame, causal: bool = False) -> DataFrame:
    """Per-row trend and volume means the divergence flags compare."""
    out = {}
    for w in (10, 20):
        first = lag("close", w - 1)
        out[f"_trend_{w}"] = enough("close", w, F.when(F.col("close") > first, 1).otherwise(-1))
        out[f"_vmean_{w}"] = rolling(F.avg, "volume", w)
        if causal:
            out[f"_bench_{w}"] = rolling(F.avg, "volume", 2 * w)
    return df.withColumns(out)


def volume_benchmarks(df: DataFrame) -> DataFrame:
    """Mean volume of the last 2w rows of each series, where all of them are known."""

    def bench(w: int) -> Column:
        late = F.when(F.col("rn") > F.col("n") - 2 * w, F.col("volume"))
        return F.when(F.count(late) == 2 * w, F.avg(late)).alias(f"_bench_{w}")

    return df.groupBy("symbol").agg(bench(10), bench(20))


def divergence(df: DataFrame) -> DataFrame:
    """Does the volume trend contradict the price trend? Needs parts and benchmarks.

    The standard benchmark is the end of the series, so it looks ahead; the causal one is the
    mean of the 2w rows up to the current one. Rows without a full frame count as diverging.
    """
    out = {}
    for w in (10, 20):
        above = F.coalesce(F.col(f"_vmean_{w}") > F.col(f"_bench_{w}"), F.lit(False))
        trend = F.when(F.col(f"_vmean_{w}").isNotNull(), F.when(above, 1).otherwise(-1))
        out[f"price_volume_divergence_{w}"] = F.coalesce((F.col(f"_trend_{w}") != trend).cast("int"), F.lit(1))
    return df.withColumns(out).drop(*[f"{p}_{w}" for w in (10, 20) for p in ("_trend", "_vmean", "_bench")])


def with_divergence(df: DataFrame) -> DataFrame:
    """Flags for core rows that have the parts: joins the series' benchmarks."""
    return divergence(df.join(volume_benchmarks(df), "symbol"))


def _extreme_rows(df: DataFrame) -> DataFrame:
    """Latest-window extremes with their earliest row, for 20, 40 and 60 rows.

    Longer windows merge two shorter ones, as in :func:`moments`.
    """
    rn = F.col("rn")
    df = df.withColumns(
        {
            "_top": F.when(F.col("high").isNotNull(), F.struct(F.col("high").alias("v"), (-rn).alias("r"))),
            "_low": F.when(F.col("low").isNotNull(), F.struct(F.col("low").alias("v"), rn.alias("r"))),
        }
    )
    five = back(5)
    df = df.withColumns(
        {"_top_5": F.max("_top").over(five), "_low_5": F.min("_low").over(five), "_tn_5": F.count("high").over(five), "_ln_5": F.count("low").over(five)}
    )
    for w, newer, older in ((10, 5, 5), (20, 10, 10), (40, 20, 20), (60, 20, 40)):
        df = df.withColumns(
            {
                f"_top_{w}": F.greatest(F.col(f"_top_{newer}"), lag(f"_top_{older}", newer)),
                f"_low_{w}": F.least(F.col(f"_low_{newer}"), lag(f"_low_{older}", newer)),
                f"_tn_{w}": F.col(f"_tn_{newer}") + F.coalesce(lag(f"_tn_{older}", newer), F.lit(0)),
                f"_ln_{w}": F.col(f"_ln_{newer}") + F.coalesce(lag(f"_ln_{older}", newer), F.lit(0)),
            }
        )
    return df


def timing(df: DataFrame) -> DataFrame:
    before = df.columns
    df = _extreme_rows(df)
    out = {}
    for w in (20, 40, 60):
        out[f"days_since_high_{w}"] = F.when(F.col(f"_tn_{w}") >= w, (F.col("rn") + F.col(f"_top_{w}.r")).cast("int"))
        out[f"days_since_low_{w}"] = F.when(F.col(f"_ln_{w}") >= w, (F.col("rn") - F.col(f"_low_{w}.r")).cast("int"))
    return autocorrelations(df.withColumns(out).select(*before, *out))


LAGS = (1, 5, 10, 20)


def autocorrelations(df: DataFrame, window: int = 60) -> DataFrame:
    """Correlation of returns with themselves ``k`` rows earlier, inside ``window`` rows.

    Sums over a window are differences of the shard's running sums: returns are small numbers
    around zero, so nothing is lost, and a row costs the same for any window. A constant
    window has no correlation; run lengths tell exactly where that is.
    """
    before = df.columns
    x = F.col("log_return")
    upto = rows(Window.unboundedPreceding, 0)
    df = df.withColumns({"_x": F.coalesce(x, F.lit(0.0)), "_moved": F.when(x.isNull() | lag(x).isNull() | (x != lag(x)), F.col("rn"))})
    sums = {"_sx": F.sum("_x"), "_sxx": F.sum(F.col("_x") * F.col("_x")), "_n": F.count(x), "_since": F.max("_moved")}
    sums = {name: total.over(upto) for name, total in sums.items()}
    sums.update({f"_p_{k}": F.col("_x") * lag("_x", k) for k in LAGS})
    df = df.withColumns(sums)
    df = df.withColumns({f"_sxy_{k}": F.sum(f"_p_{k}").over(upto) for k in LAGS} | {"_flat": F.col("rn") - F.col("_since") + 1})
    level = {}
    for k in LAGS:
        m = window - k

        def within(c: str, shift: int = 0) -> Column:
            end = lag(c, shift) if shift else F.col(c)
            return F.coalesce(end, F.lit(0.0)) - F.coalesce(lag(c, shift + m), F.lit(0.0))

        sx, sy = within("_sx"), within("_sx", k)
        vx, vy = within("_sxx") - sx * sx / m, within("_sxx", k) - sy * sy / m
        cov = within(f"_sxy_{k}") - sx * sy / m
        full = F.col("_n") - F.coalesce(lag("_n", window), F.lit(0)) >= window
        varied = (F.col("_flat") < m) & (lag("_flat", k) < m)
        level[f"autocorr_lag_{k}"] = F.when(full & varied, ratio(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))))
    return df.withColumns(level).select(*before, *level)


def streaks(df: DataFrame, size: int = SIZE) -> DataFrame:
    """Consecutive rises and falls. Takes core rows."""
    return streak(
        df, {"consecutive_up": F.col("log_return") > 0, "consecutive_down": F.col("log_return") < 0}, size
    )


def exponential(df: DataFrame, config: FeatureConfig = FeatureConfig(), more: dict[str, int] | None = None) -> DataFrame:
    spans = {f"ema_{w}": w for w in config.windows}
    return ema(df, "close", {**spans, **(more or {})}, {f"ema_{w}": max(1, w // 2) for w in config.windows})


MACD_SPANS = {"_fast": 12, "_slow": 26}


def macd(df: DataFrame) -> DataFrame:
    """Difference of two exponential means and its own smoothing; reuses the means if present."""
    if "_fast" not in df.columns:
        df = ema(df, "close", MACD_SPANS)
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = ema(df, "macd", {"macd_signal": 9})
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def return_zscore(w: int) -> Column:
    x, frame = F.col("log_return"), back(w)
    return enough(x, w, (x - F.avg(x).over(frame)) / (F.stddev_samp(x).over(frame) + EPS))


def narrow_rows(positioned: DataFrame, config: FeatureConfig = FeatureConfig(), size: int = SIZE) -> DataFrame:
    """The base columns with log return and its z-score, which the scans read."""
    framed = with_halo(positioned, before=config.shape_window + 1, size=size)
    framed = with_returns_and_range(framed).withColumn("return_zscore", return_zscore(config.shape_window))
    return core_rows(framed).drop("true_range")


def scans(positioned: DataFrame, config: FeatureConfig = FeatureConfig(), size: int = SIZE) -> DataFrame:
    """Whole-series features on the few base columns, before anything is widened.

    Scans and per-series statistics read their input more than once. Doing them first, on a
    stored narrow table, keeps the wide rolling plan a single pass.
    """
    narrow = cut(narrow_rows(positioned, config, size))
    out = macd(exponential(streaks(narrow, size), config, MACD_SPANS))
    if config.use_shapes and config.sax_bins > 0:
        out = out.join(sax_extremes(narrow), "symbol").withColumn("sax_symbol", sax_symbol(config.sax_bins)).drop("_lo", "_hi")
    if config.use_volume and not config.causal_divergence:
        out = out.join(volume_benchmarks(narrow), "symbol")
    return out.drop("return_zscore")


def bounded_features(framed: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    df = price(base(framed, config), config)
    if config.use_volume:
        df = volume(df, config)
    df = multiscale(local_extrema(structure(df, config)), config)
    if config.use_shapes:
        df = shape(df, config)
    df = risk_adjusted(df, config)
    if config.use_volume:
        df = divergence(divergence_parts(df, config.causal_divergence))
    df = timing(df)
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def features(positioned: DataFrame, config: FeatureConfig = FeatureConfig(), size: int = SIZE) -> DataFrame:
    """All feature columns for clean rows with ``rn`` and ``n``."""
    framed = with_halo(scans(positioned, config, size), before=warmup(config), after=5, size=size)
    return core_rows(bounded_features(framed, config))


def warmup(config: FeatureConfig = FeatureConfig()) -> int:
    """How many earlier rows the bounded features of a row look at."""
    return max(WARMUP, 2 * max(config.windows) + 1)


def feature_names(config: FeatureConfig = FeatureConfig()) -> list[str]:
    """The model's columns. Labels and look-ahead events are not in it and cannot get in."""
    names: list[str] = ["day_of_week", "month", "quarter", "day_of_month", "week_of_year"]
    names += ["is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end"]
    per = ["momentum", "volatility", "sma", "ema", "price_to_sma", "high_low_range", "range_expansion"]
    per += ["pct_from_high", "pct_from_low", "bb_width", "bb_position", "rsi", "stoch_k", "stoch_d"]
    if config.use_volume:
        per += ["volume_zscore", "volume_surge", "obv_slope", "vwap", "price_to_vwap"]
        names += [f"price_volume_corr_{w}" for w in (10, 20, 40)]
    names += [f"{p}_{w}" for p in per for w in config.windows]
    names += ["atr_14", "intraday_range", "intraday_position", "open_to_close"]
    names += ["macd", "macd_signal", "macd_histogram", "consecutive_up", "consecutive_down"]
    names += [f"{p}_{w}" for p in ("pullback_from_high", "rally_from_low") for w in (10, 20, 40)]
    names += ["trend_alignment", "volatility_regime", "momentum_consistency"]
    if config.use_shapes:
        k = config.shape_window
        names += [f"shape_position_{k}", f"shape_slope_{k}", f"shape_curvature_{k}"]
        if config.sax_bins > 0:
            names += ["sax_symbol"]
    names += [f"risk_adjusted_return_{w}" for w in (5, 10, 20) if w in config.windows]
    if config.use_volume:
        names += [f"price_volume_divergence_{w}" for w in (10, 20)]
    names += [f"days_since_{s}_{w}" for s in ("high", "low") for w in (20, 40, 60)]
    names += [f"autocorr_lag_{k}" for k in (1, 5, 10, 20)]
    return names
