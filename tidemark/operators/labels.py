"""Forward-looking event labels. Frames reach ahead, so labels live apart from features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.config import LabelConfig
from tidemark.functions.exprs import back, enough, flag, lag, lead, ratio, rows, sorted_quantile
from tidemark.operators.frame import SIZE, core_rows, running, with_halo
from tidemark.operators.quality import atr, with_returns_and_range
from tidemark.session import cut


def base(framed: DataFrame) -> DataFrame:
    framed = with_returns_and_range(framed)
    return framed.withColumn("atr_14", atr(14))


def usable(c: str = "atr_14") -> Column:
    return F.col(c).isNotNull() & (F.col(c) != 0)


def move(df: DataFrame, horizon: int, config: LabelConfig = LabelConfig(), compat: bool = False) -> DataFrame:
    """First barrier touched within ``horizon`` rows: 1 up, -1 down, 0 none.

    The last ``horizon`` rows have no full future: null, or 0 with ``compat``.
    """
    c, a = F.col("close"), F.col("atr_14")
    # structs, as collecting bare values would skip null closes and shift the rows after them
    future = F.transform(
        F.collect_list(F.struct("close")).over(rows(1, horizon)), lambda x: F.try_divide(x["close"] - c, c)
    )
    df = df.withColumn("_f", future)
    up = F.array_position(F.transform("_f", lambda x: x >= F.try_divide(config.atr_up * a, c)), True)
    down = F.array_position(F.transform("_f", lambda x: x <= -F.try_divide(config.atr_down * a, c)), True)
    df = df.withColumns({"_up": up, "_down": down})
    side = (
        F.when((F.col("_up") > 0) & ((F.col("_down") == 0) | (F.col("_up") < F.col("_down"))), 1)
        .when(F.col("_down") > 0, -1)
        .otherwise(0)
    )
    size = F.when(side == 1, F.array_max("_f")).when(side == -1, F.array_min("_f")).otherwise(F.get("_f", F.lit(horizon - 1)))
    known = F.col("rn") <= F.col("n") - horizon
    rest = F.lit(0 if compat else None)
    h = f"{horizon}d"
    df = df.withColumns(
        {
            f"label_move_{h}": F.when(known, F.when(usable(), side).otherwise(0)).otherwise(rest.cast("int")),
            f"magnitude_move_{h}": F.when(known, F.when(usable(), size).otherwise(0.0)).otherwise(rest.cast("double")),
            f"prob_move_{h}": F.lit(0.0),
        }
    )
    label = F.col(f"label_move_{h}")
    return df.withColumns(
        {f"label_up_{h}": (label == 1).cast("int"), f"label_down_{h}": (label == -1).cast("int")}
    ).drop("_f", "_up", "_down")


def consolidation(df: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """Shortest look-back whose range is narrow for its median ATR, and the breakout from it."""
    lo, hi = config.min_days, config.max_days
    past, near = rows(-hi, -1), rows(-lo, -1)
    df = df.withColumns(
        {
            "_p": F.collect_list(F.struct("high", "low", "atr_14", "volume")).over(past),
            "_range": F.max("high").over(near) - F.min("low").over(near),
            "_amax": F.max("atr_14").over(past),
            "_cmax": F.max("close").over(rows(0, config.confirm_days - 1)),
            "_cmin": F.min("close").over(rows(0, config.false_window - 1)),
            "_vmax": F.max("volume").over(rows(0, config.confirm_days - 1)),
        }
    )

    def newest(field: str, k: Column) -> Column:
        return F.slice("_p", -k, k)[field]

    def median(field: str, k: Column) -> Column:
        return sorted_quantile(F.sort_array(F.array_compact(newest(field, k))), 0.5)

    def candidate(k: Column) -> Column:
        return F.struct(
            k.alias("days"),
            F.array_max(newest("high", k)).alias("high"),
            F.array_min(newest("low", k)).alias("low"),
            median("atr_14", k).alias("median"),
        )

    fits = F.filter(
        F.transform(F.sequence(F.lit(lo), F.lit(hi)), candidate),
        lambda s: s["high"] - s["low"] <= config.width_multiplier * s["median"],
    )
    # No look-back can fit unless the shortest range is within the largest ATR of the frame,
    # which spares most rows the search. Without a price in the shortest range only longer ones can tell.
    narrow = F.col("_range").isNull() | (F.col("_range") <= config.width_multiplier * F.col("_amax"))
    possible = (F.col("rn") > hi) & usable() & narrow
    df = df.withColumn("_s", F.when(possible, F.get(fits, F.lit(0))))
    s = F.col("_s")
    df = df.withColumn("_vmed", F.when(s.isNotNull(), median("volume", s["days"])))
    level = s["high"] + config.breakout_atr * F.col("atr_14")
    confirmed = (
        F.when(F.col("_vmax").isNull(), True)
        .when(F.col("_vmed") > 0, F.col("_vmax") > config.breakout_volume * F.col("_vmed"))
        .otherwise(True)
    )
    broke = flag((F.col("rn") <= F.col("n") - config.confirm_days) & (F.col("_cmax") > level) & confirmed)
    fell = F.col("_cmin") < level - config.false_atr * F.col("atr_14")
    df = df.withColumns(
        {
            "in_consolidation": s.isNotNull().cast("int"),
            "consolidation_width": ratio(s["high"] - s["low"], s["median"]),
            "consolidation_days": F.coalesce(s["days"], F.lit(0)),
            "consolidation_breakout": broke,
            "false_breakout": flag((broke == 1) & (F.col("rn") <= F.col("n") - config.false_window) & fell),
        }
    )
    return df.drop("_p", "_range", "_amax", "_cmax", "_cmin", "_vmax", "_s", "_vmed")


def reversal(df: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    w = config.reversal_window
    a = F.col("atr_14")
    prior = F.col("close") - lag("close", w)
    ahead = lead("close", w - 1) - F.col("close")
    inside = (F.col("rn") > 2 * w) & (F.col("rn") <= F.col("n") - w) & usable()
    hit = (
        inside
        & (ratio(F.abs(prior), a) >= config.reversal_prior_atr)
        & (ratio(F.abs(ahead), a) >= config.reversal_change_atr)
        & ((prior > 0) != (ahead > 0))
    )
    return df.withColumns(
        {
            "trend_reversal": flag(hit),
            "reversal_strength": F.when(flag(hit) == 1, ratio(F.abs(ahead), a)).otherwise(0.0),
        }
    )


def regime(df: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    change = ratio("close", lag("close", config.regime_rows)) - 1
    name = F.when(change > config.regime_return, "bull").when(change < -config.regime_return, "bear").otherwise("sideways")
    df = df.withColumn("market_regime", name)
    return df.withColumns(
        {f"{zone}_zone": (F.col("market_regime") == zone).cast("int") for zone in ("bull", "bear", "sideways")}
    )


def momentum_burst(df: DataFrame) -> DataFrame:
    """Move part and volume part; :func:`with_burst` combines them per series."""
    change = ratio("close", lag("close", 3)) - 1
    deviation = enough("log_return", 20, F.stddev_samp("log_return").over(back(20)))
    middle = enough("volume", 20, sorted_quantile(F.sort_array(F.collect_list("volume").over(back(20))), 0.5))
    return df.withColumns({"_vm": middle}).withColumns(
        {
            "_burst": F.coalesce(F.abs(change) > 2 * deviation * F.sqrt(F.lit(3.0)), F.lit(False)),
            "_surge": F.coalesce(F.col("volume") > F.col("_vm") * 1.5, F.lit(False)),
        }
    )


def burst() -> Column:
    return (F.col("_burst") & (F.col("_surge") | ~F.col("_has"))).cast("int")


def with_burst(df: DataFrame) -> DataFrame:
    """Volume confirms only where the series has a volume median at all. Takes core rows."""
    has = df.groupBy("symbol").agg((F.count("_vm") > 0).alias("_has"))
    return df.join(has, "symbol").withColumn("momentum_burst", burst()).drop("_vm", "_burst", "_surge", "_has")


def v_reversal(df: DataFrame, w: int = 10) -> DataFrame:
    decline = ratio(lag("close", 1) - lag("close", w), lag("close", w))
    recovery = ratio(lead("close", w - 1) - F.col("close"), F.col("close"))
    trough = F.col("close") == F.min("close").over(rows(-w, w - 1))
    inside = (F.col("rn") > w) & (F.col("rn") <= F.col("n") - w)
    return df.withColumn("v_reversal", flag(inside & (decline < -0.05) & (recovery > 0.05) & trough))


def days_in_regime(df: DataFrame, size: int = SIZE) -> DataFrame:
    """Position inside the current run of ``market_regime``. Takes core rows with ``_new``."""
    starts = running(df, {"_start": ("max", F.when(F.col("_new"), F.col("rn")))}, size=size)
    return starts.withColumn("days_in_regime", (F.col("rn") - F.col("_start") + 1).cast("int")).drop("_start", "_new")


def mark_changes(df: DataFrame, c: str = "market_regime") -> DataFrame:
    return df.withColumn("_new", F.coalesce(F.col(c) != lag(c), F.lit(True)))


def labels(positioned: DataFrame, config: LabelConfig = LabelConfig(), compat: bool = False, size: int = SIZE) -> DataFrame:
    """All labels keyed by (symbol, ts) for clean rows with ``rn`` and ``n``.

    Regimes and their run lengths, and whether a series has volume, are settled first on the
    narrow rows; the forward-looking frames then take one pass.
    """
    early = with_halo(positioned.select("symbol", "ts", "rn", "n", "open", "high", "low", "close", "volume"), before=config.regime_rows + 1, size=size)
    early = cut(core_rows(mark_changes(regime(early, config)).withColumn("_v20", enough("volume", 20, F.lit(1)))))
    has = early.groupBy("symbol").agg((F.count("_v20") > 0).alias("_has"))
    early = days_in_regime(early, size).drop("_v20").join(has, "symbol")
    ahead = max(*config.horizons, config.false_window, config.reversal_window)
    before = max(config.max_days + 14 + 1, 2 * config.reversal_window, 22)
    df = base(with_halo(early, before=before, after=ahead, size=size))
    for h in config.horizons:
        df = move(df, h, config, compat)
    df = v_reversal(momentum_burst(reversal(consolidation(df, config), config)))
    df = core_rows(df).withColumn("momentum_burst", burst())
    return df.select("symbol", "ts", *label_columns(config)["all_outputs"])


def label_columns(config: LabelConfig = LabelConfig()) -> dict[str, list[str]]:
    hs = [f"{h}d" for h in config.horizons]
    events = ["in_consolidation", "consolidation_breakout", "false_breakout", "trend_reversal"]
    groups = {
        "move": [f"{p}_{h}" for h in hs for p in ("label_move", "label_up")],
        "breakout": ["in_consolidation", "consolidation_breakout", "false_breakout"],
        "reversal": ["trend_reversal", "v_reversal"],
        "cycle": ["bull_zone", "bear_zone", "sideways_zone", "market_regime"],
        "pattern": ["momentum_burst", "v_reversal", "consolidation_breakout"],
    }
    moves = [f"{p}_{h}" for h in hs for p in ("label_move", "label_up", "label_down")]
    groups["all"] = moves + events + ["bull_zone", "bear_zone", "momentum_burst", "v_reversal"]
    groups["all_outputs"] = (
        moves
        + [f"{p}_{h}" for h in hs for p in ("magnitude_move", "prob_move")]
        + events
        + ["consolidation_width", "consolidation_days", "reversal_strength", "market_regime"]
        + ["bull_zone", "bear_zone", "sideways_zone", "days_in_regime", "momentum_burst", "v_reversal"]
    )
    return groups


def label_statistics(labelled: DataFrame, config: LabelConfig = LabelConfig()) -> DataFrame:
    """One row per symbol and label; every label is counted in a single aggregation."""
    names = [f"label_move_{h}d" for h in config.horizons]
    names += ["in_consolidation", "consolidation_breakout", "false_breakout", "trend_reversal"]
    parts = []
    for name in names:
        c = F.col(name)
        strength = F.avg(F.when(c == 1, F.col("reversal_strength"))) if name == "trend_reversal" else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(name).alias("label"),
                F.count(c).alias("total"),
                F.count_if(c == 1).alias("ones"),
                F.count_if(c == -1).alias("minus_ones"),
                F.count_if(c == 0).alias("zeros"),
                strength.alias("avg_strength"),
            )
        )
    per = labelled.groupBy("symbol").agg(F.array(*parts).alias("s")).select("symbol", F.inline("s"))
    return per.withColumns(
        {
            "one_share": F.coalesce(ratio("ones", "total"), F.lit(0.0)),
            "minus_one_share": F.coalesce(ratio("minus_ones", "total"), F.lit(0.0)),
        }
    )
