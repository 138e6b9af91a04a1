"""Long-only backtest with costs, as scans and aggregations instead of an event loop.

A position opens when yesterday's signal is the first positive one after a flat stretch and
closes at the next negative one, so it is the sign of the latest non-zero signal. One round
trip multiplies cash by a factor that depends only on its entry and exit price, which turns
the cash curve into a running sum of logarithms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.config import EvaluationConfig
from tidemark.functions.exprs import EPS, lag, ratio
from tidemark.operators.frame import SIZE, core_rows, running, with_halo
from tidemark.session import cut

SYMBOL = ("symbol",)


def signal_of(score: Column, threshold: Column) -> Column:
    """Sell below 1 - threshold wins over buy at threshold and above."""
    return F.when(score < 1 - threshold, -1).when(score >= threshold, 1).otherwise(0)


def signals_from_scores(df: DataFrame, threshold: float = 0.5, score: str = "score") -> DataFrame:
    return df.withColumn("signal", signal_of(F.col(score), F.lit(threshold)))


def delayed(df: DataFrame, c: str, size: int = SIZE) -> DataFrame:
    """``c`` one and two rows ago, for rows with ``rn`` and ``n``."""
    framed = with_halo(df, before=2, size=size)
    return core_rows(framed.withColumns({"_s1": lag(c, 1), "_s2": lag(c, 2)}))


def positions(df: DataFrame, keys: tuple[str, ...] = SYMBOL, size: int = SIZE) -> DataFrame:
    """``long`` after today's trade and ``was_long`` before it, from the delayed signals."""

    def nonzero(c: str) -> Column:
        return F.when(F.col(c) != 0, F.col(c))

    out = running(df, {"_now": ("last", nonzero("_s1")), "_old": ("last", nonzero("_s2"))}, size=size, keys=keys, stored=True)
    return out.withColumns(
        {
            "long": F.coalesce(F.col("_now") > 0, F.lit(False)),
            "was_long": F.coalesce(F.col("_old") > 0, F.lit(False)),
        }
    ).drop("_now", "_old", "_s1", "_s2")


def equity_curve(
    delayed_signals: DataFrame, config: EvaluationConfig = EvaluationConfig(), keys: tuple[str, ...] = SYMBOL, size: int = SIZE
) -> DataFrame:
    """Per row: position, shares, value, cash, equity, and the trade the row belongs to."""
    p, k = config.position_share, config.commission
    cost = (config.spread_bps + config.slippage_bps) / 10000
    fill = F.col("open") if config.delay_days == 1 else F.col("close")
    df = positions(delayed_signals, keys, size)
    df = df.withColumns(
        {
            "enters": F.col("long") & ~F.col("was_long"),
            "leaves": ~F.col("long") & F.col("was_long"),
            "fill": fill,
        }
    )
    df = running(
        df,
        {
            "entry_price": ("last", F.when(F.col("enters"), F.col("fill") * (1 + cost))),
            "trade_no": ("sum", F.col("enters").cast("long")),
        },
        size=size, keys=keys, stored=True,
    )
    exit_price = F.when(F.col("leaves"), F.col("fill") * (1 - cost))
    df = df.withColumn("exit_price", exit_price)
    factor = 1 - p * (1 + k) + p * (1 - k) * ratio("exit_price", "entry_price")
    df = running(df, {"_growth": ("sum", F.log(factor))}, size=size, keys=keys, stored=True)
    base = config.capital * F.exp(F.coalesce("_growth", F.lit(0.0)))
    df = df.withColumn("_base", base)
    shares = F.when(F.col("long"), ratio(p * F.col("_base"), "entry_price")).otherwise(0.0)
    df = df.withColumn("shares", shares).withColumn("value", F.col("shares") * F.col("close"))
    cash = F.col("_base") * F.when(F.col("long"), 1 - p * (1 + k)).otherwise(1.0)
    return df.withColumn("cash", cash).withColumn("equity", F.col("cash") + F.col("value")).drop("_growth", "_base", "fill")


def trades(curve: DataFrame, keys: tuple[str, ...] = SYMBOL) -> DataFrame:
    """One row per trade; the last one may still be open."""
    events = curve.filter("enters OR leaves")

    def at(flag: str, c: str) -> Column:
        return F.max(F.when(F.col(flag), F.col(c)))

    out = events.groupBy(*keys, "trade_no").agg(
        at("enters", "ts").alias("entry_ts"),
        at("enters", "entry_price").alias("entry_price"),
        at("enters", "shares").alias("shares"),
        at("leaves", "ts").alias("exit_ts"),
        at("leaves", "exit_price").alias("exit_price"),
    )
    return out.withColumns(
        {
            "return": ratio(F.col("exit_price") - F.col("entry_price"), "entry_price"),
            "pnl": (F.col("exit_price") - F.col("entry_price")) * F.col("shares"),
            "holding_days": F.date_diff("exit_ts", "entry_ts"),
            "type": F.when(F.col("exit_ts").isNull(), "LONG_ENTRY").otherwise("COMPLETED_TRADE"),
        }
    )


def performance(
    curve: DataFrame, config: EvaluationConfig = EvaluationConfig(), keys: tuple[str, ...] = SYMBOL, size: int = SIZE
) -> DataFrame:
    """Return, risk and trade metrics per key. Reads the curve several times: store it first."""
    ks = list(keys)
    # Yesterday's equity, carried over the shard edge by the owning shard's halo.
    halo = with_halo(curve.select(*ks, "rn", "n", "equity"), before=1, size=size)
    from pyspark.sql import Window

    w = Window.partitionBy(*ks, "shard").orderBy("rn")
    rets = core_rows(halo.withColumn("_r", ratio("equity", F.lag("equity").over(w)) - 1))
    peaks = running(
        rets.withColumn("_e", F.when(F.col("rn") > 1, F.col("equity"))), {"_peak": ("max", F.col("_e"))}, size=size, keys=keys
    )
    year = F.sqrt(F.lit(252.0))
    risk = peaks.groupBy(*ks).agg(
        F.count("equity").alias("_n"),
        F.max_by("equity", "rn").alias("final_equity"),
        F.min_by("equity", "rn").alias("_first"),
        F.avg("_r").alias("_mean"),
        (F.stddev_samp("_r") * year).alias("volatility"),
        (F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))) * year).alias("_down"),
        F.count_if(F.col("_r") < 0).alias("_n_down"),
        F.min(ratio(F.col("_e") - F.col("_peak"), "_peak")).alias("max_drawdown"),
    )
    done = trades(curve, keys)
    ret = F.col("return")
    stats = done.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("num_trades"),
        F.avg(F.when(ret.isNotNull(), (ret > 0).cast("double"))).alias("win_rate"),
        F.avg(F.when(ret > 0, ret)).alias("avg_win"),
        F.avg(F.when(ret < 0, ret)).alias("avg_loss"),
        F.avg(ret).alias("avg_trade_return"),
    )
    out = risk.filter(F.col("_n") >= 2).join(stats, ks, "left").fillna(
        0, ["num_trades", "win_rate", "avg_win", "avg_loss", "avg_trade_return"]
    )
    growth = ratio("final_equity", "_first")
    win, loss, rate = F.col("avg_win"), F.col("avg_loss"), F.col("win_rate")
    out = out.withColumns(
        {
            "total_return": growth - 1,
            "cagr": F.pow(growth, F.lit(252.0) / F.col("_n")) - 1,
            "sharpe_ratio": F.col("_mean") * 252 / (F.col("volatility") + EPS),
            "sortino_ratio": ratio(F.col("_mean") * 252, F.when(F.col("_n_down") > 0, F.col("_down")).otherwise(EPS)),
            "profit_factor": F.coalesce(F.abs(ratio(win, loss)), F.lit(0.0)),
            "expectancy": rate * win - (1 - rate) * F.abs(loss),
        }
    )
    return out.select(*ks, *METRICS)


METRICS = (
    "total_return", "cagr", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "avg_win",
    "avg_loss", "profit_factor", "avg_trade_return", "expectancy", "num_trades", "final_equity",
)


def backtest(signals: DataFrame, config: EvaluationConfig = EvaluationConfig(), size: int = SIZE) -> dict[str, DataFrame]:
    """Curve, trades and metrics for rows with ``rn``, ``n``, prices and ``signal``."""
    curve = cut(equity_curve(delayed(signals, "signal", size), config, SYMBOL, size))
    return {"curve": curve, "trades": trades(curve), "metrics": performance(curve, config, SYMBOL, size)}


def strategy(scores: DataFrame, threshold: float = 0.5, config: EvaluationConfig = EvaluationConfig(), size: int = SIZE) -> dict[str, DataFrame]:
    return backtest(signals_from_scores(scores, threshold), config, size)


def default_thresholds() -> list[float]:
    return [round(0.30 + 0.02 * i, 2) for i in range(21)]


def threshold_sweep(
    scores: DataFrame, thresholds: list[float] | None = None, config: EvaluationConfig = EvaluationConfig(), size: int = SIZE
) -> DataFrame:
    """Metrics for every threshold in one job: the grid is exploded onto delayed scores."""
    grid = F.array(*[F.lit(t) for t in thresholds or default_thresholds()])
    keys = ("symbol", "threshold")
    df = delayed(scores.select("symbol", "ts", "rn", "n", "open", "close", "score"), "score", size).drop("score")
    df = df.withColumn("threshold", F.explode(grid))
    df = df.withColumns({c: signal_of(F.col(c), F.col("threshold")) for c in ("_s1", "_s2")})
    curve = cut(equity_curve(df, config, keys, size))
    return performance(curve, config, keys, size)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Highest Sharpe ratio per symbol; the lower threshold wins a tie."""
    best = F.max_by(F.struct("threshold", *METRICS), F.struct("sharpe_ratio", -F.col("threshold")))
    return sweep.groupBy("symbol").agg(best.alias("b")).select("symbol", "b.*")
