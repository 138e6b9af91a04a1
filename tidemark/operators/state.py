"""Features of new bars from saved state: one row per symbol stands for its whole history.

Most features look back a bounded number of rows. The few that do not (exponential means, run lengths, extremes of a whole series)
are recursions: their value at the last row, kept in a state table, is all that later rows need. New bars are then featured from the state and
the last ``warmup + 1`` clean bars, and give the state after them, so scoring a day does not read the years before it.

A series must have passed the warm-up of its exponential means (half the widest window) before its state is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.config import FeatureConfig
from tidemark.operators import features as X
from tidemark.operators.frame import SIZE, core_rows, ema, position, running, with_halo
from tidemark.session import cut

SIGNAL = {"macd_signal": 9}


def _spans(config: FeatureConfig) -> dict[str, int]:
    return {**{f"ema_{w}": w for w in config.windows}, **X.MACD_SPANS}


def _last(rows: DataFrame, config: FeatureConfig) -> DataFrame:
    kept = [F.col(c).alias(f"s_{c}") for c in (*_spans(config), *SIGNAL, "consecutive_up", "consecutive_down")]
    return rows.filter("rn = n").select("symbol", F.col("n").alias("s_n"), F.col("ts").alias("s_ts"), *kept)


def snapshot(positioned: DataFrame, config: FeatureConfig = FeatureConfig(), size: int = SIZE) -> DataFrame:
    """The state of each series after its last row: (symbol, s_n, s_ts, a column per mean and run, s_lo, s_hi)."""
    narrow = cut(X.narrow_rows(positioned, config, size))
    means = ema(X.streaks(narrow, size), "close", _spans(config)).withColumn("macd", F.col("_fast") - F.col("_slow"))
    ends = _last(ema(means, "macd", SIGNAL), config)
    return ends.join(X.sax_extremes(narrow).withColumnsRenamed({"_lo": "s_lo", "_hi": "s_hi"}), "symbol")


def numbered(state: DataFrame, recent: DataFrame, size: int = SIZE) -> DataFrame:
    """``recent`` clean rows (the last ones of the state's history with their ``rn``, and new ones without) with ``rn`` and ``n`` throughout.

    New rows are those after the state's time; they are numbered in shards like any series, without one task per symbol.
    """
    known = state.select("symbol", "s_n", "s_ts")
    marked = recent.drop("n").join(known, "symbol")
    old, new = marked.filter("ts <= s_ts"), marked.filter("ts > s_ts").drop("rn")
    placed = position(new, size=size).withColumn("rn", F.col("rn") + F.col("s_n"))
    counts = placed.groupBy("symbol").agg(F.max(F.col("n") + F.col("s_n")).alias("n"))
    return old.unionByName(placed.drop("n")).join(counts, "symbol")


def advance(state: DataFrame, recent: DataFrame, config: FeatureConfig = FeatureConfig(), size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Features of the new rows in ``recent``, equal to those from the whole history, and the state after them.

    ``recent`` holds, per symbol, the last ``features.warmup(config) + 1`` rows of the history (with ``rn``) and the new rows; symbols without
    new rows get neither features nor a new state.
    """
    state = cut(state)
    spans = _spans(config)
    rows = cut(numbered(state, recent, size))
    base = cut(X.narrow_rows(rows, config, size).join(state.drop("s_n", "s_ts"), "symbol"))
    new = base.filter("rn > s_n")
    # the state's last row starts each mean with the mean's own value
    seeds = {name: f"_x_{name}" for name in spans}
    at = F.col("rn") == F.col("s_n")
    started = base.filter("rn >= s_n").withColumns({x: F.when(at, F.col(f"s_{n}")).otherwise(F.col("close")) for n, x in seeds.items()})
    means = ema(started, seeds, spans).withColumn("macd", F.col("_fast") - F.col("_slow"))
    means = ema(means.withColumn("_x_signal", F.when(at, F.col("s_macd_signal")).otherwise(F.col("macd"))), {"macd_signal": "_x_signal"}, SIGNAL)
    ups = {"consecutive_up": F.col("log_return") > 0, "consecutive_down": F.col("log_return") < 0}
    broken = {f"_b_{n}": ("max", F.when(~F.coalesce(c, F.lit(False)), F.col("rn"))) for n, c in ups.items()}
    runs = running(means.filter("rn > s_n"), broken, size=size, stored=True).withColumns(
        {n: (F.col("rn") - F.coalesce(F.col(f"_b_{n}"), F.col("s_n") - F.col(f"s_{n}"))).cast("int") for n in ups})
    scanned = cut(runs.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop(*broken, *seeds.values(), "_x_signal"))

    extremes = new.groupBy("symbol").agg(F.min("return_zscore").alias("n_lo"), F.max("return_zscore").alias("n_hi"))
    bounds = cut(state.select("symbol", "s_lo", "s_hi").join(extremes, "symbol").select(
        "symbol", F.least("s_lo", "n_lo").alias("_lo"), F.greatest("s_hi", "n_hi").alias("_hi")))
    after = _last(scanned, config).join(bounds.withColumnsRenamed({"_lo": "s_lo", "_hi": "s_hi"}), "symbol")

    given = [c for c in scanned.columns if not c.startswith("s_") and c not in ("_fast", "_slow")]
    held = base.filter("rn <= s_n").select("s_n", *[F.col(c) if c in base.columns else F.lit(None).cast(scanned.schema[c].dataType).alias(c) for c in given])
    wide = held.unionByName(scanned.select("s_n", *given))
    if config.use_shapes and config.sax_bins > 0:
        wide = wide.join(bounds, "symbol").withColumn("sax_symbol", X.sax_symbol(config.sax_bins)).drop("_lo", "_hi")
    if config.use_volume and not config.causal_divergence:
        wide = wide.join(X.volume_benchmarks(base), "symbol")
    framed = with_halo(wide.drop("return_zscore"), before=X.warmup(config), after=5, size=size)
    found = X.bounded_features(framed.withColumnRenamed("s_n", "after_row"), config)
    return core_rows(found.filter("rn > after_row")).drop("after_row"), after
