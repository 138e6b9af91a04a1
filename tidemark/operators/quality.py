"""Row checks, outlier flags, gap filling, normalisation and the preprocessing plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.config import QualityConfig
from tidemark.functions.exprs import EPS, back, lag, ratio, sorted_over, sorted_quantile
from tidemark.operators.frame import SIZE, core_rows, position, running, with_halo
from tidemark.session import cut, written
from tidemark.sources.bars import PRICES, date_range

VALUES = (*PRICES, "volume")


def history_report(bars: DataFrame, min_rows: int = 252) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "enough", F.col("n_rows") >= min_rows
    )


def require_history(bars: DataFrame, min_rows: int = 252) -> DataFrame:
    """Keep symbols that have enough bars."""
    kept = history_report(bars, min_rows).filter("enough").select("symbol")
    return bars.join(kept, "symbol", "left_semi")


def missing_rate(bars: DataFrame, limit: float = 0.05) -> DataFrame:
    nulls = sum(F.col(p).isNull().cast("int") for p in PRICES)
    return (
        bars.groupBy("symbol")
        .agg((F.sum(nulls) / (4 * F.count(F.lit(1)))).alias("missing_rate"))
        .withColumn("too_many", F.col("missing_rate") > limit)
    )


def _keep(bad: Column) -> Column:
    return ~F.coalesce(bad, F.lit(False))


def drop_invalid_high(bars: DataFrame) -> DataFrame:
    """A null comparison is not a violation, so rows with null prices stay."""
    bad = F.lit(False)
    for other in ("low", "open", "close"):
        bad = bad | F.coalesce(F.col("high") < F.col(other), F.lit(False))
    return bars.filter(~bad)


def drop_non_positive(bars: DataFrame) -> DataFrame:
    for p in PRICES:
        bars = bars.filter(_keep(F.col(p) <= 0))
    return bars


def flag_outliers(bars: DataFrame, config: QualityConfig = QualityConfig(), size: int = SIZE) -> DataFrame:
    """Returns, gaps and outlier flags. Expects rows with ``rn`` and ``n``."""
    framed = with_halo(bars, before=1, size=size)
    prev = lag("close")
    with_return = core_rows(
        framed.withColumn("return", ratio(F.col("close"), prev) - 1).withColumn(
            "gap", ratio(F.col("open") - prev, prev)
        )
    )
    moments = with_return.groupBy("symbol").agg(
        F.avg("return").alias("_mean"), F.stddev_samp("return").alias("_std")
    )
    score = ratio(F.abs(F.col("return") - F.col("_mean")), F.col("_std"))
    flags = with_return.join(moments, "symbol")
    flags = flags.withColumn("outlier_zscore", F.coalesce(score > config.outlier_sigmas, F.lit(False)))
    flags = flags.withColumn(
        "outlier_return", F.coalesce(F.abs("return") > config.outlier_return, F.lit(False))
    )
    flags = flags.withColumn("is_outlier", F.col("outlier_zscore") | F.col("outlier_return"))
    flags = flags.withColumn("large_gap", F.coalesce(F.abs("gap") > config.large_gap, F.lit(False)))
    return flags.drop("_mean", "_std")


def forward_fill(bars: DataFrame, columns: tuple[str, ...] = VALUES, size: int = SIZE) -> DataFrame:
    """Latest non-null value so far, over gaps of any length."""
    filled = running(bars, {f"_f_{c}": ("last", F.col(c)) for c in columns}, size=size)
    return filled.select(*[F.col(f"_f_{c}").alias(c) if c in columns else F.col(c) for c in bars.columns])


def interpolate(bars: DataFrame, columns: tuple[str, ...] = VALUES, limit: int = 5, size: int = SIZE) -> DataFrame:
    """Linear by position, at most ``limit`` rows into a gap; a trailing gap repeats the last value."""
    marks = {}
    for c in columns:
        marks[f"_{c}"] = ("last", F.when(F.col(c).isNotNull(), F.struct(F.col("rn").alias("at"), F.col(c).alias("v"))))
    forward = running(bars, {f"_p{k}": v for k, v in marks.items()}, size=size)
    both = running(forward, {f"_n{k}": v for k, v in marks.items()}, reverse=True, size=size)
    out = []
    for c in bars.columns:
        if c not in columns:
            out.append(F.col(c))
            continue
        p, q = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        step = (F.col("rn") - p["at"]) / (q["at"] - p["at"])
        line = F.when(q.isNull(), p["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * step)
        near = F.col("rn") - p["at"] <= limit
        out.append(F.when(F.col(c).isNotNull(), F.col(c)).when(near, line).alias(c))
    return both.select(*out)


def drop_missing(bars: DataFrame, columns: tuple[str, ...] = VALUES) -> DataFrame:
    return bars.dropna("any", subset=list(columns))


def fill_missing(bars: DataFrame, method: str = "forward_fill", size: int = SIZE) -> DataFrame:
    if method == "forward_fill":
        return forward_fill(bars, size=size)
    if method == "interpolate":
        return interpolate(bars, size=size)
    if method == "drop":
        return drop_missing(bars)
    raise ValueError(f"unknown method {method}")


# ---- columns over one shard ------------------------------------------------------------


def log_return() -> Column:
    return F.when(
        (F.col("close") > 0) & (lag("close") > 0), F.log(ratio(F.col("close"), lag("close")))
    )


def true_range() -> Column:
    prev = lag("close")
    return F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
    )


def with_returns_and_range(framed: DataFrame) -> DataFrame:
    return framed.withColumns({"log_return": log_return(), "true_range": true_range()})


def atr(window: int) -> Column:
    """Plain mean of the true range from the first row on."""
    return F.avg("true_range").over(back(window))


def normalized(c: str, method: str, window: int) -> Column:
    x, w = F.col(c), back(window)
    if method == "zscore":
        return (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + EPS)
    if method == "minmax":
        low = F.min(x).over(w)
        return (x - low) / (F.max(x).over(w) - low + EPS)
    if method == "robust":
        q = [sorted_quantile(F.col(f"_sorted_{c}"), p) for p in (0.25, 0.5, 0.75)]
        return (x - q[1]) / (q[2] - q[0] + EPS)
    raise ValueError(f"unknown method {method}")


def normalize(framed: DataFrame, method: str = "zscore", window: int = 252, columns: tuple[str, ...] = PRICES) -> DataFrame:
    helpers = [f"_sorted_{c}" for c in columns] if method == "robust" else []
    if helpers:
        framed = framed.withColumns({f"_sorted_{c}": sorted_over(c, back(window)) for c in columns})
    return framed.withColumns({f"{c}_norm": normalized(c, method, window) for c in columns}).drop(*helpers)


def calendar(df: DataFrame) -> DataFrame:
    day = F.col("ts").cast("date")
    month, quarter = F.trunc(day, "month"), F.trunc(day, "quarter")

    def same(a: Column, b: Column) -> Column:
        return (a == b).cast("int")

    return df.withColumns(
        {
            "day_of_week": F.weekday(day),
            "month": F.month(day),
            "quarter": F.quarter(day),
            "day_of_month": F.dayofmonth(day),
            "week_of_year": F.weekofyear(day),
            "is_month_start": same(day, month),
            "is_month_end": same(day, F.last_day(day)),
            "is_quarter_start": same(day, quarter),
            "is_quarter_end": same(day, F.date_sub(F.add_months(quarter, 3), 1)),
        }
    )


# ---- the preprocessing plan ------------------------------------------------------------


def validate(bars: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """Date range, minimum history, then the row checks, in that order.

    The bars of the range are written once: the checks and the numbering after them read them four times, and where
    they are made from ticks each read would aggregate all ticks again.
    """
    bars = written(date_range(bars, config.start_date, config.end_date))
    return drop_non_positive(drop_invalid_high(require_history(bars, config.min_rows)))


def clean(bars: DataFrame, config: QualityConfig = QualityConfig(), method: str = "forward_fill", size: int = SIZE) -> DataFrame:
    """Validated, flagged and filled rows with ``rn`` and ``n``.

    Forward filling carries the flags' return and gap too, as it fills every column. The
    rows are written three times on the way: every step reads its input more than once.
    """
    flagged = cut(flag_outliers(cut(position(validate(bars, config), size=size)), config, size))
    if method == "forward_fill":
        return forward_fill(flagged, (*VALUES, "return", "gap"), size)
    if method == "interpolate":
        return interpolate(flagged, (*VALUES, "return", "gap"), size=size)
    if method == "drop":
        kept = drop_missing(flagged, (*VALUES, "return", "gap")).drop("rn", "n")
        return position(kept, size=size)
    raise ValueError(f"unknown method {method}")


def preprocess(bars: DataFrame, config: QualityConfig = QualityConfig(), size: int = SIZE, method: str = "forward_fill") -> DataFrame:
    """Clean rows with log return, ATR 14/20/40 and normalised prices."""
    framed = with_halo(clean(bars, config, method, size), before=config.normalization_window + 1, size=size)
    framed = with_returns_and_range(framed)
    framed = framed.withColumns({f"atr_{w}": atr(w) for w in (14, 20, 40)})
    framed = normalize(framed, config.normalization, config.normalization_window)
    return core_rows(framed).drop("true_range")


def metadata(bars: DataFrame, config: QualityConfig = QualityConfig(), size: int = SIZE, method: str = "forward_fill") -> DataFrame:
    """One row per symbol about the preprocessed bars; filling keeps every row, dropping those without a gap in any column."""
    flagged = flag_outliers(cut(position(validate(bars, config), size=size)), config, size)
    whole = F.lit(True)
    if method == "drop":
        for c in (*VALUES, "return", "gap"):
            whole = whole & F.col(c).isNotNull()
    return flagged.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows_initial"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        (F.count("volume") > 0).alias("has_volume"),
        F.sum(F.col("is_outlier").cast("int")).alias("n_outliers"),
        F.count_if(whole).alias("n_rows_after_cleaning"),
    )
