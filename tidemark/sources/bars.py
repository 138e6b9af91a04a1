"""Bars in: from ticks, from files, from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
PRICES = ("open", "high", "low", "close")


def bars_from_ticks(
    ticks: DataFrame, symbol: Column, ts: Column, price: Column, size: Column, tie: list[Column], grain: str = "day"
) -> DataFrame:
    """Aggregate ticks to one bar per symbol and day or hour.

    First and last tick are found by ``min_by``/``max_by``, so all of it combines before the
    shuffle and a busy symbol costs no more than any other key. Tasks sort their ticks for it, by time
    first: times differ in their first eight bytes, which are compared without reading the rows, symbols are few.
    """
    start = ts.cast("date").cast("timestamp_ntz")
    if grain == "hour":
        start = start + F.make_dt_interval(F.lit(0), F.hour(ts))
    elif grain != "day":
        raise ValueError(grain)
    when = F.struct(ts, *tie)
    return (
        ticks.select(
            symbol.alias("symbol"), start.alias("ts"), when.alias("_at"), price.alias("_p"), size.alias("_q")
        )
        .groupBy("ts", "symbol")
        .agg(
            F.min_by("_p", "_at").alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.max_by("_p", "_at").alias("close"),
            F.sum("_q").alias("volume"),
        )
        .select("symbol", "ts", *PRICES, "volume")
    )


def load_bars(df: DataFrame, columns: dict[str, str] | None = None, symbol: str | None = None) -> DataFrame:
    """Bring any bar table to the canonical schema.

    ``columns`` maps canonical names to the table's names; names match without regard to
    case. A missing price or date column is an error, a missing volume becomes null, and
    NaN becomes null. Row order is not stored: operators order by ``ts``.
    """
    have = {c.lower(): c for c in df.columns}
    given = {k: v for k, v in (columns or {}).items()}

    def source(name: str, *aliases: str) -> Column | None:
        for candidate in (given.get(name), name, *aliases):
            if candidate and candidate.lower() in have:
                return F.col(f"`{have[candidate.lower()]}`")
        return None

    found = {p: source(p) for p in PRICES}
    missing = [p for p, c in found.items() if c is None]
    when = source("ts", "date")
    if when is None:
        missing.append("ts")
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    name = F.lit(symbol) if symbol is not None else source("symbol")
    if name is None:
        raise ValueError("missing symbol: name the column or give a constant")
    volume = source("volume")

    def number(c: Column | None) -> Column:
        if c is None:
            return F.lit(None).cast("double")
        c = c.cast("double")
        return F.when(~F.isnan(c), c)

    return df.select(
        name.cast("string").alias("symbol"),
        when.cast("timestamp_ntz").alias("ts"),
        *[number(found[p]).alias(p) for p in PRICES],
        number(volume).alias("volume"),
    )


def read_parquet_bars(spark: SparkSession, path: str, **options) -> DataFrame:
    return load_bars(spark.read.parquet(path), **options)


def read_csv_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """CSV with a header ``Date,Open,High,Low,Close[,Volume]`` and an optional ``Symbol``.

    The columns are taken from the header by name; values are read as text and cast,
    so no inference pass runs over the files.
    """
    return load_bars(spark.read.csv(path, header=True), symbol=symbol)


def date_range(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive at both ends; reaches the parquet scan as a pushed filter."""
    if start:
        bars = bars.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        bars = bars.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return bars
