"""Bars derived from the given tables, once for Spark and once as SQL common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.frame import position
from tidemark.sources.bars import bars_from_ticks

EPS = "1e-8"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per return flag; the level makes every event label fire."""
    ticks = table(spark, sf, "lineitem")
    dd = F.date_diff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")) + 7 * F.ascii("l_returnflag")
    d = F.col("dd")
    level = (
        100
        + F.sin(2 * F.pi() * d / 167)
        + F.when(d % 90 >= 45, 4).otherwise(0)
        + F.when(d % 500 >= 250, 12).otherwise(0)
        - F.when(d % 251 < 20, F.lit(1.2) * (10 - F.abs(d % 251 - 10))).otherwise(0.0)
    )
    ticks = ticks.withColumn("dd", dd)
    ticks = ticks.withColumn("p", level * (1 + (F.col("l_quantity") - 25.5) / 25.5 * 0.01))
    ticks = ticks.withColumn("q", F.col("l_quantity") * F.when(d % 45 <= 3, 4).otherwise(1))
    tie = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    return bars_from_ticks(ticks, F.col("l_returnflag"), F.col("l_shipdate"), F.col("p"), F.col("q"), tie)


def placed(spark: SparkSession, sf: str) -> DataFrame:
    return position(bars(spark, sf))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return bars_from_ticks(
        e, F.col("event_type"), F.col("ts"), F.col("value"), F.lit(1.0), [F.col("event_id")], "hour"
    )


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Placed bars with nulls, runs of nulls, bad highs, bad lows and price spikes."""
    rn = F.col("rn")
    b = placed(spark, sf)
    gone = (rn % 97 == 5) | ((rn % 401 >= 50) & (rn % 401 < 57))
    close = F.when(gone, None).when(rn % 503 == 11, F.col("close") * 1.8).otherwise(F.col("close"))
    high = F.when(rn % 211 == 7, F.col("low") - 1).when(rn % 503 == 11, F.col("high") * 1.8).otherwise(F.col("high"))
    low = F.when(rn % 307 == 9, -1.0).otherwise(F.col("low"))
    return b.withColumns({"close": close, "high": high, "low": low})


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """A deterministic score in [0, 1] per placed bar: the 10-row momentum, scaled and clipped."""
    from tidemark.operators import features as X
    from tidemark.operators.frame import core_rows, with_halo
    from tidemark.functions.exprs import lag, ratio

    b = with_halo(placed(spark, sf), before=10)
    b = core_rows(b.withColumn("momentum_10", ratio("close", lag("close", 10)) - 1))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 4 * F.col("momentum_10")))
    return b.withColumn("score", F.round(F.coalesce(score, F.lit(0.5)), 6))


BARS_SQL = """
ticks AS (
  SELECT l_returnflag AS symbol, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + 7 * ascii(l_returnflag) AS dd
  FROM lineitem),
priced AS (
  SELECT *, (100 + sin(2 * pi() * dd / 167) + (CASE WHEN dd % 90 >= 45 THEN 4 ELSE 0 END)
      + (CASE WHEN dd % 500 >= 250 THEN 12 ELSE 0 END)
      - (CASE WHEN dd % 251 < 20 THEN CAST(1.2 AS DOUBLE) * (10 - abs(dd % 251 - 10)) ELSE 0 END))
      * (1 + (l_quantity - 25.5) / 25.5 * CAST(0.01 AS DOUBLE)) AS p,
      l_quantity * (CASE WHEN dd % 45 <= 3 THEN 4 ELSE 1 END) AS q
  FROM ticks),
bars AS (
  SELECT symbol, ts,
    arg_min(p, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)) AS open,
    max(p) AS high, min(p) AS low,
    arg_max(p, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)) AS close,
    CAST(sum(q) AS DOUBLE) AS volume
  FROM priced GROUP BY symbol, ts),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n
  FROM bars)"""

DIRTY_SQL = BARS_SQL + """,
dirty AS MATERIALIZED (
  SELECT symbol, ts, open,
    CASE WHEN rn % 211 = 7 THEN low - 1 WHEN rn % 503 = 11 THEN high * CAST(1.8 AS DOUBLE) ELSE high END AS high,
    CASE WHEN rn % 307 = 9 THEN -1.0 ELSE low END AS low,
    CASE WHEN rn % 97 = 5 OR (rn % 401 >= 50 AND rn % 401 < 57) THEN NULL
         WHEN rn % 503 = 11 THEN close * CAST(1.8 AS DOUBLE) ELSE close END AS close,
    volume, rn, n
  FROM placed)"""

BASE_SQL = BARS_SQL + """,
lagged AS (
  SELECT *, lag(close) OVER w AS prev, lag(volume) OVER w AS pvol FROM placed
  WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
base AS MATERIALIZED (
  SELECT *, ln(close / prev) AS lr, close - prev AS delta, high - low AS rng, volume / nullif(pvol, 0) - 1 AS vch,
    close * volume AS dollar, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr
  FROM lagged)"""

ATR_SQL = BASE_SQL + """,
ranged AS MATERIALIZED (
  SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr
  FROM base)"""

SCORES_SQL = BARS_SQL + """,
moved AS (SELECT *, close / lag(close, 10) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS mom FROM placed),
scores AS MATERIALIZED (
  SELECT * EXCLUDE (mom), round(coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + 4 * mom)), 0.5), 6) AS score FROM moved)"""


def back(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def span(first: int, last: int) -> str:
    def edge(i: int) -> str:
        return "CURRENT ROW" if i == 0 else f"{abs(i)} {'PRECEDING' if i < 0 else 'FOLLOWING'}"

    return f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {edge(first)} AND {edge(last)})"


SYM = "(PARTITION BY symbol ORDER BY rn)"


def r(expr: str, name: str, digits: int = 6) -> str:
    """Rounded SQL column; adding zero turns a negative zero into zero."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def full(c: str, k: int, expr: str, need: int | None = None) -> str:
    return f"CASE WHEN count({c}) OVER {back(k)} >= {need or k} THEN {expr} END"


def out(df: DataFrame, ints: tuple[str, ...] = (), digits: int = 6, keys: tuple[str, ...] = ("symbol", "ts"), **cols) -> DataFrame:
    """Keys as text, integers as bigint, doubles rounded: the form the comparison hashes."""
    picked = [F.col(k).cast("string").alias(k) for k in keys]
    picked += [F.col(c).cast("bigint").alias(c) for c in ints]
    picked += [
        (F.round(F.col(c).cast("double"), d if d is not None else digits) + 0.0).alias(c) for c, d in cols.items()
    ]
    return df.select(*picked)
