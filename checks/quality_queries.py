"""Sources, row checks, projections and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    BARS_SQL, BASE_SQL, DIRTY_SQL, SCORES_SQL, SYM, back, bars, dirty, hourly, out, placed, r, scores,
)
from tidemark.config import QualityConfig
from tidemark.functions.exprs import lag, ratio
from tidemark.operators import quality as Q
from tidemark.operators.backtest import signals_from_scores
from tidemark.operators.frame import core_rows, with_halo
from tidemark.sources import bars as S

QUERIES, SQL = {}, {}
OHLCV = dict(open=6, high=6, low=6, close=6, volume=6)
OHLCV_SQL = ", ".join(r(c, c) for c in OHLCV)
KEY = "symbol, CAST(ts AS VARCHAR) AS ts"


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


register("bars", lambda s, d: out(bars(s, d), **OHLCV), f"WITH {BARS_SQL} SELECT {KEY}, {OHLCV_SQL} FROM bars")

register(
    "bars_hourly",
    lambda s, d: out(hourly(s, d), **OHLCV),
    f"""WITH b AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
      arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM events GROUP BY event_type, date_trunc('hour', ts))
      SELECT {KEY}, {OHLCV_SQL} FROM b""",
)


def _load(s, d):
    raw = bars(s, d).select(
        "symbol", F.col("ts").cast("string").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), F.when(F.dayofmonth("ts") == 13, float("nan")).otherwise(F.col("close")).alias("Close"),
    )
    return out(S.load_bars(raw), **OHLCV)


register(
    "load_bars", _load,
    f"""WITH {BARS_SQL} SELECT {KEY}, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')},
    {r('CASE WHEN day(ts) = 13 THEN NULL ELSE close END', 'close')}, CAST(NULL AS DOUBLE) AS volume FROM bars""",
)
register(
    "date_range",
    lambda s, d: out(S.date_range(bars(s, d), "1995-03-01", "1996-06-30"), **OHLCV),
    f"WITH {BARS_SQL} SELECT {KEY}, {OHLCV_SQL} FROM bars WHERE ts >= TIMESTAMP '1995-03-01' AND ts <= TIMESTAMP '1996-06-30'",
)


def _short(s, d):
    b = placed(s, d)
    return b.filter((F.col("symbol") != "N") | (F.col("rn") <= 200))


SHORT = BARS_SQL + ", short AS (SELECT * FROM placed WHERE symbol <> 'N' OR rn <= 200)"
register(
    "history_report",
    lambda s, d: Q.history_report(_short(s, d)).select("symbol", "n_rows", F.col("enough").cast("int").alias("enough")),
    f"WITH {SHORT} SELECT symbol, count(*) AS n_rows, CAST(count(*) >= 252 AS INTEGER) AS enough FROM short GROUP BY symbol",
)
register(
    "require_history",
    lambda s, d: out(Q.require_history(_short(s, d)), **OHLCV),
    f"WITH {SHORT} SELECT {KEY}, {OHLCV_SQL} FROM short WHERE symbol IN (SELECT symbol FROM short GROUP BY symbol HAVING count(*) >= 252)",
)
register(
    "missing_rate",
    lambda s, d: Q.missing_rate(dirty(s, d), 0.005).select(
        "symbol", F.round("missing_rate", 8).alias("missing_rate"), F.col("too_many").cast("int").alias("too_many")
    ),
    f"""WITH {DIRTY_SQL}, m AS (SELECT symbol, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) / (4.0 * count(*)) AS x FROM dirty GROUP BY symbol)
    SELECT symbol, round(CAST(x AS DOUBLE), 8) AS missing_rate, CAST(x > 0.005 AS INTEGER) AS too_many FROM m""",
)
BAD_PRICE = "coalesce(open <= 0, FALSE) OR coalesce(high <= 0, FALSE) OR coalesce(low <= 0, FALSE) OR coalesce(close <= 0, FALSE)"
register(
    "drop_invalid_high",
    lambda s, d: out(Q.drop_invalid_high(dirty(s, d)), **OHLCV),
    f"WITH {DIRTY_SQL} SELECT {KEY}, {OHLCV_SQL} FROM dirty WHERE NOT (coalesce(high < low, FALSE) OR coalesce(high < open, FALSE) OR coalesce(high < close, FALSE))",
)
register(
    "drop_non_positive",
    lambda s, d: out(Q.drop_non_positive(dirty(s, d)), **OHLCV),
    f"WITH {DIRTY_SQL} SELECT {KEY}, {OHLCV_SQL} FROM dirty WHERE NOT ({BAD_PRICE})",
)

FLAGS = QualityConfig(outlier_sigmas=6.0, outlier_return=0.7)
OUTLIER_SQL = """
  ret AS (SELECT *, close / lag(close) OVER {w} - 1 AS ret, (open - lag(close) OVER {w}) / lag(close) OVER {w} AS gap FROM {src}),
  mom AS (SELECT symbol, avg(ret) AS mu, stddev_samp(ret) AS sd FROM ret GROUP BY symbol),
  flagged AS (SELECT ret.*, coalesce(abs(ret - mu) / nullif(sd, 0) > {sig}, FALSE) AS oz, coalesce(abs(ret) > {lim}, FALSE) AS orr FROM ret JOIN mom USING (symbol))"""
FLAG_COLS = dict(gap=6, **{"return": 6})
register(
    "outlier_flags",
    lambda s, d: out(
        Q.flag_outliers(dirty(s, d), FLAGS), ("outlier_zscore", "outlier_return", "is_outlier", "large_gap"), **FLAG_COLS
    ),
    f"""WITH {DIRTY_SQL}, {OUTLIER_SQL.format(w=SYM, src='dirty', sig=6.0, lim=0.7)}
    SELECT {KEY}, CAST(oz AS BIGINT) AS outlier_zscore, CAST(orr AS BIGINT) AS outlier_return, CAST(oz OR orr AS BIGINT) AS is_outlier,
      CAST(coalesce(abs(gap) > 0.1, FALSE) AS BIGINT) AS large_gap, {r('gap', 'gap')}, {r('ret', '"return"')} FROM flagged""",
)
FILLED = dict(close=6, high=6)
register(
    "forward_fill",
    lambda s, d: out(Q.forward_fill(dirty(s, d)), **FILLED),
    f"""WITH {DIRTY_SQL} SELECT {KEY}, {r('high', 'high')},
    {r(f'last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'close')} FROM dirty""",
)
register(
    "interpolate",
    lambda s, d: out(Q.interpolate(dirty(s, d), ("close",)), **FILLED),
    f"""WITH {DIRTY_SQL}, m AS (SELECT *, CASE WHEN close IS NOT NULL THEN rn END AS pos FROM dirty),
    e AS (SELECT *, max(pos) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
      min(pos) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS na FROM m),
    j AS (SELECT e.*, p.close AS pv, q.close AS nv FROM e LEFT JOIN dirty p ON p.symbol = e.symbol AND p.rn = e.pa
      LEFT JOIN dirty q ON q.symbol = e.symbol AND q.rn = e.na)
    SELECT {KEY}, {r('high', 'high')}, {r('''CASE WHEN close IS NOT NULL THEN close WHEN rn - pa > 5 THEN NULL
      WHEN na IS NULL THEN pv ELSE pv + (nv - pv) * (rn - pa) / (na - pa) END''', 'close')} FROM j""",
)
register(
    "drop_missing",
    lambda s, d: out(Q.drop_missing(dirty(s, d)), **FILLED),
    f"WITH {DIRTY_SQL} SELECT {KEY}, {r('high', 'high')}, {r('close', 'close')} FROM dirty WHERE close IS NOT NULL",
)

CLEAN_SQL = DIRTY_SQL + f""",
valid AS (SELECT * EXCLUDE (rn, n), row_number() OVER {SYM} AS rn FROM dirty
  WHERE NOT ({BAD_PRICE}) AND NOT (coalesce(high < low, FALSE) OR coalesce(high < open, FALSE) OR coalesce(high < close, FALSE))),
{OUTLIER_SQL.format(w=SYM, src='valid', sig=10.0, lim=0.5)},
filled AS MATERIALIZED (SELECT * EXCLUDE (close),
  last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM flagged),
fl AS (SELECT *, lag(close) OVER {SYM} AS prev FROM filled),
ft AS MATERIALIZED (SELECT *, ln(close / prev) AS lr, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM fl)"""
Z = ", ".join(
    r(f"({c} - avg({c}) OVER {back(252)}) / (stddev_samp({c}) OVER {back(252)} + 1e-8)", f"{c}_norm", 5)
    for c in ("open", "high", "low", "close")
)
register(
    "preprocess",
    lambda s, d: out(
        Q.preprocess(dirty(s, d).drop("rn", "n")), ("is_outlier",), close=6, log_return=6, atr_14=6, atr_20=6, atr_40=6,
        open_norm=5, high_norm=5, low_norm=5, close_norm=5,
    ),
    f"""WITH {CLEAN_SQL} SELECT {KEY}, CAST(oz OR orr AS BIGINT) AS is_outlier, {r('close', 'close')}, {r('lr', 'log_return')},
    {', '.join(r(f'avg(tr) OVER {back(k)}', f'atr_{k}') for k in (14, 20, 40))}, {Z} FROM ft""",
)
register(
    "preprocess_metadata",
    lambda s, d: Q.metadata(dirty(s, d).drop("rn", "n")).select(
        "symbol", "n_rows_initial", F.col("first_ts").cast("string").alias("first_ts"), F.col("last_ts").cast("string").alias("last_ts"),
        F.col("has_volume").cast("int").alias("has_volume"), "n_outliers", "n_rows_after_cleaning",
    ),
    f"""WITH {CLEAN_SQL} SELECT symbol, count(*) AS n_rows_initial, CAST(min(ts) AS VARCHAR) AS first_ts, CAST(max(ts) AS VARCHAR) AS last_ts,
    CAST(count(volume) > 0 AS INTEGER) AS has_volume, CAST(sum(CAST(oz OR orr AS INTEGER)) AS BIGINT) AS n_outliers, count(*) AS n_rows_after_cleaning
    FROM ft GROUP BY symbol""",
)


def framed(s, d, before):
    return with_halo(placed(s, d), before=before)


register(
    "log_return",
    lambda s, d: out(core_rows(Q.with_returns_and_range(framed(s, d, 1))), log_return=6),
    f"WITH {BASE_SQL} SELECT {KEY}, {r('lr', 'log_return')} FROM base",
)
register(
    "pct_change",
    lambda s, d: out(
        core_rows(framed(s, d, 40).withColumns({f"return_{k}": ratio("close", lag("close", k)) - 1 for k in (1, 3, 40)})),
        return_1=6, return_3=6, return_40=6,
    ),
    f"WITH {BARS_SQL} SELECT {KEY}, {', '.join(r(f'close / lag(close, {k}) OVER {SYM} - 1', f'return_{k}') for k in (1, 3, 40))} FROM placed",
)
register(
    "true_range",
    lambda s, d: out(core_rows(Q.with_returns_and_range(framed(s, d, 1))), true_range=6),
    f"WITH {BASE_SQL} SELECT {KEY}, {r('tr', 'true_range')} FROM base",
)
register(
    "atr",
    lambda s, d: out(
        core_rows(Q.with_returns_and_range(framed(s, d, 41)).withColumns({f"atr_{k}": Q.atr(k) for k in (14, 20, 40)})),
        atr_14=6, atr_20=6, atr_40=6,
    ),
    f"WITH {BASE_SQL} SELECT {KEY}, {', '.join(r(f'avg(tr) OVER {back(k)}', f'atr_{k}') for k in (14, 20, 40))} FROM base",
)
CAL = ("day_of_week", "month", "quarter", "day_of_month", "week_of_year", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end")
register(
    "calendar",
    lambda s, d: out(Q.calendar(bars(s, d)), CAL),
    f"""WITH {BARS_SQL}, c AS (SELECT *, CAST(ts AS DATE) AS day FROM bars)
    SELECT {KEY}, isodow(day) - 1 AS day_of_week, month(day) AS month, quarter(day) AS quarter, day(day) AS day_of_month, weekofyear(day) AS week_of_year,
    CAST(day(day) = 1 AS BIGINT) AS is_month_start, CAST(day = last_day(day) AS BIGINT) AS is_month_end,
    CAST(day = date_trunc('quarter', day) AS BIGINT) AS is_quarter_start,
    CAST(day = date_trunc('quarter', day) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS BIGINT) AS is_quarter_end FROM c""",
)
register(
    "signals_from_scores",
    lambda s, d: out(
        signals_from_scores(scores(s, d), 0.6).withColumn("low", F.col("signal")).drop("signal").transform(
            lambda x: signals_from_scores(x, 0.4)
        ).select("symbol", "ts", F.col("low").alias("signal_60"), F.col("signal").alias("signal_40"), "score"),
        ("signal_60", "signal_40"), score=6,
    ),
    f"""WITH {SCORES_SQL} SELECT {KEY}, CAST(CASE WHEN score < 0.4 THEN -1 WHEN score >= 0.6 THEN 1 ELSE 0 END AS BIGINT) AS signal_60,
    CAST(CASE WHEN score < 0.6 THEN -1 WHEN score >= 0.4 THEN 1 ELSE 0 END AS BIGINT) AS signal_40, {r('score', 'score')} FROM scores""",
)


def _norm(method):
    return lambda s, d: out(
        core_rows(Q.normalize(framed(s, d, 252), method)), open_norm=5, high_norm=5, low_norm=5, close_norm=5
    )


register("normalize_zscore", _norm("zscore"), f"WITH {BARS_SQL} SELECT {KEY}, {Z} FROM placed")
register(
    "normalize_minmax", _norm("minmax"),
    f"WITH {BARS_SQL} SELECT {KEY}, " + ", ".join(
        r(f"({c} - min({c}) OVER {back(252)}) / (max({c}) OVER {back(252)} - min({c}) OVER {back(252)} + 1e-8)", f"{c}_norm", 5)
        for c in ("open", "high", "low", "close")) + " FROM placed",
)
register(
    "normalize_robust", _norm("robust"),
    f"WITH {BARS_SQL} SELECT {KEY}, " + ", ".join(
        r(f"({c} - quantile_cont({c}, 0.5) OVER {back(252)}) / (quantile_cont({c}, 0.75) OVER {back(252)} - quantile_cont({c}, 0.25) OVER {back(252)} + 1e-8)", f"{c}_norm", 5)
        for c in ("open", "high", "low", "close")) + " FROM placed",
)
