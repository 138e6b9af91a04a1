"""One query per rolling feature family."""

from __future__ import annotations

import uuid

from checks.fixtures import ATR_SQL, BASE_SQL, SYM, back, full, out, placed, r, span
from tidemark.operators import features as X
from tidemark.operators.frame import core_rows, with_halo
from tidemark.operators.quality import with_returns_and_range
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import store

QUERIES, SQL = {}, {}
WINDOWS = (3, 5, 10, 20, 40, 80)
KEY = "symbol, CAST(ts AS VARCHAR) AS ts"


def register(name, query, sql):
    QUERIES[name], SQL[name] = query, sql


def framed(s, d, before=80, after=0):
    return X.base(with_halo(placed(s, d), before=before + 1, after=after))


def per_window(name, build, names, sql, windows=WINDOWS, digits=6, source="base", ctes=BASE_SQL, before=80):
    cols = {n.format(w=w): digits for n in names for w in windows}

    def query(s, d):
        return out(core_rows(build(framed(s, d, before))), **cols)

    exprs = ", ".join(r(e(w), n.format(w=w), digits) for n, e in zip(names, sql) for w in windows)
    register(name, query, f"WITH {ctes} SELECT {KEY}, {exprs} FROM {source}")


def half(w):
    return max(1, w // 2)


def hi(w):
    return full("high", w, f"max(high) OVER {back(w)}")


def lo(w):
    return full("low", w, f"min(low) OVER {back(w)}")


per_window("momentum", X.price, ["momentum_{w}"], [lambda w: f"close / nullif(lag(close, {w}) OVER {SYM}, 0) - 1"])
per_window("volatility", X.price, ["volatility_{w}"], [lambda w: full("lr", w, f"stddev_samp(lr) OVER {back(w)}", half(w))])
per_window("sma", X.price, ["sma_{w}"], [lambda w: full("close", w, f"avg(close) OVER {back(w)}", half(w))])
per_window(
    "price_to_sma", X.price, ["price_to_sma_{w}"],
    [lambda w: f"(close - ({full('close', w, f'avg(close) OVER {back(w)}', half(w))})) / (atr + 1e-8)"], source="ranged", ctes=ATR_SQL,
)


def _stored(s, d):
    """The same values for a range of dates, from bars stored by year and bucketed by shard."""
    ensure_checkpoint_dir(s)
    name = f"bars_{uuid.uuid4().hex}"
    store.store_bars(placed(s, d), name, s.sparkContext.getCheckpointDir(), before=81, buckets=8)
    found = X.price(X.base(store.read_framed(s, name, "1996-01-01", "1997-06-30", before=81)))
    return out(core_rows(found), **{f"price_to_sma_{w}": 6 for w in WINDOWS})


register(
    "stored_price_to_sma", _stored,
    f"SELECT * FROM ({SQL['price_to_sma']}) WHERE CAST(ts AS TIMESTAMP) BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'",
)
per_window("high_low_range", X.price, ["high_low_range_{w}"], [lambda w: f"(({hi(w)}) - ({lo(w)})) / close"])
per_window(
    "range_expansion", X.price, ["range_expansion_{w}"], [lambda w: f"rng / (({full('rng', w, f'avg(rng) OVER {back(w)}')}) + 1e-8)"]
)
per_window(
    "pct_from_extremes", X.price, ["pct_from_high_{w}", "pct_from_low_{w}"],
    [lambda w: f"close / ({hi(w)}) - 1", lambda w: f"close / ({lo(w)}) - 1"],
)
register(
    "intraday",
    lambda s, d: out(core_rows(X.price(framed(s, d, 1))), intraday_range=6, intraday_position=6, open_to_close=6, gap=6),
    f"""WITH {BASE_SQL} SELECT {KEY}, {r('rng / close', 'intraday_range')}, {r('(close - low) / (rng + 1e-8)', 'intraday_position', 6)},
    {r('(close - open) / open', 'open_to_close')}, {r('(open - prev) / prev', 'gap')} FROM base""",
)
per_window(
    "volume_zscore", X.volume, ["volume_zscore_{w}"],
    [lambda w: full("volume", w, f"(volume - avg(volume) OVER {back(w)}) / (stddev_samp(volume) OVER {back(w)} + 1e-8)")], digits=5,
)
per_window(
    "volume_surge", X.volume, ["volume_surge_{w}"],
    [lambda w: full("volume", w, f"volume / (quantile_cont(volume, 0.5) OVER {back(w)} + 1e-8)")],
)
OBV_SQL = BASE_SQL + """,
obv AS (SELECT *, sum(coalesce(sign(lr) * volume, 0)) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv FROM base)"""
per_window("obv_slope", X.volume, ["obv_slope_{w}"], [lambda w: f"(obv - lag(obv, {w}) OVER {SYM}) / {w}"], digits=6, source="obv", ctes=OBV_SQL)
VWAP = lambda w: full("dollar", w, f"sum(dollar) OVER {back(w)} / (sum(volume) OVER {back(w)} + 1e-8)")
per_window(
    "vwap", X.volume, ["vwap_{w}", "price_to_vwap_{w}"], [VWAP, lambda w: f"close / (({VWAP(w)}) + 1e-8) - 1"],
)
PAIR = lambda a, b, w, k: (
    f"CASE WHEN count({a} + {b}) OVER {back(w)} >= {k} AND stddev_pop({a}) OVER {back(w)} > 0 AND stddev_pop({b}) OVER {back(w)} > 0 THEN corr({a}, {b}) OVER {back(w)} END"
)
per_window("price_volume_corr", X.volume, ["price_volume_corr_{w}"], [lambda w: PAIR("lr", "vch", w, w)], (10, 20, 40))
MEAN = lambda w: f"avg(close) OVER {back(w)}"
DEV = lambda w: f"stddev_samp(close) OVER {back(w)}"
per_window(
    "bollinger", X.structure, ["bb_width_{w}", "bb_position_{w}"],
    [lambda w: full("close", w, f"2 * {DEV(w)} / ({MEAN(w)} + 1e-8)"), lambda w: full("close", w, f"(close - {MEAN(w)}) / (2 * {DEV(w)} + 1e-8)")],
)
per_window(
    "rsi", X.structure, ["rsi_{w}"],
    [lambda w: f"""CASE WHEN rn >= {w} THEN 100 - 100 / (1 + avg(greatest(coalesce(delta, 0), 0)) OVER {back(w)}
      / (avg(greatest(-coalesce(delta, 0), 0)) OVER {back(w)} + 1e-8)) END"""], digits=4,
)
STOCH_SQL = BASE_SQL + ", k AS (SELECT *, " + ", ".join(
    f"(close - ({lo(w)})) / (({hi(w)}) - ({lo(w)}) + 1e-8) * 100 AS k{w}" for w in WINDOWS
) + " FROM base)"
per_window(
    "stochastic", X.structure, ["stoch_k_{w}", "stoch_d_{w}"],
    [lambda w: f"k{w}", lambda w: full(f"k{w}", 3, f"avg(k{w}) OVER {back(3)}")], digits=5, source="k", ctes=STOCH_SQL, before=83,
)
TOP = lambda w: full("close", w, f"max(close) OVER {back(w)}")
LOW = lambda w: full("close", w, f"min(close) OVER {back(w)}")
per_window(
    "pullback_rally", X.structure, ["pullback_from_high_{w}", "rally_from_low_{w}"],
    [lambda w: f"(close - ({TOP(w)})) / (({TOP(w)}) + 1e-8)", lambda w: f"(close - ({LOW(w)})) / (({LOW(w)}) + 1e-8)"], (10, 20, 40),
)
register(
    "local_extrema",
    lambda s, d: out(core_rows(X.local_extrema(framed(s, d, 5, 5))), ("local_high_5", "local_low_5")),
    f"""WITH {BASE_SQL} SELECT {KEY},
    CAST(rn > 5 AND rn <= n - 5 AND high = max(high) OVER {span(-5, 5)} AS BIGINT) AS local_high_5,
    CAST(rn > 5 AND rn <= n - 5 AND low = min(low) OVER {span(-5, 5)} AS BIGINT) AS local_low_5 FROM base""",
)


def ema_sql(pairs, source, c, alias="e"):
    """Direct weighted sums over each row's whole past."""
    cols = ", ".join(
        f"sum(b.{c} * CASE WHEN b.rn = 1 THEN pow({1 - 2 / (s + 1)!r}, a.rn - 1) ELSE {2 / (s + 1)!r} * pow({1 - 2 / (s + 1)!r}, a.rn - b.rn) END) AS {name}"
        for name, s in pairs
    )
    return f"{alias} AS MATERIALIZED (SELECT a.symbol, a.ts, a.rn, {cols} FROM {source} a JOIN {source} b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY ALL)"


register(
    "ema",
    lambda s, d: out(X.exponential(placed(s, d)), **{f"ema_{w}": 6 for w in WINDOWS}),
    f"WITH {BASE_SQL}, {ema_sql([(f'y{w}', w) for w in WINDOWS], 'base', 'close')} SELECT {KEY}, "
    + ", ".join(r(f"CASE WHEN rn >= {half(w)} THEN y{w} END", f"ema_{w}") for w in WINDOWS) + " FROM e",
)
register(
    "macd",
    lambda s, d: out(X.macd(placed(s, d)), macd=6, macd_signal=6, macd_histogram=6),
    f"""WITH {BASE_SQL}, {ema_sql([('fast', 12), ('slow', 26)], 'base', 'close')}, m AS (SELECT *, fast - slow AS macd FROM e),
    {ema_sql([('sig', 9)], 'm', 'macd', 'g')}
    SELECT m.symbol, CAST(m.ts AS VARCHAR) AS ts, {r('macd', 'macd')}, {r('sig', 'macd_signal')}, {r('macd - sig', 'macd_histogram')}
    FROM m JOIN g USING (symbol, rn)""",
)


def run_sql(cond, name):
    return f"""{name}_i AS (SELECT *, sum(CASE WHEN coalesce({cond}, FALSE) THEN 0 ELSE 1 END) OVER
      (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM base),
    {name} AS (SELECT symbol, rn, ts, CASE WHEN coalesce({cond}, FALSE) THEN
      sum(CASE WHEN coalesce({cond}, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY rn) ELSE 0 END AS v FROM {name}_i)"""


register(
    "consecutive",
    lambda s, d: out(X.streaks(core_rows(with_returns_and_range(with_halo(placed(s, d), before=1)))), ("consecutive_up", "consecutive_down")),
    f"""WITH {BASE_SQL}, {run_sql('lr > 0', 'u')}, {run_sql('lr < 0', 'w')}
    SELECT u.symbol, CAST(u.ts AS VARCHAR) AS ts, CAST(u.v AS BIGINT) AS consecutive_up, CAST(w.v AS BIGINT) AS consecutive_down FROM u JOIN w USING (symbol, rn)""",
)
SMA = {w: full("close", w, f"avg(close) OVER {back(w)}", half(w)) for w in WINDOWS}
register(
    "trend_alignment",
    lambda s, d: out(core_rows(X.multiscale(X.price(framed(s, d)))), trend_alignment=6),
    f"WITH {BASE_SQL} SELECT {KEY}, " + r(
        "(" + " + ".join(f"CAST(coalesce(({SMA[a]}) > ({SMA[b]}), FALSE) AS INTEGER)" for a, b in ((5, 10), (10, 20), (20, 40))) + ") / 3.0",
        "trend_alignment") + " FROM base",
)
register(
    "volatility_regime",
    lambda s, d: out(core_rows(X.multiscale(X.price(framed(s, d, X.WARMUP)))), volatility_regime=6),
    f"""WITH {BASE_SQL}, v AS (SELECT *, round({full('lr', 20, f'stddev_samp(lr) OVER {back(20)}', 10)}, 13) AS vol FROM base),
    c AS (SELECT *, CASE WHEN count(vol) OVER {back(252)} >= 252 THEN list(vol) OVER {back(252)} END AS vs FROM v)
    SELECT {KEY}, {r('''(len(list_filter(vs, lambda x: x < vol)) + len(list_filter(vs, lambda x: x <= vol)) +
      CAST(len(list_filter(vs, lambda x: x <= vol)) > len(list_filter(vs, lambda x: x < vol)) AS INTEGER)) * 50.0 / 252 / 100''', 'volatility_regime')} FROM c""",
)
register(
    "momentum_consistency",
    lambda s, d: out(core_rows(X.multiscale(X.price(framed(s, d)))), momentum_consistency=6),
    f"WITH {BASE_SQL} SELECT {KEY}, " + r(
        "(" + " + ".join(f"CAST(coalesce(close / lag(close, {w}) OVER {SYM} - 1 > 0, FALSE) AS INTEGER)" for w in WINDOWS) + ") / 6.0",
        "momentum_consistency") + " FROM base",
)
# Oracle for the quadratic term: discrete orthogonal polynomial of degree two on 0..19.
register(
    "shape",
    lambda s, d: out(core_rows(X.shape(framed(s, d, 20))), shape_position_20=6, shape_slope_20=6, shape_curvature_20=6),
    f"""WITH {BASE_SQL}, c AS (SELECT *, list(close) OVER {back(20)} AS xs FROM base),
    g AS (SELECT list(i ORDER BY i) AS t FROM range(20) x(i)),
    q AS (SELECT c.*, list_transform(t, lambda i: (i - 9.5) * (i - 9.5) - 33.25) AS p2 FROM c, g)
    SELECT {KEY}, {r(full('close', 20, f'(close - avg(close) OVER {back(20)}) / (stddev_samp(close) OVER {back(20)} + 1e-8)'), 'shape_position_20')},
    {r(full('close', 20, f'regr_slope(close, rn) OVER {back(20)}'), 'shape_slope_20')},
    {r('CASE WHEN len(xs) = 20 THEN list_inner_product(xs, CAST(p2 AS DOUBLE[])) / list_inner_product(CAST(p2 AS DOUBLE[]), CAST(p2 AS DOUBLE[])) END', 'shape_curvature_20')} FROM q""",
)
register(
    "sax_symbol",
    lambda s, d: out(X.with_sax(core_rows(X.shape(framed(s, d, 21)))), sax_symbol=0, return_zscore=5),
    f"""WITH {BASE_SQL}, z AS (SELECT *, {full('lr', 20, f'(lr - avg(lr) OVER {back(20)}) / (stddev_samp(lr) OVER {back(20)} + 1e-8)')} AS z FROM base),
    m AS (SELECT *, min(z) OVER (PARTITION BY symbol) AS lo, max(z) OVER (PARTITION BY symbol) AS hi FROM z)
    SELECT {KEY}, {r('z', 'return_zscore', 5)}, CAST(greatest(0, least(9, ceil((z - lo) / ((hi - lo) / 10)) - 1)) + 0 * z AS DOUBLE) AS sax_symbol FROM m""",
)
VOLW = lambda w: full("lr", w, f"stddev_samp(lr) OVER {back(w)}", half(w))
per_window(
    "risk_adjusted_return", lambda f: X.risk_adjusted(X.price(f)), ["risk_adjusted_return_{w}"],
    [lambda w: f"(close / lag(close, {w}) OVER {SYM} - 1) / (({VOLW(w)}) + 1e-8)"], (5, 10, 20), digits=5,
)


def div_sql(w):
    return f"""CAST(coalesce(
      (CASE WHEN rn >= {w} THEN CASE WHEN close > lag(close, {w - 1}) OVER {SYM} THEN 1 ELSE -1 END END)
      <> (CASE WHEN count(volume) OVER {back(w)} >= {w} THEN CASE WHEN avg(volume) OVER {back(w)} > g{w} THEN 1 ELSE -1 END END), TRUE) AS BIGINT) AS price_volume_divergence_{w}"""


register(
    "price_volume_divergence",
    lambda s, d: out(
        X.with_divergence(core_rows(X.divergence_parts(framed(s, d, 40)))), ("price_volume_divergence_10", "price_volume_divergence_20")
    ),
    f"""WITH {BASE_SQL}, g AS (SELECT *, avg(CASE WHEN rn > n - 20 THEN volume END) OVER (PARTITION BY symbol) AS g10,
      avg(CASE WHEN rn > n - 40 THEN volume END) OVER (PARTITION BY symbol) AS g20 FROM base)
    SELECT {KEY}, {div_sql(10)}, {div_sql(20)} FROM g""",
)
DAYS = (20, 40, 60)
register(
    "days_since_extreme",
    lambda s, d: out(core_rows(X.timing(framed(s, d, 80))), **{f"days_since_{x}_{w}": 0 for x in ("high", "low") for w in DAYS}),
    f"WITH {BASE_SQL} SELECT {KEY}, " + ", ".join(
        f"CASE WHEN rn >= {w} THEN CAST({w} - list_position(list({x}) OVER {back(w)}, {f}({x}) OVER {back(w)}) AS DOUBLE) END AS days_since_{x}_{w}"
        for x, f in (("high", "max"), ("low", "min")) for w in DAYS) + " FROM base",
)
register(
    "autocorrelation_feature",
    lambda s, d: out(core_rows(X.timing(framed(s, d, 80))), **{f"autocorr_lag_{k}": 6 for k in (1, 5, 10, 20)}),
    f"WITH {BASE_SQL}, p AS (SELECT *, " + ", ".join(f"lag(lr, {k}) OVER {SYM} AS p{k}" for k in (1, 5, 10, 20)) + f" FROM base) SELECT {KEY}, " + ", ".join(
        r(f"CASE WHEN count(lr) OVER {back(60)} >= 60 THEN {PAIR('lr', f'p{k}', 60 - k, 60 - k)} END", f"autocorr_lag_{k}") for k in (1, 5, 10, 20)) + " FROM p",
)
