"""Event labels, regime statistics and their aggregates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from checks.fixtures import ATR_SQL, BASE_SQL, SYM, back, full, out, placed, r, span
from tidemark.operators import labels as L
from tidemark.operators import regimes as R
from tidemark.operators.frame import core_rows, with_halo

QUERIES, SQL = {}, {}
HORIZONS = (3, 5, 10, 20)
KEY = "symbol, CAST(ts AS VARCHAR) AS ts"


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def framed(s, d, before=46, after=20):
    return L.base(with_halo(placed(s, d), before=before, after=after))


def move_sql(h, rest):
    return f"""m AS (SELECT *, list(close) OVER {span(1, h)} AS f FROM ranged),
    t AS (SELECT *, list_transform(f, lambda x: (x - close) / close) AS fr FROM m),
    u AS (SELECT *, coalesce(list_position(list_transform(fr, lambda x: x >= 1.5 * atr / close), TRUE), 0) AS up,
      coalesce(list_position(list_transform(fr, lambda x: x <= -1.5 * atr / close), TRUE), 0) AS dn FROM t),
    v AS (SELECT *, CASE WHEN atr IS NULL OR atr = 0 THEN 0 WHEN up > 0 AND (dn = 0 OR up < dn) THEN 1 WHEN dn > 0 THEN -1 ELSE 0 END AS side FROM u),
    moved AS (SELECT *, CASE WHEN rn <= n - {h} THEN side ELSE {rest} END AS label,
      CASE WHEN rn <= n - {h} THEN CASE WHEN atr IS NULL OR atr = 0 THEN 0 WHEN side = 1 THEN list_max(fr) WHEN side = -1 THEN list_min(fr) ELSE fr[{h}] END ELSE {rest} END AS size FROM v)"""


for h in HORIZONS:
    names = {f"label_move_{h}d": 0, f"label_up_{h}d": 0, f"label_down_{h}d": 0, f"magnitude_move_{h}d": 6, f"prob_move_{h}d": 6}
    register(
        f"label_move_{h}d",
        lambda s, d, h=h, names=names: out(core_rows(L.move(framed(s, d, 15, h), h)), **names),
        f"""WITH {ATR_SQL}, {move_sql(h, 'NULL')} SELECT {KEY}, CAST(label AS DOUBLE) AS label_move_{h}d, CAST(label = 1 AS DOUBLE) AS label_up_{h}d,
        CAST(label = -1 AS DOUBLE) AS label_down_{h}d, {r('size', f'magnitude_move_{h}d')}, CAST(0 AS DOUBLE) AS prob_move_{h}d FROM moved""",
    )
register(
    "label_move_compat",
    lambda s, d: out(core_rows(L.move(framed(s, d, 15, 10), 10, compat=True)), ("label_move_10d", "label_up_10d", "label_down_10d"), magnitude_move_10d=6),
    f"""WITH {ATR_SQL}, {move_sql(10, '0')} SELECT {KEY}, CAST(label AS BIGINT) AS label_move_10d, CAST(label = 1 AS BIGINT) AS label_up_10d,
    CAST(label = -1 AS BIGINT) AS label_down_10d, {r('size', 'magnitude_move_10d')} FROM moved""",
)
register(
    "label_move_counts",
    lambda s, d: core_rows(L.move(framed(s, d, 15, 10), 10)).groupBy("symbol", F.col("label_move_10d").cast("double").alias("label")).agg(F.count(F.lit(1)).alias("rows")),
    f"WITH {ATR_SQL}, {move_sql(10, 'NULL')} SELECT symbol, CAST(label AS DOUBLE) AS label, count(*) AS rows FROM moved GROUP BY ALL",
)
CONS_SQL = ATR_SQL + f""",
w AS (SELECT *, list(high) OVER {span(-30, -1)} AS hs, list(low) OVER {span(-30, -1)} AS ls, list(atr) OVER {span(-30, -1)} AS ats, list(volume) OVER {span(-30, -1)} AS vs,
  max(close) OVER {span(0, 2)} AS cmax, min(close) OVER {span(0, 9)} AS cmin, max(volume) OVER {span(0, 2)} AS vmax FROM ranged),
x AS (SELECT w.*, k, list_max(hs[31 - k:30]) AS top, list_min(ls[31 - k:30]) AS bottom, list_aggregate(ats[31 - k:30], 'median') AS med, list_aggregate(vs[31 - k:30], 'median') AS vmed
  FROM w, range(10, 31) AS g(k) WHERE rn > 30 AND atr <> 0),
first AS (SELECT * FROM x WHERE top - bottom <= CAST(1.2 AS DOUBLE) * med QUALIFY row_number() OVER (PARTITION BY symbol, rn ORDER BY k) = 1),
cons AS MATERIALIZED (SELECT p.symbol, p.ts, p.rn, p.n, k, top, bottom, med, f.cmin, top + 0.5 * f.atr AS lvl, f.atr,
  coalesce(p.rn <= p.n - 3 AND f.cmax > top + 0.5 * f.atr AND CASE WHEN vmax IS NULL THEN TRUE WHEN vmed > 0 THEN vmax > 1.5 * vmed ELSE TRUE END, FALSE) AS broke
  FROM placed p LEFT JOIN first f ON p.symbol = f.symbol AND p.rn = f.rn)"""
CONS_COLS = f"""CAST(k IS NOT NULL AS BIGINT) AS in_consolidation, CAST(coalesce(k, 0) AS BIGINT) AS consolidation_days, {r('(top - bottom) / med', 'consolidation_width')}"""
register(
    "consolidation",
    lambda s, d: out(core_rows(L.consolidation(framed(s, d, 45, 10))), ("in_consolidation", "consolidation_days"), consolidation_width=6),
    f"WITH {CONS_SQL} SELECT {KEY}, {CONS_COLS} FROM cons",
)
BROKE = "CAST(broke AS BIGINT) AS consolidation_breakout"
FALSE = "CAST(coalesce(broke AND rn <= n - 10 AND cmin < lvl - 0.5 * atr, FALSE) AS BIGINT) AS false_breakout"
register(
    "consolidation_breakout",
    lambda s, d: out(core_rows(L.consolidation(framed(s, d, 45, 10))), ("consolidation_breakout",)),
    f"WITH {CONS_SQL} SELECT {KEY}, {BROKE} FROM cons",
)
register(
    "false_breakout",
    lambda s, d: out(core_rows(L.consolidation(framed(s, d, 45, 10))), ("false_breakout",)),
    f"WITH {CONS_SQL} SELECT {KEY}, {FALSE} FROM cons",
)
NOVOL = CONS_SQL.replace("CAST(sum(q) AS DOUBLE) AS volume", "CAST(NULL AS DOUBLE) AS volume")
register(
    "breakout_without_volume",
    lambda s, d: out(
        core_rows(L.consolidation(L.base(with_halo(placed(s, d).withColumn("volume", F.lit(None).cast("double")), before=45, after=10)))),
        ("consolidation_breakout", "false_breakout"),
    ),
    f"WITH {NOVOL} SELECT {KEY}, {BROKE}, {FALSE} FROM cons",
)
REV_SQL = ATR_SQL + f""",
rv AS (SELECT *, close - lag(close, 10) OVER {SYM} AS prior, lead(close, 9) OVER {SYM} - close AS ahead FROM ranged),
rev AS MATERIALIZED (SELECT *, coalesce(rn > 20 AND rn <= n - 10 AND atr <> 0 AND abs(prior) / atr >= 2 AND abs(ahead) / atr >= 2 AND (prior > 0) <> (ahead > 0), FALSE) AS hit FROM rv)"""
register(
    "trend_reversal",
    lambda s, d: out(core_rows(L.reversal(framed(s, d, 15, 10))), ("trend_reversal",), reversal_strength=6),
    f"WITH {REV_SQL} SELECT {KEY}, CAST(hit AS BIGINT) AS trend_reversal, {r('CASE WHEN hit THEN abs(ahead) / atr ELSE 0 END', 'reversal_strength')} FROM rev",
)
REGIME_SQL = BASE_SQL + f""",
rg AS (SELECT *, close / lag(close, 40) OVER {SYM} - 1 AS r40 FROM base),
reg AS (SELECT *, CASE WHEN r40 > 0.10 THEN 'bull' WHEN r40 < -0.10 THEN 'bear' ELSE 'sideways' END AS market_regime FROM rg),
chg AS (SELECT *, lag(market_regime) OVER {SYM} AS pr FROM reg),
isl AS MATERIALIZED (SELECT *, sum(CASE WHEN pr IS NULL OR pr <> market_regime THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM chg)"""


def regimes(s, d):
    return core_rows(L.regime(framed(s, d, 41, 0)))


register(
    "market_regime",
    lambda s, d: out(regimes(s, d), ("bull_zone", "bear_zone", "sideways_zone"), keys=("symbol", "ts", "market_regime")),
    f"WITH {REGIME_SQL} SELECT {KEY}, market_regime, " + ", ".join(f"CAST(market_regime = '{z}' AS BIGINT) AS {z}_zone" for z in ("bull", "bear", "sideways")) + " FROM reg",
)
register(
    "days_in_regime",
    lambda s, d: out(L.days_in_regime(core_rows(L.mark_changes(L.regime(framed(s, d, 42, 0))))), ("days_in_regime",)),
    f"WITH {REGIME_SQL} SELECT {KEY}, row_number() OVER (PARTITION BY symbol, island ORDER BY rn) AS days_in_regime FROM isl",
)
register(
    "momentum_burst",
    lambda s, d: out(L.with_burst(core_rows(L.momentum_burst(framed(s, d, 22, 0)))), ("momentum_burst",)),
    f"""WITH {BASE_SQL} SELECT {KEY}, CAST(coalesce(abs(close / lag(close, 3) OVER {SYM} - 1) > 2 * ({full('lr', 20, f'stddev_samp(lr) OVER {back(20)}')}) * sqrt(3)
      AND volume > 1.5 * ({full('volume', 20, f'quantile_cont(volume, 0.5) OVER {back(20)}')}), FALSE) AS BIGINT) AS momentum_burst FROM base""",
)
register(
    "v_reversal",
    lambda s, d: out(core_rows(L.v_reversal(framed(s, d, 15, 10))), ("v_reversal",)),
    f"""WITH {BASE_SQL} SELECT {KEY}, CAST(coalesce(rn > 10 AND rn <= n - 10 AND lag(close, 1) OVER {SYM} / lag(close, 10) OVER {SYM} - 1 < -0.05
      AND lead(close, 9) OVER {SYM} / close - 1 > 0.05 AND close = min(close) OVER {span(-10, 9)}, FALSE) AS BIGINT) AS v_reversal FROM base""",
)


def _stats(s, d):
    df = L.label_statistics(L.labels(placed(s, d), compat=True))
    return out(df, ("total", "ones", "minus_ones", "zeros"), keys=("symbol", "label"), one_share=6, minus_one_share=6, avg_strength=6)


STAT_SQL = f"WITH {CONS_SQL}, rv AS (SELECT *, close - lag(close, 10) OVER {SYM} AS prior, lead(close, 9) OVER {SYM} - close AS ahead FROM ranged), " + ", ".join(
    move_sql(h, "0").replace("moved AS", f"moved{h} AS").replace("m AS (", f"m{h} AS (", 1).replace("FROM m)", f"FROM m{h})").replace("t AS (SELECT *, list_tr", f"t{h} AS (SELECT *, list_tr")
    .replace("FROM t)", f"FROM t{h})").replace("u AS (SELECT", f"u{h} AS (SELECT").replace("FROM u)", f"FROM u{h})").replace("v AS (SELECT", f"v{h} AS (SELECT").replace("FROM v)", f"FROM v{h})")
    for h in HORIZONS
) + f""",
hits AS (SELECT *, coalesce(rn > 20 AND rn <= n - 10 AND atr <> 0 AND abs(prior) / atr >= 2 AND abs(ahead) / atr >= 2 AND (prior > 0) <> (ahead > 0), FALSE) AS hit FROM rv),
tall AS (
  {' UNION ALL '.join(f"SELECT symbol, 'label_move_{h}d' AS label, label AS v, NULL AS strength FROM moved{h}" for h in HORIZONS)}
  UNION ALL SELECT symbol, 'in_consolidation', CAST(k IS NOT NULL AS INTEGER), NULL FROM cons
  UNION ALL SELECT symbol, 'consolidation_breakout', CAST(broke AS INTEGER), NULL FROM cons
  UNION ALL SELECT symbol, 'false_breakout', CAST(coalesce(broke AND rn <= n - 10 AND cmin < lvl - 0.5 * atr, FALSE) AS INTEGER), NULL FROM cons
  UNION ALL SELECT symbol, 'trend_reversal', CAST(hit AS INTEGER), CASE WHEN hit THEN abs(ahead) / atr END FROM hits)
SELECT symbol, label, count(v) AS total, CAST(sum(CAST(v = 1 AS INTEGER)) AS BIGINT) AS ones, CAST(sum(CAST(v = -1 AS INTEGER)) AS BIGINT) AS minus_ones,
  CAST(sum(CAST(v = 0 AS INTEGER)) AS BIGINT) AS zeros, {r('sum(CAST(v = 1 AS INTEGER)) / count(v)', 'one_share')}, {r('sum(CAST(v = -1 AS INTEGER)) / count(v)', 'minus_one_share')},
  {r('avg(strength)', 'avg_strength')} FROM tall GROUP BY symbol, label"""
register("label_statistics", _stats, STAT_SQL)

register(
    "regime_statistics",
    lambda s, d: out(
        R.regime_statistics(regimes(s, d)), ("n_days",), keys=("symbol", "market_regime"),
        frequency=6, mean_return=6, volatility=6, max_drawdown=6, sharpe=5,
    ),
    f"""WITH {REGIME_SQL}, pk AS (SELECT *, max(close) OVER (PARTITION BY symbol, market_regime ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM reg)
    SELECT symbol, market_regime, count(*) AS n_days, {r('count(*) / max(n)', 'frequency')}, {r('avg(lr)', 'mean_return')}, {r('stddev_samp(lr)', 'volatility')},
    {r('min(close / peak - 1)', 'max_drawdown')}, {r('avg(lr) / (stddev_samp(lr) + 1e-8) * sqrt(252)', 'sharpe', 5)} FROM pk GROUP BY symbol, market_regime""",
)
register(
    "regime_counts",
    lambda s, d: R.regime_counts(regimes(s, d)),
    f'WITH {REGIME_SQL} SELECT symbol, market_regime, count(*) AS "count" FROM reg GROUP BY ALL',
)
register(
    "regime_transitions",
    lambda s, d: out(R.transitions(regimes(s, d)), ("duration_days",), keys=("symbol", "ts", "from_regime", "to_regime")),
    f"""WITH {REGIME_SQL}, st AS (SELECT *, min(ts) OVER (PARTITION BY symbol, island) AS started FROM isl),
    pv AS (SELECT *, lag(started) OVER {SYM} AS before FROM st)
    SELECT {KEY}, pr AS from_regime, market_regime AS to_regime, date_diff('day', before, ts) AS duration_days FROM pv WHERE rn > 1 AND pr <> market_regime""",
)
register(
    "regime_durations",
    lambda s, d: out(R.regime_durations(regimes(s, d)), ("min", "max"), keys=("symbol", "market_regime"), mean=6, median=6, std=6),
    f"""WITH {REGIME_SQL}, runs AS (SELECT symbol, market_regime, island, count(*) AS k FROM isl GROUP BY ALL)
    SELECT symbol, market_regime, {r('avg(k)', 'mean')}, {r('median(k)', 'median')}, {r('stddev_pop(k)', 'std')}, min(k) AS "min", max(k) AS "max" FROM runs GROUP BY symbol, market_regime""",
)
register(
    "drawdown",
    lambda s, d: out(R.drawdown(placed(s, d)), running_max=6, running_growth=6, drawdown=6),
    f"""WITH {BASE_SQL}, m AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mx,
      product(coalesce(close / prev, 1)) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gr FROM base)
    SELECT {KEY}, {r('mx', 'running_max')}, {r('gr', 'running_growth')}, {r('close / mx - 1', 'drawdown')} FROM m""",
)
register(
    "top_moves",
    lambda s, d: out(
        core_rows(L.base(with_halo(placed(s, d), before=1)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.abs("log_return").desc_nulls_last(), "ts")))
        .filter("rank <= 10"),
        ("rank",), log_return=6,
    ),
    f"""WITH {BASE_SQL} SELECT {KEY}, row_number() OVER w AS rank, {r('lr', 'log_return')} FROM base
    WINDOW w AS (PARTITION BY symbol ORDER BY abs(lr) DESC NULLS LAST, ts) QUALIFY row_number() OVER w <= 10""",
)
