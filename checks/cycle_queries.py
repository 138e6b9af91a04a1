"""Autocorrelation, spectrum, wavelet and regime model."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import BARS_SQL, out, placed, r
from tidemark.operators import cycles as C
from tidemark.operators import spectrum as S
from tidemark.operators import wavelet as V
from tidemark.session import cut

QUERIES, SQL = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def series(s, d):
    return cut(C.series_of(placed(s, d)))


ACF_SQL = BARS_SQL + """,
acf AS MATERIALIZED (SELECT a.symbol, a.rn - b.rn AS lag, corr(a.close, b.close) AS acf FROM placed a JOIN placed b ON a.symbol = b.symbol AND a.rn > b.rn AND a.rn <= b.rn + 100 GROUP BY ALL)"""
register("acf", lambda s, d: out(C.acf(series(s, d)), ("lag",), keys=("symbol",), acf=6), f"WITH {ACF_SQL} SELECT symbol, lag, {r('acf', 'acf')} FROM acf")
PACF_SQL = ACF_SQL + """,
m AS (SELECT symbol, avg(close) AS mu FROM placed GROUP BY symbol),
x AS (SELECT symbol, rn, close - mu AS x FROM placed JOIN m USING (symbol)),
gk AS (SELECT a.symbol, a.rn - b.rn AS k, sum(a.x * b.x) AS g FROM x a JOIN x b ON a.symbol = b.symbol AND a.rn >= b.rn AND a.rn <= b.rn + 100 GROUP BY ALL),
gs AS MATERIALIZED (SELECT symbol, list(g ORDER BY k) AS g FROM gk GROUP BY symbol),
lev AS (
  SELECT symbol, 1 AS k, [g[2] / g[1]] AS phi, g[1] * (1 - (g[2] / g[1]) * (g[2] / g[1])) AS v, g[2] / g[1] AS c FROM gs
  UNION ALL
  SELECT symbol, k, list_append(list_transform(phi, lambda p, i: p - c * phi[len(phi) + 1 - i]), c), v * (1 - c * c), c
  FROM (SELECT l.symbol, l.k + 1 AS k, l.phi, l.v, (g[l.k + 2] - list_sum(list_transform(l.phi, lambda p, i: p * g[l.k + 2 - i]))) / l.v AS c
    FROM lev l JOIN gs USING (symbol) WHERE l.k < 100) z)"""
register(
    "pacf",
    lambda s, d: out(C.pacf(series(s, d)), ("lag",), keys=("symbol",), pacf=6),
    f"WITH RECURSIVE {PACF_SQL} SELECT symbol, CAST(lev.k AS BIGINT) AS lag, {r('CASE WHEN lev.k = 1 THEN acf ELSE c END', 'pacf')} FROM lev JOIN acf USING (symbol) WHERE lag = 1",
)
register(
    "significant_acf_lags",
    lambda s, d: out(C.significant_lags(C.acf(series(s, d)), "acf"), ("lag",), keys=("symbol",), acf=6),
    f"WITH {ACF_SQL} SELECT symbol, lag, {r('acf', 'acf')} FROM acf WHERE abs(acf) > 0.3",
)
register(
    "significant_pacf_lags",
    lambda s, d: out(C.significant_lags(C.pacf(series(s, d)), "pacf"), ("lag",), keys=("symbol",), pacf=6),
    f"WITH RECURSIVE {PACF_SQL}, p AS (SELECT symbol, lev.k, CASE WHEN lev.k = 1 THEN acf ELSE c END AS pacf FROM lev JOIN acf USING (symbol) WHERE lag = 1) SELECT symbol, CAST(k AS BIGINT) AS lag, {r('pacf', 'pacf')} FROM p WHERE abs(pacf) > 0.3",
)
PEAK_SQL = ACF_SQL + """,
nb AS (SELECT *, lag(acf) OVER w AS p, lead(acf) OVER w AS q FROM acf WINDOW w AS (PARTITION BY symbol ORDER BY lag)),
acf_peaks AS MATERIALIZED (SELECT symbol, lag, acf FROM nb WHERE acf > p AND acf > q AND acf >= 0.3)"""
register("acf_peaks", lambda s, d: out(C.cycle_peaks(cut(C.acf(series(s, d)))), ("lag",), keys=("symbol",), acf=6), f"WITH {PEAK_SQL} SELECT symbol, lag, {r('acf', 'acf')} FROM acf_peaks")
SPEC_SQL = BARS_SQL + """,
fit AS (SELECT symbol, regr_slope(close, rn) AS b, regr_intercept(close, rn) AS a FROM placed GROUP BY symbol),
dt AS MATERIALIZED (SELECT symbol, rn - 1 AS t, n, close - a - b * rn AS x FROM placed JOIN fit USING (symbol)),
ks AS (SELECT symbol, n, k FROM (SELECT DISTINCT symbol, n FROM dt) s, range(1, 100000) g(k) WHERE 2 * k < n AND k * 252 >= n AND k * 5 <= n),
spec AS MATERIALIZED (SELECT dt.symbol, k, any_value(dt.n) / k AS period, sqrt(pow(sum(x * cos(2 * pi() * ((k * t) % dt.n) / dt.n)), 2) + pow(sum(x * sin(2 * pi() * ((k * t) % dt.n) / dt.n)), 2)) AS power
  FROM dt JOIN ks ON dt.symbol = ks.symbol GROUP BY dt.symbol, k)"""
register(
    "spectrum",
    lambda s, d: out(S.amplitudes(series(s, d)), ("k",), keys=("symbol",), period=6, power=5),
    f"WITH {SPEC_SQL} SELECT symbol, k, {r('period', 'period')}, {r('power', 'power', 5)} FROM spec",
)
DOM_SQL = SPEC_SQL + """,
sd AS (SELECT symbol, stddev_pop(power) AS lim FROM spec GROUP BY symbol),
nbp AS (SELECT *, lag(power) OVER w AS p, lead(power) OVER w AS q FROM spec WINDOW w AS (PARTITION BY symbol ORDER BY k)),
pk AS (SELECT symbol, k, period, power FROM nbp WHERE power > p AND power > q),
edge AS (SELECT pk.symbol, pk.k, any_value(pk.period) AS period, any_value(pk.power) AS power, max(CASE WHEN s.k < pk.k AND s.power > pk.power THEN s.k END) AS l, min(CASE WHEN s.k > pk.k AND s.power > pk.power THEN s.k END) AS h
  FROM pk JOIN spec s ON pk.symbol = s.symbol GROUP BY pk.symbol, pk.k),
prom AS (SELECT e.symbol, e.k, any_value(e.period) AS period, any_value(e.power) AS power,
  any_value(e.power) - greatest(min(CASE WHEN s.k <= e.k AND s.k >= coalesce(l, 0) THEN s.power END), min(CASE WHEN s.k >= e.k AND s.k <= coalesce(h, 1000000) THEN s.power END)) AS prominence
  FROM edge e JOIN spec s ON e.symbol = s.symbol GROUP BY e.symbol, e.k),
dom AS MATERIALIZED (SELECT * FROM prom JOIN sd USING (symbol) WHERE prominence >= lim QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY power DESC, k) <= 10)"""
register(
    "dominant_periods",
    lambda s, d: out(C.dominant_periods(S.amplitudes(series(s, d))), ("k",), keys=("symbol",), period=6, power=5, prominence=5),
    f"WITH {DOM_SQL} SELECT symbol, k, {r('period', 'period')}, {r('power', 'power', 5)}, {r('prominence', 'prominence', 5)} FROM dom",
)


def _summary(s, d):
    x = series(s, d)
    return C.summarize(C.cycle_peaks(cut(C.acf(x))), C.dominant_periods(S.amplitudes(x)), V.dominant_scales(cut(V.scale_power(x))))


register("cycle_summary", lambda s, d: out(_summary(s, d), keys=("symbol", "method"), period_days=6, strength=5))
register(
    "cycle_summary_without_wavelet",
    lambda s, d: out(_summary(s, d).filter("method <> 'wavelet'"), keys=("symbol", "method"), period_days=6, strength=5),
    f"""WITH {PEAK_SQL}, {DOM_SQL[len(BARS_SQL) + 1:]} SELECT symbol, 'autocorrelation' AS method, {r('lag', 'period_days')}, {r('acf', 'strength', 5)} FROM acf_peaks
    UNION ALL SELECT symbol, 'spectral', {r('period', 'period_days')}, {r('power', 'strength', 5)} FROM dom""",
)
register("wavelet_power", lambda s, d: out(V.scale_power(series(s, d)), ("scale",), keys=("symbol",), avg_power=5))
register("wavelet_scales", lambda s, d: out(V.dominant_scales(cut(V.scale_power(series(s, d)))), ("scale",), keys=("symbol",), avg_power=5))
register("wavelet_strongest", lambda s, d: out(V.strongest_scales(series(s, d)), ("rn", "scale"), keys=("symbol",), power=5))


def _states(s, d):
    from tidemark.operators import hidden_states as H

    return H.regimes(placed(s, d))


register("hidden_states", lambda s, d: out(_states(s, d)["states"], ("state",), keys=("symbol", "ts", "regime"), mean_return=6, mean_volatility=6))
register("hidden_state_parameters", lambda s, d: out(_states(s, d)["parameters"].withColumn("stay", F.get("transition", F.col("state"))), ("state",), keys=("symbol",), mean_return=6, mean_volatility=6, stay=6))


def _named(s, d):
    """Naming alone: the state is the rule regime's zone, which SQL can derive too."""
    from tidemark.operators import hidden_states as H

    obs = cut(H.observations(placed(s, d)))
    states = obs.select("symbol", "rn", (F.weekday("ts") % 3).cast("int").alias("state"))
    return H.name_states(states, obs)


register(
    "name_states",
    lambda s, d: out(_named(s, d), ("state",), keys=("symbol", "ts", "regime"), mean_return=7, mean_volatility=6),
    f"""WITH {BARS_SQL}, l AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY rn)) AS lr FROM placed),
    o AS (SELECT *, CASE WHEN count(lr) OVER w >= 20 THEN stddev_samp(lr) OVER w END AS vol, (isodow(ts) - 1) % 3 AS state FROM l WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    k AS (SELECT * FROM o WHERE lr IS NOT NULL AND vol IS NOT NULL),
    m AS (SELECT symbol, state, avg(lr) AS mr, avg(vol) AS mv FROM k GROUP BY symbol, state),
    q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mr) AS place FROM m)
    SELECT k.symbol, CAST(ts AS VARCHAR) AS ts, ['bear', 'sideways', 'bull'][place] AS regime, CAST(state AS BIGINT) AS state, {r('mr', 'mean_return', 7)}, {r('mv', 'mean_volatility')} FROM k JOIN q USING (symbol, state)""",
)
