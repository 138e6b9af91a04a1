"""Backtest, folds and metrics. The SQL side replays the trades row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import BARS_SQL, SCORES_SQL, SYM, bars, out, placed, r, scores
from tidemark.config import EvaluationConfig
from tidemark.functions.exprs import lead, ratio
from tidemark.operators import backtest as B
from tidemark.operators import folds as E
from tidemark.operators import metrics as M
from tidemark.operators.frame import core_rows, with_halo
from tidemark.session import cut

QUERIES, SQL = {}, {}
KEY = "symbol, CAST(ts AS VARCHAR) AS ts"
THRESHOLD = 0.55


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def signal_sql(t):
    return f"CASE WHEN score < 1 - {t} THEN -1 WHEN score >= {t} THEN 1 ELSE 0 END"


def replay(feed, keys="symbol", fill="open"):
    """A recursive walk over rows: what an event loop would do."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"f.{k} = b.{k}" for k in ks)
    fk = ", ".join(f"f.{k}" for k in ks)
    return f"""feed AS MATERIALIZED ({feed}),
walk AS (
  SELECT {keys}, rn, ts, close, CAST(100000 AS DOUBLE) AS capital, CAST(0 AS DOUBLE) AS shares, CAST(0 AS DOUBLE) AS entry, 0 AS trade, FALSE AS en, FALSE AS lv, CAST(0 AS DOUBLE) AS px,
    CAST(0 AS DOUBLE) AS old_shares
  FROM feed WHERE rn = 1
  UNION ALL
  SELECT {keys}, rn, ts, close,
    CASE WHEN en THEN capital - capital * 0.05 * 1.001 WHEN lv THEN capital + shares * px * (1 - 0.0007) * (1 - 0.001) ELSE capital END,
    CASE WHEN en THEN capital * 0.05 / (px * 1.0007) WHEN lv THEN 0 ELSE shares END,
    CASE WHEN en THEN px * 1.0007 ELSE entry END, CASE WHEN en THEN trade + 1 ELSE trade END, en, lv, px, shares
  FROM (SELECT {fk}, f.rn, f.ts, f.close, f.{fill} AS px, b.capital, b.shares, b.entry, b.trade,
      coalesce(f.s > 0 AND b.shares = 0, FALSE) AS en, coalesce(f.s < 0 AND b.shares > 0, FALSE) AS lv
    FROM walk b JOIN feed f ON {on} AND f.rn = b.rn + 1) z),
curve AS MATERIALIZED (SELECT *, shares * close AS value, capital + shares * close AS equity FROM walk),
trades AS MATERIALIZED (SELECT {keys}, trade, max(CASE WHEN en THEN ts END) AS entry_ts, max(CASE WHEN en THEN entry END) AS entry_price, max(CASE WHEN en THEN shares END) AS shares,
  max(CASE WHEN lv THEN ts END) AS exit_ts, max(CASE WHEN lv THEN px * (1 - 0.0007) END) AS exit_price FROM curve WHERE en OR lv GROUP BY {keys}, trade),
stepped AS (SELECT *, equity / lag(equity) OVER (PARTITION BY {keys} ORDER BY rn) - 1 AS ret,
  max(CASE WHEN rn > 1 THEN equity END) OVER (PARTITION BY {keys} ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM curve),
risk AS (SELECT {keys}, count(*) AS n, arg_max(equity, rn) AS last_eq, arg_min(equity, rn) AS first_eq, avg(ret) AS mu, stddev_samp(ret) * sqrt(252) AS vol,
  stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) AS down, sum(CASE WHEN ret < 0 THEN 1 ELSE 0 END) AS nd, min(CASE WHEN rn > 1 THEN equity / peak - 1 END) AS mdd FROM stepped GROUP BY {keys}),
tr AS (SELECT *, exit_price / entry_price - 1 AS ret FROM trades),
ts AS (SELECT {keys}, count(*) AS num, avg(CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS DOUBLE) END) AS win_rate, coalesce(avg(CASE WHEN ret > 0 THEN ret END), 0) AS avg_win,
  coalesce(avg(CASE WHEN ret < 0 THEN ret END), 0) AS avg_loss, avg(ret) AS avg_ret FROM tr GROUP BY {keys}),
perf AS MATERIALIZED (SELECT {', '.join('risk.' + k for k in ks)}, last_eq / first_eq - 1 AS total_return, pow(last_eq / first_eq, 252.0 / n) - 1 AS cagr, vol AS volatility, mu * 252 / (vol + 1e-8) AS sharpe_ratio,
  mu * 252 / CASE WHEN nd > 0 THEN down ELSE 1e-8 END AS sortino_ratio, mdd AS max_drawdown, coalesce(win_rate, 0) AS win_rate, coalesce(avg_win, 0) AS avg_win, coalesce(avg_loss, 0) AS avg_loss,
  coalesce(abs(avg_win / nullif(avg_loss, 0)), 0) AS profit_factor, coalesce(avg_ret, 0) AS avg_trade_return,
  coalesce(win_rate * avg_win - (1 - win_rate) * abs(avg_loss), 0) AS expectancy, coalesce(num, 0) AS num_trades, last_eq AS final_equity
  FROM risk LEFT JOIN ts USING ({keys}))"""


FEED = f"SELECT symbol, rn, ts, open, close, lag({signal_sql(THRESHOLD)}) OVER {SYM} AS s FROM scores"
REPLAY = f"WITH RECURSIVE {SCORES_SQL}, {replay(FEED)}"
DIGITS = {"total_return": 6, "cagr": 6, "volatility": 6, "sharpe_ratio": 4, "sortino_ratio": 4, "max_drawdown": 6, "win_rate": 6, "avg_win": 6, "avg_loss": 6,
          "profit_factor": 5, "avg_trade_return": 6, "expectancy": 6, "final_equity": 3}
PERF = ", ".join(r(c, c, k) for c, k in DIGITS.items()) + ", CAST(num_trades AS BIGINT) AS num_trades"


def run(s, d, config=EvaluationConfig()):
    return B.strategy(scores(s, d), THRESHOLD, config)


register(
    "positions",
    lambda s, d: out(
        B.positions(B.delayed(B.signals_from_scores(scores(s, d), THRESHOLD), "signal")), ("long", "was_long")
    ),
    f"""WITH {SCORES_SQL}, sg AS (SELECT *, lag({signal_sql(THRESHOLD)}) OVER {SYM} AS s1, lag({signal_sql(THRESHOLD)}, 2) OVER {SYM} AS s2 FROM scores)
    SELECT {KEY}, CAST(coalesce(last_value(nullif(s1, 0) IGNORE NULLS) OVER w > 0, FALSE) AS BIGINT) AS long,
      CAST(coalesce(last_value(nullif(s2, 0) IGNORE NULLS) OVER w > 0, FALSE) AS BIGINT) AS was_long
    FROM sg WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
register(
    "trades",
    lambda s, d: out(
        run(s, d)["trades"], ("trade_no",), keys=("symbol", "entry_ts", "exit_ts", "type"), entry_price=6, exit_price=6, shares=6, pnl=5, holding_days=0, **{"return": 6}
    ),
    f"""{REPLAY} SELECT symbol, CAST(entry_ts AS VARCHAR) AS entry_ts, CAST(exit_ts AS VARCHAR) AS exit_ts, CASE WHEN exit_ts IS NULL THEN 'LONG_ENTRY' ELSE 'COMPLETED_TRADE' END AS type,
    CAST(trade AS BIGINT) AS trade_no, {r('entry_price', 'entry_price')}, {r('exit_price', 'exit_price')}, {r('shares', 'shares')}, {r('(exit_price - entry_price) * shares', 'pnl', 5)},
    CAST(date_diff('day', entry_ts, exit_ts) AS DOUBLE) AS holding_days, {r('exit_price / entry_price - 1', '"return"')} FROM trades""",
)
register("equity_curve", lambda s, d: out(run(s, d)["curve"], cash=4, equity=4), f"{REPLAY} SELECT {KEY}, {r('capital', 'cash', 4)}, {r('equity', 'equity', 4)} FROM curve")
register("daily_positions", lambda s, d: out(run(s, d)["curve"], shares=6, value=4), f"{REPLAY} SELECT {KEY}, {r('shares', 'shares')}, {r('value', 'value', 4)} FROM curve")
register(
    "performance_metrics", lambda s, d: out(run(s, d)["metrics"], ("num_trades",), keys=("symbol",), **DIGITS), f"{REPLAY} SELECT symbol, {PERF} FROM perf"
)
CLOSE_FEED = f"WITH RECURSIVE {SCORES_SQL}, {replay(FEED, fill='close')}"
register(
    "performance_same_day_close",
    lambda s, d: out(run(s, d, EvaluationConfig(delay_days=0))["metrics"], ("num_trades",), keys=("symbol",), **DIGITS),
    f"{CLOSE_FEED} SELECT symbol, {PERF} FROM perf",
)
GRID = "grid AS (SELECT round(0.30 + 0.02 * i, 2) AS threshold FROM range(21) g(i))"
SWEEP_FEED = "SELECT symbol, threshold, rn, ts, open, close, lag(CASE WHEN score < 1 - threshold THEN -1 WHEN score >= threshold THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, threshold ORDER BY rn) AS s FROM scores, (SELECT CAST(threshold AS DOUBLE) AS threshold FROM grid)"
SWEEP = f"WITH RECURSIVE {SCORES_SQL}, {GRID}, {replay(SWEEP_FEED, 'symbol, threshold')}"
register(
    "threshold_sweep",
    lambda s, d: out(B.threshold_sweep(scores(s, d)), ("num_trades",), keys=("symbol",), threshold=2, **DIGITS),
    f"{SWEEP} SELECT symbol, round(threshold, 2) AS threshold, {PERF} FROM perf",
)
register(
    "best_threshold",
    lambda s, d: out(B.best_threshold(cut(B.threshold_sweep(scores(s, d)))), ("num_trades",), keys=("symbol",), threshold=2, **DIGITS),
    f"{SWEEP} SELECT symbol, round(threshold, 2) AS threshold, {PERF} FROM perf QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe_ratio DESC NULLS LAST, threshold) = 1",
)

# ---- folds -----------------------------------------------------------------------------
FOLDS_SQL = BARS_SQL + """,
edge AS (SELECT min(ts) AS lo, max(ts) AS hi FROM placed),
f AS (SELECT f, lo + to_days(CAST(90 * f AS INTEGER)) AS a, hi FROM edge, range(200) g(f) WHERE lo + to_days(CAST(90 * f + 1825 + 360 AS INTEGER)) <= hi),
parts AS (SELECT f AS fold, 'train' AS role, a AS part_start, a + to_days(1825) AS part_end FROM f
  UNION ALL SELECT f, 'val', a + to_days(1825), a + to_days(2005) FROM f UNION ALL SELECT f, 'test', a + to_days(2005), a + to_days(2185) FROM f),
folded AS (SELECT p.*, fold, role, part_start, part_end FROM placed p JOIN parts ON ts >= part_start AND ts < part_end),
kept AS MATERIALIZED (SELECT * FROM folded WHERE fold IN (SELECT fold FROM folded GROUP BY fold HAVING count(DISTINCT role) = 3))"""
register(
    "walk_forward_folds",
    lambda s, d: out(E.fold_summary(E.fold_rows(cut(bars(s, d)))), ("fold", "rows"), keys=("role", "part_start", "part_end")),
    f"WITH {FOLDS_SQL} SELECT role, CAST(part_start AS VARCHAR) AS part_start, CAST(part_end AS VARCHAR) AS part_end, fold, count(*) AS rows FROM kept GROUP BY ALL",
)
register(
    "fold_rows",
    lambda s, d: out(E.fold_rows(cut(bars(s, d))), ("fold",), keys=("symbol", "ts", "role"), close=6),
    f"WITH {FOLDS_SQL} SELECT {KEY}, role, fold, {r('close', 'close')} FROM kept",
)


def scored(s, d):
    """Score, next-row direction as truth, and the decision at one half."""
    df = with_halo(scores(s, d), after=1)
    df = core_rows(df.withColumn("target", ratio(lead("close", 1), "close") - 1)).filter("target IS NOT NULL")
    return df.withColumns({"label": (F.col("target") > 0).cast("int"), "prediction": (F.col("score") >= 0.5).cast("int")})


SCORED_SQL = SCORES_SQL + f""",
nx AS (SELECT *, lead(close) OVER {SYM} / close - 1 AS target FROM scores),
scored AS MATERIALIZED (SELECT *, CAST(target > 0 AS INTEGER) AS label, CAST(score >= 0.5 AS INTEGER) AS prediction FROM nx WHERE target IS NOT NULL)"""
register(
    "fold_metric_aggregate",
    lambda s, d: out(
        E.aggregate_metrics(
            E.fold_rows(cut(scored(s, d))).groupBy("fold", "role").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("value")).withColumn("metric", F.lit("accuracy"))
        ),
        keys=("role", "metric"), mean=6, std=6,
    ),
    f"""WITH {FOLDS_SQL.replace('FROM placed p JOIN', 'FROM scored p JOIN').replace(BARS_SQL, SCORED_SQL).replace('hi FROM placed', 'hi FROM scored')},
    a AS (SELECT fold, role, avg(CAST(label = prediction AS DOUBLE)) AS v FROM kept GROUP BY fold, role)
    SELECT role, 'accuracy' AS metric, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'std')} FROM a GROUP BY role""",
)
register(
    "aligned_test_rows",
    lambda s, d: out(
        scored(s, d).join(E.fold_rows(cut(bars(s, d))).filter("role = 'test'").select("symbol", "ts"), ["symbol", "ts"], "left_semi"), ("label", "prediction"), score=6
    ),
    f"WITH {FOLDS_SQL.replace(BARS_SQL, SCORED_SQL)} SELECT {KEY}, CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction, {r('score', 'score')} FROM scored WHERE (symbol, ts) IN (SELECT symbol, ts FROM kept WHERE role = 'test')",
)

# ---- metrics ---------------------------------------------------------------------------
register(
    "confusion_matrix",
    lambda s, d: out(M.confusion(scored(s, d), ("symbol",)), ("label", "prediction", "count"), keys=("symbol",)),
    f'WITH {SCORED_SQL} SELECT symbol, CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction, count(*) AS "count" FROM scored GROUP BY ALL',
)
register(
    "classification_metrics",
    lambda s, d: out(M.classification(scored(s, d), ("symbol",)), keys=("symbol",), accuracy=6, precision=6, recall=6, f1=6),
    f"""WITH {SCORED_SQL}, c AS (SELECT symbol, avg(CAST(label = prediction AS DOUBLE)) AS acc, sum(label * prediction) AS tp, sum(prediction) AS p, sum(label) AS t FROM scored GROUP BY symbol)
    SELECT symbol, {r('acc', 'accuracy')}, {r('tp / p', '"precision"')}, {r('tp / t', 'recall')}, {r('2 * tp / (t + p)', 'f1')} FROM c""",
)


def _three(s, d):
    df = scored(s, d)
    side = F.when(F.col("target") > 0.005, 1).when(F.col("target") < -0.005, -1).otherwise(0)
    return df.withColumns({"label": side, "prediction": B.signal_of(F.col("score"), F.lit(0.55))})


register(
    "classification_metrics_macro",
    lambda s, d: out(M.classification(_three(s, d), ("symbol",)), keys=("symbol",), accuracy=6, precision=6, recall=6, f1=6),
    f"""WITH {SCORED_SQL}, t AS (SELECT symbol, CASE WHEN target > 0.005 THEN 1 WHEN target < -0.005 THEN -1 ELSE 0 END AS y, {signal_sql(0.55)} AS p FROM scored),
    k AS (SELECT * FROM (VALUES (-1), (0), (1)) v(c)),
    m AS (SELECT symbol, c, sum(CAST(y = c AND p = c AS INTEGER)) AS tp, sum(CAST(p = c AS INTEGER)) AS np, sum(CAST(y = c AS INTEGER)) AS nt FROM t, k GROUP BY symbol, c)
    SELECT symbol, {r('sum(tp) / sum(nt)', 'accuracy')}, {r('avg(coalesce(tp / nullif(np, 0), 0))', '"precision"')}, {r('avg(coalesce(tp / nullif(nt, 0), 0))', 'recall')},
    {r('avg(coalesce(2 * tp / nullif(np + nt, 0), 0))', 'f1')} FROM m GROUP BY symbol""",
)
register(
    "ranking_metrics",
    lambda s, d: out(M.ranking(scored(s, d), ("symbol",)), keys=("symbol",), auc_roc=6, avg_precision=6),
    f"""WITH {SCORED_SQL}, g AS (SELECT symbol, score, sum(label) AS p, sum(1 - label) AS q FROM scored GROUP BY symbol, score),
    h AS (SELECT *, sum(q) OVER (PARTITION BY symbol ORDER BY score) - q AS below, sum(p) OVER (PARTITION BY symbol ORDER BY score DESC) AS pa,
      sum(p + q) OVER (PARTITION BY symbol ORDER BY score DESC) AS al FROM g)
    SELECT symbol, {r('sum(p * (below + q / 2.0)) / (sum(p) * sum(q))', 'auc_roc')}, {r('sum(p * pa / al) / sum(p)', 'avg_precision')} FROM h GROUP BY symbol""",
)


def _probabilities(s, d):
    df = _three(s, d)
    up, down = F.col("score"), 1 - F.col("score")
    return df.withColumns({"label": F.col("label") + 1, "probabilities": F.array(down * 0.7, F.lit(0.3) + 0 * up, up * 0.7)})


register(
    "ranking_metrics_multiclass",
    lambda s, d: out(M.one_vs_rest_auc(_probabilities(s, d), 3, ("symbol",)), keys=("symbol",), auc_roc=6),
    f"""WITH {SCORED_SQL}, t AS (SELECT symbol, CASE WHEN target > 0.005 THEN 2 WHEN target < -0.005 THEN 0 ELSE 1 END AS y, score FROM scored),
    c AS (SELECT symbol, c, CAST(y = c AS INTEGER) AS label, CASE c WHEN 0 THEN (1 - score) * 0.7 WHEN 1 THEN 0.3 + 0 * score ELSE score * 0.7 END AS sc FROM t, (VALUES (0), (1), (2)) v(c)),
    g AS (SELECT symbol, c, sc, sum(label) AS p, sum(1 - label) AS q FROM c GROUP BY symbol, c, sc),
    h AS (SELECT *, sum(q) OVER (PARTITION BY symbol, c ORDER BY sc) - q AS below FROM g),
    a AS (SELECT symbol, c, sum(p * (below + q / 2.0)) / (sum(p) * sum(q)) AS auc FROM h GROUP BY symbol, c)
    SELECT symbol, {r('avg(auc)', 'auc_roc')} FROM a GROUP BY symbol""",
)
register(
    "regression_metrics",
    lambda s, d: out(
        M.regression(scored(s, d).withColumns({"label": F.col("target"), "prediction": (F.col("score") - 0.5) / 20}), ("symbol",)),
        keys=("symbol",), mse=8, rmse=6, mae=6, r2=5, directional_accuracy=6,
    ),
    f"""WITH {SCORED_SQL}, t AS (SELECT symbol, target AS y, (score - 0.5) / 20 AS p FROM scored)
    SELECT symbol, {r('avg((y - p) * (y - p))', 'mse', 8)}, {r('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {r('avg(abs(y - p))', 'mae')},
    {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 'r2', 5)}, {r('avg(CAST(sign(y) = sign(p) AS DOUBLE))', 'directional_accuracy')} FROM t GROUP BY symbol""",
)
register(
    "directional_match",
    lambda s, d: out(scored(s, d).withColumn("match", (F.signum("target") == F.signum(F.col("score") - 0.5)).cast("int")), ("match",)),
    f"WITH {SCORED_SQL} SELECT {KEY}, CAST(sign(target) = sign(score - 0.5) AS BIGINT) AS match FROM scored",
)
register(
    "focal_loss",
    lambda s, d: out(M.focal_loss(scored(s, d).withColumn("margin", (F.col("score") - 0.5) * 8), keys=("symbol",)), keys=("symbol",), focal_loss=6),
    f"""WITH {SCORED_SQL}, b AS (SELECT symbol, greatest((score - 0.5) * 8, 0) - (score - 0.5) * 8 * label + ln(1 + exp(-abs((score - 0.5) * 8))) AS bce FROM scored)
    SELECT symbol, {r('avg(0.25 * pow(1 - exp(-bce), 2) * bce)', 'focal_loss')} FROM b GROUP BY symbol""",
)
