"""Training sets, models, attributions, texts, sinks and the end-to-end plans."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from checks.evaluation_queries import SCORED_SQL, scored
from checks.fixtures import BARS_SQL, BASE_SQL, SCORES_SQL, SYM, bars, out, placed, r, scores, span
from checks.pattern_queries import LIBRARY_SQL, _tables
from tidemark.config import EvaluationConfig, Settings
from tidemark.functions.exprs import lag, ratio
from tidemark.operators import cycles as C
from tidemark.operators import explain as E
from tidemark.operators import features as X
from tidemark.operators import folds
from tidemark.operators import labels as L
from tidemark.operators import metrics as MT
from tidemark.operators import models as M
from tidemark.operators.frame import core_rows, with_halo
from tidemark.plans import stages
from tidemark.session import cut, ensure_checkpoint_dir, written
from tidemark.sources import bars as S
from tidemark.sources import sinks

QUERIES, SQL = {}, {}
KEY = "symbol, CAST(ts AS VARCHAR) AS ts"
DEFAULT = Settings()
_TRAINED: dict[tuple[str, str, str], dict] = {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


#: Models of the registered queries: the defaults, but this many trees at most, as one query must end within a few minutes on one machine.
QUERY = replace(DEFAULT, models=replace(DEFAULT.models, trees=12))


def once(kind, s, d, make):
    """What several queries below read; made once per application and data set."""
    key = (s.sparkContext.applicationId, kind, d)
    if key not in _TRAINED:
        _TRAINED[key] = make()
    return _TRAINED[key]


def training(s, d):
    """Bars, stored as whatever reads them would aggregate the ticks again; clean bars, and the rows and columns to train on."""

    def make():
        made = written(bars(s, d))
        clean = stages.prepared(made, QUERY)
        return {"bars": made, "clean": clean, **stages.training_rows(clean, settings=QUERY)}

    return once("rows", s, d, make)


def trained(s, d):
    """The binary model of the ten-day move with its scored test rows."""
    t = training(s, d)
    return once("model", s, d, lambda: {**t, **stages.fitted(t["rows"], t["names"], settings=QUERY)})


def scratch(s):
    ensure_checkpoint_dir(s)
    return f"{s.sparkContext.getCheckpointDir()}/out-{uuid.uuid4().hex}"


# ---- training set ----------------------------------------------------------------------
register(
    "training_split",
    lambda s, d: out(M.split(cut(scored(s, d))), ("label",), keys=("symbol", "ts", "role"), score=6),
    f"""WITH {SCORED_SQL}, o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM scored),
    c AS (SELECT min(CASE WHEN i = CAST(floor(n * 0.8) AS BIGINT) THEN ts END) AS test, min(CASE WHEN i = CAST(floor(n * (0.8 * 0.9)) AS BIGINT) THEN ts END) AS val FROM o)
    SELECT {KEY}, CASE WHEN ts >= test THEN 'test' WHEN ts >= val THEN 'validation' ELSE 'train' END AS role, CAST(label AS BIGINT) AS label, {r('score', 'score')} FROM scored, c""",
)
register(
    "class_weights",
    lambda s, d: out(M.class_weights(scored(s, d)), ("label",), keys=(), weight=6),
    f"WITH {SCORED_SQL} SELECT CAST(label AS BIGINT) AS label, {r('(SELECT count(*) FROM scored) / (2.0 * count(*))', 'weight')} FROM scored GROUP BY label",
)


def _sequence_source(s, d):
    b = with_halo(placed(s, d), before=1)
    return core_rows(b.withColumns({"ret": ratio("close", lag("close")) - 1, "range": ratio(F.col("high") - F.col("low"), "close")}))


register(
    "sequence_windows",
    lambda s, d: out(
        M.sequences(_sequence_source(s, d), ["ret", "range"], 15).withColumns(
            {"steps": F.size("sequence"), "first_ret": F.get(F.get("sequence", F.lit(0)), F.lit(0)), "last_range": F.get(F.get("sequence", F.lit(14)), F.lit(1))}
        ).withColumn("total", F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x)),
        ("steps",), first_ret=6, last_range=6, total=6,
    ),
    f"""WITH {BASE_SQL}, q AS (SELECT *, coalesce(close / prev - 1, 0) AS ret, rng / close AS rg FROM base)
    SELECT {KEY}, CAST(15 AS BIGINT) AS steps, {r(f'lag(ret, 14) OVER {SYM}', 'first_ret')}, {r('rg', 'last_range')}, {r(f'sum(ret + rg) OVER {span(-14, 0)}', 'total')}
    FROM q QUALIFY rn >= 15""",
)


def _network(s, d):
    rows = M.sequences(_sequence_source(s, d), ["ret", "range"], 15)
    labelled = rows.join(scored(s, d).select("symbol", "ts", F.col("label").cast("double").alias("label")), ["symbol", "ts"])
    net, flat = M.sequence_network(cut(labelled), 15, 2)
    return net.transform(flat).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("rows"))


register("sequence_network", _network)

# ---- models ----------------------------------------------------------------------------
register("gbt_scores", lambda s, d: out(trained(s, d)["test"], ("label",), score=6))
register("gbt_test_metrics", lambda s, d: trained(s, d)["metrics"])
register("gbt_importance", lambda s, d: trained(s, d)["importance"])


def _regression(s, d):
    t = training(s, d)
    target = L.move(L.base(with_halo(t["clean"], before=15, after=10)), 10)
    target = core_rows(target).select("symbol", "ts", F.col("magnitude_move_10d").alias("label"))
    names = t["names"]
    rows = cut(t["rows"].drop("label").join(target, ["symbol", "ts"]))
    model = M.boosted_trees(rows, names, "regression", QUERY.models)
    return MT.regression(M.predict(model, rows.filter("role = 'test'"), names))


def _classes(s, d):
    t = training(s, d)
    target = core_rows(L.move(L.base(with_halo(t["clean"], before=15, after=10)), 10)).select("symbol", "ts", (F.col("label_move_10d") + 1).cast("double").alias("label"))
    rows = cut(t["rows"].drop("label").join(target.filter("label IS NOT NULL"), ["symbol", "ts"]))
    return rows, M.boosted_trees(rows, t["names"], "multiclass", QUERY.models)


def _multiclass(s, d):
    names = training(s, d)["names"]
    rows, model = once("classes", s, d, lambda: _classes(s, d))
    test = cut(M.predict(model, rows.filter("role = 'test'"), names).select("label", "prediction", "probabilities"))
    labels = sorted(M.class_columns(model))
    auc = MT.one_vs_rest_auc(test, len(labels), classes=labels)
    sides = [MT.tall(MT.classification(test), ("rows", "accuracy", "precision", "recall", "f1")), MT.tall(auc, ("auc_roc",))]
    return sides[0].unionByName(sides[1])


register("gbt_regression_metrics", _regression)
register("gbt_multiclass_metrics", _multiclass)


def _cross_validation(s, d):
    t = training(s, d)
    names = t["names"]

    def fit(train, val):
        both = train.withColumn("role", F.lit("train")).unionByName(val.withColumn("role", F.lit("validation")))
        return M.boosted_trees(both, names, "binary", QUERY.models)

    def predict(model, rows):
        return cut(M.predict(model, rows, names).select("label", "prediction"))

    def score(scored_rows):
        return MT.tall(MT.classification(scored_rows), ("accuracy", "precision", "recall", "f1"))

    return folds.cross_validate(t["rows"].drop("role"), fit, predict, score)[1]


register("cross_validation", _cross_validation)
register(
    "strategy_backtest",
    lambda s, d: stages.backtest_scores(trained(s, d)["clean"], trained(s, d)["test"], 0.5, QUERY)["metrics"],
)

# ---- attributions ----------------------------------------------------------------------


def explained(s, d):
    t = trained(s, d)
    return E.attributions(t["model"], t["test"], t["names"])




def _class_attributions(s, d):
    """The latest fifty test rows, explained for each class by its own trees."""
    names = training(s, d)["names"]
    rows, model = once("classes", s, d, lambda: _classes(s, d))
    latest = rows.filter("role = 'test'").orderBy(F.desc("ts"), "symbol").limit(50)
    return out(E.attributions(model, latest, names).withColumn("label", F.col("class")), ("label",), base=6, margin=6)


register("attribution_classes", _class_attributions)
register("attribution_margin", lambda s, d: out(explained(s, d), base=6, margin=6))
register("attribution_importance", lambda s, d: E.global_importance(explained(s, d), trained(s, d)["names"]))
register("instance_explanations", lambda s, d: out(E.instance_explanations(explained(s, d), trained(s, d)["names"]), ("rank",), keys=("symbol", "ts", "feature"), attribution=6, value=6))


def _linear(s, d):
    """Attributions SQL can state too: score parts of a linear rule on bar returns."""
    b = _sequence_source(s, d).withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    return b.select("symbol", "ts", F.array("ret", "range", F.col("close") / 100 - 1).alias("values"), F.array(F.col("ret") * 3, F.col("range") * -2, F.col("close") / 100 - 1).alias("attribution"))


PARTS = ["return_5", "range_20", "level_20d"]
LINEAR_SQL = f"""{BASE_SQL}, q AS (SELECT *, coalesce(close / prev - 1, 0) AS ret, rng / close AS rg, close / 100 - 1 AS lv FROM base),
u AS (SELECT symbol, ts, 'return_5' AS feature, ret * 3 AS a FROM q UNION ALL SELECT symbol, ts, 'range_20', rg * -2 FROM q UNION ALL SELECT symbol, ts, 'level_20d', lv FROM q)"""
register(
    "top_factors",
    lambda s, d: out(E.instance_explanations(_linear(s, d), PARTS, 2), ("rank",), keys=("symbol", "ts", "feature"), attribution=6),
    f"""WITH {LINEAR_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY abs(a) DESC, feature) AS rank FROM u)
    SELECT {KEY}, feature, rank, {r('a', 'attribution')} FROM z WHERE rank <= 2""",
)
register(
    "window_attributions",
    lambda s, d: out(E.window_attributions(_linear(s, d), PARTS, (5, 20, 40)), ("window",), attribution=6),
    f"""WITH {LINEAR_SQL}, w AS (SELECT symbol, ts, v AS win, coalesce(sum(CASE WHEN (feature = 'return_5' AND v = 5) OR (feature <> 'return_5' AND v = 20) THEN abs(a) END), 0) AS s
      FROM u, (VALUES (5), (20), (40)) g(v) GROUP BY ALL)
    SELECT {KEY}, CAST(win AS BIGINT) AS "window", {r('s', 'attribution')} FROM w""",
)
register(
    "linear_importance",
    lambda s, d: out(E.global_importance(_linear(s, d), PARTS), keys=("feature",), importance=6),
    f"WITH {LINEAR_SQL} SELECT feature, {r('avg(abs(a))', 'importance')} FROM u GROUP BY feature",
)

# ---- texts -----------------------------------------------------------------------------
register(
    "pattern_report",
    lambda s, d: out(E.pattern_report(*_tables(s, d)), ("occurrences", "best_horizon_days"), keys=("symbol", "pattern_name", "description"), win_rate=6, mean_return=6, sharpe_ratio=4),
    f"""WITH {LIBRARY_SQL}, b AS (SELECT * FROM power QUALIFY row_number() OVER (PARTITION BY symbol, pattern_name ORDER BY sharpe_ratio DESC, horizon) = 1),
    w AS (SELECT * FROM power QUALIFY row_number() OVER (PARTITION BY symbol, pattern_name ORDER BY win_rate DESC, horizon) = 1)
    SELECT s.symbol, s.pattern_name, 'Pattern: ' || s.pattern_name || '. Observed ' || occurrences || ' times in the dataset' ||
      CASE WHEN w.win_rate > 0 THEN printf('. Best predictive power at %d-day horizon: %.1f%% win rate, %.2f%% mean return', w.horizon, w.win_rate * 100, w.mean_return * 100) ELSE '' END || '.' AS description,
      occurrences, b.horizon AS best_horizon_days, {r('b.win_rate', 'win_rate')}, {r('b.mean_return', 'mean_return')}, {r('b.sharpe_ratio', 'sharpe_ratio', 4)}
    FROM shapes s LEFT JOIN b ON s.symbol = b.symbol AND s.pattern_name = b.pattern_name LEFT JOIN w ON s.symbol = w.symbol AND s.pattern_name = w.pattern_name""",
)
IMPORTANCE = [("volume", 0.6), ("close", 0.3), ("momentum_99", 0.2), ("open", 0.1)]
register(
    "signal_explanations",
    lambda s, d: out(E.explain_signals(scores(s, d), IMPORTANCE, 0.55), keys=("symbol", "ts", "signal", "narrative"), confidence=6),
    f"""WITH {SCORES_SQL}, x AS (SELECT *, CASE WHEN score >= 0.55 THEN 'BUY' ELSE 'HOLD/SELL' END AS signal, abs(score - 0.5) * 2 AS conf FROM scores)
    SELECT {KEY}, signal, 'Signal: ' || signal || chr(10) || printf('Confidence: %.1f%%', conf * 100) || chr(10) || 'Key factors:' || chr(10)
      || printf('  - volume: %.3f (importance: 0.600)', volume) || chr(10) || printf('  - close: %.3f (importance: 0.300)', close) || chr(10)
      || printf('  - open: %.3f (importance: 0.100)', open) AS narrative, {r('conf', 'confidence')} FROM x""",
)


def _report(s, d):
    t = trained(s, d)
    regimes = core_rows(L.regime(with_halo(t["clean"], before=41)))
    return E.prediction_report(t["test"], explained(s, d), t["names"], regimes=regimes).select(
        F.col("symbol"), F.col("ts").cast("string").alias("ts"), F.round("score", 6).alias("score"), "signal", "regime", F.to_json("factors").alias("factors")
    )


register("prediction_report", _report)
register(
    "score_and_explain",
    lambda s, d: stages.score_and_explain(training(s, d)["bars"], trained(s, d)["model"], start="1998-06-01", settings=QUERY).select(
        "symbol", F.col("ts").cast("string").alias("ts"), F.round("score", 6).alias("score"), "signal", F.to_json("factors").alias("factors")
    ),
)

# ---- sources and sinks -----------------------------------------------------------------


def _csv_bars(s, d):
    path = scratch(s)
    table = bars(s, d).select(F.col("symbol").alias("Symbol"), F.col("ts").cast("date").alias("Date"), *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    table.write.option("header", True).csv(path)
    return out(S.read_csv_bars(s, path), open=6, high=6, low=6, close=6, volume=6)


register(
    "csv_bars", _csv_bars,
    f"WITH {BARS_SQL} SELECT {KEY}, " + ", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume")) + " FROM bars",
)


def _importance_csv(s, d):
    path = scratch(s)
    sinks.write_importance_csv(trained(s, d)["importance"], path)
    return s.read.csv(path, header=True, schema="feature string, importance double")


def _json_sink(s, d):
    path = scratch(s)
    table = C.acf(cut(C.series_of(placed(s, d)))).groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("acf"))
    sinks.write_json(table, path)
    back = sinks.read_json(s, path, "symbol string, acf array<double>")
    return out(back.select("symbol", F.posexplode("acf").alias("i", "acf")).withColumn("lag", F.col("i") + 1), ("lag",), keys=("symbol",), acf=6)


def _saved_model(s, d):
    path = scratch(s)
    t = trained(s, d)
    sinks.save_model(t["model"], path)
    return out(M.predict(sinks.load_model(path), t["test"].drop("features", "score", "prediction"), t["names"]), ("label",), score=6)


register("importance_csv", _importance_csv)
register(
    "json_sink", _json_sink,
    f"WITH {BARS_SQL} SELECT a.symbol, a.rn - b.rn AS lag, {r('corr(a.close, b.close)', 'acf')} FROM placed a JOIN placed b ON a.symbol = b.symbol AND a.rn > b.rn AND a.rn <= b.rn + 100 GROUP BY a.symbol, a.rn - b.rn",
)
register("saved_model_scores", _saved_model)
