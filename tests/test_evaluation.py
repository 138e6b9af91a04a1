import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.config import EvaluationConfig, ModelConfig
from tidemark.operators import backtest as B
from tidemark.operators import explain as E
from tidemark.operators import metrics as M
from tidemark.operators import models
from tidemark.operators.frame import position
from tidemark.session import cut


def replay(pdf, signal, config):
    """A plain event loop over one series."""
    cash, shares, entry, equity, trades = config.capital, 0.0, 0.0, [config.capital], []
    cost = (config.spread_bps + config.slippage_bps) / 10000
    for i in range(1, len(pdf)):
        price, s = pdf.open[i], signal[i - 1]
        if s > 0 and shares == 0:
            stake = cash * config.position_share
            entry = price * (1 + cost)
            shares = stake / entry
            cash -= stake * (1 + config.commission)
        elif s < 0 and shares > 0:
            value = shares * price * (1 - cost)
            cash += value * (1 - config.commission)
            trades.append(price * (1 - cost) / entry - 1)
            shares = 0.0
        equity.append(cash + shares * pdf.close[i])
    return np.array(equity), trades


def test_backtest_matches_an_event_loop_over_small_shards(bars):
    df, pdf = bars
    config = EvaluationConfig()
    placed = position(df)
    signal = F.when(F.col("rn") % 37 == 5, 1).when(F.col("rn") % 53 == 9, -1).otherwise(0)
    result = B.backtest(cut(placed.withColumn("signal", signal)), config, size=64)
    curve = result["curve"].toPandas()
    for s in ("X", "Y"):
        x = pdf[pdf.symbol == s].reset_index(drop=True)
        rn = np.arange(1, len(x) + 1)
        want, trades = replay(x, np.where(rn % 37 == 5, 1, np.where(rn % 53 == 9, -1, 0)), config)
        got = curve[curve.symbol == s].sort_values("rn")
        np.testing.assert_allclose(got.equity, want, rtol=1e-11)
        np.testing.assert_allclose(got.cash + got.value, got.equity, rtol=1e-12)
        done = result["trades"].filter(f"symbol = '{s}' AND type = 'COMPLETED_TRADE'").orderBy("trade_no").toPandas()
        np.testing.assert_allclose(done["return"], trades, rtol=1e-10)


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(1)
    score, label = rng.integers(0, 20, 400) / 20, rng.integers(0, 2, 400)
    df = spark.createDataFrame(pd.DataFrame({"score": score, "label": label}))
    got = M.ranking(df, partitions=5).first()
    pos, neg = score[label == 1], score[label == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ap = sum((pos == s).sum() / len(pos) * (pos >= s).sum() / (score >= s).sum() for s in np.unique(score))
    assert abs(got["auc_roc"] - auc) < 1e-12 and abs(got["avg_precision"] - ap) < 1e-12


def test_attributions_are_additive_and_match_brute_force(spark):
    import itertools
    import math

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(500, 3)), columns=["a", "b", "c"])
    pdf["label"] = ((pdf.a + pdf.b * pdf.c) > 0).astype(float)
    pdf["symbol"], pdf["ts"] = "X", pd.date_range("2020-01-01", periods=500, freq="D")
    rows = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("role", F.when(F.col("ts") >= "2021-03-01", "validation").otherwise("train"))
    names = ["a", "b", "c"]
    model = models.boosted_trees(rows, names, "binary", ModelConfig(trees=5, depth=3, learning_rate=0.3))
    explained = E.attributions(model, rows, names).orderBy("ts").toPandas()
    scored = models.predict(model, rows, names).orderBy("ts").toPandas()
    np.testing.assert_allclose(1 / (1 + np.exp(-2 * explained.margin)), scored.score, rtol=1e-9)

    leaves = E.leaf_table(model.stages[-1], spark)
    x = pdf[names].to_numpy()[:5]

    def value(row, known):
        total = 0.0
        for leaf in leaves:
            part = leaf["value"]
            for f, (low, high, share) in leaf["path"].items():
                part *= float(low < row[f] <= high) if f in known else share
            total += part
        return total

    for i, row in enumerate(x):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            phi = 0.0
            for k in range(3):
                for s in itertools.combinations(rest, k):
                    weight = math.factorial(k) * math.factorial(2 - k) / 6
                    phi += weight * (value(row, {*s, f}) - value(row, set(s)))
            assert abs(phi - explained.attribution[i][f]) < 1e-10


def test_attributions_of_every_class_are_additive(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(240, 2)), columns=["a", "b"])
    pdf["label"] = np.where(pdf.a > 0.4, 2.0, np.where(pdf.b > 0, 1.0, 0.0))
    pdf["symbol"], pdf["ts"] = "X", pd.date_range("2020-01-01", periods=240, freq="D")
    rows = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("role", F.lit("train"))
    model = models.boosted_trees(rows, ["a", "b"], "multiclass", ModelConfig(trees=3, depth=3, learning_rate=0.3))
    explained = E.attributions(model, rows, ["a", "b"]).toPandas()
    assert len(explained) == 720 and set(explained["class"]) == {0.0, 1.0, 2.0}
    raw = model.transform(rows.orderBy("ts")).toPandas().sort_values("ts")
    for c, column in models.class_columns(model).items():
        margin = explained[explained["class"] == c].sort_values("ts").margin
        np.testing.assert_allclose(1 / (1 + np.exp(-2 * margin)), [p[1] for p in raw[column]], rtol=1e-9)


def test_deep_paths_by_row_equal_paths_by_pattern():
    rng = np.random.default_rng(8)
    leaves = [{"value": rng.normal(), "path": {int(f): (-1.0, float(rng.normal()), float(rng.random())) for f in rng.choice(9, d, replace=False)}} for d in (0, 1, 3, 3, 6, 6)]
    x = rng.normal(size=(40, 9))
    np.testing.assert_allclose(E.attribute(x, leaves), E.attribute(x, leaves, deepest=2), atol=1e-12)


def test_window_names():
    assert E.window_of("momentum_20", (3, 5, 10, 20)) == 20
    assert E.window_of("macd", (3, 5)) is None
