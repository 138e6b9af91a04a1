"""Sharding must not show: small shards give the same results as whole series."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import frame as R
from tidemark.operators import labels as L
from tidemark.session import cut


def of(df, symbol="X"):
    return df[df.symbol == symbol].sort_values("ts").reset_index(drop=True)


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(a.astype(float).to_numpy(), np.asarray(b, dtype=float), rtol=tol, atol=tol, equal_nan=True)


def test_position_counts_rows_across_buckets(bars):
    df, pdf = bars
    got = R.position(df, size=50).toPandas()
    for s in ("X", "Y"):
        g = of(got, s)
        assert list(g.rn) == list(range(1, len(g) + 1))
        assert set(g.n) == {len(g)}


def test_prefix_in_two_levels(spark):
    rows = [("a", i, i * 2) for i in range(50)]
    totals = spark.createDataFrame(rows, "symbol string, b long, v long")
    got = R.prefix(totals, ["symbol"], "b", {"v": "sum"}, fan=7, grand=True).orderBy("b").collect()
    run = 0
    for r, (_, i, v) in zip(got, rows):
        assert r["v"] == run and r["v_all"] == sum(x[2] for x in rows)
        run += v


def test_running_folds_both_ways(bars):
    df, pdf = bars
    placed = cut(R.position(df, size=50))
    holes = placed.withColumn("close", F.when(F.col("rn") % 90 < 60, F.col("close")))
    fwd = of(R.running(holes, {"f": ("last", F.col("close")), "m": ("max", F.col("high")), "s": ("sum", F.col("volume"))}, size=16).toPandas())
    bwd = of(R.running(holes, {"b": ("last", F.col("close"))}, reverse=True, size=16).toPandas())
    x = of(holes.toPandas())
    same(fwd.f, x.close.ffill())
    same(fwd.m, x.high.cummax())
    same(fwd.s, x.volume.cumsum())
    same(bwd.b, x.close.bfill())


def test_ema_matches_pandas_for_any_block(bars):
    df, pdf = bars
    placed = cut(R.position(df))
    spans = {"e3": 3, "e26": 26, "e80": 80}
    for block in (8, 64):
        got = of(R.ema(placed, "close", spans, block=block).toPandas())
        for name, span in spans.items():
            same(got[name], of(pdf).close.ewm(span=span, adjust=False).mean(), 1e-10)


def test_streak_crosses_shards(bars):
    df, pdf = bars
    placed = cut(R.position(df))
    got = of(R.streak(placed, {"k": F.col("rn") % 100 != 0}, size=16).toPandas())
    assert list(got.k) == [i % 100 for i in range(1, 601)]


def test_grouped_quantile_is_exact(bars):
    df, pdf = bars
    for q in (0.0, 0.25, 0.5, 0.9):
        got = R.grouped_quantile(df, ["symbol"], "close", q, "q").toPandas().set_index("symbol").q
        want = pdf.groupby("symbol").close.quantile(q)
        for s in ("X", "Y"):
            assert abs(got[s] - want[s]) < 1e-9


def test_features_do_not_depend_on_shard_size(bars):
    df, _ = bars
    placed = cut(R.position(df))
    names = X.feature_names()[9:]
    a = X.features(placed, size=2048).select("symbol", "ts", *names).toPandas()
    b = X.features(placed, size=90).select("symbol", "ts", *names).toPandas()
    for s in ("X", "Y"):
        for c in names:
            same(of(a, s)[c], of(b, s)[c], 1e-7)


def test_features_match_pandas(bars):
    df, pdf = bars
    got = of(X.features(cut(R.position(df)), size=100).toPandas())
    x = of(pdf)
    lr = np.log(x.close / x.close.shift(1))
    same(got.volatility_20, lr.rolling(20, min_periods=10).std(), 1e-8)
    same(got.sma_80, x.close.rolling(80, min_periods=40).mean(), 1e-9)
    same(got.bb_width_40, 2 * x.close.rolling(40).std() / (x.close.rolling(40).mean() + 1e-8), 1e-8)
    same(got.stoch_k_10, (x.close - x.low.rolling(10).min()) / (x.high.rolling(10).max() - x.low.rolling(10).min() + 1e-8) * 100, 1e-7)
    same(got.volume_zscore_5, (x.volume - x.volume.rolling(5).mean()) / (x.volume.rolling(5).std() + 1e-8), 1e-7)
    same(got.volume_surge_80, x.volume / (x.volume.rolling(80).median() + 1e-8), 1e-9)
    flow = (np.sign(lr) * x.volume).fillna(0).cumsum()
    same(got.obv_slope_20, flow.diff(20) / 20, 1e-7)
    same(got.price_volume_corr_20, lr.rolling(20).corr(x.volume.pct_change()), 1e-7)
    same(got.autocorr_lag_5, lr.rolling(60).apply(lambda v: v.autocorr(5)), 1e-7)
    same(got.days_since_low_40, x.low.rolling(40).apply(lambda v: len(v) - 1 - v.argmin(), raw=True))


def test_only_look_ahead_columns_change_when_the_future_is_cut(bars):
    df, pdf = bars
    names = [n for n in X.feature_names()[9:] if not n.startswith(("price_volume_divergence", "sax"))]
    whole = of(X.features(cut(R.position(df))).toPandas())
    part = of(X.features(cut(R.position(df.filter("ts < '2021-03-01'")))).toPandas())
    for c in names:
        same(part[c], whole[c][: len(part)], 1e-7)


def test_constant_and_null_series_do_not_fail(bars):
    df, _ = bars
    flat = df.withColumns({c: F.lit(100.0) for c in ("open", "high", "low", "close")})
    got = of(X.features(cut(R.position(flat))).toPandas())
    assert got.rsi_10.dropna().eq(0).all() and got.bb_width_20.dropna().eq(0).all()
    assert got.autocorr_lag_1.isna().all()
    same(got.ema_10.dropna(), [100.0] * len(got.ema_10.dropna()))
    bare = df.withColumn("volume", F.lit(None).cast("double"))
    got = of(X.features(cut(R.position(bare))).toPandas())
    assert got.vwap_10.isna().all() and got.obv_slope_3.dropna().eq(0).all()
    assert of(L.labels(cut(R.position(bare))).toPandas()).shape[0] == 600


def test_labels_do_not_depend_on_shard_size(bars):
    df, _ = bars
    placed = cut(R.position(df))
    a, b = (of(L.labels(placed, size=k).toPandas()) for k in (2048, 64))
    pd.testing.assert_frame_equal(a, b)


def test_manifests_name_real_columns_and_keep_labels_out(bars):
    df, _ = bars
    from tidemark.operators.quality import calendar

    placed = cut(R.position(df))
    names = X.feature_names()
    assert len(names) == len(set(names))
    assert set(names) <= set(calendar(X.features(placed)).columns)
    groups = L.label_columns()
    made = L.labels(placed).columns
    assert all(set(g) <= set(made) for g in groups.values())
    assert not set(names) & set(made[2:])


def test_numbering_windows_are_bounded_from_seconds_to_days(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.frame import SIZE, bucket_of, position

    for step in (1, 60, 3600, 86400):
        ts = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * step)
        made = spark.range(20_000).select(F.lit("X").alias("symbol"), ts.alias("ts"), (F.col("id") + 1).alias("want"))
        most = made.groupBy(bucket_of(F.col("ts"))).count().agg(F.max("count")).first()[0]
        assert most <= SIZE
        numbered = position(made)
        assert numbered.filter("rn = want and n = 20000").count() == 20_000
