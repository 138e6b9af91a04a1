import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import QualityConfig
from tidemark.operators import quality as Q
from tidemark.operators.frame import position
from tidemark.session import cut
from tidemark.sources import bars as S


def test_missing_columns_are_an_error(spark):
    df = spark.createDataFrame([("2020-01-01", 1.0, 1.0)], "Date string, Open double, High double")
    with pytest.raises(ValueError, match="low"):
        S.load_bars(df, symbol="X")


def test_volume_is_optional_and_nan_is_null(spark):
    df = spark.createDataFrame([("2020-01-01", 1.0, 2.0, 0.5, float("nan"))], "Date string, Open double, High double, Low double, Close double")
    row = S.load_bars(df, symbol="X").first()
    assert row["close"] is None and row["volume"] is None and row["symbol"] == "X"


def test_rows_with_null_prices_survive_the_checks(spark):
    rows = [("X", 1.0, 2.0, 0.5, None), ("X", None, 0.4, 0.5, 1.0), ("X", 1.0, 2.0, -0.5, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, open double, high double, low double, close double")
    assert Q.drop_non_positive(Q.drop_invalid_high(df)).count() == 1


def test_interpolation_limits(bars):
    df, pdf = bars
    placed = cut(position(df))
    rn = F.col("rn")
    holes = placed.withColumn("close", F.when(rn.between(100, 103) | rn.between(200, 209) | (rn > 590), None).otherwise(F.col("close")))
    got = Q.interpolate(holes, ("close",), size=32).filter("symbol = 'X'").orderBy("rn").toPandas().close
    want = holes.filter("symbol = 'X'").orderBy("rn").toPandas().close.interpolate(method="linear", limit=5)
    pd.testing.assert_series_equal(got, want, check_exact=False)


def test_preprocess_drops_short_series_and_keeps_every_row(bars):
    df, pdf = bars
    got = Q.preprocess(df, QualityConfig(), size=128).toPandas()
    assert set(got.symbol) == {"X"} and len(got) == 600
    x = got.sort_values("ts").reset_index(drop=True)
    close = pdf[pdf.symbol == "X"].reset_index(drop=True).close
    want = (close - close.rolling(252, min_periods=1).mean()) / (close.rolling(252, min_periods=1).std() + 1e-8)
    pd.testing.assert_series_equal(x.close_norm, want, check_names=False, rtol=1e-6)


def test_unknown_methods_are_refused(bars):
    df, _ = bars
    with pytest.raises(ValueError):
        Q.fill_missing(df, "guess")
    with pytest.raises(ValueError):
        Q.normalized("close", "guess", 5)
