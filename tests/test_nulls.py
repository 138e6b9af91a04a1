"""Null prices: rows keep their place, series start at their first value."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import quality as Q
from tidemark.operators.frame import ema, position, with_halo
from tidemark.session import cut


def holed(df, *rows):
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2020-01-01").cast("date"))
    return df.withColumn("close", F.when(~day.isin(*rows), F.col("close")))


def test_moves_count_rows_not_closes(bars):
    df, pdf = bars
    framed = L.base(with_halo(position(holed(df.filter("symbol = 'X'"), 61)), before=46, after=20))
    got = L.move(framed, 3).filter("core").orderBy("rn").toPandas().set_index("rn")
    x = pdf[pdf.symbol == "X"].close.to_numpy().copy()
    x[61] = np.nan
    for i in (57, 58, 59, 60, 62):
        future = (x[i + 1:i + 4] - x[i]) / x[i]
        edge = 1.5 * got.atr_14[i + 1] / x[i]
        up, down = np.flatnonzero(future >= edge), np.flatnonzero(future <= -edge)
        if len(up) and (not len(down) or up[0] < down[0]):
            want = (1, np.nanmax(future))
        elif len(down):
            want = (-1, np.nanmin(future))
        else:
            want = (0, future[-1])
        assert got.label_move_3d[i + 1] == want[0]
        np.testing.assert_allclose(got.magnitude_move_3d[i + 1], want[1], rtol=1e-9)


def test_consolidation_looks_back_over_rows(bars):
    df, pdf = bars
    low = F.when(F.col("rn") % 11 != 0, F.col("low"))
    high = F.when(F.col("rn") % 7 != 0, F.col("high"))
    volume = F.when(F.col("rn") % 5 != 0, F.col("volume"))
    from tidemark.config import LabelConfig
    config = LabelConfig(width_multiplier=6.0)
    framed = L.base(with_halo(position(df.filter("symbol = 'X'")), before=46, after=20))
    framed = framed.withColumns({"low": low, "high": high, "volume": volume})
    got = L.consolidation(framed, config).filter("core").orderBy("rn").toPandas()
    assert got.in_consolidation.sum() > 0
    for i in range(config.max_days, len(got)):
        days = width = None
        for k in range(config.min_days, config.max_days + 1):
            part = got.iloc[i - k:i]
            middle = part.atr_14.median()
            if part.high.max() - part.low.min() <= config.width_multiplier * middle:
                days, width = k, (part.high.max() - part.low.min()) / middle
                break
        assert got.consolidation_days[i] == (days or 0), i
        if days:
            np.testing.assert_allclose(got.consolidation_width[i], width, rtol=1e-9)


def test_ema_starts_at_the_first_value(bars):
    df, pdf = bars
    placed = cut(position(holed(df.filter("symbol = 'X'"), *range(70))))
    got = ema(placed, "close", {"e": 10}, {"e": 5}).orderBy("rn").toPandas().e.to_numpy()
    x = pdf[pdf.symbol == "X"].close.copy()
    x.iloc[:70] = np.nan
    want = x.ewm(span=10, adjust=False, min_periods=5).mean().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_metadata_counts_what_dropping_leaves(bars):
    df, _ = bars
    from tidemark.config import QualityConfig
    config = QualityConfig(min_rows=50)
    made = holed(df, 20, 21, 40)
    left = Q.clean(made, config, "drop").groupBy("symbol").count().toPandas().set_index("symbol")["count"]
    told = Q.metadata(made, config, method="drop").toPandas().set_index("symbol").n_rows_after_cleaning
    assert told.to_dict() == left.to_dict()
