"""Features of the last days from saved state, against those from the whole history."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.operators import features as X, state as S
from tidemark.operators.frame import position
from tidemark.session import cut

CONFIG = FeatureConfig(windows=(3, 10, 20))


def test_last_days_from_state_equal_the_whole_history(spark, bars):
    placed = cut(position(bars[0]))
    early = placed.filter(F.col("rn") <= F.col("n") - 7).withColumn("n", F.col("n") - 7)
    state = S.snapshot(early, CONFIG, size=128)
    recent = placed.filter(F.col("rn") > F.col("n") - 7 - X.warmup(CONFIG) - 1).drop("n")
    got, after = S.advance(state, recent, CONFIG, size=128)
    want = X.features(placed, CONFIG, size=128).filter(F.col("rn") > F.col("n") - 7)
    a, b = (d.toPandas().sort_values(["symbol", "rn"]).reset_index(drop=True) for d in (got, want))
    assert len(a) == 14 and set(X.feature_names(CONFIG)) - set(a.columns) <= {"day_of_week", "month", "quarter", "day_of_month", "week_of_year", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end"}
    look_ahead = {"local_high_5", "local_low_5"}
    for c in b.columns:
        if c in look_ahead or c in ("symbol", "ts"):
            continue
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
    whole = S.snapshot(placed, CONFIG, size=128).toPandas().sort_values("symbol").reset_index(drop=True)
    then = after.toPandas().sort_values("symbol").reset_index(drop=True)
    for c in whole.columns:
        if c not in ("symbol", "s_ts"):
            np.testing.assert_allclose(then[c].astype(float), whole[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)
    assert list(then.s_ts) == list(whole.s_ts)
