import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session

    s = session(8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """600 random bars of one series and 90 of another, as Spark and pandas tables."""
    import numpy as np
    import pandas as pd

    from tidemark.sources.bars import BAR_SCHEMA

    rng = np.random.default_rng(7)
    parts = []
    for symbol, n in (("X", 600), ("Y", 90)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * (1 + rng.normal(0, 0.004, n))
        high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.004, n)))
        low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.004, n)))
        parts.append(pd.DataFrame({
            "symbol": symbol, "ts": pd.date_range("2020-01-01", periods=n, freq="D"), "open": open_, "high": high,
            "low": low, "close": close, "volume": rng.integers(100, 1000, n).astype(float),
        }))
    pdf = pd.concat(parts, ignore_index=True)
    return spark.createDataFrame(pdf, BAR_SCHEMA), pdf
