"""Bars made from ticks: cleaning aggregates the ticks once, however many steps read the bars."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.config import QualityConfig
from tidemark.operators import quality as Q
from tidemark.sources.bars import bars_from_ticks

DAYS, TICKS = 300, 3


def counted(spark, seen):
    """Three ticks a day for two symbols; ``seen`` counts them each time they are read."""

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [(s, d, k) for s in "AB" for d in range(DAYS) for k in range(TICKS)]
    ticks = spark.createDataFrame(rows, "symbol string, d int, k int").mapInPandas(count, "symbol string, d int, k int")
    ts = F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).cast("timestamp_ntz")
    return bars_from_ticks(ticks, F.col("symbol"), ts, 100.0 + F.col("d") % 7 + F.col("k"), F.lit(1.0), [F.col("k")])


def test_ticks_are_aggregated_once(spark):
    seen = spark.sparkContext.accumulator(0)
    clean = Q.clean(counted(spark, seen), QualityConfig(start_date="2020-01-11")).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert seen.value == 2 * DAYS * TICKS
    assert clean.groupby("symbol").size().to_dict() == {"A": DAYS - 10, "B": DAYS - 10}
    want = [100.0 + d % 7 for d in range(10, DAYS)] * 2
    pd.testing.assert_series_equal(clean.open, pd.Series(want, name="open"))
    pd.testing.assert_series_equal(clean.close, pd.Series(want, name="close") + TICKS - 1)
    assert (clean.volume == TICKS).all() and clean.rn.tolist() == [*range(1, DAYS - 9)] * 2


def test_ticks_are_sorted_by_time_first(spark):
    bars = counted(spark, spark.sparkContext.accumulator(0))
    assert bars.columns == ["symbol", "ts", "open", "high", "low", "close", "volume"]
    plan = bars._jdf.queryExecution().executedPlan().toString()
    sorts = [line.split("Sort [", 1)[1] for line in plan.splitlines() if "Sort [" in line]
    assert sorts and all(s.startswith("ts#") for s in sorts)
