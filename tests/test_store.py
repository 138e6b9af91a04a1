"""Stored bars: same results, fewer exchanges, only the years asked for."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators.frame import core_rows, position, with_halo
from tidemark.session import cut
from tidemark.sources import store


@pytest.fixture(scope="module")
def stored(spark, bars, tmp_path_factory):
    name = f"bars_{uuid.uuid4().hex}"
    placed = cut(position(bars[0]))
    store.store_bars(placed, name, str(tmp_path_factory.mktemp("bars")), before=81, buckets=4, size=64)
    return name, placed


def features(framed):
    return core_rows(X.price(X.base(framed))).select("symbol", "ts", "sma_20", "price_to_sma_80", "momentum_5")


def test_stored_bars_give_the_same_values(spark, stored):
    name, placed = stored
    want = features(with_halo(placed, before=81, size=64))
    got = features(store.read_framed(spark, name, before=81))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    low, high = "2020-09-01", "2021-02-15"
    some = features(store.read_framed(spark, name, low, high, before=81))
    inside = want.filter((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(high).cast("timestamp_ntz")))
    assert sorted(map(str, some.collect())) == sorted(map(str, inside.collect())) and some.count() > 100


def test_plan_prunes_years_and_shuffles_nothing(spark, stored):
    name, placed = stored

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    late = plan(features(store.read_framed(spark, name, "2021-06-01", before=81)))
    assert "PartitionFilters: [period" in late.replace("isnotnull(period", "period") and "Exchange" not in late
    assert "Exchange" in plan(features(with_halo(placed, before=81, size=64)))
    years = spark.table(f"{name}_shards").select("period").distinct().count()
    files = store.read_framed(spark, name, "2021-06-01", before=81).inputFiles()
    assert years == 2 and files and all("period=" in f for f in files)


def test_a_wider_halo_than_stored_is_refused(spark, stored):
    with pytest.raises(ValueError, match="81 rows before"):
        store.read_framed(spark, stored[0], before=90)
