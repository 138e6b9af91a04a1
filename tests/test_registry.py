"""The registry itself, and a sample of its queries against their SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = ["bars", "interpolate", "preprocess", "ema", "label_move_10d", "false_breakout", "regime_transitions", "trades", "performance_metrics", "ranking_metrics", "forward_power_start", "acf_peaks", "training_split", "signal_explanations"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()).startswith("ok")
