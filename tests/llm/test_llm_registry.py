"""Registered queries: SQL on the smallest tables, and the pipeline's stages."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import TABLES, compare
from tidemark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()).startswith("ok")


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in QUERIES}


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and after
        if name in ("quality classifier", "language ID"):
            assert len(good & before - after) <= 0.02 * len(good & before)
    assert docs.count() <= 3 * n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.filter("not exact").count() == 0 and last.count() == docs.count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
