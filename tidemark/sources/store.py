"""Bars stored the way the rolling operators read them.

Each shard is stored with the copies of the rows around it (its halo), bucketed by (symbol, shard) and partitioned by the year in which
the shard begins. Windows over shards then need no exchange, and a range of dates is a filter on whole partitions, which
a filter on ``ts`` cannot be: rows before the range still belong to the windows of rows in it. A small table of shards tells
which years hold rows of a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.frame import SIZE, with_halo


def store_bars(positioned: DataFrame, table: str, path: str, before: int, after: int = 0, buckets: int = 32, size: int = SIZE) -> None:
    """Write bars with ``rn`` and ``n`` as ``table`` below ``path``; later windows may look ``before`` rows back and ``after`` ahead.

    The number of buckets is the number of tasks that read a year; choose it so that a bucket's rows fit a task.
    """
    framed = with_halo(positioned, before=before, after=after, size=size)
    began = framed.filter("core").groupBy("symbol", "shard").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    shards = began.withColumn("period", F.year("first_ts"))
    where = {"before": before, "after": after, "size": size}
    marked = framed.join(shards.select("symbol", "shard", "period"), ["symbol", "shard"])
    marked.repartition(buckets, "symbol", "shard").write.partitionBy("period").bucketBy(buckets, "symbol", "shard").sortBy("symbol", "shard", "rn").option(
        "path", f"{path}/{table}").format("parquet").saveAsTable(table)
    kept = [F.lit(v).alias(k) for k, v in where.items()]
    shards.select("*", *kept).write.option("path", f"{path}/{table}_shards").format("parquet").saveAsTable(f"{table}_shards")


def read_framed(spark: SparkSession, table: str, start: str | None = None, end: str | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """Shards of ``table`` that hold rows from ``start`` to ``end`` (inclusive), as :func:`with_halo` gives them.

    ``core`` marks the rows of the range, so rows outside it only feed windows. The years are settled from the table of shards
    (one row per shard) and reach the scan as partition filters. Asking for a wider halo than is stored is an error.
    """
    shards = spark.table(f"{table}_shards")
    held = shards.agg(F.min("before"), F.min("after")).first()
    if held[0] is not None and (before > held[0] or after > held[1]):
        raise ValueError(f"{table} holds {held[0]} rows before and {held[1]} after a shard")
    inside, shown = F.lit(True), F.col("core")
    if start:
        first = F.lit(start).cast("timestamp_ntz")
        inside, shown = inside & (F.col("last_ts") >= first), shown & (F.col("ts") >= first)
    if end:
        last = F.lit(end).cast("timestamp_ntz")
        inside, shown = inside & (F.col("first_ts") <= last), shown & (F.col("ts") <= last)
    years = sorted(r[0] for r in shards.filter(inside).select("period").distinct().collect())
    return spark.table(table).filter(F.col("period").isin(years)).withColumn("core", shown).drop("period")
