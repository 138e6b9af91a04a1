"""Mixing sources to target weights by hash order, distributed prefix sums and an exact cut.

Documents of a source are put in a random but fixed order (a hash of seed and doc_id), cut into ranges of that
hash, and the ranges' word totals are chained, so no task sees a whole source. A source whose target
is e times its size and some more is taken e times whole, and then from the front of the order up to the last word.

Null texts have size 0. Null is a source of its own and comes last. Rows that repeat are rows of their own. An
empty table gives no rows. Sources of size 0 get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import stored
from tidemark.operators.frame import prefix
from tidemark.session import cut

RANGE_ROWS = 1024
HEX = 4  # digits of the hash that can name a range


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``place``, from 0, of each source by code point, null last; ranges of names are numbered apart and chained."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = cut(sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    one = F.lit(0).alias("_one")
    starts = prefix(ranges.groupBy(one, "_range").agg(F.count(F.lit(1)).alias("_start")), ["_one"], "_range", {"_start": "sum"})
    local = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    return (
        ranges.withColumn("_local", F.row_number().over(local) - 1)
        .join(starts.select("_range", F.coalesce("_start", F.lit(0)).alias("_start")), "_range")
        .withColumn("place", (F.col("_start") + F.col("_local")).cast("long"))
        .drop("_range", "_local", "_start")
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, size, docs, target): weights by rank share all words; a target stops at ``most`` times its source."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    known = cut(ranked(sources).withColumn("weight", weight.cast("long")))
    bound = F.col("size") * most
    total = known.agg(F.sum("size")).first()[0] or 0
    full, held, rest = -1, 0, known.agg(F.sum("weight")).first()[0] or 0
    while rest:  # each round fills up at least one more source
        over = bound.cast("double") * F.lit(float(rest)) <= F.col("weight").cast("double") * F.lit(float(total - held))
        now = known.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, bound)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        if now[0] == full:
            break
        full, held, rest = now
    share = (F.col("weight") * F.lit(int(total - held))).cast("double") / F.lit(float(rest or 1))
    over = bound.cast("double") * F.lit(float(rest)) <= F.col("weight").cast("double") * F.lit(float(total - held))
    return known.select("source", "size", "docs", F.when(over, bound.cast("double")).otherwise(share).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **settings) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, part): whole copies of each document, and the words of one more that reach the cut."""
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")))
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
    goal = cut(targets(per, **settings).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"), F.col("size").alias("source_size"), "target", "docs"))
    largest = goal.agg(F.max("docs")).first()[0] or 0
    digits = next((d for d in range(1, HEX) if 16 ** d * RANGE_ROWS >= largest), HEX)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = (
        sized.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("_order", order).withColumn("_range", F.conv(F.substring("_order", 1, digits), 16, 10).cast("long"))
    )
    starts = prefix(keyed.groupBy("_key", "_range").agg(F.sum("size").alias("_start")), ["_key"], "_range", {"_start": "sum"})
    upto = Window.partitionBy("_key", "_range").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce("_start", F.lit(0)) + F.coalesce(F.sum("size").over(upto), F.lit(0))
    placed = keyed.join(starts, ["_key", "_range"]).withColumn("_before", before).join(goal, "_key")
    budget = F.floor("target")
    copies = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - copies * F.col("source_size")
    part = F.least("size", F.greatest(F.lit(0).cast("long"), left - F.col("_before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), part.cast("long").alias("part"))


def taken(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document."""
    return plan(docs, **settings).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of ``docs``.

    Here documents stay whole: the one at a source's cut is taken once more when at least half of its words
    lie before the cut. Documents without words have no share in any budget: they come once, as they are.
    """
    how = plan(docs, id_col, text_col, source_col, **settings)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies") + F.when(F.col("part") * 2 >= F.col("size"), 1).otherwise(0)).cast("int")
    # rows with equal ids, sources and sizes are alike for the plan: they share out the sum of their times
    ways = how.groupBy(
        F.col("doc_id").alias("_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_src"), F.col("size").alias("_size")
    ).agg(F.sum(times).alias("_times"), F.count(F.lit(1)).alias("_rows"))
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(id_col).alias("_mid"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_msrc"), words(F.col(text_col)).alias("_msize"))
    joined = keyed.join(ways, F.expr("_mid <=> _id and _msrc = _src and _msize = _size"))
    nth = Window.partitionBy("_mid", "_msrc", "_msize").orderBy(F.xxhash64(F.col(text_col)))
    own = F.when(F.col("_rows") == 1, F.col("_times")).otherwise(
        F.floor(F.col("_times") / F.col("_rows")) + F.when(F.row_number().over(nth) <= F.pmod("_times", "_rows"), 1).otherwise(0))
    return (
        joined.withColumn("_own", own.cast("int")).filter("_own > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_own"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
