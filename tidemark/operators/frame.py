"""Positions, shards and halos: how a long series is spread over many tasks.

All rolling operators are positional. A window over the whole symbol would put that
symbol into one task, so each series is numbered once and cut into shards of ``size``
rows. A shard also receives copies of the ``before`` rows that precede it and the
``after`` rows that follow it (its halo), which makes every bounded frame exact inside
the shard. A shard never exceeds ``size + before + after`` rows, whatever the symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut

SIZE = 2048
FAN = 1024


def _merge(kind: str):
    if kind == "sum":
        return lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    if kind == "max":
        return lambda a, b: F.greatest(a, b)
    if kind == "min":
        return lambda a, b: F.least(a, b)
    raise ValueError(kind)


def _fold(kind: str):
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind]


def prefix(
    totals: DataFrame, keys: list[str], index: str, kinds: dict[str, str], reverse: bool = False,
    grand: bool = False, fan: int = FAN,
) -> DataFrame:
    """Exclusive running folds of per-block totals, in two levels of ``fan`` blocks.

    ``totals`` has one row per ``keys + [index]``. The result keeps these and replaces
    every column of ``kinds`` by the fold over all earlier blocks (later ones with
    ``reverse``); ``grand`` adds ``<column>_all``, the fold over all blocks.
    """
    order = F.col(index).desc() if reverse else F.col(index)
    group = F.floor(F.col(index) / fan)
    upper_order = F.col("_group").desc() if reverse else F.col("_group")
    low = Window.partitionBy(*keys, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy(*keys).orderBy(upper_order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    blocks = totals.withColumn("_group", group)
    inner = blocks.select(
        *keys, index, "_group", *[_fold(k)(c).over(low).alias(c) for c, k in kinds.items()]
    )
    uppers = blocks.groupBy(*keys, "_group").agg(*[_fold(k)(c).alias(c) for c, k in kinds.items()])
    outer = uppers.select(
        *keys, "_group",
        *[_fold(k)(c).over(high).alias(f"_up_{c}") for c, k in kinds.items()],
        *([_fold(k)(c).over(everything).alias(f"{c}_all") for c, k in kinds.items()] if grand else []),
    )
    joined = inner.join(outer, [*keys, "_group"])
    return joined.select(
        *keys, index,
        *[_merge(k)(F.col(f"_up_{c}"), F.col(c)).alias(c) for c, k in kinds.items()],
        *([F.col(f"{c}_all") for c in kinds] if grand else []),
    )


def bucket_of(ts: Column, grain_seconds: int = 1, size: int = SIZE) -> Column:
    """Number of the stretch of time that holds at most ``size`` bars of ``grain_seconds`` or longer."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / (grain_seconds * size))


def position(bars: DataFrame, grain_seconds: int = 1, size: int = SIZE, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add ``rn`` (1-based position per series) and ``n`` (series length).

    Bars are unique per (key, ts), so a stretch of time of ``grain_seconds * size`` holds at most
    ``size`` rows of a series, from second bars to daily ones; only the stretches' counts are chained
    across the series. Bars shorter than a second make windows that many times longer.
    """
    ks = list(keys)
    bucket = bucket_of(F.col("ts"), grain_seconds, size)
    counts = bars.groupBy(*ks, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = prefix(counts, ks, "_bucket", {"_rows": "sum"}, grand=True)
    local = Window.partitionBy(*ks, "_bucket").orderBy("ts")
    numbered = bars.withColumn("_bucket", bucket).withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(offsets, [*ks, "_bucket"])
        .withColumn("rn", F.col("_rows") + F.col("_local"))
        .withColumn("n", F.col("_rows_all"))
        .drop("_bucket", "_local", "_rows", "_rows_all")
    )


def shard_of(rn: Column, size: int = SIZE) -> Column:
    return F.floor((rn - 1) / size)


def with_halo(positioned: DataFrame, before: int = 0, after: int = 0, size: int = SIZE) -> DataFrame:
    """Copy rows into every shard that needs them; ``core`` marks the owning shard.

    Shards are dealt to as many tasks as shuffles have: the rows are few and narrow but what is done with them is dear, so
    merging small partitions by their bytes would leave one task to do it all.
    """
    rn, n = F.col("rn"), F.col("n")
    first = F.greatest(F.lit(0), F.floor((rn - 1 - after) / size))
    last = F.least(F.floor((n - 1) / size), F.floor((rn - 1 + before) / size))
    parts = int(positioned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copied = positioned.withColumn("shard", F.explode(F.sequence(first, last))).withColumn("core", F.col("shard") == shard_of(rn, size))
    return copied.repartition(parts, "symbol", "shard")


def core_rows(framed: DataFrame) -> DataFrame:
    return framed.filter("core").drop("core", "shard")


def frame(bars: DataFrame, before: int = 0, after: int = 0, size: int = SIZE, grain_seconds: int = 1) -> DataFrame:
    return with_halo(position(bars, grain_seconds, size), before, after, size)


def running(
    df: DataFrame, folds: dict[str, tuple[str, Column]], reverse: bool = False, size: int = SIZE,
    keys: tuple[str, ...] = ("symbol",), stored: bool = False,
) -> DataFrame:
    """Unbounded running folds (``sum``, ``max``, ``min``, ``last``) over rows with ``rn``.

    Each shard folds its own rows; shard totals are chained with :func:`prefix`, so no
    task sees a whole series. ``last`` carries the latest non-null value (the next one with
    ``reverse``). The input is read twice; ``stored`` writes it out first, which chained
    scans need so that their inputs are not recomputed 2, 4, 8 times.
    """
    if stored:
        df = cut(df)
    ks = list(keys)
    rn = F.col("rn")
    kinds, exprs = {}, {}
    for name, (kind, expr) in folds.items():
        if kind == "last":
            key = -rn if reverse else rn
            kinds[name] = "max"
            exprs[name] = F.when(expr.isNotNull(), F.struct(key.alias("k"), expr.alias("v")))
        else:
            kinds[name], exprs[name] = kind, expr
    sharded = df.withColumn("_shard", shard_of(rn, size))
    local = (
        Window.partitionBy(*ks, "_shard")
        .orderBy(rn.desc() if reverse else rn)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    totals = sharded.groupBy(*ks, "_shard").agg(
        *[_fold(kinds[c])(exprs[c]).alias(f"_c_{c}") for c in folds]
    )
    carried = prefix(totals, ks, "_shard", {f"_c_{c}": k for c, k in kinds.items()}, reverse)
    local_cols = sharded.select("*", *[_fold(kinds[c])(exprs[c]).over(local).alias(f"_l_{c}") for c in folds])
    joined = local_cols.join(carried, [*ks, "_shard"])
    out = []
    for name, (kind, _) in folds.items():
        merged = _merge(kinds[name])(F.col(f"_c_{name}"), F.col(f"_l_{name}"))
        out.append((merged.getField("v") if kind == "last" else merged).alias(name))
    keep = [c for c in df.columns if c not in folds]
    return joined.select(*keep, *out)


def streak(df: DataFrame, folds: dict[str, Column], size: int = SIZE, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows since each condition last failed: run lengths without one window per symbol."""
    breaks = {f"_b_{n}": ("max", F.when(~F.coalesce(c, F.lit(False)), F.col("rn"))) for n, c in folds.items()}
    out = running(df, breaks, size=size, keys=keys)
    return out.select(
        *df.columns,
        *[(F.col("rn") - F.coalesce(F.col(f"_b_{n}"), F.lit(0))).cast("int").alias(n) for n in folds],
    )


def ema(df: DataFrame, source: str | dict[str, str], spans: dict[str, int], needed: dict[str, int] | None = None, block: int = 64) -> DataFrame:
    """Recursive exponential means, y = (1-a)*y' + a*x with y0 = x0, as a blocked scan.

    ``source`` is one column, or one for each mean; these must then be null in the same rows.

    A series starts at its first row with a value; rows before it have none. A later null adds nothing and
    the mean goes on to decay; fill gaps first where that matters.

    Inside a block of 64 rows the recursion is a weighted running sum. The last value of
    a block reaches later blocks with weight (1-a)^64 per block; terms below 1e-18 are
    dropped, so each block feeds a fixed number of followers. The first value counts whole: what it lacks beside the
    others is added to its block's end. It is found among the block ends, so rows meet only their own block's few numbers.
    """
    needed = needed or {}
    rn = F.col("rn")
    sources = {name: source if isinstance(source, str) else source[name] for name in spans}
    fields = {c: f"x{i}" for i, c in enumerate(dict.fromkeys(sources.values()))}
    base = df.withColumn("_blk", F.floor((rn - 1) / block)).withColumn("_pos", (rn - 1) % block)
    w = Window.partitionBy("symbol", "_blk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    share = {name: 2.0 / (span + 1) for name, span in spans.items()}
    reach = max(int(42 / (block * a)) + 1 for a in share.values())
    local = [(F.sum(F.col(sources[n]) * a * F.pow(F.lit(1 - a), -F.col("_pos"))).over(w) * F.pow(F.lit(1 - a), F.col("_pos"))).alias(f"_l_{n}") for n, a in share.items()]
    known = F.col(next(iter(fields))).isNotNull()
    ends = base.groupBy("symbol", "_blk").agg(
        F.min(F.when(known, F.struct(rn.alias("rn"), *[F.col(c).alias(f) for c, f in fields.items()]))).alias("_first"),
        *[F.sum(F.col(sources[n]) * a * F.pow(F.lit(1 - a), block - 1 - F.col("_pos"))).alias(f"_e_{n}") for n, a in share.items()])
    starts = ends.groupBy("symbol").agg(F.min("_first").alias("_start"))
    own = F.col("_start.rn") == F.col("_first.rn")

    def whole(n: str, at: Column) -> Column:
        """What the first value adds to the mean ``n`` at row ``at`` beyond its share."""
        return F.col(f"_start.{fields[sources[n]]}") * (1 - share[n]) * F.pow(F.lit(1 - share[n]), at - F.col("_start.rn"))

    last = (F.col("_blk") + 1) * block
    full = ends.join(starts, "symbol").select("symbol", "_blk", "_start", *[
        (F.coalesce(f"_e_{n}", F.lit(0.0)) + F.when(own, whole(n, last)).otherwise(0.0)).alias(f"_e_{n}") for n in share])
    carried = (
        full.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(reach))))
        .groupBy("symbol", (F.col("_blk") + F.col("_step")).alias("_blk"))
        .agg(F.max("_start").alias("_start"), *[
            F.sum(F.when(F.col("_step") > 0, F.col(f"_e_{n}") * F.pow(F.lit(1 - a), block * (F.col("_step") - 1)))).alias(f"_c_{n}") for n, a in share.items()])
    )
    joined = base.select("*", *local).join(carried, ["symbol", "_blk"])
    started = F.floor((F.col("_start.rn") - 1) / block) == F.col("_blk")
    out = []
    for name, a in share.items():
        carry = F.coalesce(F.col(f"_c_{name}"), F.lit(0.0)) * F.pow(F.lit(1 - a), F.col("_pos") + 1)
        y = F.coalesce(f"_l_{name}", F.lit(0.0)) + carry + F.when(started, whole(name, rn)).otherwise(0.0)
        out.append(F.when(rn - F.col("_start.rn") >= needed.get(name, 1) - 1, y).alias(name))
    return joined.select(*df.columns, *out)


def grouped_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str, partitions: int | None = None, by_count: bool = False) -> DataFrame:
    """Exact interpolated quantile per group without collecting a group.

    Values are reduced to counts, range-partitioned by group and value, and the blocks' counts
    are chained, so a group of any size spreads over many tasks. ``by_count`` returns the value
    at position floor(count * q) instead of interpolating.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cut(counted.repartitionByRange(n, *keys, value).withColumn("_blk", F.spark_partition_id()))
    totals = blocks.groupBy(*keys, "_blk").agg(F.sum("_c").alias("_off"))
    offsets = prefix(totals, keys, "_blk", {"_off": "sum"}, grand=True)
    upto = Window.partitionBy(*keys, "_blk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.withColumn("_run", F.sum("_c").over(upto)).join(offsets, [*keys, "_blk"])
    last = F.col("_off") + F.col("_run")
    first = last - F.col("_c")
    at = F.floor(F.col("_off_all") * q) if by_count else (F.col("_off_all") - 1) * q
    low, high = F.floor(at), F.ceil(at)

    def holds(i: Column) -> Column:
        return F.max(F.when((first <= i) & (i < last), F.col(value)))

    return placed.groupBy(*keys).agg(
        holds(low).alias("_x"), holds(high).alias("_y"), F.max(at - low).alias("_w")
    ).select(*keys, (F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_w")).alias(name))
