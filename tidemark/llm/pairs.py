"""Bounded tiles for joins within groups of any size, and groups from tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.patterns import components

BLOCK = 512


def tiles(keyed: DataFrame, keys: list[str], ident: str, payload: list[str], block: int = BLOCK) -> DataFrame:
    """Tasks of at most two blocks of about ``block`` rows that together meet every resident pair and every visitor with every resident of a key.

    ``keyed`` has ``keys``, ``visitor`` (boolean), ``ident`` and ``payload``. Residents of one key meet each other and
    its visitors; visitors do not meet. The result has ``keys``, ``tile``, ``self`` (pairs within the tile's left side) and
    ``rows``: structs with ``right`` (side), ``ident`` and the payload. Rows on the left meet rows on the right. A hot key
    becomes many tiles; its rows are copied once per block of the other side.
    """
    visitor = F.col("visitor")
    sizes = (
        keyed.groupBy(*keys)
        .agg(F.count(F.when(~visitor, 1)).alias("_r"), F.count(F.when(visitor, 1)).alias("_v"))
        .filter("_r >= 1 and _r + _v >= 2")
        .select(*keys, F.ceil(F.col("_r") / block).cast("int").alias("_rb"), F.ceil(F.col("_v") / block).cast("int").alias("_vb"))
    )
    width = F.col("_rb") + F.col("_vb")
    mine = F.pmod(F.xxhash64(ident), F.when(visitor, F.col("_vb")).otherwise(F.col("_rb"))).cast("int")
    residents = F.sequence(F.lit(0), F.col("_rb") - 1)
    meets = F.when(visitor, F.transform(residents, lambda j: F.struct((j * width + F.col("_rb") + F.col("_own")).alias("tile"), F.lit(1).alias("right")))).otherwise(
        F.concat(
            F.transform(residents, lambda j: F.struct(
                (F.least(j, F.col("_own")) * width + F.greatest(j, F.col("_own"))).alias("tile"),
                F.when(j < F.col("_own"), 1).otherwise(0).alias("right"))),
            F.when(F.col("_vb") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("_vb") - 1, F.lit(0))), lambda v: F.struct(
                (F.col("_own") * width + F.col("_rb") + v).alias("tile"), F.lit(0).alias("right")))).otherwise(F.array().cast("array<struct<tile:int,right:int>>")),
        ))
    spread = keyed.join(sizes, keys).withColumn("_own", mine).withColumn("_meet", F.explode(meets))
    at = F.col("_meet.tile")
    grouped = spread.groupBy(*keys, at.alias("tile"), F.floor(at / width).eqNullSafe(at % width).alias("self")).agg(
        F.collect_list(F.struct(F.col("_meet.right").alias("right"), F.col(ident).alias("ident"), *payload)).alias("rows"))
    return grouped.filter(F.size("rows") > 1)


def roots(near: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """The smallest ident reachable over a symmetric matrix of links."""
    near = near | np.eye(len(ident), dtype=bool)
    last = np.iinfo(np.int64).max
    found = ident.astype(np.int64)
    while True:
        lower = np.where(near, found[None, :], last).min(axis=1)
        if (lower == found).all():
            return found
        found = lower


def groups(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b): the smallest node reachable."""
    return components(edges.withColumn("_all", F.lit(0)), ["_all"]).select("node", "root")
