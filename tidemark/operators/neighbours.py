"""Exact nearest neighbours of z-normalised windows within each series, without all pairs.

Every window has a three-number signature: projections on orthonormal contrasts of its four
quarters. Distances of signatures never exceed distances of windows. Three steps:

1. Sorted by signature, windows are compared inside small contiguous chunks. The k-th best
   distance found is an upper bound ("radius") for the true k-th neighbour.
2. A window asks only those signature cells whose box lies within its radius.
3. Members of a cell and the windows asking it meet in tiles of bounded size; hot cells are
   split by hash on both sides. Tiles return the best k candidates per window, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import cut

CELL_ROWS, TILE_QUERIES, CHUNK, TIED = 1024, 4096, 512, 64


def signature(df: DataFrame, m: int) -> DataFrame:
    quarter = m // 4
    root = float(np.sqrt(quarter))

    def part(i: int) -> Column:
        if not quarter:  # fewer than four places: the values themselves
            return F.coalesce(F.get("z", F.lit(i)), F.lit(0.0))
        return F.aggregate(F.slice("z", i * quarter + 1, quarter), F.lit(0.0), lambda s, x: s + x) / root

    df = df.withColumns({f"_p{i}": part(i) for i in range(4)})
    a, b, c, d = (F.col(f"_p{i}") for i in range(4))
    return df.withColumns(
        {"q0": (a + b - c - d) / 2, "q1": (a - b - c + d) / 2, "q2": (a - b + c - d) / 2}
    ).drop("_p0", "_p1", "_p2", "_p3")


def _best(a: np.ndarray, pos_a: np.ndarray, b: np.ndarray, pos_b: np.ndarray, k: int, apart: int):
    """The k nearest rows of ``b`` for every row of ``a`` that are more than ``apart`` away, ties to the smaller position.

    Candidates are all rows up to the k-th distance and a margin for its rounding, so ties are decided exactly;
    rows of ``a`` with many candidates are taken a few at a time.
    """
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    squares[np.abs(pos_a[:, None] - pos_b[None, :]) <= apart] = np.inf
    k = min(k, b.shape[0])
    kth = np.partition(squares, k - 1, axis=1)[:, k - 1]
    slack = 1e-9 * ((a * a).sum(1) + (b * b).sum(1).max() + 1)
    near = np.where(np.isfinite(kth), (squares <= (kth + slack)[:, None]).sum(1), k)
    found, where = np.empty((len(a), k)), np.empty((len(a), k), pos_b.dtype)
    usual = near <= k + 4
    many = np.flatnonzero(~usual)
    for rows, take in ((np.flatnonzero(usual), k + 4), *((many[s : s + TIED], b.shape[0]) for s in range(0, len(many), TIED))):
        take = min(take, b.shape[0])
        picked = np.argpartition(squares[rows], take - 1, axis=1)[:, :take]
        exact = np.sqrt(((a[rows][:, None, :] - b[picked]) ** 2).sum(2))
        exact[~np.isfinite(np.take_along_axis(squares[rows], picked, 1))] = np.inf
        order = np.lexsort((pos_b[picked], exact), axis=1)[:, :k]
        found[rows] = np.take_along_axis(exact, order, 1)
        where[rows] = np.take_along_axis(pos_b[picked], order, 1)
    return found, where


def _with_radius(df: DataFrame, k: int, apart: int) -> DataFrame:
    def radii(pdf: pd.DataFrame) -> np.ndarray:
        radius = np.full(len(pdf), np.inf)
        for index in pdf.groupby("symbol", sort=False).indices.values():
            for s in range(0, len(index), CHUNK):
                end = min(s + CHUNK, len(index))
                at = index[max(0, end - CHUNK) : end]
                z = np.vstack(pdf["z"].values[at])
                pos = pdf["rn"].values[at]
                found, _ = _best(z, pos, z, pos, k, apart)
                if found.shape[1] == k:
                    radius[at] = np.minimum(radius[at], found[:, -1] * (1 + 1e-9) + 1e-9)
        return radius

    def bound(batches):
        """Rows see the rows before them over batch edges; last rows without a bound wait for the next batch, up to a chunk of them."""
        before = held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held = None
            if not len(pdf):
                continue
            whole = pdf if before is None else pd.concat([before, pdf], ignore_index=True)
            pdf["radius"] = radii(whole)[len(whole) - len(pdf) :]
            waits = (np.isinf(pdf["radius"]) & (pdf["symbol"] == pdf["symbol"].iloc[-1])).to_numpy()
            if 0 < waits.sum() <= CHUNK:
                held = pdf[waits].drop(columns="radius")
                pdf = pdf[~waits]
            before = pdf.drop(columns="radius").tail(CHUNK)
            yield pdf
        if held is not None:
            held["radius"] = np.inf
            yield held

    schema = df.schema.add("radius", "double")
    # Half-unit cells of the signature give neighbouring rows similar shapes.
    curve = ["symbol", *[F.floor(F.col(c) * 2) for c in ("q0", "q1")], "q2", "rn"]
    ordered = df.repartitionByRange(*curve).sortWithinPartitions(*curve)
    return ordered.mapInPandas(bound, schema)


def celled(points: DataFrame, m: int) -> DataFrame:
    """Signature cells of about CELL_ROWS / 2 rows of each series; |signature| <= sqrt(m)."""
    count = F.count(F.lit(1)) * 2 / CELL_ROWS
    edges = points.groupBy("symbol").agg(F.greatest(F.lit(1.0), F.round(F.cbrt(count) / 2)).cast("long").alias("_edge"))
    points = points.join(edges, "symbol").withColumn("_width", float(np.sqrt(m)) * (1 + 1e-9) / F.col("_edge"))
    return points.withColumn("cell", _code(*[F.floor(F.col(c) / F.col("_width")) for c in ("q0", "q1", "q2")]))


def _code(x: Column, y: Column, z: Column) -> Column:
    edge = F.col("_edge")
    return ((x + edge) * (2 * edge) + (y + edge)) * (2 * edge) + (z + edge)


def asking(points: DataFrame, keep: list[str]) -> DataFrame:
    """Celled points with ``radius``, once for each cell whose box lies within it."""
    edge, width = F.col("_edge"), F.col("_width")

    def index(c: str | Column) -> Column:
        return F.floor((F.col(c) if isinstance(c, str) else c) / width)

    def span(c: str) -> Column:
        low = F.greatest(-edge, index(F.col(c) - F.col("radius")))
        high = F.least(edge - 1, index(F.col(c) + F.col("radius")))
        reach = F.col("radius") < 1e9
        return F.sequence(
            F.when(reach, low).otherwise(-edge).cast("long"), F.when(reach, high).otherwise(edge - 1).cast("long")
        )

    def gap(c: str, i: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(i) * width - F.col(c), F.col(c) - (F.col(i) + 1) * width)

    asks = points
    for c, i in (("q0", "_i"), ("q1", "_j"), ("q2", "_k")):
        asks = asks.withColumn(i, F.explode(span(c)))
    reachable = sum((gap(c, i) * gap(c, i) for c, i in (("q0", "_i"), ("q1", "_j"), ("q2", "_k"))), F.lit(0.0))
    asks = asks.filter(F.sqrt(reachable) <= F.col("radius") + 1e-9)
    return asks.select("symbol", *keep, _code(F.col("_i"), F.col("_j"), F.col("_k")).alias("cell"))


TILE = ["symbol", "cell", "_b", "_q"]


def tiled(asks: DataFrame, points: DataFrame, asked: list[str], held: list[str]):
    """Askers and members of each cell, grouped by tiles of bounded size for a cogroup; member columns end in ``_r``."""
    members = points.groupBy("symbol", "cell").agg(F.count(F.lit(1)).alias("_members"))
    demand = asks.groupBy("symbol", "cell").agg(F.count(F.lit(1)).alias("_asks"))
    plan = cut(
        members.join(demand, ["symbol", "cell"]).select(
            "symbol", "cell",
            F.ceil(F.col("_members") / CELL_ROWS).alias("_nb"), F.ceil(F.col("_asks") / TILE_QUERIES).alias("_nq"),
        )
    )
    left = (
        asks.join(plan, ["symbol", "cell"])
        .withColumn("_q", F.pmod(F.xxhash64("rn"), F.col("_nq")))
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)))
        .select(*TILE, *asked)
    )
    right = (
        points.join(plan, ["symbol", "cell"])
        .withColumn("_b", F.pmod(F.xxhash64("rn"), F.col("_nb")))
        .withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nq") - 1)))
        .select(*[F.col(c).alias(f"{c}_r") for c in (*TILE, *held)])
    )
    return left.groupBy(*TILE), right.groupBy(*[f"{c}_r" for c in TILE])


def nearest(windows: DataFrame, m: int, k: int = 1, apart: int = 0) -> DataFrame:
    """``windows`` (symbol, rn, z) to (symbol, rn, neighbours: k structs of distance and rn).

    ``apart`` is the exclusion zone: neighbours start more than that many rows away.
    """
    points = celled(cut(_with_radius(signature(windows.select("symbol", "rn", "z"), m), k, apart)), m)
    left, right = tiled(asking(points, ["rn", "z", "radius"]), points, ["rn", "z", "radius"], ["rn", "z"])

    def tile(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"symbol": pd.Series([], dtype=object), "rn": np.array([], "int64"), "distance": np.array([], float), "other": np.array([], "int64")})
        d, w = _best(np.vstack(a["z"].values), a["rn"].values, np.vstack(b["z_r"].values), b["rn_r"].values, k, apart)
        rows, cols = np.nonzero(d <= a["radius"].values[:, None])
        ok = np.isfinite(d[rows, cols])
        rows, cols = rows[ok], cols[ok]
        return pd.DataFrame(
            {"symbol": key[0], "rn": a["rn"].values[rows], "distance": d[rows, cols], "other": w[rows, cols]}
        )

    found = left.cogroup(right).applyInPandas(tile, "symbol string, rn long, distance double, other long")
    pair = F.struct("distance", F.col("other").alias("rn"))
    if k == 1:
        return found.groupBy("symbol", "rn").agg(F.array(F.min(pair)).alias("neighbours"))
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "rn").orderBy("distance", "other")
    best = found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return best.groupBy("symbol", "rn").agg(F.sort_array(F.collect_list(pair)).alias("neighbours"))
