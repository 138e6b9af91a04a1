"""Hierarchical density clusters of z-normalised windows, per series.

Two windows are as far apart as the largest of their distance and of both core distances (distance to the
``min_samples``-th neighbour). Four steps:

1. The minimum spanning tree under that distance, by rounds in which every component but the largest finds its lightest
   edge to another one. Known neighbours give an upper bound, signature cells a lower one; only cells within the bound are searched.
2. For every window the edge at which its component first reaches ``min_size`` members, by a walk of that many steps along the tree.
3. Edges between two big components split clusters. All other edges are contracted; what remains is a tree of
   at most ``rows / min_size`` nodes, the only thing that one task per series holds.
4. Clusters, their stabilities and the choice between a cluster and its parts come from that tree. Windows find their place
   in it in chunks.

Edges are ordered by (weight, smaller row, larger row), which makes the tree unique.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.exprs import EPS
from tidemark.operators.neighbours import asking, celled, nearest, signature, tiled
from tidemark.operators.patterns import components
from tidemark.session import written

EDGE = "struct<w:double,lo:long,hi:long>"
EXACT, CHUNK = 65536, 50000


def _tile(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The lightest edge of each asking component to a member of another one, ties to the smaller rows."""
    names = ["symbol", "comp", "w", "lo", "hi", "other"]
    if not len(a) or not len(b):
        return pd.DataFrame({n: np.array([], "object" if n == "symbol" else float if n == "w" else "int64") for n in names})
    za, zb = np.vstack(a["z"].values), np.vstack(b["z_r"].values)
    core_a, core_b = a["core"].values, b["core_r"].values
    pos_a, pos_b = a["rn"].values, b["rn_r"].values
    own, other = a["comp"].values, b["comp_r"].values
    norm_a, norm_b = (za * za).sum(1), (zb * zb).sum(1)
    squares = np.maximum(norm_a[:, None] + norm_b[None, :] - 2.0 * (za @ zb.T), np.maximum(core_a[:, None], core_b[None, :]) ** 2)
    squares[own[:, None] == other[None, :]] = np.inf
    codes, comps = pd.factorize(own)
    least = np.full(len(comps), np.inf)
    np.minimum.at(least, codes, squares.min(1))
    slack = 1e-9 * (norm_a.max() + norm_b.max() + 1)
    rows, cols = np.nonzero((squares <= (least[codes] + slack)[:, None]) & np.isfinite(squares))
    w = np.maximum(core_a[rows], core_b[cols])
    for s in range(0, len(rows), EXACT):
        at = slice(s, s + EXACT)
        w[at] = np.maximum(w[at], np.sqrt(((za[rows[at]] - zb[cols[at]]) ** 2).sum(1)))
    lo, hi = np.minimum(pos_a[rows], pos_b[cols]), np.maximum(pos_a[rows], pos_b[cols])
    order = np.lexsort((hi, lo, w, codes[rows]))
    first = order[np.unique(codes[rows][order], return_index=True)[1]]
    return pd.DataFrame({
        "symbol": key[0], "comp": own[rows[first]], "w": w[first], "lo": lo[first], "hi": hi[first], "other": other[cols[first]],
    })


def spanning_tree(wins: DataFrame, m: int, min_samples: int = 5) -> DataFrame:
    """Edges (symbol, edge) of the minimum spanning tree of each series under mutual reachability.

    Windows must be normalised, which bounds their signatures. A series of one window has no edge. With fewer than ``min_samples`` other windows the farthest one gives the core distance.
    """
    wins = written(wins.select("symbol", "rn", "z"))
    near = written(nearest(wins, m, min_samples).withColumn("core", F.element_at("neighbours", -1)["distance"]))
    points = wins.join(near.select("symbol", "rn", "core"), ["symbol", "rn"])
    points = written(celled(signature(points, m), m).withColumn("comp", F.col("rn")))
    links = near.select("symbol", F.col("rn").alias("a"), "core", F.inline("neighbours")).withColumnRenamed("rn", "b")
    other_core = near.select("symbol", F.col("rn").alias("b"), F.col("core").alias("_core"))
    links = written(links.join(other_core, ["symbol", "b"]).select("symbol", "a", "b", F.greatest("distance", "core", "_core").alias("w")))
    found = []
    while True:
        comps = points.groupBy("symbol", "comp").agg(F.count(F.lit(1)).alias("_rows"), F.min("rn").alias("_rep"))
        largest = comps.groupBy("symbol").agg(F.max(F.struct("_rows", "comp")).alias("_top"))
        rest = comps.join(largest, "symbol").filter(F.col("comp") != F.col("_top.comp")).select("symbol", "comp", "_rep", F.col("_top.comp").alias("_to"))
        asks = points.join(_bounds(points, links, written(rest)), ["symbol", "comp"]).filter(F.col("core") <= F.col("radius"))
        cells = points.groupBy("symbol", "cell").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high"), F.min("core").alias("_core"))
        asks = asking(asks, ["rn", "z", "core", "comp", "radius"]).join(cells, ["symbol", "cell"])
        asks = asks.filter((F.col("_core") <= F.col("radius")) & ((F.col("_low") != F.col("comp")) | (F.col("_high") != F.col("comp"))))
        fields = ["rn", "z", "core", "comp"]
        left, right = tiled(asks, points, fields, fields)
        lightest = left.cogroup(right).applyInPandas(_tile, "symbol string, comp long, w double, lo long, hi long, other long")
        picks = written(lightest.groupBy("symbol", "comp").agg(F.min(F.struct(F.struct("w", "lo", "hi").alias("edge"), "other")).alias("pick")).select("symbol", "comp", "pick.*"))
        if picks.isEmpty():
            break
        found.append(picks.select("symbol", "edge").distinct())
        joined = components(picks.select("symbol", F.col("comp").alias("a"), F.col("other").alias("b")), ["symbol"])
        joined = joined.withColumnRenamed("node", "comp")
        points = written(points.join(joined, ["symbol", "comp"], "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"))
        links = written(_foreign(points, links).select("symbol", "a", "b", "w"))
    if not found:
        return wins.sparkSession.createDataFrame([], f"symbol string, edge {EDGE}")
    return written(reduce(DataFrame.unionAll, found).distinct())


def _foreign(points: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose ends lie in different components, with these."""
    comp = points.select("symbol", F.col("rn").alias("a"), F.col("comp").alias("ca"))
    out = links.join(comp, ["symbol", "a"]).join(comp.toDF("symbol", "b", "cb"), ["symbol", "b"])
    return out.filter(F.col("ca") != F.col("cb"))


def _bounds(points: DataFrame, links: DataFrame, rest: DataFrame) -> DataFrame:
    """An upper bound for the lightest outgoing edge of each component: a known link, or the way from its first row to the first of the largest one."""
    across = _foreign(points, links)
    known = across.select("symbol", F.explode(F.array("ca", "cb")).alias("comp"), "w").groupBy("symbol", "comp").agg(F.min("w").alias("_known"))
    row = points.select("symbol", F.col("rn").alias("_rep"), F.col("z").alias("_z"), F.col("core").alias("_c"))
    target = points.filter(F.col("rn") == F.col("comp")).select("symbol", F.col("comp").alias("_to"), F.col("z").alias("_zt"), F.col("core").alias("_ct"))
    ends = rest.join(row, ["symbol", "_rep"]).join(target, ["symbol", "_to"]).join(known, ["symbol", "comp"], "left")
    apart = F.sqrt(F.aggregate(F.zip_with("_z", "_zt", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    bound = F.least(F.greatest(apart, "_c", "_ct"), "_known")
    return ends.select("symbol", "comp", (bound * (1 + 1e-9) + 1e-9).alias("radius"))


def big_from(tree: DataFrame, min_size: int = 10) -> DataFrame:
    """(symbol, rn, big): the edge with which the component of each row first has ``min_size`` members; null where it never has.

    Every row walks the tree along the lightest edge at its border until it has ``min_size`` members; the heaviest edge on the way is
    the answer. No step needs more than the ``min_size - 1`` lightest edges of a row or of a border, so states are bounded.
    """
    lo, hi = F.col("edge.lo"), F.col("edge.hi")
    ways = tree.select("symbol", "edge", F.inline(F.array(F.struct(lo.alias("at"), hi.alias("to")), F.struct(hi.alias("at"), lo.alias("to")))))
    lightest = Window.partitionBy("symbol", "at").orderBy("edge")
    ways = ways.withColumn("_r", F.row_number().over(lightest)).filter(F.col("_r") < min_size)
    ways = written(ways.groupBy("symbol", "at").agg(F.sort_array(F.collect_list(F.struct("edge", "to"))).alias("ways")))
    walks = ways.select(
        "symbol", F.col("at").alias("rn"), F.col("ways").alias("border"), F.array("at").alias("members"), F.lit(None).cast(EDGE).alias("big"))
    for have in range(2, min_size + 1):
        step = F.get("border", F.lit(0))
        walks = walks.filter(F.size("border") > 0).select(
            "symbol", "rn", F.greatest("big", step["edge"]).alias("big"), step["to"].alias("at"),
            F.slice("border", 2, min_size).alias("border"), F.concat("members", F.array(step["to"])).alias("members"))
        if have < min_size:
            fresh = F.filter("ways", lambda x: ~F.array_contains("members", x["to"]))
            border = F.slice(F.sort_array(F.concat("border", fresh)), 1, min_size - have)
            walks = walks.join(ways, ["symbol", "at"]).select("symbol", "rn", "big", "members", border.alias("border"))
    return written(ways.select("symbol", F.col("at").alias("rn")).join(walks.select("symbol", "rn", "big"), ["symbol", "rn"], "left"))


def _merges(edges: pd.DataFrame) -> pd.DataFrame:
    """Binary merges of one series' leaf clusters: (cluster, leaf, parent, and the edge that ends it). The root has no parent."""
    edges = edges.sort_values(["w", "lo", "hi"])
    leaves = np.unique(edges[["sa", "sb"]].to_numpy())
    up = np.arange(2 * len(leaves) - 1)
    parent = np.full(len(up), -1)
    ends = np.zeros((len(up), 3))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    at = np.searchsorted(leaves, edges[["sa", "sb"]].to_numpy())
    for step, (pair, edge) in enumerate(zip(at, edges[["w", "lo", "hi"]].to_numpy())):
        new = len(leaves) + step
        for side in pair:
            old = top(side)
            up[old] = parent[old] = new
            ends[old] = edge
    leaf = np.concatenate([leaves, np.full(len(leaves) - 1, -1)])
    return pd.DataFrame({
        "symbol": edges["symbol"].iloc[0], "cluster": np.arange(len(up)), "leaf": leaf, "parent": parent,
        "w": ends[:, 0], "lo": ends[:, 1].astype("int64"), "hi": ends[:, 2].astype("int64"),
    })


TREE = "symbol string, cluster long, leaf long, parent long, w double, lo long, hi long"


def _left(key: tuple, rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
    """Members that leave each cluster by themselves and the sum of the densities (1 / weight) at which they do."""
    if not len(rows) or not len(tree):
        return pd.DataFrame({"symbol": np.array([], object), "cluster": np.array([], "int64"), "gone": np.array([], "int64"), "density": np.array([], float)})
    tree = tree.sort_values("cluster_r")
    parent = tree["parent_r"].to_numpy()
    jump = [np.where(parent < 0, np.arange(len(parent)), parent)]
    while (jump[-1] != len(parent) - 1).any():  # the root is the last cluster
        jump.append(jump[-1][jump[-1]])
    end = [tree[f"{c}_r"].to_numpy() for c in ("w", "lo", "hi")]
    root = parent < 0
    mine = [rows[c].to_numpy() for c in ("bw", "blo", "bhi")]
    leaves = tree[tree["leaf_r"] >= 0].sort_values("leaf_r")
    now = leaves["cluster_r"].to_numpy()[np.searchsorted(leaves["leaf_r"].to_numpy(), rows["leaf"].to_numpy())]

    def over(at: np.ndarray) -> np.ndarray:
        """Whether cluster ``at`` has merged before the row joined."""
        w, lo, hi = (e[at] for e in end)
        earlier = (w < mine[0]) | ((w == mine[0]) & ((lo < mine[1]) | ((lo == mine[1]) & (hi < mine[2]))))
        return earlier & ~root[at]

    # Clusters on the way up end in order, so the last one that is over is found by doubling steps.
    late = over(now)
    for step in reversed(jump):
        there = step[now]
        now = np.where(late & over(there), there, now)
    now = np.where(late, jump[0][now], now)
    out = pd.DataFrame({"cluster": now, "density": 1 / np.maximum(mine[0], EPS)}).groupby("cluster")["density"].agg(["size", "sum"])
    return pd.DataFrame({"symbol": key[0], "cluster": out.index, "gone": out["size"].to_numpy(), "density": out["sum"].to_numpy()})


def _chosen(tree: pd.DataFrame) -> pd.DataFrame:
    """Per leaf cluster of one series the chosen cluster it lies in, its stability and the edge that ends it."""
    tree = tree.sort_values("cluster").reset_index(drop=True)
    n = len(tree)
    parent, gone, density = (tree[c].to_numpy() for c in ("parent", "gone", "density"))
    end = 1 / np.maximum(tree["w"].to_numpy(), EPS)
    below, split, parts = np.zeros(n), np.zeros(n), np.zeros(n)
    best, stability = np.zeros(n), np.zeros(n)
    for c in range(n - 1):  # parts come before what they merge into; the root is never chosen
        stability[c] = density[c] + below[c] * split[c] - (gone[c] + below[c]) * end[c]
        best[c] = max(stability[c], parts[c])
        p = parent[c]
        below[p] += gone[c] + below[c]
        split[p] = end[c]
        parts[p] += best[c]
    taken = np.full(n, -1)
    for c in range(n - 2, -1, -1):
        up = taken[parent[c]]
        taken[c] = up if up >= 0 else c if stability[c] >= parts[c] else -1
    at = np.flatnonzero((tree["leaf"].to_numpy() >= 0) & (taken >= 0))
    into = tree.iloc[taken[at]]
    return pd.DataFrame({
        "symbol": tree["symbol"].iloc[0], "leaf": tree["leaf"].to_numpy()[at], "cluster": taken[at], "stability": stability[taken[at]],
        "w": into["w"].to_numpy(), "lo": into["lo"].to_numpy(), "hi": into["hi"].to_numpy(),
    })


def hierarchy_labels(wins: DataFrame, m: int, min_samples: int = 5, min_size: int = 10) -> DataFrame:
    """``wins`` with ``label`` (-1 is noise, clusters from the largest) and ``stability`` of the row's cluster (null for noise).

    A series that never splits into two clusters of ``min_size`` is noise as a whole, also one of fewer rows or with equal windows only.
    """
    wins = written(wins)
    tree = spanning_tree(wins, m, min_samples)
    rows = big_from(tree, min_size)
    big = rows.select("symbol", F.col("rn").alias("_lo"), F.col("big").alias("_a"))
    ends = tree.select("symbol", "edge", F.col("edge.lo").alias("_lo"), F.col("edge.hi").alias("_hi"))
    ends = ends.join(big, ["symbol", "_lo"]).join(big.toDF("symbol", "_hi", "_b"), ["symbol", "_hi"])
    splits = F.coalesce((F.col("edge") > F.col("_a")) & (F.col("edge") > F.col("_b")), F.lit(False))
    ends = written(ends.select("symbol", "edge", splits.alias("splits")))
    inner = ends.filter("NOT splits").select("symbol", F.col("edge.lo").alias("a"), F.col("edge.hi").alias("b"))
    leaf = written(components(inner, ["symbol"]).toDF("symbol", "rn", "leaf"))
    between = ends.filter("splits").select("symbol", "edge.*")
    between = between.join(leaf.toDF("symbol", "lo", "sa"), ["symbol", "lo"]).join(leaf.toDF("symbol", "hi", "sb"), ["symbol", "hi"])
    merges = written(between.groupBy("symbol").applyInPandas(_merges, TREE))
    # Rows go to chunks; every chunk meets the tree of its series.
    counted = rows.filter("big IS NOT NULL").join(leaf, ["symbol", "rn"])
    chunks = counted.groupBy("symbol").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n")).join(merges.select("symbol").distinct(), "symbol")
    placed = written(counted.join(chunks, "symbol").withColumn("chunk", F.pmod(F.xxhash64("rn"), "_n")).select(
        "symbol", "chunk", "leaf", F.col("big.w").alias("bw"), F.col("big.lo").alias("blo"), F.col("big.hi").alias("bhi")))
    copies = merges.join(chunks, "symbol").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    copies = copies.select(*[F.col(c).alias(f"{c}_r") for c in ("symbol", "chunk", "cluster", "leaf", "parent", "w", "lo", "hi")])
    gone = placed.groupBy("symbol", "chunk").cogroup(copies.groupBy("symbol_r", "chunk_r")).applyInPandas(
        _left, "symbol string, cluster long, gone long, density double")
    gone = gone.groupBy("symbol", "cluster").agg(F.sum("gone").alias("gone"), F.sum("density").alias("density"))
    whole = merges.join(gone, ["symbol", "cluster"], "left").fillna(0, ["gone"]).fillna(0.0, ["density"])
    chosen = whole.groupBy("symbol").applyInPandas(
        _chosen, "symbol string, leaf long, cluster long, stability double, w double, lo long, hi long")
    member = rows.join(leaf, ["symbol", "rn"]).join(written(chosen), ["symbol", "leaf"]).filter(F.col("big") < F.struct("w", "lo", "hi"))
    member = written(member.select("symbol", "rn", "cluster", "stability"))
    sizes = member.groupBy("symbol", "cluster").agg(F.count(F.lit(1)).alias("_size"), F.min("rn").alias("_first"))
    order = Window.partitionBy("symbol").orderBy(F.desc("_size"), "_first")
    named = sizes.select("symbol", "cluster", (F.row_number().over(order) - 1).cast("int").alias("label"))
    labels = member.join(named, ["symbol", "cluster"]).select("symbol", "rn", "label", "stability")
    return wins.join(labels, ["symbol", "rn"], "left").fillna(-1, ["label"])
