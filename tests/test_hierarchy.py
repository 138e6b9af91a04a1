import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hierarchy as H
from tidemark.operators import neighbours as N

SCHEMA = "symbol string, rn long, z array<double>"


def brute(z, samples, size):
    """The spanning tree by Kruskal over all pairs, then the hierarchy from the top by recursion over member lists."""
    n = len(z)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    core = np.sort(d + np.diag(np.full(n, -1.0)), 1)[:, min(samples, n - 1)]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    up = list(range(n))

    def top(i):
        return i if up[i] == i else top(up[i])

    tree = []
    for e in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = top(e[1]), top(e[2])
        if a != b:
            up[a] = b
            tree.append(e)

    def side(start, edges):
        seen, todo = {start}, [start]
        while todo:
            i = todo.pop()
            for _, a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == i and y not in seen:
                        seen.add(y)
                        todo.append(y)
        return seen

    def grow(members, edges, birth):
        """(stability, labels as lists) of the best choice below, and the cluster's own members and stability."""
        own, members, edges = 0.0, set(members), list(edges)
        start = set(members)
        while True:
            if not edges:
                return own, start, []
            e = max(edges)
            edges.remove(e)
            a = side(e[1], edges)
            a, b = a & members, members - a
            now = 1 / max(e[0], H.EPS)
            ea, eb = [x for x in edges if x[1] in a], [x for x in edges if x[1] in b]
            if len(a) >= size and len(b) >= size:
                own += len(members) * (now - birth)
                parts = [grow(a, ea, now), grow(b, eb, now)]
                return own, start, parts
            if len(a) < size and len(b) < size:
                own += len(members) * (now - birth)
                return own, start, []
            out, keep, edges = (a, b, eb) if len(a) < size else (b, a, ea)
            own += len(out) * (now - birth)
            members = keep

    def pick(node):
        own, members, parts = node
        below = [pick(p) for p in parts]
        total = sum(x[0] for x in below)
        if own >= total:
            return own, [(members, own)]
        return total, [c for x in below for c in x[1]]

    if n < size:
        return tree, []
    _, _, parts = grow(range(n), tree, 0.0)
    return tree, [c for p in parts for c in pick(p)[1]]


def blobs(rng, parts, noise, dims=8):
    """Shapes around a few random ones and others, normalised as windows are."""
    z = [rng.normal(0, s, (k, dims)) + rng.normal(0, 3, dims) for k, s in parts]
    return normal(np.concatenate([*z, rng.normal(0, 4, (noise, dims))]))


def normal(z):
    return (z - z.mean(1, keepdims=True)) / (z.std(1, keepdims=True) + 1e-8)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    a = blobs(rng, [(60, 0.3), (40, 0.2), (35, 0.5), (25, 0.2)], 140)  # 300 windows, four groups, much noise
    a[200:204] = a[5]  # repeated windows tie
    b = blobs(rng, [(30, 0.2), (12, 0.1)], 20)
    walk = 100 + np.cumsum(rng.normal(0, 1, 130))
    c = normal(np.array([walk[i : i + 8] for i in range(122)]))
    return {"A": a, "B": b, "C": c, "few": a[:7], "one": a[:1]}


def test_hierarchy_equals_brute_force(spark, series, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 32)
    monkeypatch.setattr(N, "TILE_QUERIES", 64)
    monkeypatch.setattr(H, "CHUNK", 50)
    rows = [(s, i + 1, row.tolist()) for s, z in series.items() for i, row in enumerate(z)]
    wins = spark.createDataFrame(rows, SCHEMA)
    tree = H.spanning_tree(wins, 8, 5).select("symbol", "edge.*").toPandas()
    got = H.hierarchy_labels(wins, 8, 5, 10).toPandas()
    assert len(got) == len(rows)
    for s, z in series.items():
        edges, clusters = brute(z, 5, 10)
        mine = tree[tree.symbol == s]
        assert len(mine) == len(z) - 1
        np.testing.assert_allclose(np.sort(mine.w), np.sort([e[0] for e in edges]), rtol=1e-9)
        g = got[got.symbol == s]
        found = {frozenset(x.rn): x.stability.iloc[0] for _, x in g[g.label >= 0].groupby("label")}
        want = {frozenset(i + 1 for i in members): value for members, value in clusters}
        assert set(found) == set(want), s
        for members, value in want.items():
            assert found[members] == pytest.approx(value, rel=1e-9)
        assert g[g.label < 0].stability.isna().all()
        sizes = g[g.label >= 0].groupby("label").size()
        assert list(sizes.index) == list(range(len(want))) and sizes.is_monotonic_decreasing
    assert (got[got.symbol.isin(["few", "one"])].label == -1).all()
    assert got[got.symbol == "A"].label.max() >= 3


def test_hierarchy_of_no_windows_and_of_equal_ones(spark):
    assert H.hierarchy_labels(spark.createDataFrame([], SCHEMA), 8).count() == 0
    same = spark.createDataFrame([("s", i + 1, [0.0] * 8) for i in range(30)], SCHEMA)
    got = H.hierarchy_labels(same, 8)
    assert got.filter(F.col("label") != -1).count() == 0 and got.count() == 30
