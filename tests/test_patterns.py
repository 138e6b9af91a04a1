import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import neighbours as N
from tidemark.operators import patterns as P
from tidemark.operators.frame import position
from tidemark.session import cut


def z_of(close, m):
    out = []
    for i in range(len(close) - m + 1):
        w = close[i : i + m]
        out.append((w - w.mean()) / (w.std() + 1e-8))
    return np.array(out)


def brute(z, k, apart):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    i = np.arange(len(z))
    d[np.abs(i[:, None] - i[None]) <= apart] = np.inf
    return np.sort(d, 1)[:, :k]


def test_nearest_is_exact_with_tiny_cells_and_tiles(bars, monkeypatch):
    df, pdf = bars
    monkeypatch.setattr(N, "CELL_ROWS", 16)
    monkeypatch.setattr(N, "TILE_QUERIES", 64)
    monkeypatch.setattr(N, "CHUNK", 32)
    wins = cut(P.windows(position(df), 20, size=100))
    for k, apart in ((1, 5), (3, 0)):
        got = N.nearest(wins, 20, k, apart).toPandas()
        for s in ("X", "Y"):
            g = got[got.symbol == s].sort_values("rn")
            want = brute(z_of(pdf[pdf.symbol == s].close.to_numpy(), 20), k, apart)
            assert list(g.rn) == list(range(1, len(want) + 1))
            found = np.array([[n["distance"] for n in row] for row in g.neighbours])
            np.testing.assert_allclose(found, want, rtol=1e-9, atol=1e-9)


def test_motifs_find_a_planted_shape(spark, bars):
    df, _ = bars
    i = F.col("rn") % 97
    planted = position(df.filter("symbol = 'X'")).withColumn("close", F.when(i < 20, 100 + F.sin(i * 1.3) * 10).otherwise(F.col("close")))
    wins = cut(P.windows(planted, 20))
    found = P.motifs(wins, P.profile(wins, 20), 20, top_k=2, max_matches=5)
    table = P.motif_table(found, 20).orderBy("motif_id").toPandas()
    assert table.occurrences[0] == 5
    assert all(r % 97 == 0 for r in table.indices[0])
    first = found.filter("motif_id = 0").toPandas().rn.to_numpy()
    assert min(abs(a - b) for a in first for b in first if a != b) > 5


def test_components_join_long_chains(spark):
    edges = [("s", i, i + 1) for i in range(1, 200) if i != 120] + [("t", 1, 2)]
    got = P.components(spark.createDataFrame(edges, "symbol string, a long, b long"), ["symbol"]).toPandas()
    roots = got.groupby(["symbol", "root"]).size()
    assert roots[("s", 1)] == 120 and roots[("s", 121)] == 80 and roots[("t", 1)] == 2


def test_density_clusters_separate_shapes_from_noise(bars):
    df, _ = bars
    labelled = P.density_labels(P.windows(position(df), 20), 20, 5, 10).toPandas()
    assert (labelled.label >= -1).all() and len(labelled) == 581 + 71
    sizes = labelled[labelled.label >= 0].groupby(["symbol", "label"]).size()
    assert (sizes >= 10).all()


def test_dtw_matches_the_recurrence(spark, bars):
    _, pdf = bars
    z = z_of(pdf.close.to_numpy()[:40], 12)
    pattern = z[5]

    def dtw(a, b):
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j + 1], d[i + 1, j], d[i, j])
        return d[-1, -1]

    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(z)], "i long, z array<double>")
    got = table.select("i", P.dtw(pattern.tolist())("z").alias("d")).orderBy("i").toPandas().d
    np.testing.assert_allclose(got, [dtw(row, pattern) for row in z], rtol=1e-12, atol=1e-12)


def test_occurrences_of_many_templates_are_exact_and_without_a_cross_join(spark, bars):
    df, pdf = bars
    wins = cut(P.windows(position(df), 20))
    z = z_of(pdf[pdf.symbol == "X"].close.to_numpy(), 20)
    shapes = np.concatenate([z + 0.01 * i for i in range(3)])  # 1,743 templates
    table = spark.createDataFrame([(f"p{i}", p.tolist()) for i, p in enumerate(shapes)], "pattern_name string, pattern array<double>")
    for radius in (0.1, 2.5):
        hits = P.occurrences(wins, table, radius)
        assert "CartesianProduct" not in hits._jdf.queryExecution().toString() and "NestedLoop" not in hits._jdf.queryExecution().toString()
        got = {(r.rn, r.pattern_name) for r in hits.filter("symbol = 'X'").select("rn", "pattern_name").collect()}
        d = np.sqrt(((z[:, None] - shapes[None]) ** 2).sum(2))
        clear = np.abs(d - radius) > 1e-9
        want = {(int(a) + 1, f"p{b}") for a, b in zip(*np.nonzero((d <= radius) & clear))}
        assert want <= got and len(got - want) <= (~clear).sum()


def test_equal_distances_go_to_the_smallest_position(spark):
    rows = [("s", i + 1, [float(i % 3 == j) for j in range(8)]) for i in range(300)]
    found = N.nearest(spark.createDataFrame(rows, "symbol string, rn long, z array<double>"), 8, 2, 0).toPandas()
    for rn, near in zip(found.rn, found.neighbours):
        same = [k for k in range(1, 301) if (k - rn) % 3 == 0 and k != rn][:2]
        assert [n["rn"] for n in near] == same and all(n["distance"] == 0 for n in near)


def test_neighbours_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "symbol string, rn long, z array<double>")
    assert N.nearest(empty, 8, 1, 0).count() == 0
