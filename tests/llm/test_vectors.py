"""Vector operators against brute force, on random, planted, equal and broken vectors."""

import numpy as np
import pytest

from tidemark.llm import embedding_dedup, multi_index

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def vectors(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        base = rng.standard_normal((60, 16))
        for b in base[:15]:
            base = np.vstack([base, b + rng.standard_normal((6, 16)) * 0.22, b, b * 2.5])
        rows += [(len(rows) + i, [float(np.float32(x)) for x in v], label, "x") for i, v in enumerate(base)]
    n = len(rows)
    rows += [(n, None, 1, "x"), (n + 1, [], 1, "x"), (n + 2, [0.0] * 16, 1, "x"), (n + 3, [float("nan")] * 16, 1, "x"), (n + 4, [None] + [1.0] * 15, 1, "x"),
             (n + 5, [1.0] * 16, None, "x"), (n + 6, [1.0] * 16, None, "x"), (n + 7, [1.0, 2.0], 1, "x"), (n + 8, [2.0, 4.0], 1, "x"), (n + 9, [float("inf")] * 16, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA), rows


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()))


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("blocks,grid", [(4, 2), (8, 1), (1, 3)])
def test_links_and_components(spark, blocks, grid):
    frame, rows = vectors(spark)
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i, (_, v, l, _) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if l is not None and l == rows[j][2] and usable(v) and usable(w) and len(v) == len(w):
                near[i, j] = near[j, i] = cosine(v, w) >= 0.93
    label = np.arange(n)
    while True:
        lower = np.where(near | np.eye(n, dtype=bool), label[None, :], n).min(1)
        if (lower == label).all():
            break
        label = lower
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame, blocks=blocks, grid=grid).collect()}
    assert got == {i: (int(near[i].sum()), int(label[i]), label[i] == i) for i in range(n)}
    assert near.sum() > 200


def test_search_with_all_cells_is_exact_and_ties_go_to_small_ids(spark):
    frame, rows = vectors(spark, 2)
    good = [(i, v) for i, v, _, _ in rows if usable(v) and len(v) == 16]
    got = {}
    for r in multi_index.search(frame, share=1.0, every=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = [(i, v) for i, v in good if i % 10 == 0]
    assert set(got) == {i for i, _ in asked}
    for i, v in asked:
        best = sorted(((-cosine(v, w), j) for j, w in good if j != i))[:5]
        found = sorted(got[i])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert np.allclose([f[2] for f in found], [-b[0] for b in best], atol=1e-12)


def test_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], SCHEMA)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {}
    for r in multi_index.search(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / (5 * 60) >= 0.9


def test_walk_takes_cells_in_order():
    rng = np.random.default_rng(4)
    a, b = rng.random(7), rng.random(5)
    sizes = {c: 1 for c in range(35)}
    cells = multi_index.walk(a, b, sizes, 35)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0], 1, "x"), (50, [1.0, 1.0], 1, "x"), (7, [0.0, 1.0], 1, "x")], SCHEMA)
    assert sorted((r.query_id, r.rank) for r in multi_index.search(one).collect()) == [(0, 1), (0, 2), (50, 1), (50, 2)]
    assert multi_index.search(one.limit(0)).count() == 0 and embedding_dedup.near_duplicates(one.limit(0)).count() == 0
