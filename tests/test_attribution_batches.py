"""What depends on the trees alone is worked out once for all rows of a call, not once for every few rows."""

import numpy as np

from tidemark.operators import explain as E


def leaves_of(rng, sizes):
    paths = [rng.choice(12, d, replace=False) for d in sizes]
    return [{"value": rng.normal(), "path": {int(f): (-1.0, float(rng.normal()), float(rng.random())) for f in p}} for p in paths]


def direct(row, leaves):
    """Each leaf's Shapley values by themselves, added up."""
    phi = np.zeros(len(row))
    for leaf in leaves:
        features = list(leaf["path"])
        known = np.array([float(low < row[f] <= high) for f, (low, high, _) in leaf["path"].items()])
        phi[features] += E.shapley(known, np.array([c[2] for c in leaf["path"].values()])) * leaf["value"]
    return phi


def test_tables_are_made_once_for_all_rows(monkeypatch):
    rng = np.random.default_rng(5)
    leaves = leaves_of(rng, (1, 3, 3, 6, 6, 6))
    x = rng.normal(size=(1100, 12))
    want = np.array([direct(row, leaves) for row in x])
    made, shapley = [], E.shapley
    monkeypatch.setattr(E, "shapley", lambda *a: made.append(1) or shapley(*a))
    np.testing.assert_allclose(E.attribute(x, leaves, batch=50), want, atol=1e-12)
    assert len(made) == 3  # one for each number of features


def test_batches_do_not_change_long_paths_or_empty_calls():
    rng = np.random.default_rng(6)
    leaves = leaves_of(rng, (2, 5, 11, 12))
    x = rng.normal(size=(70, 12))
    want = np.array([direct(row, leaves) for row in x])
    for batch in (1, 32, 70, 500):
        np.testing.assert_allclose(E.attribute(x, leaves, batch=batch), want, atol=1e-12)
    assert E.attribute(x[:0], leaves).shape == (0, 12)
