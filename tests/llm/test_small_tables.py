"""The multi-index on a handful of vectors, and on vectors of several lengths."""

import numpy as np
import pytest

from tidemark.llm import multi_index

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def searched(spark, rows):
    got = {}
    for r in multi_index.search(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


@pytest.mark.parametrize("n", [5, 6])
def test_a_handful_returns_all_candidates(spark, n):
    x = np.eye(n, 8) + 0.1
    assert searched(spark, [(i, v.tolist()) for i, v in enumerate(x)]) == {0: set(range(1, n))}


def test_each_length_is_searched(spark):
    x = np.random.default_rng(6).standard_normal((12, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, [1.0, 2.0]), (51, [2.0, 1.0]), (52, [3.0, 1.0]), (100, [2.0])]
    got = searched(spark, rows)
    assert set(got) == {0, 50} and got[50] == {51, 52} and len(got[0]) == 5 and got[0] <= set(range(12))
