"""The multi-index on a table where a third of all rows are copies of one vector."""

import numpy as np

from tidemark.llm import multi_index, simhash

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def scores(frame):
    found = {}
    for r in multi_index.search(frame, share=0.3).collect():
        found.setdefault(r.query_id, []).append(r.score)
    return {q: np.sort(v)[::-1] for q, v in found.items()}


def test_copies_use_up_no_budget_of_other_cells(spark):
    x = np.random.default_rng(3).standard_normal((1000, 32)).astype(np.float32)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    copies = [(1001 + 50 * (i // 49) + i % 49, x[7].tolist(), 0, "x") for i in range(500)]  # no queries
    alone, beside = scores(spark.createDataFrame(rows, SCHEMA)), scores(spark.createDataFrame(rows + copies, SCHEMA))
    assert set(alone) == set(beside) == set(range(0, 1000, 50))
    assert all((beside[q] >= alone[q] - 1e-9).all() for q in alone)


def test_texts_that_share_an_id_are_judged_apart(spark):
    one, two = " ".join(f"alpha{i}" for i in range(30)), " ".join(f"beta{i * 7}" for i in range(30))
    rows = [(1, one, "a"), (1, two, "a"), (2, one, "b"), (None, two, "c"), (None, "gamma delta " * 9, "d"), (None, "gamma delta " * 9, "d"), (3, None, "e"), (4, "", "f"), (5, one, "b"), (5, one, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, nth string")
    got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, one, "a"), (1, two, "a"), (None, "gamma delta " * 9, "d"), (3, None, "e")], key=str)
    assert got == sorted(map(tuple, simhash.keep_one(docs.orderBy("nth").repartition(3)).collect()), key=str)


def test_keeping_one_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, fp string")
    assert simhash.keep_one(docs).count() == 0 and simhash.keep_one(docs).columns == docs.columns
