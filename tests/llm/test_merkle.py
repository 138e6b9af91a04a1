"""The manifest against trees built by hand."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, path int, grp string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grown(nodes, arity):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + arity]) for i in range(0, len(last), arity)])
    return levels


def path(levels, i, arity):
    out = []
    for level in levels[:-1]:
        run = i - i % arity
        out.append(("".join(level[run:i]), "".join(level[i + 1:run + arity])))
        i //= arity
    return out


def expected(rows, arity=2):
    groups = defaultdict(list)
    for r in rows:
        fields = [r[0], r[3], r[2], r[4], r[1]]
        changed = list(fields)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
            changed[3] += 1
        groups[b"" if r[2] is None else b"=" + r[2].encode()].append((r[0] is not None, r[0] or 0, h(*map(field, fields)), h(*map(field, changed)), r[0]))
    order = sorted(groups)
    trees = {g: grown([x[2] for x in sorted(groups[g])], arity) for g in order}
    top = grown([trees[g][-1][0] for g in order], arity)
    out = []
    for k, g in enumerate(order):
        for i, (_, _, leaf, shown, doc) in enumerate(sorted(groups[g])):
            steps = path(trees[g], i, arity) + path(top, k, arity)
            now = shown
            for left, right in steps:
                now = h(left, now, right)
            out.append((doc, leaf, trees[g][-1][0], top[-1][0], h(*[a + b for a, b in steps]), now, now == top[-1][0]))
    return out


def got(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    bumped = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return [tuple(r) for r in merkle.manifest(docs, tampered={"n_chars": bumped}, **settings).collect()]


def rows_of(n, langs=("en", "fr", None, "é", "zz")):
    return [(i, f"text {i} é" * (i % 4), langs[(i * i) % len(langs)] if i % 3 else "en", None if i % 5 == 0 else f"s{i % 3}", None if i % 11 == 0 else i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 77, 700])
def test_manifest_equals_trees_built_by_hand(spark, n):
    rows = rows_of(n)
    assert sorted(got(spark, rows), key=str) == sorted(expected(rows), key=str)


def test_wider_runs(spark):
    rows = rows_of(90)
    for arity in (3, 16):
        assert sorted(got(spark, rows, arity=arity), key=str) == sorted(expected(rows, arity), key=str)


def test_blocks_beyond_one_stride(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = rows_of(150)
    assert sorted(got(spark, rows), key=str) == sorted(expected(rows), key=str)


def test_null_ids_repeated_rows_long_and_empty_texts(spark):
    rows = [(None, "a", "en", "s", 1), (None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (5, "b", "en", "s", 0), (6, "é" * 200_000, "", "s", 9)]
    assert sorted(got(spark, rows), key=str) == sorted(expected(rows), key=str)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_many_groups(spark):
    rows = [(i, "t", f"g{i % 60}", "s", i) for i in range(100)]
    assert sorted(got(spark, rows), key=str) == sorted(expected(rows), key=str)


def test_tampered_rows_alone_fail(spark):
    out = queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    bad = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    assert out.filter(F.col("verified") == bad).count() == 0 and out.filter("not verified").count() > 0
