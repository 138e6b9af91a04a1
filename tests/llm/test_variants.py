"""Spelling variants against edit distances by hand."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import variants

SCHEMA = "doc_id bigint, text string, word string, n int, key string"


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point parts them."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counts(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = None if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            if h is not None and h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def expected(rows):
    words = counts(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(spark, rows, **settings):
    return sorted(tuple(r) for r in variants.variants(spark.createDataFrame([(*r, "x", 1, "k") for r in rows], SCHEMA), **settings).collect())


def corpus(seed, docs=60, stems=25):
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdeéñ"))
    base = ["".join(rng.choice(letters, rng.integers(6, 12))) for _ in range(stems)]
    rows = []
    for d in range(docs):
        text = []
        for w in rng.choice(base, 40, p=(p := 1 / np.arange(1, stems + 1) ** 1.5) / p.sum()):
            if rng.random() < 0.3:
                i = int(rng.integers(0, len(w)))
                w = [w[:i] + w[i + 1:], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1:]][rng.integers(0, 3)]
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    rows = corpus(seed)
    want = expected(rows)
    assert got(spark, rows) == want and any(r[1] for r in want) and max(r[4] for r in want) > 3


def test_chunks_of_one_block_and_other_parts(spark):
    rows = corpus(9)
    assert got(spark, rows, parts=2, tile=3) == expected(rows)


def test_pairs_of_all_kinds_count_once():
    pairs = [("aaaaaaa", "aaaaaaaa"), ("abababa", "babababa"), ("abcdefg", "xabcdefg"), ("abcdefg", "abcdefgx"), ("abcdefg", "abcxefg"), ("abcdefg", "abcdefh"), ("abcdefg", "bbcdefg"), ("abcdefg", "gfedcba"), ("aaaaaaa", "aaaaaaaaa")]
    for a, b in pairs:
        hits = 0
        for part in range(variants.PARTS):
            sizes = np.array([len(a), len(b)])
            codes = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)
            front, back = variants.matrices(codes, np.array([0, len(a)]), sizes, 9)
            near = variants.compared(front[None], back[None], sizes[None], np.zeros((1, 2), bool), np.zeros(1, bool), min(len(a), len(b)), part)
            assert (near[0] == near[0].T).all()
            hits += int(near.sum()) // 2
        assert hits == int(one_edit(a, b)), (a, b)


def test_nulls_empty_and_long_texts_ties_and_repeated_rows(spark):
    long = "x" * 3000
    rows = [(None, "abcdefgh abcdefgh"), (1, None), (2, ""), (3, "--- 12 ---"), (4, f"{long} {long}y {long[:-1]}z {long}"), (4, f"{long} {long}y {long[:-1]}z {long}"),
            (5, "abcdefgx " * 25 + "abcdefgy " * 25), (6, "ÀÉÎÕÜßÿ× ÀÉÎÕÜßÿ÷ " * 3), (7, "Abcdefgh ABCDEFGH abcdefg"), (8, "abcdefg " * 2), (9, "short words only " * 5)]
    assert got(spark, rows) == expected(rows)


def test_no_words(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "a b c")]) == []


def test_counts_are_handed_on_when_many(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 5)
    rows = corpus(4)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})
    found = Counter()
    for out in variants.counted([batch]):
        for w, n in zip(out.column("word").to_pylist(), out.column("n").to_pylist()):
            found[w] += n
    assert {w: n for w, n in found.items() if n >= 2} == counts(rows)
