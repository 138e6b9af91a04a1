"""Stupid-backoff scores of documents against the n-gram counts of the whole corpus.

Three joined tables do the work. ``blocks`` hold some megabytes of texts each, compressed. Every block explodes its texts into
n-grams of all orders, adds up equal ones, and asks for the counts of its n-grams, in parts by their 52-bit hash. Each
part adds up what the blocks have of each n-gram, the count table of that range of hashes, and answers each
block with the totals in the order it asked. Blocks joined with their answers score each word,
S(w | context) = count(context w) / count(context) where the n-gram occurs at least ``least`` times, else ``backoff`` times the score with a shorter
context, and the logarithms are summed per document. A frequent n-gram travels once per block, whatever its count.

Words are runs of bytes that are no white space, A-Z in lower case. Null and empty texts have 0 words, score 0.
Repeated rows count each time. N-grams do not cross documents. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_bytes, mix, span_hashes, stored, words_of
from tidemark.llm.simhash import LOWER

HASH_BITS = 52
PART_KEYS = 1 << 19


def pack(numbers: np.ndarray) -> bytes:
    """Byte planes of unsigned integers, compressed."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, kind) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    size = np.dtype(kind).itemsize
    planes = pa.decompress(packed[8:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as packed differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per order: the hash of the n-gram that ends at each word, and whether the document has that many words before; then the document of each word."""
    joined, starts, ends, owner = words_of([t.translate(LOWER) for t in texts])
    word = span_hashes(joined, starts, ends)
    drop = np.uint64(64 - HASH_BITS)
    chain, has = word, np.ones(len(word), bool)
    keys, valid = [mix(word + np.uint64(1)) >> drop], [has]
    for n in range(2, order + 1):
        longer = np.zeros(len(word), np.uint64)
        with np.errstate(over="ignore"):
            longer[1:] = mix(word[1:] + mix(chain[:-1] + np.uint64(n)))
        has = np.concatenate(([False], has[:-1] & (owner[1:] == owner[:-1]))) if len(word) else has
        chain = longer
        keys.append(mix(chain + np.uint64(n)) >> drop)
        valid.append(has)
    return keys, valid, owner


def blocks_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(block, ids, sizes, texts, words): some megabytes of texts a row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        held, number = 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            words = sum(len(t.split()) for t in texts)
            body = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                pa.array([body], pa.binary()), pa.array([words], pa.int64())], names=["block", "ids", "sizes", "texts", "words"])

        id_type = pa.int64()
        for batch in by_bytes(batches, "text", 1 << 20):
            id_type = batch.schema.field("doc_id").type
            ids += batch.column("doc_id").to_pylist()
            new = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            texts += new
            held += sum(map(len, new))
            if held >= size:
                yield block()
                ids, texts, held, number = [], [], 0, number + 1
        if texts:
            yield block()

    return stored(narrow.mapInArrow(run, f"block bigint, ids array<{kind}>, sizes array<int>, texts binary, words bigint"))


def texts_in(body: bytes, sizes: list[int]) -> list[bytes]:
    whole = pa.decompress(body, sum(sizes), codec="zstd", asbytes=True)
    ends = np.cumsum(sizes).tolist()
    return [whole[e - s:e] for e, s in zip(ends, sizes)]


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of some megabytes each, only one of them as Python objects at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def distinct(keys: list[np.ndarray], valid: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all orders, sorted, and how often each occurs."""
    every = np.concatenate([k[v] for k, v in zip(keys, valid)])
    every.sort()
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.empty(0, np.int64)
    return every[first], np.diff(first, append=len(every)).astype(np.uint32)


def asked(order: int, bits: int):
    """Each block's distinct n-grams with their counts, cut into parts by the highest bits of the hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                keys, valid, _ = grams(texts_in(row["texts"], row["sizes"]), order)
                found, n = distinct(keys, valid)
                part = found >> np.uint64(HASH_BITS - bits)
                cuts = np.flatnonzero(np.diff(part)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(found)]):
                    if b > a:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([row["block"]], pa.int64()), pa.array([int(part[a])], pa.int32()),
                            pa.array([pack_keys(found[a:b])], pa.binary()), pa.array([pack(n[a:b])], pa.binary())],
                            names=["block", "part", "keys", "counts"])

    return run


def answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of a part's n-grams, sent to each block in the order of its own keys."""
    for batch in batches:
        for i in range(batch.num_rows):
            rows = batch.column("asks")[i].as_py()
            keys = [unpack_keys(r["keys"]) for r in rows]
            counts = [unpack(r["counts"], np.uint32) for r in rows]
            found, at = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.uint64)
            ends = np.cumsum([len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([
                pa.array([r["block"] for r in rows], pa.int64()), pa.array([batch.column("part")[i].as_py()] * len(rows), pa.int32()),
                pa.array([pack(totals[at[e - len(k):e]]) for e, k in zip(ends, keys)], pa.binary())], names=["block", "part", "totals"])


def summed(order: int, least: int, backoff: float, total: int, kind: str):
    """Scores of a block's documents from its answers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in one_by_one(batch):
                keys, valid, owner = grams(texts_in(row["texts"], row["sizes"]), order)
                found, _ = distinct(keys, valid)
                answers = sorted(row["answers"] or [], key=lambda a: a["part"])
                totals = np.concatenate([unpack(a["totals"], np.uint64) for a in answers]) if answers else np.empty(0, np.uint64)
                score = np.zeros(len(owner))
                context = None
                for n, (k, v) in enumerate(zip(keys, valid), 1):
                    count = np.zeros(len(k))
                    count[v] = totals[np.searchsorted(found, k[v])]
                    if n == 1:
                        score = count / max(total, 1)
                    else:
                        seen = v & (count >= least)
                        before = np.concatenate(([1.0], context[:-1])) if len(k) else context
                        score = np.where(seen, count / np.maximum(before, 1), np.where(v, backoff * score, score))
                    context = count
                logs = np.log(np.maximum(score, 1e-300))
                docs = len(row["ids"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], id_type), pa.array(np.bincount(owner, minlength=docs).astype(np.int64)),
                    pa.array(np.bincount(owner, weights=logs, minlength=docs).astype(np.float64))], names=["doc_id", "n_words", "log_score"])

    return run


def scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, least: int = 2, backoff: float = 0.4, block_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, n_words, log_score) per row: the natural logarithms of the words' scores, summed."""
    blocks = blocks_of(docs, id_col, text_col, block_bytes)
    total = blocks.agg(F.sum("words")).first()[0] or 0
    bits = min(30, max(1, math.ceil(math.log2(max(2, order * total / PART_KEYS)))))
    asks = blocks.mapInArrow(asked(order, bits), "block bigint, part int, keys binary, counts binary")
    parts = asks.groupBy("part").agg(F.collect_list(F.struct("block", "keys", "counts")).alias("asks"))
    answers = parts.mapInArrow(answered, "block bigint, part int, totals binary")
    told = answers.groupBy("block").agg(F.collect_list(F.struct("part", "totals")).alias("answers"))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.drop("words").join(told, "block", "left").mapInArrow(
        summed(order, least, backoff, total, kind), f"doc_id {kind}, n_words bigint, log_score double")
