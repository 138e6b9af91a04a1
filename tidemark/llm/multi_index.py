"""Approximate nearest neighbours with an inverted multi-index.

Vectors of length one are split into halves; each half is quantised by its own centroids (k-means on a bounded sample,
every row is indexed). A cell is a pair of centroids. For a query, a heap walks the pairs by the
sum of the two squared distances until the cells walked hold ``share`` of all distinct vectors, so that copies use up no
other cell's budget; all their entries are reranked by the exact cosine on the original vectors. Cells are cut into chunks of ``CHUNK`` rows and their queries into lists of as
many, so a cell that holds a third of all rows is many tasks; each chunk returns its best rows only.

Vectors that are null, zero or hold null or non-finite components take no part. Each length has centroids, cells and a budget of
its own, as vectors of different lengths have no cosine. The budget is never less than the ``k`` vectors asked for. Rows with one id are rows of their own; a query's own id is no candidate. Fewer candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import chance, stored
from tidemark.llm.embedding_dedup import usable

CHUNK = 512


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means on a bounded sample; an empty cluster takes the point farthest from its centroid."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        d = squares(x, c)
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for empty in np.flatnonzero(n == 0):
            far = d[np.arange(len(x)), own].argmax()
            c[empty], own[far] = x[far], empty
            d[far] = 0
    return c


def walk(a: np.ndarray, b: np.ndarray, sizes: dict[int, int], enough: int) -> list[int]:
    """Cells i * len(b) + j by a[i] + b[j], the smallest first, until they hold ``enough`` vectors (a heap over two sorted lists)."""
    i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    x, y = a[i_order].tolist(), b[j_order].tolist()
    heap, seen, cells, held = [(x[0] + y[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(i_order[i]) * len(y) + int(j_order[j])
        if cell in sizes:
            cells.append(cell)
            held += sizes[cell]
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(x) and q < len(y) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (x[p] + y[q], p, q))
    return cells


def search(
    vectors: DataFrame, k: int = 5, every: int = 50, share: float = 0.6, sample: int = 20_000, side: int = 16,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows whose id is divisible by ``every``; ``side`` centroids per half, fitted on at most about ``sample`` rows."""
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("emb"))
    given = given.filter(usable(F.col("emb")) & F.col("vec_id").isNotNull())
    counts = dict(given.groupBy(F.size("emb").alias("d")).count().collect())
    if not counts:
        return spark.createDataFrame([], schema)
    lengths = sorted(counts)
    each = max(sample // len(lengths), 4 * side)  # sampled vectors of a length
    rates = F.map_from_arrays(F.array(*map(F.lit, lengths)), F.array(*[F.lit(each / counts[d]) for d in lengths]))
    drawn = given.filter(chance(3, F.col("vec_id")) < F.element_at(rates, F.size("emb"))).select("emb").orderBy(F.xxhash64("emb"))
    seen: dict[int, list] = {d: [] for d in lengths}
    for (emb,) in drawn.limit(2 * each * len(lengths)).collect():
        seen[len(emb)].append(emb)
    fits: dict[int, tuple[int, int, list[np.ndarray]]] = {}  # length: its number, where it is cut, centroids of both parts
    for place, d in enumerate(lengths):
        found = seen[d] or [r[0] for r in given.filter(F.size("emb") == d).select("emb").orderBy("vec_id").limit(side).collect()]
        x, h = unit(np.array(found, np.float64)), (d + 1) // 2
        fits[d] = place, h, [centroids(x[:, :h], side), centroids(x[:, h:], side) if d > h else np.zeros((1, 0))]

    def distances(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, h, halves = fits[v.shape[1]]
        u = unit(v)
        return squares(u[:, :h], halves[0]), squares(u[:, h:], halves[1])

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def by_length(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int]]:
        """Rows of one length, their vectors, and the first cell of the length."""
        for batch in batches:
            size = pc.list_value_length(batch.column("emb"))
            for d in pc.unique(size).to_pylist():
                part = batch.filter(pc.equal(size, d))
                yield part, matrix(part.column("emb")), fits[d][0] * side * side

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, first in by_length(batches):
            a, b = distances(v)
            cell = first + a.argmin(1) * b.shape[1] + b.argmin(1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], names=["vec_id", "emb", "cell"])

    indexed = stored(given.mapInArrow(assign, "vec_id bigint, emb array<double>, cell int"))
    distinct = F.count_distinct(F.xxhash64("emb"))
    held: dict[int, dict[int, int]] = {}  # by length's first cell; at most side * side cells each, copies count once
    for c, m in indexed.groupBy("cell").agg(distinct).collect():
        held.setdefault(c - c % (side * side), {})[c % (side * side)] = m
    enough = {first: max(int(np.ceil(share * sum(m.values()))), k) for first, m in held.items()}

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, first in by_length(batches):
            a, b = distances(v)
            own = part.column("own").to_numpy()  # vectors that carry the query's id are no candidates
            walks = [walk(a[i], b[i], held[first], enough[first] + int(own[i])) for i in range(part.num_rows)]
            rows = pa.array(np.repeat(np.arange(part.num_rows), [len(w) for w in walks]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(rows), part.column("emb").take(rows), pa.array([first + c for w in walks for c in w], pa.int32())],
                names=["vec_id", "emb", "cell"])

    def chunked(rows: DataFrame, name: str) -> DataFrame:
        parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_parts"))
        salted = rows.join(parts, "cell").withColumn("_chunk", F.pmod(F.xxhash64("vec_id", "emb"), F.col("_parts")))
        return salted.groupBy("cell", "_chunk").agg(F.collect_list(F.struct("vec_id", "emb")).alias(name)).drop("_chunk")

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for r in range(batch.num_rows):
                ask, have = batch.column("queries")[r].values, batch.column("entries")[r].values
                q, v = matrix(ask.field("emb")), matrix(have.field("emb"))
                q, v = q / np.abs(q).max(1, keepdims=True), v / np.abs(v).max(1, keepdims=True)
                q_len, v_len = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
                q_ids, v_ids = ask.field("vec_id").to_numpy(), have.field("vec_id").to_numpy()
                scores = (q @ v.T) / q_len[:, None] / v_len[None, :]
                scores[q_ids[:, None] == v_ids[None, :]] = -2
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(q), -2.0)
                for i in range(len(q)):
                    best = np.flatnonzero((scores[i] >= least[i] - 1e-9) & (scores[i] > -1.5))
                    exact = (q[i][None, :] * v[best]).sum(1) / (q_len[i] * v_len[best])
                    for at in np.lexsort((v_ids[best], -exact))[:k]:
                        out.append((int(q_ids[i]), int(v_ids[best][at]), float(exact[at])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())],
                names=["query_id", "vec_id", "score"])

    queries = indexed.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "emb")
    asked = queries.join(queries.groupBy("vec_id").agg(distinct.alias("own")), "vec_id").mapInArrow(probe, "vec_id bigint, emb array<double>, cell int")
    met = chunked(asked, "queries").join(chunked(indexed, "entries"), "cell")
    best = met.select("queries", "entries").mapInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
