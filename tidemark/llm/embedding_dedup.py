"""Near-duplicate embeddings by a subspace pigeonhole join.

Vectors are brought to length one and turned by a fixed random rotation, then split into ``blocks`` subspaces. Cosine
c means a squared distance of 2 - 2c, and the subspaces' squared distances add up to it, so a pair that
is near enough has at least one subspace whose share is within its proportional part of that budget. In each subspace a
grid over its first ``grid`` coordinates, as wide as the subspace's radius, joins each vector with its own cell and the
neighbour cells that its ball reaches (one of two neighbour cells visits the other). What is within the subspace's budget is verified on the original
vectors in double precision, and counted in the first such subspace only, so each pair counts once.

Equal vectors of one label are one class. Vectors that are null, empty, zero or hold null or non-finite components, and
vectors without a label, link with nothing. Vectors of different length never link. Rows with null ids are carried and
count as partners; they never name a component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import stored
from tidemark.llm.pairs import groups, roots, tiles
from tidemark.session import cut

SLACK = 1e-5  # rotated coordinates are kept in single precision


def usable(vector: Column) -> Column:
    """A vector with at least one component, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def bounds(d: int, blocks: int) -> list[tuple[int, int]]:
    """First and last + 1 coordinate of each subspace."""
    blocks = max(1, min(blocks, d))
    return [(d * i // blocks, d * (i + 1) // blocks) for i in range(blocks)]


def placed(classes: DataFrame, threshold: float, blocks: int, grid: int) -> DataFrame:
    """(label, dim, block, cell, visitor, vec, emb, rot, size): every class in its own cell of each subspace and as a visitor in those its ball reaches."""
    budget = 2 - 2 * threshold

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                vectors = part.column("emb").to_pylist()
                out: dict[str, list] = {"row": [], "block": [], "cell": [], "visitor": []}
                turned = []
                for row, v in enumerate(vectors):
                    x = np.array(v, np.float64)
                    x = (x / np.abs(x).max())
                    turned.append(((x / np.linalg.norm(x)) @ rotations.setdefault(len(x), rotation(len(x)))).astype(np.float32))
                    for b, (first, last) in enumerate(bounds(len(x), blocks)):
                        radius = np.sqrt(max(budget, 0.0) * (last - first) / len(x)) + SLACK
                        y = turned[-1][first:min(last, first + grid)].astype(np.float64)
                        home = np.floor(y / radius).astype(int)
                        low = y - home * radius
                        steps = [()]
                        gaps = [0.0]
                        for o in low:
                            more = [(s + (k,), g + c * c) for s, g in zip(steps, gaps) for k, c in ((0, 0.0), (-1, o), (1, radius - o))]
                            steps = [s for s, g in more if g <= (radius + SLACK) ** 2]
                            gaps = [g for _, g in more if g <= (radius + SLACK) ** 2]
                        for s in steps:
                            if not any(s) or s > (0,) * len(s):  # of two neighbour cells the lower visits the higher
                                out["row"].append(row)
                                out["block"].append(b)
                                out["cell"].append(",".join(map(str, home + np.array(s, int))))
                                out["visitor"].append(any(s))
                rows = pa.array(out["row"], pa.int64())
                columns = [part.column(c).take(rows) for c in ("label", "vec", "size", "emb")]
                rot = pa.array(turned, pa.list_(pa.float32())).take(rows)
                dim = pa.array([len(vectors[r]) for r in out["row"]], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*columns, rot, dim, pa.array(out["block"], pa.int32()), pa.array(out["cell"], pa.string()), pa.array(out["visitor"], pa.bool_())],
                    names=["label", "vec", "size", "emb", "rot", "dim", "block", "cell", "visitor"])

    rotations: dict[int, np.ndarray] = {}
    kind = classes.schema["label"].dataType.simpleString()
    emb = classes.schema["emb"].dataType.simpleString()
    return classes.mapInArrow(run, f"label {kind}, vec bigint, size bigint, emb {emb}, rot array<float>, dim int, block int, cell string, visitor boolean")


def verify(threshold: float, blocks: int):
    """Per member of a tile: how many other vectors it links with there, and the smallest class it reaches."""
    budget = 2 - 2 * threshold

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for tile in range(batch.num_rows):
                rows = batch.column("rows")[tile].values
                d, b = batch.column("dim")[tile].as_py(), batch.column("block")[tile].as_py()
                vec = rows.field("ident").to_numpy()
                right = rows.field("right").to_numpy()
                rot = rows.field("rot").flatten().to_numpy().reshape(-1, d).astype(np.float64)
                spans = bounds(d, blocks)
                limits = np.array([max(budget, 0.0) * (q - p) / d + SLACK for p, q in spans])
                y = rot[:, spans[b][0]:spans[b][1]]
                norms = (y * y).sum(1)
                within = norms[:, None] + norms[None, :] - 2 * (y @ y.T) <= limits[b] + SLACK
                within &= np.triu(np.ones(within.shape, bool), 1)
                if not batch.column("self")[tile].as_py():
                    within &= right[:, None] != right[None, :]
                i, j = np.nonzero(within)
                if not len(i):
                    continue
                emb = rows.field("emb").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
                emb = emb / np.abs(emb).max(1, keepdims=True)
                lengths = np.sqrt((emb * emb).sum(1))
                near = np.zeros(within.shape, bool)
                for at in range(0, len(i), 8192):
                    p, q = i[at:at + 8192], j[at:at + 8192]
                    gap = (rot[p] - rot[q]) ** 2
                    first = np.argmax(np.stack([gap[:, a:z].sum(1) for a, z in spans], 1) <= limits, axis=1)
                    inside = gap[:, spans[b][0]:spans[b][1]].sum(1) <= limits[b]
                    cosine = (emb[p] * emb[q]).sum(1) / (lengths[p] * lengths[q])
                    keep = inside & (first == b) & (cosine >= threshold)
                    near[p[keep], q[keep]] = True
                near |= near.T
                links = near @ rows.field("size").to_numpy()
                root = roots(near, vec)
                has = links > 0
                found += zip(vec[has].tolist(), root[has].tolist(), links[has].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["vec", "root", "links"])

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    blocks: int = 4, grid: int = 2,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: partners of equal label with cosine >= ``threshold``, and the smallest id reachable."""
    given = stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("emb"), F.col(label_col).alias("label"))
                   .withColumn("good", usable(F.col("emb")) & F.col("label").isNotNull()))
    good = given.filter("good")
    # a class is named by a hash of its content, so that null ids matter nowhere before the end
    classes = stored(good.groupBy("label", "emb").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first"))
                     .withColumn("vec", F.xxhash64("label", "emb")))
    met = tiles(placed(classes.select("label", "vec", "size", "emb"), threshold, blocks, grid), ["label", "dim", "block", "cell"], "vec", ["emb", "rot", "size"])
    links = cut(met.select("dim", "block", "self", "rows").mapInArrow(verify(threshold, blocks), "vec bigint, root bigint, links bigint"))
    counted = links.groupBy("vec").agg(F.sum("links").alias("links"))
    named = groups(links.filter("vec != root").select(F.col("vec").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "vec")
    firsts = named.join(classes.select("vec", "first"), "vec")
    least = firsts.groupBy("root").agg(F.min("first").alias("component"))
    known = (
        classes.join(counted, "vec", "left").join(firsts.join(least, "root").select("vec", "component"), "vec", "left")
        .select("label", "emb", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    )
    linked = good.join(known, ["label", "emb"]).select("vec_id", "n_links", "component_id")
    alone = given.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
