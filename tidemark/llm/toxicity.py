"""Toxicity with a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams (orders ``ORDERS``) that occur in the lower-cased text, runs of white space as one blank. On a
bounded sample of labelled texts each bucket gets its log-count ratio r between toxic and other texts; the buckets whose r is most
certain (r over its standard error) are kept, and a logistic regression is fitted on the present buckets' r. A score sums weight times r
over a text's distinct buckets. The intercept is set to equal shares of both kinds, so a score over 0.5 means that the text speaks for toxic, however rare that is.

Null and empty texts have no feature and score the intercept. Without labels of both kinds every score is the share of toxic labels (0 without labels). Rows are
scored one by one, so repeated rows and null ids need no care.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import by_bytes, chance, mix, replaced, stored, texts_of

ORDERS = (3, 4, 5)
BUCKET_BITS = 18
SLICE = 1 << 19


def buckets_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a slice (with repeats), and the text of each."""
    lowered = [" " + " ".join(t.lower().split()) + " " for t in texts]
    codes = mix(np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    found, whose = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = codes[:len(codes) - n + 1].copy()
            for i in range(1, n):
                h = h * np.uint64(0x100000001B3) + codes[i:len(codes) - n + 1 + i]
            one = owner[:len(h)] == owner[n - 1:]
            found.append((mix(h[one]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            whose.append(owner[:len(h)][one])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


def present(texts: list[str], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs; ``number`` gives a bucket's feature or -1."""
    found, whose = buckets_of(texts)
    feature = number[found]
    held = feature >= 0
    width = int(number.max()) + 1 if len(number) else 0
    pairs = np.unique(whose[held] * max(width, 1) + feature[held])
    return pairs // max(width, 1), pairs % max(width, 1)


@dataclass
class Model:
    number: np.ndarray  # bucket -> feature or -1
    weights: np.ndarray  # per feature, log-count ratio included
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        text, feature = present(texts, self.number)
        z = self.intercept + np.bincount(text, weights=self.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def constant(share: float) -> Model:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Model(np.full(1 << BUCKET_BITS, -1), np.zeros(1), float(np.log(share / (1 - share))))


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = 8_000, features: int = 20_000, alpha: float = 1.0, ridge: float = 0.002, seed: int = 9,
) -> Model:
    """Learn from labelled rows where ``train`` (a condition on ``labels``) holds; ``sample`` bounds the rows in use (about, half of each kind)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    known = labels.filter(train).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    n = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if not n.get(0) or not n.get(1):
        return constant(n.get(1, 0) / max(sum(n.values()), 1))
    rate = F.when(F.col("_y") == 1, min(1.0, sample / 2 / n[1])).otherwise(min(1.0, sample / 2 / n[0]))
    few = known.filter(chance(seed, F.col("_id")) < rate).dropDuplicates(["_id"])  # about `sample` rows
    named = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = stored(named.join(F.broadcast(few), "_id").select("_y", "text"))

    def frequency(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        every = np.arange(1 << BUCKET_BITS)
        for batch in by_bytes(batches, "text", SLICE):
            y = batch.column("_y").to_numpy()
            text, feature = present(texts_of(batch, "text"), every)
            for kind in (0, 1):
                total[kind] += np.bincount(feature[y[text] == kind], minlength=1 << BUCKET_BITS)
        hit = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[0][hit]), pa.array(total[1][hit])], names=["bucket", "n0", "n1"])

    df = np.zeros((2, 1 << BUCKET_BITS))
    counted = chosen.mapInArrow(frequency, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0"), F.sum("n1"))
    for bucket, n0, n1 in counted.collect():  # at most 2^18 rows
        df[:, bucket] = n0, n1
    smooth = df + alpha
    kinds = {r[0]: r[1] for r in chosen.groupBy("_y").count().collect()}
    if not kinds.get(0) or not kinds.get(1):
        return constant(n[1] / (n[0] + n[1]))
    ratio = np.log(smooth[1] / (kinds[1] + 2 * alpha)) - np.log(smooth[0] / (kinds[0] + 2 * alpha))
    certain = np.abs(ratio) / np.sqrt(1 / smooth[0] + 1 / smooth[1])
    certain[df.sum(0) < 2] = 0
    best = np.argsort(-certain, kind="stable")[:features]
    best = best[certain[best] > 0]
    if not len(best):
        return constant(n[1] / (n[0] + n[1]))
    number = np.full(1 << BUCKET_BITS, -1)
    number[best] = np.arange(len(best))
    r, width = ratio[best], len(best)
    shipped = docs.sparkSession.sparkContext.broadcast(number)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            text, feature = present(texts_of(batch, "text"), shipped.value)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_y").cast(pa.float64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))], names=["label", "at"])

    vector = F.udf(lambda at: Vectors.sparse(width, at, [float(r[i]) for i in at]), VectorUDT())  # on the bounded sample only
    data = stored(chosen.mapInArrow(rows, "label double, at array<int>")).select("label", vector("at").alias("features"))
    fitted = LogisticRegression(maxIter=60, regParam=ridge, standardization=False, aggregationDepth=2).fit(data)
    back = -np.log(kinds[1] / kinds[0])
    return Model(number, fitted.coefficients.toArray() * r, float(fitted.intercept + back))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score in 0..1 (an existing column of that name is replaced); one pass, no shuffle."""
    rest, kept, schema = replaced(docs, text_col, "_text", **{out_col: "double"})
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_text", SLICE):
            found = pa.array(shipped.value.scores(texts_of(batch, "_text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], found], names=[*kept, out_col])

    return rest.mapInArrow(run, schema)
