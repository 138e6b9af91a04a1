"""Quality by importance resampling.

Texts become n-grams: words, word pairs, and triples of word shapes (a shape keeps case pattern and punctuation of a
word; a word equal to the one before it has a shape of its own). N-grams are hashed to ``buckets`` and two generative
models counted: target (good labelled texts, a bounded sample) and raw (all texts). A text's importance is the mean over
its n-grams of log target over raw, drawn towards 0 for texts of few n-grams. Texts are drawn without replacement by Gumbel top-k: key = importance / temperature + Gumbel
noise, and the k largest keys are kept. k is the number of texts whose importance reaches the level that parts
good and bad labelled texts best, so what is kept follows the corpus, and the noise decides near that level only.

Null, empty and blank texts have no n-grams, importance null, and are not kept. Without labelled texts of both kinds
nothing can be told apart and all other texts are kept. Equal keys (repeated rows) are kept or left together. Rows with null ids are drawn like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_bytes, chance, kth_largest, mix, replaced, span_hashes, stored, words_of

SLICE = 1 << 19
PRIOR = 20
# what a byte counts as in a shape: lower case and bytes beyond ASCII, upper case, digit; others stand for themselves
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = 97
SHAPE[128:] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a slice, and the text of each."""
    joined, starts, ends, owner = words_of(texts)
    word = span_hashes(joined, starts, ends)
    shape = SHAPE[joined]
    fresh = np.concatenate(([True], shape[1:] != shape[:-1]))  # runs of one class are one sign
    place = np.cumsum(fresh) - 1
    runs = shape[fresh]
    form = span_hashes(runs, place[starts], place[ends - 1] + 1)
    one = np.concatenate(([False], owner[1:] == owner[:-1])) if len(owner) else np.empty(0, bool)
    again = one & np.concatenate(([False], word[1:] == word[:-1])) if len(word) else one
    form = np.where(again, np.uint64(61), form)
    two = one & np.concatenate(([False], one[:-1])) if len(one) else one
    with np.errstate(over="ignore"):
        pair = mix(word[1:] + mix(word[:-1] + np.uint64(1)))[one[1:]] if len(word) else word
        triple = mix(form[2:] + mix(form[1:-1] + mix(form[:-2] + np.uint64(2))))[two[2:]] if len(word) > 2 else word[:0]
    keys = np.concatenate((word, pair, triple))
    whose = np.concatenate((owner, owner[one], owner[two])) if len(owner) else owner
    return (keys % np.uint64(buckets)).astype(np.int64), whose


def bytes_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts per bucket over all rows of (text); each task adds up its own before anything is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in by_bytes(batches, "text", SLICE):
            total += np.bincount(features(bytes_of(batch.column("text")), buckets)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n  # at most `buckets` rows
    return out


@dataclass
class Model:
    ratio: np.ndarray
    level: float

    def importance(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio (NaN without n-grams), as if ``PRIOR`` n-grams more had ratio 1, and number of n-grams of each text."""
        found, whose = features(texts, len(self.ratio))
        n = np.bincount(whose, minlength=len(texts))
        sums = np.bincount(whose, weights=self.ratio[found], minlength=len(texts))
        return np.where(n > 0, sums / (n + PRIOR), np.nan), n


def level_between(good: np.ndarray, bad: np.ndarray) -> float:
    """The level with the best balanced accuracy, in the middle of the gap it lies in."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.concatenate((good, bad))
    order = np.argsort(values, kind="stable")
    values = values[order]
    is_good = (order < len(good))
    balance = np.concatenate(([0.0], np.cumsum(np.where(is_good, -1 / len(good), 1 / len(bad)))))
    ends = np.concatenate((values[1:] != values[:-1], [True]))
    allowed = np.concatenate(([True], ends))
    at = int(np.argmax(np.where(allowed, balance, -np.inf)))
    if at == 0:
        return -np.inf
    return float((values[at - 1] + values[at]) / 2) if at < len(values) else float(values[-1])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    buckets: int = 10_000, sample: int = 10_000, smoothing: float = 1.0, prior: float = 5.0, seed: int = 3,
) -> Model:
    """Target and raw models; ``sample`` bounds the labelled rows in use (about), raw counts cover every row.

    The target model is drawn towards the raw one as by ``prior`` n-grams a bucket, so buckets that few good texts reach say little.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    n = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    rate = F.when(F.col("_y") == 1, min(1.0, sample / 2 / max(n.get(1, 0), 1))).otherwise(min(1.0, sample / 2 / max(n.get(0, 0), 1)))
    few = known.filter(chance(seed, F.col("_id")) < rate).dropDuplicates(["_id"])  # about `sample` rows
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    chosen = stored(named.join(F.broadcast(few), "_id").select("_y", "text"))
    raw = bucket_counts(named.select("text"), buckets) + smoothing
    target = bucket_counts(chosen.filter("_y = 1").select("text"), buckets) + prior * buckets * raw / raw.sum()
    model = Model(np.log(target / target.sum()) - np.log(raw / raw.sum()), -np.inf)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(shipped.value.importance(bytes_of(batch.column("text")))[0])], names=["_y", "w"])

    seen = [(y, w) for y, w in chosen.mapInArrow(run, "_y int, w double").collect() if w == w]
    model.level = level_between(np.array([w for y, w in seen if y == 1]), np.array([w for y, w in seen if y == 0]))
    return model


def weighed(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``importance`` and ``n_grams``; one pass, no shuffle."""
    new = ("importance", "n_grams")
    rest, kept, schema = replaced(docs, text_col, "_text", **dict(zip(new, ("double", "bigint"))))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_text", SLICE):
            w, n = shipped.value.importance(bytes_of(batch.column("_text")))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(w, mask=np.isnan(w)), pa.array(n.astype(np.int64))], names=[*kept, *new])

    return rest.mapInArrow(run, schema)


def keyed(weights: DataFrame, id_col: str, temperature: float, seed: int) -> DataFrame:
    """Add ``gumbel_key``; the noise depends on the id alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return weights.withColumn("gumbel_key", F.col("importance") / temperature - F.log(-F.log(u)))


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", temperature: float = 0.002, seed: int = 17, **settings,
) -> tuple[DataFrame, float | None]:
    """(docs with ``importance``, ``n_grams``, ``gumbel_key`` and ``selected``; the smallest key kept)."""
    model = fit(docs, labels, id_col, text_col, **settings)
    scored = keyed(weighed(docs, model, text_col), id_col, temperature, seed)
    narrow = stored(scored.select("importance", "gumbel_key"))
    k = narrow.filter(F.col("importance") >= F.lit(model.level)).count()
    least = kth_largest(narrow, "gumbel_key", k)
    chosen = F.lit(False) if least is None else F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False))
    return scored.withColumn("selected", chosen), least
