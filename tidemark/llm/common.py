"""What several operators share: byte-bounded Arrow slices, stored tables, bounded samples and hashing of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructType

from tidemark.session import ensure_checkpoint_dir

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Compressed and column-wise, so wide or binary rows cost less there than a checkpoint.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice have about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        cuts = np.flatnonzero(np.diff((ends - sizes) // limit)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a slice, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def replaced(docs: DataFrame, source: str, held: str, **columns: str) -> tuple[DataFrame, list[str], StructType]:
    """Input, kept names and output schema of a pass over Arrow batches that adds ``columns`` (name to type) and drops older ones of these names.

    The input has the kept columns and, last, ``source`` under the name ``held``.
    """
    kept = [c for c in docs.columns if c not in columns]
    rest = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias(held))
    schema = StructType(rest.schema.fields[:-1])
    for name, kind in columns.items():
        schema = schema.add(name, DataType.fromDDL(kind))
    return rest, kept, schema


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys evenly (multiply and fold, twice)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * GOLDEN
        return (h ^ (h >> np.uint64(29))) * GOLDEN


def chance(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the values of ``columns`` alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, few: int = 4096) -> float | None:
    """The ``k``-th largest value of a double column, by counting ever narrower bins; no row but the last few leaves the executors."""
    if k <= 0:
        return None
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n <= k:
        return lo
    above = 0
    while True:
        inside = df.filter(F.col(column).between(lo, hi))
        width = (hi - lo) / bins
        if width <= abs(hi) * 1e-15 or inside.count() <= few:
            values = inside.groupBy(column).count().orderBy(F.desc(column)).limit(few).collect()
            for value, times in values:
                above += times
                if above >= k:
                    return value
            return lo
        place = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / width))
        found = inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for _, times, low, high in sorted(found.collect(), key=lambda r: -r[0]):
            if above + times >= k:
                lo, hi = low, high
                break
            above += times


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are no white space) of a slice: the joined bytes, starts, ends, and the text of each word."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    solid = (joined != 32) & ((joined < 9) | (joined > 13))
    edge = np.diff(np.concatenate(([False], solid, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return joined, starts, ends, np.searchsorted(np.cumsum(lengths), starts, side="right")


BASE = 0x100000001B3
SIGNS = mix(np.arange(1, 257, dtype=np.uint64))
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base and of its inverse modulo 2^64; kept for the next call."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, base, np.uint64))), dtype=np.uint64)
    return _powers[0][:n], _powers[1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit polynomial hash of every span of bytes; equal spans have equal hashes wherever they lie. Spans ascend.

    Some ``step`` bytes at a time are spread to 64 bits (more only for one span that is longer).
    """
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        low = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, low + step, side="right")))
        part = codes[low:int(ends[b - 1])]
        up, down = powers(len(part))
        with np.errstate(over="ignore"):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(SIGNS[part] * up, dtype=np.uint64)))
            first, last = starts[a:b] - low, ends[a:b] - low
            out[a:b] = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        a = b
    return out
