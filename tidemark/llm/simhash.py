"""SimHash near-duplicates by segment popcounts.

A fingerprint has one bit for each of 64 hash bits: whether over half of the document's shingles set it. Two
fingerprints within ``BITS`` = 3 bits agree in one of their halves up to 1 bit (3 bits on two halves leave one at
most on one of them). Each half of 32 bits is mapped to its counts of set bits in 16 segments; the Manhattan
distance of two such vectors is never larger than the number of differing bits. So a unit grid on these vectors
is joined with all its cells at Manhattan distance 0 and 1, and what meets is verified on the bits themselves.
Of two neighbours at distance 1 the one with an even number of set bits visits the other.

Equal fingerprints are one class and are compared once. Null and empty texts have fingerprint zero, linked like
any other; texts shorter than a shingle hash their whole sequence. Null ids are carried and never name a component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import by_bytes, stored, texts_of
from tidemark.llm.pairs import groups, roots, tiles
from tidemark.session import cut

BITS = 3
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest as hashed

    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    spans = [words[i:] for i in range(shingle)]
    found = [hashed(s, seed) for s in map(b" ".join, zip(*spans))] or [hashed(b" ".join(words), seed)]
    bits = np.unpackbits(np.array(found, ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(found)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per row; one pass, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            found = pa.array([fingerprint(t) for t in texts_of(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


def counts_of(half: Column) -> Column:
    """Set bits of each of the 16 two-bit segments of a half, packed as two bits each."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555).cast("long"))


def cells(fps: DataFrame) -> DataFrame:
    """(half, cell, visitor, fp): the own cell of each half, and for even ones all cells one step away."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.array(*[F.struct(F.lit(i).alias("half"), h.alias("bits")) for i, h in enumerate((low, high))])
    each = fps.select("fp", F.explode(halves).alias("h")).select(
        "fp", F.col("h.half").alias("half"), counts_of(F.col("h.bits")).alias("cell"), (F.bit_count("h.bits") % 2 == 0).alias("even"))
    steps = []
    for i in range(16):
        count = F.shiftright("cell", 2 * i).bitwiseAND(F.lit(3).cast("long"))
        steps += [F.when(count < 2, F.col("cell") + F.lit(1 << 2 * i)), F.when(count > 0, F.col("cell") - F.lit(1 << 2 * i))]
    visits = each.filter("even").select("fp", "half", F.explode(F.array_compact(F.array(*steps))).alias("cell"))
    own = each.select("half", "cell", F.lit(False).alias("visitor"), "fp")
    # most steps lead to empty cells: visits are kept only where someone lives
    lived = visits.join(own.select("half", "cell").distinct(), ["half", "cell"], "left_semi")
    return own.unionByName(lived.select("half", "cell", F.lit(True).alias("visitor"), "fp"))


def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a tile's members to the smallest fingerprint they reach in it."""
    for batch in batches:
        own = batch.column("self").to_pylist()
        rows = batch.column("rows")
        offsets = rows.offsets.to_numpy()
        flat = rows.values
        right_all = flat.field("right").to_numpy()
        fp_all = flat.field("ident").to_numpy()
        found_a, found_b = [], []
        for i, within in enumerate(own):
            fp, right = fp_all[offsets[i]:offsets[i + 1]], right_all[offsets[i]:offsets[i + 1]]
            bits = fp.view(np.uint64)
            near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= BITS
            if not within:
                near &= right[:, None] != right[None, :]
            if near.sum() > (len(fp) if within else 0):
                root = roots(near, fp)
                far = root != fp
                found_a.append(root[far])
                found_b.append(fp[far])
        a = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
        b = np.concatenate(found_b) if found_b else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components_of(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the fingerprints in ``marked`` (doc_id, fp): the smallest fingerprint reachable over links of at most
    3 bits, and the smallest doc_id among the rows of that component."""
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    met = tiles(cells(classes.select("fp")), ["half", "cell"], "fp", [])
    links = cut(met.select("self", "rows").mapInArrow(verified, "a bigint, b bigint").distinct())
    named = groups(links).withColumnsRenamed({"node": "fp"}).join(classes, "fp")
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    joined = classes.join(named.join(least, "root").select("fp", "root", "component"), "fp", "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row; the component is the smallest doc_id reachable over links of at most 3 bits."""
    marked = stored(fingerprints(docs, id_col, text_col))
    return marked.join(components_of(marked), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest id, then fingerprint, then hash of the text,
    then hash of all its columns (maps aside); rows without an id come last.

    Groups are those of the fingerprints, so rows that share an id but no text are judged apart. Of rows equal in everything one stays.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = pa.array([fingerprint(t or "") for t in part.column("row").field(text_col).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("row"), found], names=["row", "fp"])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = stored(whole.mapInArrow(run, StructType([*whole.schema.fields, StructField("fp", LongType())])).withColumn("nth", F.monotonically_increasing_id()))
    text, own = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`")
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.struct(own.isNull().alias("lacking"), own.alias("own"), "fp", F.xxhash64(text).alias("text"), F.xxhash64(*plain).alias("all"), "nth")
    roots = components_of(rows.select(own.alias("doc_id"), "fp")).select("fp", "root")
    first = rows.select("fp", order.alias("order")).join(roots, "fp").groupBy("root").agg(F.min("order").alias("least"))
    return rows.join(first.select(F.col("least.nth").alias("nth")), "nth", "left_semi").select("row.*")
