"""Spelling variants of a corpus' words: which words are one edit apart, and which frequent form a rare word belongs to.

Words are counted per slice of texts before anything is shuffled. Two words one insertion, deletion or replacement apart
share all but one of ``PARTS`` parts of the shorter one's length, counted from both ends: those before the edit stand at the
front of both, those behind it at their ends. Words meet in blocks of equal shared parts. A block of any size is cut into chunks,
and each pair of chunks is a tile of its own: two padded matrices of code points, one aligned at the front and one at the
end, give the common prefix and suffix of all pairs of the tile at once. Where both together reach the longer length minus one, a
single edit parts the words. A pair met in several blocks counts in the first. Tiles return one row per word, never pairs.

Null texts have no words; texts of a null id keep all letters; repeated rows count as often as they come. An empty table gives no
rows. Words of any length are kept; tiles shrink with the length. Only the two named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import by_bytes, stored

LEAST = 7
PARTS = 3
TILE = 256
LETTERS = "[A-Za-zÀ-ÿ]"
DROP = 31
HELD = 1 << 17
LOWER = {c: c + 32 for c in range(65, 91)}


def changed(prefix: int, run: str) -> str:
    """The lower-cased run, without one letter where the hash (continued from ``prefix``) says so."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DROP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words in the texts seen; handed on whenever ``HELD`` different ones are there."""
    # a run shorter than the least length cannot give a word
    runs = re.compile(f"{LETTERS}{{{LEAST},}}")
    counts: dict[str, int] = defaultdict(int)

    def told() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in by_bytes(batches, "text", 4 << 20):
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            own: dict[str, int] = defaultdict(int)
            for run in runs.findall(text or ""):
                own[run] += 1
            prefix = None if doc is None else zlib.crc32(f"{doc}:".encode())
            for run, times in own.items():
                run = run.lower() if run.isascii() else run.translate(LOWER)
                word = run if prefix is None else changed(prefix, run)
                if len(word) >= LEAST:
                    counts[word] += times
            if len(counts) >= HELD:
                yield told()
    yield told()


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """(word, n) of all words that occur ``least`` times or more."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    each = narrow.mapInArrow(counted, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def blocks(found: DataFrame, parts: int = PARTS) -> DataFrame:
    """(m, part, key, word, n): each word as the shorter (its length is m) and as the longer one of a pair, by what it shares if the edit lies in ``part``."""
    size = F.length("word")
    keys = []
    for less in (0, 1):
        m = size - less
        for q in range(parts):
            first, last = F.floor(m * q / parts).cast("int"), F.floor(m * (q + 1) / parts).cast("int")
            shared = F.concat(F.substring("word", F.lit(1), first), F.right("word", m - last))
            keys.append(F.when(m >= LEAST, F.struct(m.alias("m"), F.lit(q).alias("part"), F.xxhash64(shared).alias("key"))))
    return found.select("word", "n", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("k.*", "word", "n")


def tiles(keyed: DataFrame, tile: int = TILE) -> DataFrame:
    """(m, part, cross, rows): the chunks of a block in pairs; ``rows`` ascend by falling count and word and know their chunk's side."""
    own = ["m", "part", "key"]
    per = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(1 << 16) / F.col("m"))))
    sizes = keyed.groupBy(*own).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.length("word") == F.col("m"), 1)).alias("short")).filter("rows > 1 and short > 0").select(
        *own, F.ceil(F.col("rows") / per).cast("long").alias("chunks"))
    mine = F.pmod(F.xxhash64("word"), F.col("chunks"))
    spread = keyed.join(sizes, own).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    # a name of its own for each tile: tiles of one block need not meet in one task
    name = F.concat_ws(":", "m", "part", "key", F.least("mine", "other").cast("string"), F.greatest("mine", "other").cast("string"))
    row = F.struct((-F.col("n")).alias("fewer"), "word", (F.col("mine") > F.col("other")).alias("second"))
    return spread.groupBy(name.alias("tile")).agg(F.first("m").alias("m"), F.first("part").alias("part"), F.max(F.col("mine") != F.col("other")).alias("cross"), F.sort_array(F.collect_list(row)).alias("rows"))


def matrices(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, padded with 0: aligned at the front, and reversed."""
    steps = np.arange(width)
    inside = steps[None, :] < sizes[:, None]
    last = len(codes) - 1
    front = np.where(inside, codes[np.minimum(starts[:, None] + steps, last)], 0)
    back = np.where(inside, codes[np.maximum(starts[:, None] + sizes[:, None] - 1 - steps, 0)], 0)
    return front, back


def common(side: np.ndarray) -> np.ndarray:
    """Length of the common beginning of all pairs of rows; ``side`` is (tiles, rows, width). Padding differs between the two of a pair."""
    other = np.where(side == 0, np.uint32(1), side)
    return (side[:, :, None, :] == other[:, None, :, :]).argmin(axis=3)


def compared(front: np.ndarray, back: np.ndarray, sizes: np.ndarray, second: np.ndarray, cross: np.ndarray, m: int, part: int, parts: int = PARTS) -> np.ndarray:
    """Which pairs of each tile are one edit apart and belong to this part; ``sizes`` is 0 where a tile has no row."""
    prefix, suffix = common(front), common(back)
    longer = np.maximum(sizes[:, :, None], sizes[:, None, :])
    shorter = np.minimum(sizes[:, :, None], sizes[:, None, :])
    near = (prefix + suffix >= longer - 1) & (shorter == m) & (longer <= m + 1) & ~np.eye(sizes.shape[1], dtype=bool)[None]
    near &= ~cross[:, None, None] | (second[:, :, None] != second[:, None, :])
    for q in range(part + 1):
        shared = (prefix >= m * q // parts) & (suffix >= m - m * (q + 1) // parts)
        near &= shared if q == part else ~shared
    return near


def verified(batches: Iterable[pa.RecordBatch], parts: int = PARTS, slice_words: int = 1 << 15, cells: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """(word, n_near, fewer, form) of words with a near one in their tile; tiles of like size and length are compared together."""
    for batch in batches:
        offsets = batch.column("rows").offsets.to_numpy()
        flat = batch.column("rows").values
        ms, own_part = batch.column("m").to_numpy(), batch.column("part").to_numpy()
        crosses = batch.column("cross").to_numpy(zero_copy_only=False)
        marks = np.flatnonzero(np.diff((offsets[:-1] - offsets[0]) // slice_words)) + 1
        for a, b in zip([0, *marks.tolist()], [*marks.tolist(), batch.num_rows]):
            low, high = int(offsets[a]), int(offsets[b])
            if low == high:
                continue
            names = flat.field("word").slice(low, high - low).to_pylist()
            fewer = flat.field("fewer").slice(low, high - low).to_numpy()
            second = flat.field("second").slice(low, high - low).to_numpy(zero_copy_only=False)
            sizes = np.fromiter(map(len, names), np.int64, len(names))
            codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
            starts = np.cumsum(sizes) - sizes
            held = np.diff(offsets[a:b + 1])
            kinds = defaultdict(list)
            for t in range(b - a):
                kinds[int(ms[a + t]), int(own_part[a + t]), 1 << (int(held[t]) - 1).bit_length()].append(t)
            out_word, out_n, out_form = [], [], []
            for (m, part, c), found in kinds.items():
                step = max(1, cells // (c * c * (m + 1)))
                for i in range(0, len(found), step):
                    chosen = np.array(found[i:i + step])
                    places = (offsets[a + chosen] - low)[:, None] + np.arange(c)[None, :]
                    there = np.arange(c)[None, :] < held[chosen][:, None]
                    places = np.where(there, places, 0)
                    own = np.where(there, sizes[places], 0)
                    front, back = matrices(codes, starts[places].ravel(), own.ravel(), m + 1)
                    shape = (len(chosen), c, m + 1)
                    near = compared(front.reshape(shape), back.reshape(shape), own, second[places], crosses[a + chosen], m, part, parts)
                    many = near.sum(axis=2)
                    tile, row = np.nonzero(many)
                    out_word.append(places[tile, row])
                    out_n.append(many[tile, row])
                    out_form.append(places[tile, near[tile, row].argmax(axis=1)])  # rows ascend, so the first is the best
            at, best = np.concatenate(out_word), np.concatenate(out_form)
            yield pa.RecordBatch.from_arrays([
                pa.array([names[i] for i in at], pa.string()), pa.array(np.concatenate(out_n).astype(np.int64)),
                pa.array(fewer[best], pa.int64()), pa.array([names[i] for i in best], pa.string())], names=["word", "n_near", "fewer", "form"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of each chain. Counts grow tenfold along a chain, so doubling its steps ends after a few rounds."""
    known = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = stored(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if known.filter("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def near_words(found: DataFrame, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(word, n_near, form, form_n): the number of words one edit apart and the most frequent of them (ties: the first in code-point order)."""
    met = tiles(blocks(found, parts), tile).select("m", "part", "cross", "rows").mapInArrow(partial(verified, parts=parts), "word string, n_near bigint, fewer bigint, form string")
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("fewer", "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.fewer")).alias("form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 10, **settings) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word; a form is ``times`` as frequent as the word or more."""
    found = stored(words(docs, id_col, text_col))
    ruled: Column = F.col("form_n") >= times * F.col("n")
    placed = stored(found.join(near_words(found, **settings), "word", "left").select(
        "word", F.when(ruled, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ruled, F.col("form_n")).alias("form_n")))
    ends = roots(placed.filter("form is not null"))
    return placed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
