"""Language identification with interpolated Kneser-Ney character models.

One model per language over lower-cased letters, all else a blank, runs of blanks one blank. The highest order uses
counts, lower orders count different left neighbours, each order discounts by n1 / (n1 + 2 n2). N-grams of up to four
16-bit characters are hashed to 64-bit keys; per order one sorted array of keys holds the probabilities of all languages, so
a text is scored for every language with one binary search per character (further ones only where an n-gram is unknown).
The language with the lowest cross-entropy per character wins. It is rejected if that
entropy lies more than ``z`` deviations, and by half or more, above what texts of this language had that were not used for fitting.

Counts come from a bounded sample (``chars`` characters over all languages, rows chosen by a hash); the models are thus
of bounded size. Null texts and texts without a letter are ``und``, score 0, rejected. If nothing can be learned every
text is ``und``. Rows are carried one by one, so repeated rows and null ids need no care.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import by_bytes, chance, mix, replaced, stored, texts_of

ORDER = 4
PAD, BLANK = 0xFFFF, 32
LEAST_EXCESS = 0.5


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every 16-bit code the code itself if it is a letter, else a blank; code 0xFFFE stands for all letters beyond."""
    table = np.full(0x10000, BLANK, np.uint64)
    for code in range(0xD800):
        if chr(code).isalpha():
            table[code] = code
    for code in range(0xE000, 0xFFFD):
        if chr(code).isalpha():
            table[code] = code
    return table


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each after ``ORDER - 1`` pads, and the number of the text of each code."""
    lowered = [t.lower() for t in texts]
    raw = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    beyond = raw > 0xFFFF
    codes = letters()[np.where(beyond, 0, raw)]
    if beyond.any():
        far = np.flatnonzero(beyond)
        codes[far] = [0xFFFE if chr(c).isalpha() else BLANK for c in raw[far].tolist()]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    same = np.concatenate(([False], owner[1:] == owner[:-1])) if len(owner) else np.empty(0, bool)
    before = np.concatenate(([BLANK], codes[:-1])) if len(codes) else codes
    keep = (codes != BLANK) | ((before != BLANK) & same)
    codes, owner = codes[keep], owner[keep]
    gap = ORDER - 1
    shift = (owner + 1) * gap
    padded = np.full(len(codes) + gap * len(texts), PAD, np.uint64)
    whose = np.full(len(padded), -1)
    at = np.arange(len(codes)) + shift
    padded[at], whose[at] = codes, owner
    return padded, whose


def grams(codes: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each place, packed 16 bits a character, the last one lowest."""
    packed = codes.copy()
    for back in range(1, order):
        packed[back:] |= codes[:-back] << np.uint64(16 * back)
    return packed


def counted(texts: DataFrame) -> pa.Table:
    """(label, gram, n, part): packed highest-order n-grams of each language, counted over all rows of a bounded sample and over those
    with ``own``. Numbers alone come to the driver, as Arrow columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            names, owned = batch.column("label").to_pylist(), batch.column("own").to_pylist()
            texts_here = texts_of(batch, "text")
            for name in sorted(set(names)):
                rows = [i for i, l in enumerate(names) if l == name]
                codes, owner = codes_of([texts_here[i] for i in rows])
                held = owner >= 0
                keys, at = np.unique(grams(codes, ORDER)[held], return_inverse=True)
                part = np.array([owned[i] for i in rows], bool)[owner[held]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64)),
                     pa.array(np.bincount(at, weights=part, minlength=len(keys)).astype(np.int64))], names=["label", "gram", "n", "part"])

    found = texts.mapInArrow(run, "label string, gram bigint, n bigint, part bigint").groupBy("label", "gram").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))
    return found.toArrow()


class Model:
    """Sorted hash arrays of one joint table per order, and what calibrates rejection."""

    def __init__(self, labels: pa.ChunkedArray | pa.Array, packed: np.ndarray, times: np.ndarray):
        coded = pc.dictionary_encode(labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels)
        given = coded.dictionary.to_pylist()
        self.names = sorted(given)
        number = np.array([self.names.index(name) for name in given], np.int64)
        L = max(1, len(self.names))
        raw = packed.view(np.uint64)
        tables, counts = [None] * (ORDER + 1), [None] * (ORDER + 1)
        tables[ORDER], at = np.unique(raw, return_inverse=True)
        counts[ORDER] = np.zeros((len(tables[ORDER]), L))
        if len(raw):
            np.add.at(counts[ORDER], (at, number[coded.indices.to_numpy()]), times)
        for n in range(ORDER - 1, 0, -1):  # different left neighbours
            tables[n], at = np.unique(tables[n + 1] & np.uint64((1 << 16 * n) - 1), return_inverse=True)
            counts[n] = np.zeros((len(tables[n]), L))
            np.add.at(counts[n], at, counts[n + 1] > 0)
        self.keys, self.logs, self.ctx, self.back = [], [], [], []
        below = None
        for n in range(1, ORDER + 1):
            c = counts[n]
            once, twice = (c == 1).sum(0), (c == 2).sum(0)
            discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
            head, at = np.unique(tables[n] >> np.uint64(16), return_inverse=True)
            total, kinds = np.zeros((len(head), L)), np.zeros((len(head), L))
            np.add.at(total, at, c)
            np.add.at(kinds, at, c > 0)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            lower = 1.0 / (len(tables[1]) + 1) if n == 1 else below[np.searchsorted(tables[n - 1], tables[n] & np.uint64((1 << 16 * (n - 1)) - 1))]
            below = np.maximum(c - discount, 0) / np.maximum(total[at], 1) + weight[at] * lower
            for keys, values, to_keys, to_values in ((tables[n], below, self.keys, self.logs), (head, weight, self.ctx, self.back)):
                hashed = mix(keys + np.uint64(n))
                order = np.argsort(hashed)
                to_keys.append(hashed[order])
                to_values.append(np.log(np.maximum(values[order], 1e-12)).astype(np.float32))
        self.unknown = np.float32(np.log(1.0 / (len(tables[1]) + 1)))
        self.center = np.full(L, np.inf)
        self.near = np.zeros(L)
        self.far = np.zeros(L)

    @staticmethod
    def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, wanted), max(len(sorted_keys) - 1, 0))
        return at, sorted_keys[at] == wanted

    def logs_at(self, packed: np.ndarray, n: int) -> np.ndarray:
        """Log probability of the last character of each n-gram, one column a language."""
        if n == 0:
            return np.full((len(packed), len(self.names)), self.unknown, np.float32)
        at, known = self.find(self.keys[n - 1], mix(packed + np.uint64(n)))
        out = self.logs[n - 1][at]
        miss = np.flatnonzero(~known)
        if len(miss):
            lacking = packed[miss]
            where, seen = self.find(self.ctx[n - 1], mix((lacking >> np.uint64(16)) + np.uint64(n)))
            back = np.where(seen[:, None], self.back[n - 1][where], np.float32(0))
            out[miss] = back + self.logs_at(lacking & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character for every text and language, and the texts' numbers of letters and blanks (0 without a letter)."""
        codes, owner = codes_of(texts)
        held = owner >= 0
        packed, owner, codes = grams(codes, ORDER)[held], owner[held], codes[held]
        n = np.bincount(owner, minlength=len(texts))
        sums = np.zeros((len(texts), len(self.names)))
        if len(owner):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sums[owner[starts]] = np.add.reduceat(self.logs_at(packed, ORDER), starts, axis=0, dtype=np.float64)
        has = np.bincount(owner, weights=codes != BLANK, minlength=len(texts)) > 0
        return -sums / np.maximum(n, 1)[:, None], np.where(has, n, 0)

    def calibrate(self, rows: list[tuple[str, float, int]]) -> None:
        """(language, entropy, length) of texts outside the fit: their mean, and deviations for short and for long texts."""
        for i, name in enumerate(self.names):
            e = np.array([r[1] for r in rows if r[0] == name])
            n = np.array([r[2] for r in rows if r[0] == name], float)
            if not len(e):
                continue
            self.center[i] = np.average(e, weights=np.minimum(n, 1000))
            self.near[i] = np.sqrt(np.mean(np.minimum(n, 200) * (e - self.center[i]) ** 2))
            self.far[i] = np.sqrt(np.mean((e - self.center[i]) ** 2))

    def decide(self, texts: list[str], z: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, entropy and rejection of each text."""
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        e, n = self.entropies(texts)
        best = e.argmin(1)
        low = e[np.arange(len(texts)), best]
        chances = np.exp(-(e - low[:, None]) * np.minimum(n, 50)[:, None])
        score = np.where(n > 0, 1 / chances.sum(1), 0.0)
        spread = z * np.maximum(self.far[best], self.near[best] / np.sqrt(np.maximum(n, 1)))
        limit = self.center[best] + np.maximum(spread, LEAST_EXCESS * self.center[best])
        names = [self.names[b] if m else "und" for b, m in zip(best.tolist(), n.tolist())]
        return names, score, np.where(n > 0, low, 0.0), (n == 0) | (low > limit)


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", chars: int = 12_000_000, seed: int = 1) -> Model:
    """Models of the languages of the rows where ``train`` holds, from about ``chars`` characters of their texts, the same share for each language;
    a language that has fewer gives all it has, so none is left out.

    Rejection is calibrated by cross-fitting: a second model of two thirds of these texts says how unlike its language a text it has not seen is.
    A language whose texts all fall on one side (one text, or copies of it) is calibrated on the texts of the fit.
    """
    narrow = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("label"), chance(seed, F.col(text_col)).alias("_u"), train.alias("_train"))
    narrow = narrow.filter("_train and label is not null and text is not null")
    totals = {r[0]: r[1] for r in narrow.groupBy("label").agg(F.sum(F.length("text").cast("long"))).collect()}
    if not totals:
        return Model(pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64))
    each = chars / len(totals)
    share = F.create_map(*[F.lit(x) for name, n in totals.items() for x in (name, min(1.0, each / max(n, 1)))])[F.col("label")]
    sample = stored(narrow.filter(F.col("_u") < share).select("label", "text", (F.col("_u") < share * (2 / 3)).alias("own")))
    rows = counted(sample)
    packed, part = rows.column("gram").to_numpy(), rows.column("part").to_numpy()
    model = Model(rows.column("label"), packed, rows.column("n").to_numpy())
    seen = part > 0
    crossed = Model(rows.column("label").combine_chunks().filter(pa.array(seen)) if len(seen) else pa.array([], pa.string()), packed[seen], part[seen])

    def entropies_of(judge: Model, texts: DataFrame) -> list[tuple[str, float, int]]:
        shipped = docs.sparkSession.sparkContext.broadcast(judge)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "text", 1 << 19):
                names = batch.column("label").to_pylist()
                e, n = shipped.value.entropies(texts_of(batch, "text"))
                own = [shipped.value.names.index(l) if l in shipped.value.names else -1 for l in names]
                rows = [(l, float(e[i, k]), int(n[i])) for i, (l, k) in enumerate(zip(names, own)) if k >= 0 and n[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64())],
                    names=["label", "e", "n"])

        return [tuple(r) for r in texts.mapInArrow(run, "label string, e double, n bigint").collect()]

    unseen = entropies_of(crossed, sample.filter("not own")) if crossed.names else []
    # languages with all their texts on one side are judged by texts of the fit
    lone = sorted(set(model.names) - {r[0] for r in unseen})
    model.calibrate(unseen + (entropies_of(model, sample.filter(F.col("label").isin(lone))) if lone else []))
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", z: float = 15.0) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score``, ``lang_entropy`` and ``lang_rejected``; one pass, no shuffle."""
    new = ("lang_pred", "lang_score", "lang_entropy", "lang_rejected")
    rest, kept, schema = replaced(docs, text_col, "_text", **dict(zip(new, ("string", "double", "double", "boolean"))))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_text", 1 << 19):
            names, score, entropy, rejected = shipped.value.decide(texts_of(batch, "_text"), z)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(score), pa.array(entropy, pa.float64()), pa.array(rejected)], names=[*kept, *new])

    return rest.mapInArrow(run, schema)
