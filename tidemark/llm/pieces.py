"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps, for each of the last characters (as many as the longest piece has), one backpointer:
the piece that ends there on the best path. Whenever the paths of all these places run through one common
boundary, the ids before it are committed and forgotten, so a text of any length needs a bounded window unless its
paths never meet.

For unigram models the best path has the largest sum of scores. For merge models (BPE) scores rank merges
and do not add up; there the path that the library would take is the only one in which each neighbouring pair of
pieces is stable, that is, merging the joined pair from characters gives just these two. (If a merge across the pair's border
came up in the whole text, the same merge would come up in the pair alone, and the other way round.) A prefix of such a path is the path of the prefix, so
one backpointer per place holds all that is needed.

The search runs over the whole text. Borders that no piece of the vocabulary crosses (before a blank, between letters that stand side by side
in no piece) are places where all paths meet, so ids are committed there without asking, and what the search found between two
of them is remembered for the next time. Between borders it commits wherever the paths in the window have met.

Characters outside the vocabulary become their UTF-8 bytes if the model has byte pieces, else the unknown id.
Null and empty texts give no ids. The texts' own blanks are kept, so decoding returns the text (with byte pieces and
without the blank's escape sign in the text).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_bytes, replaced, texts_of

BLANK = "▁"
TAIL = 4


class Memo(dict):
    """A dictionary that computes what it lacks and holds up to ``size`` entries and the ``size`` before them, so that what is common stays."""

    def __init__(self, compute, size: int):
        super().__init__()
        self.compute, self.size, self.older = compute, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


class Segmenter:
    """Pieces of one vocabulary. ``pieces`` maps text to (id, score); ``merges`` tells BPE from unigram."""

    def __init__(self, pieces: dict[str, tuple[int, float]], merges: bool, byte_ids: list[int] | None, unk: int = 0, prefix: bool = True):
        self.pieces, self.merges, self.byte_ids, self.unk, self.prefix = pieces, merges, byte_ids, unk, prefix
        self.width = max(map(len, pieces), default=1)
        self.commits = 0  # made inside spans
        self.floor = min((s for _, s in pieces.values()), default=0.0) - 10.0
        longer: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > TAIL:
                longer.setdefault(p[-TAIL:], set()).add(len(p))
        self.longer = {tail: tuple(sorted(sizes, reverse=True)) for tail, sizes in longer.items()}
        crossing = any(BLANK in p.lstrip(BLANK) for p in pieces)
        # no piece crosses the border of a span: all paths meet there, and what a span commits can be remembered
        self.spans = re.compile(r"(?s).+" if crossing else rf"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.sizes = Memo(self._sizes, 1 << 16)
        self.followers = Memo(self._followers, 1 << 13)
        self.starts = Memo(self._beginnings, 1 << 15)
        self.ends = Memo(lambda piece: [piece[i:] for i in range(len(piece))], 1 << 15)
        self.beside = {pair for p in pieces for pair in zip(p, p[1:])}
        self.packed = Memo(lambda span: b"".join(map(self.parts.__getitem__, self._split(span))), 1 << 17)
        self.parts = Memo(lambda part: array("i", self.segment(part)).tobytes(), 1 << 18)

    def _sizes(self, tail: str) -> tuple[int, ...]:
        """How long pieces may be that end in the (up to) ``TAIL`` characters, longest first; those beyond ``TAIL`` need a look."""
        short = tuple(k for k in range(len(tail), 1, -1) if tail[-k:] in self.pieces)
        return (self.longer.get(tail, ()) + short + (1,)) if tail else (1,)

    def _followers(self, left: str) -> Memo:
        return Memo(lambda right: self._stable(left, right), 1 << 14)

    def _stable(self, left: str, right: str) -> bool:
        """Whether merging the characters of ``left + right`` by score, leftmost of equals first, gives the two pieces."""
        pieces = self.pieces
        if left and self.starts[right] and not any(a + b in pieces for a in self.ends[left] for b in self.starts[right]):
            return True
        parts, border = [*left, *right], len(left)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = pieces.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                return len(parts) - border == 1
            if at == border - 1:
                return False
            if at < border:
                border -= 1
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _beginnings(self, piece: str) -> list[str]:
        """All beginnings of a piece that merges alone lead to; none if they end elsewhere."""
        return [piece[:i] for i in range(1, len(piece) + 1)] if self._stable("", piece) else []

    def ids_of(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found:
            return [found[0]]
        return [self.unk] if self.byte_ids is None else [self.byte_ids[b] for b in piece.encode()]

    def segment(self, text: str) -> list[int]:
        """Ids of a text, committed as soon as all surviving paths agree."""
        step = self._stable_step if self.merges else self._best_step
        ids: list[int] = []
        base, n, width = 0, len(text), self.width
        last = [""]  # last[i]: the piece that ends at base + i
        state = [self.followers[""] if self.merges else 0.0]  # what may follow there, or the score of the path
        while base < n:
            # up to the next place where the window is looked at
            end = min(n, base + max(4 * width, len(last) - 1 + width))
            step(text, base, base + len(last), end + 1, last, state)
            if end == n:
                break
            at = self._meeting(last, end - base)
            if at:
                ids += self._trace(last, at)
                self.commits += 1
                last, state, base = last[at:], state[at:] if self.merges else [s - state[at] for s in state[at:]], base + at
        return ids + self._trace(last, n - base)

    def _stable_step(self, text: str, base: int, first: int, stop: int, last: list[str], state: list[Memo]) -> None:
        """Backpointers of the places from ``first`` to ``stop`` of a merge model: the one piece that is stable after what ends where it starts."""
        sizes, pieces, followers = self.sizes, self.pieces, self.followers
        add_last, add_state = last.append, state.append
        for end in range(first, stop):
            held = end - base
            for size in sizes[text[end - TAIL if held > TAIL else base:end]]:
                if size <= held:
                    here = text[end - size:end]
                    if (size <= TAIL or here in pieces) and state[held - size][here]:
                        add_last(here)
                        add_state(followers[here])
                        break

    def _best_step(self, text: str, base: int, first: int, stop: int, last: list[str], state: list[float]) -> None:
        """Backpointers and scores of the places from ``first`` to ``stop`` of a unigram model: the piece on the path with the largest sum."""
        sizes, pieces, floor = self.sizes, self.pieces, self.floor
        for end in range(first, stop):
            held = end - base
            piece, total = "", None
            for size in sizes[text[end - TAIL if held > TAIL else base:end]]:
                here = text[end - size:end]
                if size <= held and (size <= TAIL or here in pieces):
                    s = state[held - size] + (pieces[here][1] if here in pieces else floor)
                    if total is None or s > total:
                        piece, total = here, s
            last.append(piece)
            state.append(total)

    def _split(self, span: str) -> list[str]:
        """``span`` cut between characters that stand side by side in no piece: there, too, all paths meet."""
        beside = self.beside
        cuts = [i for i, pair in enumerate(zip(span, span[1:]), 1) if pair not in beside]
        return [span[a:b] for a, b in zip([0, *cuts], [*cuts, len(span)])] if cuts else [span]

    def _meeting(self, last: list[str], end: int) -> int:
        """The last place that the paths of all places in the window run through."""
        places = set(range(end - self.width + 1, end + 1))
        while len(places) > 1:
            top = max(places)
            places.remove(top)
            places.add(top - len(last[top]))
        return places.pop()

    def _trace(self, last: list[str], end: int) -> list[int]:
        found, pieces = [], self.pieces
        while end:
            piece = last[end]
            known = pieces.get(piece)
            if known:
                found.append(known[0])
            else:
                found += reversed(self.ids_of(piece))
            end -= len(piece)
        return found[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as packed 32-bit integers: the search runs span by span, and what it found for a span is remembered."""
        if not text:
            return b""
        escaped = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        return b"".join(map(self.packed.__getitem__, self.spans.findall(escaped)))


@lru_cache(maxsize=2)
def load(model: str) -> tuple[Segmenter, list[bytes]]:
    """The segmenter of a model file, and the bytes each id stands for."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(model, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models that leave characters and blanks as they are")
    kinds = proto.ModelProto.SentencePiece.Type
    normal = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL}
    raw = {int(p.piece[3:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
    unk = next((i for i, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN), 0)
    known = Segmenter(normal, m.trainer_spec.model_type == 2, [raw[b] for b in range(256)] if raw else None, unk, spec.add_dummy_prefix)
    out = []
    for p in m.pieces:
        if p.type == kinds.BYTE:
            out.append(bytes([int(p.piece[3:-1], 16)]))
        elif p.type == kinds.CONTROL:
            out.append(b"")
        else:
            out.append((" ⁇ " if p.type == kinds.UNKNOWN else p.piece.replace(BLANK, " ")).encode())
    return known, out


def joined(ids: pa.ListArray, units: pa.Array, prefix: bool) -> pa.Array:
    """Texts of id lists: the units of the ids one after another, without the blank before the first."""
    raw = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, units.take(ids.values)), b"")
    try:
        out = raw.cast(pa.string())
    except pa.ArrowInvalid:  # ids that no text has: bytes that are no UTF-8
        out = pa.array([None if b is None else b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())
    return pc.replace_substring_regex(out, "^ ", "") if prefix else out


def coded_slices(batches: Iterable[pa.RecordBatch], known: Segmenter) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Slices of bounded bytes and the id lists of their texts (last column)."""
    for batch in by_bytes(batches, "_text", 2 << 20):
        packed = [known.encode(t) for t in texts_of(batch, "_text")]
        offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
        yield batch, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
    pa.default_memory_pool().release_unused()


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", exact_col: str | None = None) -> DataFrame:
    """``docs`` with an array of ids for each text (an existing column of that name is replaced); one pass, no shuffle.

    ``exact_col`` adds whether decoding the ids returns the text (null as empty). It is found in the same pass: a second
    one beside it would double the Python workers that remember spans.
    """
    new = {ids_col: "array<int>"} | ({exact_col: "boolean"} if exact_col else {})
    rest, kept, schema = replaced(docs, text_col, "_text", **new)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, units = load(model)
        table = pa.array(units, pa.binary())
        for batch, ids in coded_slices(batches, known):
            columns = [*[batch.column(i) for i in range(batch.num_columns - 1)], ids]
            if exact_col:
                columns.append(pc.equal(joined(ids, table, known.prefix), pc.fill_null(batch.column(batch.num_columns - 1), "")))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return rest.mapInArrow(run, schema)


def decode(coded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of each id list; null ids give null, no ids the empty text."""
    rest, kept, schema = replaced(coded, ids_col, "_ids", **{out_col: "string"})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, units = load(model)
        table = pa.array(units, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(part.num_columns - 1)
                flat = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))).astype(np.int32)), ids.flatten())
                text = joined(flat, table, known.prefix)
                text = pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns - 1)], text], names=[*kept, out_col])

    return rest.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, exact) per row: the ids, their number, and whether decoding them returns the text (null as empty)."""
    coded = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, exact_col="exact")
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")
