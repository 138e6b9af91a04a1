"""Token counts: whole texts encoded in batches of equal bytes, only lengths leave the function.

Null and empty texts have 0 tokens. Rows repeat as they are. A text longer than ``piece_bytes`` is cut
before encoding, at blanks after a character that is no blank: no vocabulary entry crosses such a place, and the
blank that the library puts before every text stands for the one that is cut out. A text without such a
place is encoded in one piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import by_bytes, texts_of


@lru_cache(maxsize=4)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def pieces_of(text: str, size: int) -> list[str]:
    """Parts of ``text`` whose token counts add up to that of the whole."""
    parts, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at != -1 and text[at - 1] == " ":
            at = text.find(" ", at + 1)
        if at == -1 or at + 1 >= len(text):
            break
        parts.append(text[start:at])
        start = at + 1
    parts.append(text[start:])
    return parts


def lengths(model: str, texts: list[str], batch_bytes: int, piece_bytes: int) -> np.ndarray:
    encode = processor(model).encode
    counts = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        found = encode(parts, num_threads=1)
        np.add.at(counts, owners, np.fromiter(map(len, found), np.int64, len(found)))

    for i, text in enumerate(texts):
        for part in pieces_of(text, piece_bytes):
            parts.append(part)
            owners.append(i)
            held += len(part)
            if held >= batch_bytes:
                flush()
                parts, owners, held = [], [], 0
    if parts:
        flush()
    return counts


def token_counts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
    batch_bytes: int = 1 << 19, piece_bytes: int = 1 << 16,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; one pass, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            counts = lengths(model, texts_of(batch, "text"), batch_bytes, piece_bytes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    counted = narrow.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
