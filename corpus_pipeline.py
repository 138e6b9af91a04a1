"""A training corpus from raw documents: good texts, in known languages, without near copies, mixed by source, as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import langid, mixing, pieces, quality, simhash
from tidemark.llm.common import stored


def tokenizer() -> str:
    """The vocabulary file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling against the texts labelled good; what is not drawn goes."""
    chosen, _ = quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return chosen.filter("selected").select(*docs.columns)


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts too unlike every language learned, go."""
    model = langid.fit(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(False)))
    return langid.predict(docs, model).filter("not lang_rejected").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer(), exact_col="exact")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")


STAGES = [
    ("quality classifier", good_texts),
    ("language ID", known_languages),
    ("SimHash near-dedup", without_copies),
    ("mixing sources", mixed_sources),
    ("SentencePiece", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
