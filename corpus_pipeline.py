"""The corpus pipeline: quality filter, exact and near deduplication, decontamination, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; it is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm.common import prepare, table
from ripplegraph.llm.decontam import drop_contaminated
from ripplegraph.llm.dedup import drop_duplicates
from ripplegraph.llm.neardup import drop_near_duplicates
from ripplegraph.llm.pieces import digests, encode_decode
from ripplegraph.llm.quality import keep_good
from ripplegraph.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier does not reject."""
    prepare(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each text."""
    prepare(spark)
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near duplicates."""
    prepare(spark)
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that no benchmark item contaminates."""
    prepare(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the documents and decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    prepare(spark)
    return digests(encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece_encoding", encode),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer are no SQL; tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
