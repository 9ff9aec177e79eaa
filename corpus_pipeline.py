"""A corpus pipeline: each stage works on all that the one before kept, written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontaminate, neardup, pii, quality
from quern.llm.common import scratch, table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels that are not held out, does not reject.

    Each row is judged by its own text (null: empty), whatever its key; without labels of both classes all stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least key.

    Of rows with one key one stays, rows without a key all do; null and empty texts are copies of each other.
    """
    return neardup.keep_one(docs)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy, edited or not, of a test item; rows without a key or without text stay."""
    return decontaminate.drop_copies(docs, table(spark, sf_dir, "benchmark"))


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, and n_chars counted anew; null texts stay null."""
    return pii.redact_texts(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document (little-endian 32-bit integers), their count, and digests of them and of the decoded bytes.

    Null and empty texts have no ids; null keys stay null.
    """
    return bpe.encode_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", uncontaminated_documents),
    ("personal_data", redacted_documents),
    ("byte_bpe", encoded_documents),
]

#: The stages learn, align and encode; SQL cannot express them. tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; what they write on the way is deleted, the last table stays.

    Columns beyond those of ``documents``, whatever their names, go through to the last stage; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    with scratch():
        for name, stage in STAGES:
            with scratch():
                docs = written(stage(spark, docs, sf_dir), name, keep=2 if name == STAGES[-1][0] else 1)
    return docs
