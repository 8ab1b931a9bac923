"""A corpus in five stages, each written as Parquet and read again as the next one's documents.

Quality rules reject documents, lines found in many documents go, one document of each near-duplicate group stays,
benchmark passages and contaminated documents go, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekin.llm import decontaminate, line_dedup, near_dup, quality_rules, queries, sentencepiece_bpe
from tablekin.llm.common import own_names, plain_names
from tablekin.session import materialize


def count_chars(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as its texts are now; a null text keeps its number."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text passes the base test and whose votes make them probably good."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten documents share; n_chars follows the text."""
    plain = plain_names(docs)
    kept = line_dedup.drop_frequent_lines(plain, carry=tuple(c for c in plain.columns if c not in ("doc_id", "text")))
    return count_chars(own_names(kept, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without words are in no group."""
    return near_dup.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the passages that benchmark items cover; n_chars follows the text."""
    return count_chars(decontaminate.remove_passages(docs, queries.table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, digests of ids and decoded text, and the ids."""
    return sentencepiece_bpe.encode_documents(docs, queries.piece_model(), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece", encode),
]

#: The quality stage learns by EM, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
