"""Training-text pipeline: five stages, each a function from documents to documents.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is stored and read again as the next stage's
documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from scarpline.llm import byte_bpe, common, pairwise_quality, pii, simhash_grid, tiling


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking does not reject."""
    labels = common.table(spark, sf_dir, "labels")
    model = pairwise_quality.train(docs, labels, common.id_remainder("doc_id") != 0)
    return pairwise_quality.score(docs, model, out="_score").filter(F.col("_score") >= pairwise_quality.CUT).drop("_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group at similarity 0.8 over five-word shingles."""
    return simhash_grid.drop_near_duplicates(docs, k=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian, 32 bits) and the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    n_tokens = (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return encoded.select("doc_id", n_tokens, "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

ORACLE_SQL = None  # ranking, fingerprints and tokens have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.stored(docs)
    return docs
