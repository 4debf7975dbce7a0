"""A pipeline over documents made of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirune.llm import mixing, ngram_join, packing, quality, secrets
from semirune.llm.common import checkpointed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew, 0 for a null text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have the score of no n-grams; repeated rows are judged alike; an empty table is empty.
    """
    scored = quality.classify(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id.

    Null and empty texts are one group; of rows that repeat one stays; texts of any length are compared whole.
    """
    return ngram_join.keep_one(docs.select(*COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; null, empty and repeated rows stay."""
    return _as_documents(secrets.redact(docs.select(*COLUMNS)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, repeats written out; documents of which it takes none go, as do null and empty texts."""
    docs = docs.select(*COLUMNS)
    return _as_documents(mixing.mixed_documents(docs, mixing.mix(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null or empty text is one end token, an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("quality", good), ("near duplicates", distinct), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]

#: No SQL for a classifier, a forest and a tokenizer: see tests/llm for brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
