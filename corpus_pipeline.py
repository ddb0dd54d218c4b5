"""A corpus pipeline of five stages, each applying one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. run() writes each stage's result to the shared folder as
Parquet, which the next one reads, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import bpe, mixing, pii, quality, similar
from lexivec.llm.common import fresh_dir

#: SQL can't express the fingerprints, personal data or tokens; tests compare with brute force.
ORACLE_SQL = None
#: Words of a shingle in near-duplicate detection.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null texts have no words and are rejected."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity about 0.8 or more): the one with the smallest id.

    Rows without an id can't be told apart and stay; rows that repeat a kept id stay.
    """
    return similar.keep_one(docs, words=SHINGLE_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced and n_chars counted anew."""
    return pii.redact_column(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the production mix has them."""
    mixed = mixing.select_copies(docs, mixing.PRODUCTION).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing_sources", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            where = fresh_dir(spark, name)
            docs.write.parquet(where)
            docs = spark.read.parquet(where)
    return docs
