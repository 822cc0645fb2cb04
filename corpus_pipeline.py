"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from relspark.llm import decontaminate, minhash_dedup, packing, secret_scan, toxicity
from relspark.scratch import own_folder
from relspark.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones, does not reject. Null and empty texts stay, repeated
    rows are judged each; without labels of both kinds nothing is rejected; an empty table stays empty."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit_on_sample(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates. Null and empty texts and rows without an id stay;
    repeated rows of one id stay or go together; an empty table stays empty."""
    ship(spark)
    return minhash_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts stay, repeated rows are judged each; without items
    all stay; an empty table stays empty."""
    ship(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text where there is such a column. Null texts stay null,
    repeated rows are masked each, an empty table stays empty."""
    return secret_scan.redact_secrets(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 2048 tokens. Null and empty texts are a piece of one id,
    repeated rows are packed each; an empty table gives none."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express a trained model, near duplicates or tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = own_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
