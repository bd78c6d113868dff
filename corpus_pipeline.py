"""Corpus pipeline: toxicity, exact dedup, near dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread
as the next one's ``docs``. All but the last return the columns of ``documents``.

* toxicity: documents whose predicted label is toxic go; labels come from ``labels``.
* exact_dedup: of documents with equal texts (white space aside) one stays.
* near_dedup: of each SimHash component the document with the smallest id stays.
* mixing: documents are repeated, at most 3 times, or left out, as the mix of their source takes
  their words.
* packing: the pieces of the documents with the sequence and offset of each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from drivescore.llm import exact_dedup, mixing, packing, simhash, toxicity
from drivescore.llm.common import staged

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", keep_clean),
    ("exact_dedup", keep_distinct),
    ("near_dedup", keep_unlike),
    ("mixing", mix),
    ("packing", pack),
]

#: The toxicity model and the tokenizer have no SQL form; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
