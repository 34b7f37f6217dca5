"""The training-data pipeline: identify, dedup, decontaminate, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
in the cluster's shared folder and read again as the next stage's docs, so a lost executor
costs at most the stage at hand.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from exposa.llm import bpe, decontam, langid, simhash
from exposa.llm.queries import tokenizer_path
from exposa.llm.tables import ensure_checkpoint_dir, table

#: Documents are rejected below this share of the best language; texts without evidence have at
#: most one over the number of languages.
MIN_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from their own text."""
    return langid.keep_identified(docs, langid.fit(docs), min_score=MIN_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that with the least doc_id."""
    return simhash.keep_one(docs, shingle=3, bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word passage of a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the text that they decode to."""
    return bpe.tokens(docs, tokenizer_path("byte_bpe_50k.json")).drop("text")


STAGES = [("language_id", identify_language), ("simhash_dedup", drop_near_copies),
          ("decontamination", decontaminate), ("bpe", encode)]

#: The stages are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole of ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
