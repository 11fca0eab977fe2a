"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage is written as Parquet and read again by the next one, so a lost executor costs
one stage at most. All but the last return the columns of ``documents`` as they are, whatever extra
columns there are; an empty table passes through all of them.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbars.llm import bpe, decontaminate, langid, nearcopies, quality
from sparkbars.llm.columns import bounded_batches
from sparkbars.session import cut

MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (NULL too), and those whose best language scores under ``MIN_LANGUAGE_SCORE``.

    The score ranks the learned languages among each other and says nothing about fit: text of another
    language and noise of letters stay.
    """
    return langid.keep(docs, langid.train(docs), MIN_LANGUAGE_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of under 50 words and texts that repeat themselves."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that shares 0.8 or more of its five-word shingles."""
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): ids as little-endian unsigned 32-bit integers, decoded again to compare."""
    tokens = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", tokens.round_trip(F.col("text")).alias("encoded")).select("doc_id", "encoded.*")


def _bounded(stage):
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(bounded_batches(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _bounded(language_id)),
    ("quality_rules", _bounded(quality_rules)),
    ("near_dedup", _bounded(near_dedup)),
    ("decontamination", _bounded(decontamination)),
    ("byte_bpe", _bounded(byte_bpe)),
]

ORACLE_SQL = None  # language models, suffix arrays, XXH64 and merges are not to be had in SQL; tests hold the rows against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
