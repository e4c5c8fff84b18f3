"""The corpus pipeline: language, near duplicates, repeated passages, mixture, tokens.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. Only the last stage returns other columns than those of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, langid, mixing, near_dup, suffix_dedup
from tessera.llm._common import drop_staged, read, stage_table, staged_tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned languages together explain: half of their trigrams at least occur in their own mixture.

    Null texts and texts without letters go; of repeated rows all stay or all go.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of smallest id; null and empty texts are one class, equal rows too."""
    return near_dup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 100 bytes or more that occur earlier; null texts stay null, long ones are read whole."""
    return suffix_dedup.strip(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; texts without a word go, repeated rows count one by one."""
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix, a row for every row; a null text has no tokens."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What a stage has staged goes once its result is written."""
    docs, before = read(spark, sf_dir, "documents"), set(staged_tables())
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        own = staged_tables()[-1]
        drop_staged(spark, [p for p in staged_tables() if p not in before and p != own])
    return STAGES[-1][1](spark, docs, sf_dir)
