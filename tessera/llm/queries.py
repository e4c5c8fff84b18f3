"""The corpus queries, one for each operator, and their SQL."""

from __future__ import annotations

import public_tokenizers

from tessera.llm import bpe, fingerprints, langid, licenses, mixing, near_dup, quality_gam, rules, sharding, suffix_dedup
from tessera.llm._common import read

QUERIES = {}
ORACLES = {}


def _query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@_query("op1_license_scans", licenses.oracle_sql())
def op1(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


@_query("op2_quality_classifier")
def op2(spark, sf_dir):
    return quality_gam.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query("op3_language_id")
def op3(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "documents"))


@_query("op4_bpe")
def op4(spark, sf_dir):
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op5_near_dup")
def op5(spark, sf_dir):
    return near_dup.classes(read(spark, sf_dir, "documents")).drop("node")


@_query("op6_suffix_dedup")
def op6(spark, sf_dir):
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


@_query("op7_fingerprints")
def op7(spark, sf_dir):
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


@_query("op8_quality_rules")
def op8(spark, sf_dir):
    judged = rules.judge(rules.counts(read(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op9_mixing")
def op9(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op10_sharding")
def op10(spark, sf_dir):
    return sharding.shards(read(spark, sf_dir, "documents"))
