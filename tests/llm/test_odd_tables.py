"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from conftest import EXTRA, ODD
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprints, langid, licenses, mixing, near_dup, quality_gam, rules, sharding, suffix_dedup

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def quality(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return quality_gam.classify(docs, labels)


OPERATORS = {
    "licenses": licenses.scan,
    "quality": quality,
    "langid": langid.identify,
    "bpe": lambda d: bpe.round_trip(d, *BPE),
    "near_dup": near_dup.classes,
    "suffix": suffix_dedup.report,
    "fingerprints": fingerprints.compare_with_next,
    "rules": lambda d: rules.judge(rules.counts(d)),
    "mixing": mixing.mix,
    "sharding": sharding.shards,
}
STAGES = dict(corpus_pipeline.STAGES)
FILTERS = ("language_id", "near_duplicates", "suffix_array_dedup", "mixing")


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(odd, name):
    got = Counter(r["doc_id"] for r in OPERATORS[name](odd).select("doc_id").collect())
    assert got == Counter(r[0] for r in ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(none_at_all, name):
    out = OPERATORS[name](none_at_all)
    assert out.count() == 0 and "doc_id" in out.columns


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(odd, clashing, name):
    plain, more = OPERATORS[name](odd), OPERATORS[name](clashing)
    assert plain.columns == more.columns
    assert Counter(map(str, plain.collect())) == Counter(map(str, more.collect()))


@pytest.mark.parametrize("name", FILTERS)
def test_stages_return_whole_documents(spark, clashing, name):
    out = STAGES[name](spark, clashing, "")
    assert out.columns == clashing.columns
    known = {tuple(r[5:]): r for r in clashing.collect()}
    rows = out.collect()
    assert rows
    for r in rows:
        was = known[tuple(r[5:])]
        assert (r["doc_id"], r["lang"], r["source"]) == (was["doc_id"], was["lang"], was["source"])
        assert all(r[c].startswith(f"{c}-") for c in EXTRA)
        if name != "suffix_array_dedup":
            assert r["text"] == was["text"]


@pytest.mark.parametrize("name", FILTERS)
def test_stages_take_no_rows(spark, none_at_all, name):
    out = STAGES[name](spark, none_at_all, "")
    assert out.count() == 0 and out.columns == none_at_all.columns


def test_last_stage(spark, odd, none_at_all):
    assert STAGES["bpe"](spark, odd, "").count() == len(ODD)
    assert STAGES["bpe"](spark, none_at_all, "").count() == 0


def test_same_rows_on_every_run(odd):
    for name in ("quality", "mixing", "sharding", "near_dup", "rules"):
        assert Counter(map(str, OPERATORS[name](odd).collect())) == Counter(map(str, OPERATORS[name](odd.repartition(5)).collect())), name


def test_null_texts_are_empty(odd):
    by = {n: {r["doc_id"]: r for r in OPERATORS[n](odd.where("doc_id in (2, 3, 4, 5)")).collect()} for n in OPERATORS}
    assert by["langid"][2]["lang_pred"] == by["langid"][5]["lang_pred"] == "und"
    assert by["bpe"][2]["n_tokens"] == 0 and by["bpe"][2]["ids_sha256"] == by["bpe"][3]["ids_sha256"]
    assert by["suffix"][2]["n_bytes"] == 0
    assert by["fingerprints"][2]["n_chars"] == 0 and by["fingerprints"][2]["fingerprint"] == by["fingerprints"][3]["fingerprint"]
    assert by["rules"][2]["base_failed"] and not by["rules"][2]["kept"]
    assert by["mixing"][2]["size"] == by["mixing"][2]["taken"] == 0
    assert by["sharding"][2]["size"] == 16 and by["sharding"][2]["text_crc32"] == 0
    assert by["licenses"][2]["licenses"] == ""
    assert 0 <= by["quality"][2]["score"] <= 1
    assert by["near_dup"][2]["class_id"] == by["near_dup"][3]["class_id"] == 2
