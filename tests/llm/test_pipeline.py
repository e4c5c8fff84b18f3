"""The corpus pipeline, stage by stage, against plain versions of its stages."""

import base64
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SCHEMA, SF
from pyspark.sql import functions as F

from tessera.llm import langid


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """The rows after each stage of the run over sf0.001, each written and read again."""
    at = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        out.append(docs.collect())
    return out


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "suffix_array_dedup", "mixing", "bpe"]


def test_language(spark, ran):
    docs = spark.createDataFrame(ran[0], SCHEMA)
    keep = {r["doc_id"] for r in langid.identify(docs).where("lang_pred <> 'und' and explained >= 0.5").collect()}
    assert Counter(map(tuple, ran[1])) == Counter(tuple(r) for r in ran[0] if r["doc_id"] in keep)
    assert len(ran[1]) > 0.9 * len(ran[0])


def test_one_of_each_class(ran):
    classes = brute.near_duplicate_classes([(r["doc_id"], r["text"]) for r in ran[1]])
    assert Counter(map(tuple, ran[2])) == Counter(tuple(r) for r in ran[1] if classes[r["doc_id"]] == r["doc_id"])
    assert len(ran[2]) < len(ran[1])


def test_passages_go(ran):
    want = brute.repeated_bytes([(r["doc_id"], r["text"]) for r in ran[2]])
    was = {r["doc_id"]: r for r in ran[2]}
    assert {r["doc_id"] for r in ran[3]} == set(was) and len(ran[3]) == len(ran[2])
    for r in ran[3]:
        n, gone, spans, kept = want[r["doc_id"]]
        assert r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == (was[r["doc_id"]]["lang"], was[r["doc_id"]]["source"])
        extra = len(r["text"].encode()) - len(kept)
        assert extra == 0 or 0 < extra <= 6 * spans  # a sign goes only if all its bytes do
    assert any(r["n_chars"] < was[r["doc_id"]]["n_chars"] for r in ran[3])


def test_the_mix(ran):
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in ran[3]:
        n = len(brute.words(r["text"]))
        sizes[r["source"]] += n
        most[r["source"]] = max(most[r["source"]], n)
    for r in ran[4]:
        taken[r["source"]] += len(brute.words(r["text"]))
    want = brute.mixing_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    assert max(Counter(r["doc_id"] for r in ran[4]).values()) <= 2
    assert {tuple(r) for r in ran[4]} <= {tuple(r) for r in ran[3]}


def test_the_mix_of_rows_that_share_an_id(spark):
    from tessera.llm import mixing

    source = lambda i: ("a", "b", None)[i % 3]
    rows = [(None if i % 2 else 7, " ".join([f"w{i}"] * (1 + i)), "en", source(i), i) for i in range(60)]
    rows += [(None, "the same row " * 5, "en", "a", -1)] * 9 + [(None, "the same row " * 5, "en", "b", -1)] * 4
    docs = spark.createDataFrame(rows, SCHEMA)
    want, sizes, taken, most = Counter(), Counter(), Counter(), Counter()
    for r in mixing.mix(docs).collect():
        want[r["source"], r["size"]] += r["copies"]
    for _, text, _, s, _ in rows:
        sizes[s] += len(text.split())
        most[s] = max(most[s], len(text.split()))
    out = mixing.apply(docs).collect()
    got = Counter((r["source"], len(r["text"].split())) for r in out)
    for (s, n), k in got.items():
        taken[s] += n * k
    assert got == +want and {tuple(r) for r in out} <= set(rows)
    assert all(abs(taken[s] - x) <= most[s] for s, x in brute.mixing_targets(sizes).items())


def test_tokens(ran):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in ran[4]:
        ids = e.encode_ordinary(r["text"])
        want[r["doc_id"], len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(r["text"].encode())] += 1
    assert Counter(map(tuple, ran[5])) == want


def test_run_is_its_stages(spark, ran):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, ran[5]))


def test_planted_cases(spark):
    """Copies and passages go, clean documents stay."""
    rng = np.random.default_rng(3)
    prose = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and length(text) > 1500").limit(12).collect()]
    clean = [" ".join(rng.permutation(t.split())[:200]) for t in prose]
    passage = " ".join(f"{a} {b}" for a, b in zip(rng.permutation(prose[0].split())[:60], rng.permutation(prose[1].split())[:60], strict=True))
    texts = [*clean, clean[0], clean[1] + " the end", clean[2] + "\n" + passage, clean[3][::1] + " " + passage]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} >= set(range(12)) and {12, 13}.isdisjoint(r["doc_id"] for r in kept.collect())
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs.where("doc_id not in (2, 3, 12, 13)"), SF).collect()}
    assert all(left[i] == clean[i] for i in range(12) if i not in (2, 3))
    assert passage in left[14] and passage[5:-5] not in left[15]
    assert docs.where(F.col("doc_id") == 15).first()["text"].startswith(left[15][:50])
