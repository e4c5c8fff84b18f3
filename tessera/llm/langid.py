"""Language identification as mixture inference over character n-grams.

A text is taken as a mixture of languages. Each language has a distribution
over hashed trigrams of letters (lower case, other signs as blanks), learned
from counts over all labelled rows that may be learned from, smoothed by
PSEUDO. Expectation-maximisation estimates the text's proportions; the set of
languages is chosen by penalised likelihood: the language of least proportion
is dropped as long as the likelihood less PENALTY * ln(n) a language does not
fall. The prediction is the largest proportion (of equals the first by code
point), the score is that proportion.

With DENSE_LANGUAGES languages or fewer the model is one table of 2^BUCKET_BITS
numbers a language, so its size is bounded and it can travel to executors with
the code; with more it stays a distributed table that is joined to the grams of
the texts, with the same results.
Counting is an aggregation with partial sums in each task: of a hot language
each task sends at most 2^BUCKET_BITS rows.

Nulls: a null text, or one without a letter, is "und" with score 0; rows with a
null lang teach nothing; a null doc_id counts as empty text in the split. With
nothing learned everything is "und". Repeated rows teach and are scored as often
as they occur. Empty tables give empty results. Long texts cost time and memory
in proportion to their length. Further columns are no inputs.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm._common import held_out, key_of, stage_table, text_or_empty

BUCKET_BITS = 16
DENSE_LANGUAGES = 500
#: A proportion that EM has given up.
NOTHING = 1e-6
PSEUDO = 0.05
PENALTY = 2.0
STEPS = 25
LEARN_MOD, LEARN_NOT = 4, 2
#: Of a pipeline's stage: the least share of a document's trigrams that must occur in the learned languages.
LEAST_EXPLAINED = 0.5


@cache
def letter_bits() -> np.ndarray:
    """For each code point whether it is a letter, eight to a byte; made on the driver and sent along."""
    n = sys.maxunicode + 1
    return np.packbits(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(n)), bool, n))


def letter_table(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed).view(bool)


def grams(text: str, letters: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    """Buckets of the trigrams around each letter; blanks stand for what is no letter."""
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[low]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    x = np.zeros(len(low) + 2, np.uint32)
    x[1:-1] = np.where(is_letter, low, 32)
    x[0] = x[-1] = 32
    mid = np.flatnonzero(is_letter) + 1
    h = x[mid - 1] * np.uint32(0x9E3779B1) ^ x[mid] * np.uint32(0x85EBCA77) ^ x[mid + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def _count(bits: int):
    packed = letter_bits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table(packed)
        sums: dict[str, np.ndarray] = {}

        def put() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in sums:
                    if len(sums) == 64:
                        yield from put()
                        sums = {}
                    sums[lang] = np.zeros(1 << bits, np.int64)
                np.add.at(sums[lang], grams(text, letters, bits), 1)
        yield from put()

    return run


class Model(NamedTuple):
    """Languages in order, probabilities of buckets by language, and each language's probability of a bucket that it lacks."""

    names: list[str]
    table: np.ndarray
    unseen: np.ndarray


def _counts(docs: DataFrame, bits: int) -> DataFrame:
    """(lang, bucket, n) from all rows of (lang, text)."""
    rows = docs.where("lang is not null").select("lang", text_or_empty(F.col("text")).alias("text"))
    return rows.mapInArrow(_count(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def n_languages(docs: DataFrame, most: int) -> int:
    """How many languages there are, most + 1 standing for more."""
    return docs.where("lang is not null").select("lang").distinct().limit(most + 1).count()


def learn(docs: DataFrame, bits: int = BUCKET_BITS) -> Model:
    """The model of all rows of (lang, text), as one dense table."""
    found = _counts(docs, bits).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    table = np.zeros((len(names), 1 << bits), np.float64)
    place = {x: i for i, x in enumerate(names)}
    table[[place[x] for x in found["lang"].to_pylist()], found["bucket"].to_numpy()] = found["n"].to_numpy()
    total = table.sum(axis=1, keepdims=True) + PSEUDO * table.shape[1]
    return Model(names, (table + PSEUDO) / total, PSEUDO / total[:, 0])


def proportions(p: np.ndarray, n: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """EM for the proportions of the columns of p (grams by languages), grams occurring n times."""
    total = n.sum()
    pi = np.full(p.shape[1], 1.0 / p.shape[1])
    for _ in range(steps if p.shape[1] > 1 else 0):
        joint = p * pi
        new = (n / joint.sum(axis=1)) @ joint / total
        moved = np.abs(new - pi).max()
        pi = new
        if moved < 1e-4:
            break
    return pi, float(n @ np.log(p @ pi))


def infer(buckets: np.ndarray, table: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions by language of one text, 0 for the languages outside the chosen set."""
    u, n = np.unique(buckets, return_counts=True)
    return choose(table[:, u].T, n.astype(np.float64), penalty)


def choose(p: np.ndarray, n: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The same from the probabilities of the text's grams (grams by languages) and how often each occurs.

    Languages that EM leaves less than NOTHING go first, together: without them
    the likelihood falls by less than the penalty of any one.
    """
    out = np.zeros(p.shape[1])
    chosen = np.arange(p.shape[1])
    cost = penalty * np.log(n.sum() + 1.0)
    pi, fit = proportions(p, n)
    some = pi >= NOTHING
    if not some.all():
        chosen = chosen[some]
        pi, fit = proportions(p[:, chosen], n)
    while len(chosen) > 1:
        drop = int(np.argmin(pi))
        rest = np.delete(np.arange(len(chosen)), drop)
        new_pi, new_fit = proportions(p[:, chosen[rest]], n)
        if new_fit + cost < fit:
            break
        chosen, pi, fit = chosen[rest], new_pi, new_fit
    out[chosen] = pi
    return out


def judged(names: list[str], unseen: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[str, float, float]:
    """(language, its proportion, explained share) of one text, from its grams as for choose()."""
    if not names or not len(n):
        return "und", 0.0, 0.0
    pi = choose(p, n)
    k, chosen = int(np.argmax(pi)), pi > 0
    known = (p[:, chosen] > unseen[chosen] * (1 + 1e-9)).any(axis=1)
    return names[k], min(1.0, float(pi[k])), float(n @ known / n.sum())


def _predict(model: Model, bits: int):
    packed = letter_bits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table(packed)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                u, n = np.unique(grams(text or "", letters, bits), return_counts=True)
                found.append(judged(model.names, model.unseen, model.table[:, u].T, n.astype(np.float64)))
            lang, score, explained = zip(*found) if found else ((), (), ())
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(explained, pa.float64())], [*rest, "lang_pred", "score", "explained"])

    return run


def _grams_of(bits: int):
    """(key, th, bucket, n): a text's grams, with one row of bucket -1 for a text that has none."""
    packed = letter_bits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table(packed)
        for batch in batches:
            for key, th, text in zip(*[batch.column(c).to_pylist() for c in ("key", "th", "text")], strict=True):
                u, n = np.unique(grams(text, letters, bits), return_counts=True)
                u, n = (u, n) if len(u) else (np.array([-1]), np.array([0]))
                yield pa.record_batch({"key": np.full(len(u), key, np.int64), "th": np.full(len(u), th, np.int64), "bucket": u.astype(np.int32), "n": n.astype(np.int64)})

    return run


def _judge_wide(rows: DataFrame, learnt: DataFrame, bits: int) -> DataFrame:
    """(key, th, lang_pred, score, explained) for rows (key, th, text), with any number of languages.

    The model stays a table, for each bucket the languages that have it; it meets
    the grams of the texts in a join, and a text's own part of it is all that a
    task holds. Only the languages' names and totals go with the code.
    """
    counts = stage_table(_counts(learnt, bits), "langid-counts")
    totals = sorted((r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())
    names, total = [x for x, _ in totals], np.array([n for _, n in totals], np.float64) + PSEUDO * (1 << bits)
    model = counts.groupBy("bucket").agg(F.collect_list(F.struct("lang", "n")).alias("has"))
    texts = rows.dropDuplicates(["key", "th"]).mapInArrow(_grams_of(bits), "key long, th long, bucket int, n long")
    place = {x: i for i, x in enumerate(names)}

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        n = t["n"].to_numpy().astype(np.float64)
        out = ("und", 0.0, 0.0)
        if n.sum():
            p = np.tile(PSEUDO / total, (len(n), 1))
            for i, hs in enumerate(t["has"].to_pylist()):
                for h in hs or ():
                    k = place[h["lang"]]
                    p[i, k] = (h["n"] + PSEUDO) / total[k]
            out = judged(names, PSEUDO / total, p, n)
        return pa.table({"key": t["key"][:1], "th": t["th"][:1], "lang_pred": [out[0]], "score": [out[1]], "explained": [out[2]]})

    return texts.join(model, "bucket", "left").groupBy("key", "th").applyInArrow(run, "key long, th long, lang_pred string, score double, explained double")


def _with_keys(docs: DataFrame, *keep: Column) -> DataFrame:
    return docs.select(key_of(docs["doc_id"]).alias("key"), F.xxhash64(text_or_empty(docs["text"])).alias("th"), text_or_empty(docs["text"]).alias("text"), *keep)


def identify(docs: DataFrame, bits: int = BUCKET_BITS, dense: int = DENSE_LANGUAGES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, explained), one row for each document."""
    d = docs.select("doc_id", "lang", "text").withColumn("held_out", held_out(F.col("doc_id"), LEARN_MOD, LEARN_NOT))
    learnt = d.where("not held_out")
    if n_languages(learnt, dense) > dense:
        rows = _with_keys(d, d["doc_id"].alias("doc_id"), d["held_out"].alias("held_out"))
        return rows.drop("text").join(_judge_wide(rows.select("key", "th", "text"), learnt, bits), ["key", "th"]).drop("key", "th")
    kind = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, explained double"
    return d.select("doc_id", "held_out", text_or_empty(F.col("text")).alias("text")).mapInArrow(_predict(learn(learnt, bits), bits), kind)


def keep_known(docs: DataFrame, least: float = LEAST_EXPLAINED, bits: int = BUCKET_BITS, dense: int = DENSE_LANGUAGES) -> DataFrame:
    """The documents, in their own columns, that the learned languages together explain.

    That is those with letters of which at least the share least of the trigrams
    occurs in the languages of their own mixture, however many these are.
    """
    d = docs.select("doc_id", "lang", "text").withColumn("held_out", held_out(F.col("doc_id"), LEARN_MOD, LEARN_NOT))
    learnt = d.where("not held_out")
    if n_languages(learnt, dense) > dense:
        rows = _with_keys(docs, F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
        known = _judge_wide(rows.select("key", "th", "text"), learnt, bits).where((F.col("lang_pred") != "und") & (F.col("explained") >= least))
        return rows.join(known.select("key", "th"), ["key", "th"], "left_semi").select("doc.*")
    predict = _predict(learn(learnt, bits), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(predict(iter([pa.record_batch({"text": batch.column("text")})])))
            keep = [x != "und" and e >= least for x, e in zip(found["lang_pred"].to_pylist(), found["explained"].to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
