"""The operators against plain versions of themselves on whole small tables."""

import base64
import heapq
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SCHEMA, SENTENCE, SF
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprints, langid, licenses, mixing, near_dup, quality_gam, rules, sharding, suffix_dedup
from tessera.llm.queries import ORACLES, QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = sorted(x[0] for x in want.description)
    assert names == sorted(got.columns)
    want = Counter(map(str, con.execute(f"select {', '.join(names)} from ({ORACLES[name]})").fetchall()))
    assert Counter(str(tuple(r)) for r in got.select(*names).collect()) == want


# 1


def test_licences_in_other_spellings(spark):
    mit = licenses.KNOWN[0][3]
    texts = [mit, "Copyright (c) 2024 Someone\n\n" + mit.upper().replace(",", ""), mit.replace("sublicense", "sub-license"), mit + " and more words", "prose\nReleased under the MIT Licence!\nprose"]
    got = [(r["text_license"], r["licenses"], r["n_notices"]) for r in licenses.scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["MIT", "MIT", "MIT", None, None]
    assert got[4][1:] == ("MIT", 1) and got[3][1] == ""


def test_licences_in_whole_texts_and_under_other_headings(spark):
    at = Path(licenses.__file__).parent / "license_texts"
    full = {n: (at / f"{n}.txt").read_text() for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Apache-2.0", "CC0-1.0", "CC-BY-SA-4.0")}
    mit = licenses.KNOWN[0][3].partition("\n\n")[2]
    bsd = next(x[3] for x in licenses.KNOWN if x[0] == "BSD-3-Clause").partition("\n\n")[2].replace("HOLDER OR", "OWNER OR")
    bullets = bsd.replace(" 1. ", "\n\n* ").replace(" 2. ", "\n* ").replace(" 3. ", "\n* ")
    notices = {"SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "// SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0", "SPDX-License-Identifier: EPL-2.0": "EPL-2.0", "Licensed under the Mozilla Public License 2.0.": "MPL-2.0", "This project is licensed under the GNU General Public License v2.0.": "GPL-2.0"}
    texts = [*full.values(), full["GPL-2.0"].replace("\n", "\r\n"), mit, "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + mit, "Copyright (c) 2020, A\nAll rights reserved.\n\n" + bsd, bullets, mit + " and more words"]
    want = [*full, "GPL-2.0", "MIT", "MIT", "BSD-3-Clause", "BSD-3-Clause", None]
    got = licenses.scan(frame(spark, [*texts, *[f"prose\n{x}\nprose" for x in notices]])).orderBy("doc_id").collect()
    assert [r["text_license"] for r in got[: len(want)]] == want
    assert [(r["licenses"], r["n_notices"]) for r in got[len(want) :]] == [(x, 1) for x in notices.values()]


def test_licences_however_they_are_wrapped():
    at = Path(licenses.__file__).parent / "license_texts"
    texts = [(r[0], r[3]) for r in licenses._FIRST if r[2] == "text"] + [(f.stem.removesuffix("_spdx"), f.read_text()) for f in at.glob("*.txt")]
    known = {form: row[0] for form, row in licenses._FORMS.items()}
    for name, text in texts:
        for width in range(60, 101):
            for hyphens in (True, False):
                wrapped = "\n\n".join(textwrap.fill(p, width, break_on_hyphens=hyphens) for p in re.split(r"\n\s*\n", text))
                assert known.get(licenses.canonical_text(wrapped)) == name, (name, width, hyphens)


# 2


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_gam.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["held_out"]]
    assert auc(np.array([r["score"] for r in out]), np.array([r["quality"] for r in out])) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_takes_the_text_alone(spark, small):
    docs, _ = small
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = {r["doc_id"]: r["score"] for r in quality_gam.classify(docs, labels).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "n_chars": F.lit(0)})
    assert {r["doc_id"]: r["score"] for r in quality_gam.classify(other, labels).collect()} == plain
    # labels of held-out rows teach nothing
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality_gam.classify(docs, turned).collect()} == plain


def plain_fit(x, y, bins, coarse_bins, rounds, pair_rounds, n_pairs):
    """Cyclic boosting one row, one bin and one cut at a time: a function that scores a row."""
    q = quality_gam
    m, n = len(x[0]), len(y)
    base = math.log(sum(y) / (n - sum(y)))

    def cuts_of(j, parts):
        v = sorted(r[j] for r in x)
        return sorted({v[math.floor((n - 1) * i / parts + 1e-9)] for i in range(1, parts)})

    place = lambda cuts, v: sum(c <= v for c in cuts)
    cuts, coarse = [cuts_of(j, bins) for j in range(m)], [cuts_of(j, coarse_bins) for j in range(m)]
    tables = [[0.0] * (len(c) + 1) for c in cuts]
    grids = {}
    raw = lambda r: base + sum(t[place(c, v)] for t, c, v in zip(tables, cuts, r)) + sum(g[place(coarse[a], r[a])][place(coarse[b], r[b])] for (a, b), g in grids.items())
    value = lambda rows: sum(g for g, _ in rows) / (sum(h for _, h in rows) + q.RIDGE)
    part = lambda rows: sum(g for g, _ in rows) ** 2 / (sum(h for _, h in rows) + q.RIDGE)

    def cut(cells):
        best, at = 0.0, 1
        for k in range(1, len(cells)):
            left, right = sum(cells[:k], []), sum(cells[k:], [])
            gain = 0.0 if min(len(left), len(right)) < q.LEAST_LEAF else part(left) + part(right) - part(left + right)
            if gain > best + 1e-12:
                best, at = gain, k
        return best, at

    def tree(cells, depth):
        gain, k = cut(cells) if depth else (0.0, 0)
        if gain <= 1e-12:
            return [value(sum(cells, []))] * len(cells)
        return tree(cells[:k], depth - 1) + tree(cells[k:], depth - 1)

    def quadrants(cells):
        rows = sum((c for line in cells for c in line), [])
        best, out = -1.0, [[value(rows)] * len(cells[0]) for _ in cells]
        for turned in (False, True):
            grid = [list(c) for c in zip(*cells)] if turned else cells
            for k in range(1, len(grid)):
                gain, made = 0.0, []
                for lines in (grid[:k], grid[k:]):
                    across = [sum((line[j] for line in lines), []) for j in range(len(grid[0]))]
                    if len(sum(across, [])) < q.LEAST_LEAF:
                        gain = -1.0
                        break
                    _, j = cut(across)
                    left, right = sum(across[:j], []), sum(across[j:], [])
                    gain += part(left) + part(right)
                    made += [[value(left)] * j + [value(right)] * (len(across) - j) for _ in lines]
                if gain > best + 1e-12:
                    best, out = gain, [list(c) for c in zip(*made)] if turned else made
        return best - part(rows), out

    def gradients():
        ps = [1 / (1 + math.exp(-raw(r))) for r in x]
        return [(t - p, p * (1 - p)) for t, p in zip(y, ps)]

    for _ in range(rounds):
        for j in range(m):
            if len(tables[j]) > 1:
                cells = [[] for _ in tables[j]]
                for r, gh in zip(x, gradients()):
                    cells[place(cuts[j], r[j])].append(gh)
                tables[j] = [t + q.RATE * s for t, s in zip(tables[j], tree(cells, q.DEPTH))]

    def cells_of(a, b, gs):
        cells = [[[] for _ in range(len(coarse[b]) + 1)] for _ in range(len(coarse[a]) + 1)]
        for r, gh in zip(x, gs):
            cells[place(coarse[a], r[a])][place(coarse[b], r[b])].append(gh)
        return cells

    gs = gradients()
    ranked = sorted((-round(quadrants(cells_of(a, b, gs))[0], 9), a, b) for a in range(m) for b in range(a + 1, m) if coarse[a] and coarse[b])[:n_pairs]
    for _, a, b in ranked:
        grids[a, b] = [[0.0] * (len(coarse[b]) + 1) for _ in range(len(coarse[a]) + 1)]
    for _ in range(pair_rounds):
        for a, b in list(grids):
            step = quadrants(cells_of(a, b, gradients()))[1]
            grids[a, b] = [[t + q.RATE * s for t, s in zip(ts, ss)] for ts, ss in zip(grids[a, b], step)]
    return lambda r: 1 / (1 + math.exp(-raw(r)))


def test_quality_by_a_plain_fit(monkeypatch):
    how = {"BINS": 7, "COARSE": 4, "ROUNDS": 4, "PAIR_ROUNDS": 3, "PAIRS": 2}
    for k, v in how.items():
        monkeypatch.setattr(quality_gam, k, v)
    rng = np.random.default_rng(4)
    x = np.round(rng.random((160, 4)), 3)
    x[:, 3] = 1.0  # tells nothing
    y = (((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6)) | (x[:, 2] > 0.9)).astype(float)
    plain = plain_fit(x.tolist(), y.tolist(), 7, 4, 4, 3, 2)
    fresh = np.round(rng.random((50, 4)), 3)
    want = [plain(r) for r in fresh.tolist()]
    assert quality_gam.fit(x, y).score(fresh) == pytest.approx(want, abs=1e-9)


def test_quality_tables_find_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert {(a, b) for a, b, _ in model.pairs} >= {(0, 1)}
    fresh = rng.random((1000, 4))
    assert auc(model.score(fresh), ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5)).astype(float)) > 0.95


# 3


def test_language_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 30").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.97


def test_language_takes_the_text_alone(small):
    docs, _ = small
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = docs.withColumns({"lang": F.when(~held, F.col("lang")).otherwise(F.lit("en")), "source": F.lit("x")})
    plain = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(other).collect()} == plain


def test_mixture_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, table, _ = langid.learn(docs)
    letters = langid.letter_table(langid.letter_bits())
    long = {k: docs.where((F.col("lang") == k) & (F.length("text") > 3000)).first()["text"][:3000] for k in ("en", "fr")}
    for share in (0.25, 0.5, 0.75):
        cut = int(3000 * share)
        pi = langid.infer(langid.grams(long["en"][:cut] + " " + long["fr"][cut:], letters), table)
        assert pi[names.index("en")] == pytest.approx(share, abs=0.1)
        assert pi[[i for i, n in enumerate(names) if n not in ("en", "fr")]].sum() < 0.02
    assert np.count_nonzero(langid.infer(langid.grams(long["fr"], letters), table)) == 1


def test_mixtures_by_plain_loops(spark, small):
    """The counts, the probabilities, EM and the elimination once more, one gram and one language at a time."""
    docs, rows = small
    docs = docs.where("length(text) < 3000")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])[:60]
    letters = langid.letter_table(langid.letter_bits())
    bits = 12
    counts = defaultdict(Counter)
    for r in docs.collect():
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts[r["lang"]].update(langid.grams(r["text"] or "", letters, bits).tolist())
    langs = sorted(counts)
    total = {k: sum(counts[k].values()) + langid.PSEUDO * 2**bits for k in langs}
    p = lambda k, g: (counts[k][g] + langid.PSEUDO) / total[k]

    def em(grams, chosen):
        pi = {k: 1 / len(chosen) for k in chosen}
        for _ in range(langid.STEPS if len(chosen) > 1 else 0):
            new = dict.fromkeys(chosen, 0.0)
            for g, n in grams.items():
                joint = {k: p(k, g) * pi[k] for k in chosen}
                for k in chosen:
                    new[k] += n * joint[k] / sum(joint.values()) / sum(grams.values())
            moved = max(abs(new[k] - pi[k]) for k in chosen)
            pi = new
            if moved < 1e-4:
                break
        return pi, sum(n * math.log(sum(p(k, g) * pi[k] for k in chosen)) for g, n in grams.items())

    got = {r["doc_id"]: r for r in langid.identify(docs, bits).collect()}
    for r in rows:
        grams = Counter(langid.grams(r["text"] or "", letters, bits).tolist())
        if not grams:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        chosen = list(langs)
        pi, fit = em(grams, chosen)
        while len(chosen) > 1:  # every language goes by itself here, those that EM gave up too
            rest = [k for k in chosen if k != min(chosen, key=lambda k: pi[k])]
            new_pi, new_fit = em(grams, rest)
            if new_fit + langid.PENALTY * math.log(sum(grams.values()) + 1) < fit:
                break
            chosen, pi, fit = rest, new_pi, new_fit
        best = max(langs, key=lambda k: pi.get(k, 0))
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["score"] == pytest.approx(pi[best], abs=1e-6)
        explained = sum(n for g, n in grams.items() if any(counts[k][g] for k in chosen)) / sum(grams.values())
        assert got[r["doc_id"]]["explained"] == pytest.approx(explained)


def test_any_number_of_languages(spark, small):
    docs, _ = small
    docs = docs.where("length(text) < 2000").unionByName(docs.where("doc_id < 5"))
    one, other = (Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9), round(r["explained"], 9)) for r in langid.identify(docs, 12, dense).collect()) for dense in (500, 2))
    assert one == other
    one, other = (Counter(map(tuple, langid.keep_known(docs, bits=12, dense=dense).collect())) for dense in (500, 2))
    assert one == other


def test_stage_keeps_mixtures_and_drops_what_no_language_explains(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = {k: docs.where((F.col("lang") == k) & (F.length("text") > 3000)).first()["text"] for k in ("en", "fr", "de")}
    mixture = "\n".join(long[k][:n] for k, n in (("en", 1200), ("fr", 1000), ("de", 800)))
    more = [(10**6, mixture, None, "s", 3000), (10**6 + 1, "zxqj vkkq wwpz qqxz " * 20, None, "s", 400), (10**6 + 2, "ελευθεροι γεννιουνται ολοι", None, "s", 26), (10**6 + 3, "1234 5678", None, "s", 9)]
    kept = {r["doc_id"] for r in langid.keep_known(docs.unionByName(spark.createDataFrame(more, docs.schema))).where("doc_id >= 1000000").collect()}
    assert kept == {10**6}


# 4


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_of_the_library(spark, small):
    docs, rows = small
    odd = ["<|endoftext|>", "a b c\x1c\x1d\x85d", "don't I'LL we've", "   \n\n  x \t", "日本語のテキスト ١٢٣ ²³½", "😀" * 50, "﻿x​y", "aaaa" * 3000, "\r\n\r\nz", "ªº µ ÿß", None]
    texts = [r["text"] for r in rows] + odd
    e = encoder()
    for chunk in (50_000, bpe.CHUNK_BYTES):
        got = bpe.round_trip(frame(spark, texts), PATH, public_tokenizers.PATTERN, chunk).orderBy("doc_id").collect()
        for r, t in zip(got, texts, strict=True):
            ids = e.encode_ordinary(t or "")
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == brute.sha(np.array(ids, "<u4").tobytes())
            assert r["decoded_sha256"] == brute.sha((t or "").encode())


def test_tokens_of_rows_that_repeat(spark):
    rows = [(1, "the same row again", "en", "s", None)] * 9 + [(None, None, "en", "s", None)] * 4 + [(i, f"row {i}", "en", "s", None) for i in range(2, 6)]
    got = bpe.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, public_tokenizers.PATTERN, repeats=2).collect()
    e = encoder()
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == Counter((i, len(e.encode_ordinary(t or "")), brute.sha((t or "").encode())) for i, t, *_ in rows)


# 5


def altered(rng, text, share):
    w = text.split()
    for i in rng.sample(range(len(w)), int(len(w) * share)):
        w[i] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark, small):
    docs, rows = small
    rng = random.Random(5)
    texts = [r["text"] for r in rows]
    for base in [t for t in texts if len(t.split()) > 60][:25]:
        texts += [base, altered(rng, base, 0.01), altered(rng, base, 0.1), " ".join(base.split()[3:])]
    texts += ["one two three", "one two three", "one two four", "", None, "x " * 40, "x " * 41, "a b c d e", "a b c d e f"]
    # a chain: each link above the threshold, its ends far apart
    chain = [f"c{i}" for i in range(300)]
    texts += [" ".join([*chain[: 300 - 10 * k], *[f"d{i}" for i in range(10 * k)]]) for k in range(12)]
    want = brute.near_duplicate_classes(list(enumerate(texts)))
    got = near_dup.classes(frame(spark, texts)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["keep"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_registers_agree_as_often_as_the_likeness():
    rng = random.Random(2)
    w = [f"q{i}" for i in range(400)]
    a, b = w[:320] * 2 + w[:100], w[60:400] + w[80:200]
    rng.shuffle(b)
    b = a[:500] + b[:60]
    bags = [brute.weighted_shingles(" ".join(x)) for x in (a, b)]
    doc, sh, weight = near_dup.shingles([" ".join(x).encode() for x in (a, b)])
    sig = near_dup.signatures(doc, sh, weight, 2, 8192)
    want = brute.probability_jaccard(*bags)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)
    cut = np.searchsorted(doc, [0, 1, 2])
    assert near_dup.likeness(*[(sh[i:j], weight[i:j]) for i, j in zip(cut, cut[1:])]) == pytest.approx(want)


# 6


@pytest.mark.parametrize("length,gram", [(100, 24), (20, 7)])
def test_repeated_bytes(spark, small, length, gram):
    docs, rows = small
    rng = random.Random(6)
    texts = [r["text"] for r in rows] if length == 100 else []
    letters = "abcdé日😀 "
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    passage = "".join(rng.choice("abcdefghijkl ") for _ in range(3 * length))
    texts += [passage, "x" + passage, passage[: length - 1], passage[:length], passage[1 : length + 1] + "y", passage + passage, passage[length // 2 :] + passage[: length // 2], "a" * (3 * length), "ab" * length, "a" * length, "a" * (length + 1), "", None]
    texts += ["".join(rng.choice(texts[-20:]) or "" for _ in range(4)) for _ in range(20)]
    want = brute.repeated_bytes(list(enumerate(texts)), length)
    for limit in (suffix_dedup.KINDS, 3):
        for r in suffix_dedup.report(frame(spark, texts), length, gram, limit).collect():
            n, gone, spans, kept = want[r["doc_id"]]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, brute.sha(kept)), r["doc_id"]
    if length == 100:
        for r in suffix_dedup.strip(frame(spark, texts)).collect():
            kept = want[r["doc_id"]][3]
            if texts[r["doc_id"]] is None:
                assert r["text"] is None
            elif texts[r["doc_id"]].isascii():
                assert r["text"].encode() == kept and r["n_chars"] == len(kept)
            else:
                assert len(kept) <= len(r["text"].encode()) <= len(kept) + 6 * want[r["doc_id"]][2]


@pytest.mark.parametrize("length", [100, 24, 9, 8, 5])
def test_digit_passes(length):
    rng = np.random.default_rng(0)
    slab = rng.integers(0, 2, 4000).astype(np.uint8)
    slab[1000:1300] = slab[2000:2300]
    at = np.sort(rng.choice(4000 - length - 8, 900, replace=False))
    at, group = np.concatenate([at, at]), np.concatenate([rng.integers(0, 3, len(at)), rng.integers(0, 3, len(at))])
    got = suffix_dedup.equal_windows(slab, at, group, length)
    want = [(g, slab[a : a + length].tobytes()) for a, g in zip(at.tolist(), group.tolist(), strict=True)]
    number, several = {}, Counter(want)
    for w, n in zip(want, got.tolist(), strict=True):
        assert (n == -1) == (several[w] == 1) and (n == -1 or number.setdefault(w, n) == n)
    assert len(set(number.values())) == len(number)


def test_repeated_bytes_of_rows_that_repeat(spark):
    rng = random.Random(61)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, f"{word()} {passage} {word()}", "en", "s", None) for i in range(5)] + [(7, f"x {passage}", "en", "s", None)] * 6
    want = brute.repeated_bytes([(i, t) for i, t, *_ in rows[:6]])
    got = suffix_dedup.report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got) == Counter((i, want[i][1], brute.sha(want[i][3])) for i, *_ in rows)


# 7


def simhash(spark, texts):
    """{text: fingerprint} by votes counted one at a time; only single hashes are Spark's."""
    words = {t: brute.words(t) for t in texts}
    every = sorted({w for ws in words.values() for w in ws})
    one = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()} if every else {}
    runs = {t: [tuple(one[w] for w in ws[i : i + 3]) for i in range(len(ws) - 2)] or ([tuple(one[w] for w in ws)] if ws else []) for t, ws in words.items()}
    many = sorted({r for rs in runs.values() for r in rs})
    frames = [(r,) for r in many]
    hashed = {}
    for r in spark.createDataFrame(frames, "r array<long>").select("r", F.when(F.size("r") == 3, F.xxhash64(*[F.get("r", i) for i in range(3)])).otherwise(F.xxhash64("r")).alias("h")).collect():
        hashed[tuple(r["r"])] = r["h"] % 2**64
    return {t: sum(1 << i for i in range(64) if sum(1 if hashed[r] >> i & 1 else -1 for r in rs) > 0) for t, rs in runs.items()}


def test_fingerprints_of_a_whole_table(spark, small):
    docs, rows = small
    want = simhash(spark, {r["text"] for r in rows})
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs).collect()}
    assert all(int(got[r["doc_id"]]["fingerprint"], 16) == want[r["text"]] for r in rows)
    for r in rows:
        near = sum((want[r["text"]] ^ want[o["text"]]).bit_count() <= 3 for o in rows) - 1
        assert got[r["doc_id"]]["near_docs"] == (near if r["doc_id"] % 100 == 0 else None)


def test_fingerprints_of_rows_that_share_an_id(spark):
    """All rows have one id or none, some are repeated; each is followed by the next in order of id and hash of the text."""
    rows = [(None, f"text {i} of many", "en", "s", None) for i in range(20)] + [(None, "one text again and again", "en", "s", None)] * 7 + [(300, f"late {i}", "en", "s", None) for i in range(6)] + [(300, "late again", "en", "s", None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    h = {r["t"]: r["h"] for r in docs.select(F.col("text").alias("t"), F.xxhash64("text").alias("h")).collect()}
    order = sorted(((-1 if i is None else i), h[t], t) for i, t, *_ in rows)
    want = Counter()
    for k, (i, _, t) in enumerate(order):
        n = len(t) // 4
        want[None if i < 0 else i, brute.sha((t[: len(t) - n] + order[(k + 1) % len(order)][2][:n]).encode())] += 1
    near = {t: sum(x == t for *_, x in order) for t in h}
    for buckets, repeats in ((1, 1000), (8, 1000), (8, 2)):
        got = fingerprints.compare_with_next(docs, buckets, repeats, asking=300).collect()
        assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want
        assert all((r["near_docs"] is None) == (r["doc_id"] is None) for r in got)
        assert all(r["near_docs"] >= near["late again"] - 1 for r in got if r["doc_id"] == 300 and r["n_chars"] == 10)


def test_fingerprints(spark, small):
    docs, rows = small
    rows = sorted((r["doc_id"], r["text"]) for r in rows)
    for buckets in (1, 6):
        got = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs, buckets).collect()}
        for i, (key, text) in enumerate(rows):
            follows = rows[(i + 1) % len(rows)]
            n = len(text)
            k = n // 4
            edited = text[: n - k] + follows[1][:k]
            r = got[key]
            assert r["n_chars"] == n and r["edited_sha256"] == brute.sha(edited.encode())
            differ = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
            assert r["near_edited"] == differ(r["fingerprint"], r["edited_fingerprint"])
            assert r["near_next"] == differ(r["fingerprint"], got[follows[0]]["fingerprint"])
    same = defaultdict(set)
    for key, text in rows:
        same[text].add(got[key]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()]) + 0.2


def test_votes(spark):
    text = "a b c d a b c"
    terms = spark.createDataFrame([("a", "b", "c"), ("b", "c", "d"), ("c", "d", "a"), ("d", "a", "b"), ("a", "b", "c")], "x string, y string, z string")
    h = [r[0] % 2**64 for r in terms.select(F.xxhash64(F.xxhash64("x"), F.xxhash64("y"), F.xxhash64("z"))).collect()]
    want = sum(1 << i for i in range(64) if sum(2 * (x >> i & 1) - 1 for x in h) > 0)
    got = fingerprints.compare_with_next(frame(spark, [text])).first()
    assert int(got["fingerprint"], 16) == want


def test_all_pairs_within_a_radius(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = base + [b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (1, 2, 3, 4)] + base[:10] + [0, 2**64 - 1]
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    d = spark.createDataFrame(list(enumerate(signed)), "id long, fingerprint long")
    got = {(r["fp_a"], r["fp_b"], r["distance"]) for r in fingerprints.hamming_pairs(d, 3).collect()}
    distinct = sorted(set(signed))
    want = {(a, b, c) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (c := ((a ^ b) % 2**64).bit_count()) <= 3}
    assert got == want


# 8


def test_rule_counts(spark, small):
    docs, rows = small
    texts = [r["text"] for r in rows] + [SENTENCE * 4, "a b c d e f g h " * 3, "a " * 30, "x\n\n x\nx\nx", "\x0b\x0c\x1c #*$%&|<>", None, "", "é" * 5]
    got = rules.counts(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.rule_counts(t)


def test_thresholds_follow_their_group(spark):
    rng = random.Random(8)
    plain = lambda: " ".join(f"{rng.choice('abcdef')}{rng.randrange(1000)}" for _ in range(60))
    marked = lambda: " ".join(f"#{rng.randrange(1000)}" for _ in range(60))
    rows = [(i, plain(), "en", "prose", 0) for i in range(100)] + [(100 + i, marked(), "en", "tags", 0) for i in range(100)] + [(200, marked(), "en", "prose", 0), (201, plain(), "en", "new", 0)]
    got = {r["doc_id"]: r["kept"] for r in rules.judge(rules.counts(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert not got.pop(200)
    assert all(got.values())


# 9


def test_mixing(spark, small):
    docs, _ = small
    docs = docs.unionByName(docs.withColumns({"source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10**6}))
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(brute.words(r["text"]))
    want = brute.mixing_targets(sizes)
    got = mixing.mix(docs).collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    taken, most = Counter(), Counter()
    for r in got:
        assert r["size"] == len(brute.words(text[r["doc_id"]])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and abs(r["copies"] - r["rate"]) <= 1
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    # the dual: the rate is 2 * sigmoid(lam * size / scale), with sums that meet the targets
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(want[s], rel=1e-6)
        open_ones = [r for r in own if r["size"] and 0 < r["rate"] < 2]
        slopes = [math.log(r["rate"] / (2 - r["rate"])) / r["size"] for r in open_ones]
        assert not slopes or max(slopes) - min(slopes) <= 1e-6 * max(1e-3, max(map(abs, slopes)))


def test_mixing_takes_exactly_as_planned(spark):
    """Every cell gives floor(rate) copies of each row and the cell's further ones, also where many rows are equal."""
    rows = [(None if i % 2 else 7, " ".join(["w"] * (1 + i % 9)), "en", "ab"[i % 2], None) for i in range(400)] + [(i, f"w w {i}", "en", "a", None) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    cells, want = defaultdict(list), Counter()
    for r in got:
        cells[r["source"], r["size"]].append(r["copies"])
        want[r["source"]] = r["target"]
    assert len(got) == len(rows) and all(max(x) - min(x) <= 1 for x in cells.values())
    assert any(max(x) != min(x) for x in cells.values())
    for s, target in want.items():
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target) <= 9
    # apply() takes what mix() says
    taken = Counter((r["source"], r["size"]) for r in got for _ in range(r["copies"]))
    assert Counter((r["source"], len(r["text"].split())) for r in mixing.apply(docs).collect()) == taken


# 10


def test_differencing_by_hand():
    sizes = [8, 7, 6, 5, 4]
    heap = [-s for s in sizes]
    heapq.heapify(heap)
    while len(heap) > 1:  # two-way differencing keeps differences only
        heapq.heappush(heap, -abs(heapq.heappop(heap) - heapq.heappop(heap)))
    desc, went = sharding.difference_single(sizes, 2)
    assert desc[0] - desc[1] == -heap[0] == 2
    assert sorted(sum(s for s, w in zip(sizes, went, strict=True) if w == k) for k in range(2)) == [14, 16]
    desc, went = sharding.difference([[s, 0, 0] for s in (9, 8, 7, 6, 5, 4)], 3)
    loads = Counter()
    for s, w in zip((9, 8, 7, 6, 5, 4), went, strict=True):
        assert sorted(w) == [0, 1, 2]
        loads[w[0]] += s
    assert sorted(loads.values()) == sorted(desc) == [13, 13, 13]


@pytest.mark.parametrize("block", [20_000, 11])
def test_shards(spark, small, block):
    docs, rows = small
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 3"))
    k = 7
    got = sharding.shards(docs, k, block).collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    place, slots, load, group = defaultdict(set), defaultdict(list), Counter(), Counter()
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 16 and r["text_crc32"] == zlib.crc32(t.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        place[t].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        group[t] += r["size"]
    assert len(got) == docs.count()
    assert all(len(x) == 1 for x in place.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(k))
    mean = sum(load.values()) / k
    assert max(load.values()) <= max(1.01 * mean, max(group.values()) * 1.001)
