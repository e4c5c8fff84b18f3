"""Byte-level BPE: encode each distinct word once, join the ids back, decode by the token-byte table.

Texts are dealt by hashed id and text into chunks of about CHUNK_BYTES bytes, the
only time that they move. Rows that are equal in id and text, where there are
more than REPEATS of them, go as one row with their number, so that no chunk
receives a row's copies. Then

1. each chunk lists its distinct pre-tokens ("words") and sends them, by hash,
   to buckets: one row for each chunk and bucket, its words in order, end to
   end and compressed. A word that occurs often in a chunk is sent
   once, so frequent words make no hot bucket;
2. each bucket encodes its distinct words, every one once in the whole corpus,
   and sends each chunk the ids of its words, in the order they came in;
3. each chunk, which meets its ids by a cogroup on the chunk's number, lists its
   pre-tokens with their positions again, looks up their ids, and puts them
   together by position: an array gather over all positions of the chunk.

Positions are those of the list itself, so they need no columns of their own.
Decoding looks every id up in the table of token bytes.

A match of the pattern is a word; encoding a word by itself gives what the
library gives for the whole text, since it merges within matches only. For
texts in Latin-1 the pattern is run by `re` with the classes spelled out, for
others by `regex`; both take exactly the characters of Unicode's White_Space
property as blanks.

Nulls: a null text is empty; a null doc_id comes back as null. Empty texts have no
ids. Repeated rows give equal rows, one for each. Empty tables give empty results.
Further columns are not read. A chunk is in memory as a whole: about CHUNK_BYTES
of text, or a single longer text.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import collapsed, id_of, key_of, shuffle_partitions, text_or_empty

CHUNK_BYTES = 16 << 20
REPEATS = 1000
ZSTD_LEVEL = 3


def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def patterns(pattern: str) -> tuple[re.Pattern, regex.Pattern]:
    """The pattern for Latin-1 texts and for all texts."""
    wide = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def spelled(prop: str) -> str:
        return "".join(f"\\x{c:02x}" for c in range(256) if regex.match(rf"\p{{{prop}}}", chr(c)))

    letter, number, blank = spelled("L"), spelled("N"), spelled("White_Space")
    narrow = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(narrow.replace(r"\S", f"[^{blank}]").replace(r"\s", f"[{blank}]")), wide


def pre_tokens(text: str, narrow: re.Pattern, wide: regex.Pattern) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return wide.findall(text)
    return narrow.findall(text)


def _in_order(t: pa.Table) -> list[tuple]:
    """(key, text, copies) of a chunk, in an order that both its readers find."""
    copies = t["copies"].to_pylist() if "copies" in t.column_names else [1] * t.num_rows
    return sorted(zip(t["key"].to_pylist(), t["text"].to_pylist(), copies, strict=True))


def _vocabulary(rows: list[tuple], pattern: str) -> tuple[dict[str, int], list[np.ndarray]]:
    """The distinct words by first occurrence, and for each text the numbers of its words."""
    numbers: dict[str, int] = {}
    texts = []
    both = patterns(pattern)
    for _, text, _ in rows:
        words = pre_tokens(text, *both)
        texts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
    return numbers, texts


def _buckets(words: list[bytes], n: int) -> np.ndarray:
    of = xxhash.xxh3_64_intdigest
    return (np.fromiter((of(w) for w in words), np.uint64, len(words)) % np.uint64(n)).astype(np.int64)


def _ordered(numbers: dict[str, int], n_buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words by number, their numbers in order of bucket and word, and the buckets in that order."""
    words = [w.encode("utf-8", "surrogatepass") for w in numbers]
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    bucket = _buckets(words, n_buckets)[order]
    by = np.argsort(bucket, kind="stable")
    return words, order[by], bucket[by]


def _id_type(n_ranks: int) -> type:
    return np.uint16 if n_ranks <= 1 << 16 else np.uint32


def _send_words(pattern: str, n_buckets: int):
    def run(t: pa.Table) -> pa.Table:
        numbers: dict[str, int] = {}
        both = patterns(pattern)
        for _, text, _ in _in_order(t):
            for w in dict.fromkeys(pre_tokens(text, *both)):
                numbers.setdefault(w, len(numbers))
        words, order, bucket = _ordered(numbers, n_buckets)
        cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
        pack = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress
        out = {"chunk": [], "bucket": [], "sizes": [], "words": []}
        for b in np.flatnonzero(np.diff(cut)).tolist():
            some = [words[i] for i in order[cut[b] : cut[b + 1]].tolist()]
            out["chunk"].append(t["chunk"][0].as_py())
            out["bucket"].append(b)
            out["sizes"].append(pack(np.array([len(w) for w in some], np.uint32).tobytes()))
            out["words"].append(pack(b"".join(some)))
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("sizes", pa.binary()), ("words", pa.binary())]))

    return run


def _encode_bucket(ranks: dict[bytes, int], pattern: str):
    def run(t: pa.Table) -> pa.Table:
        encoder = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        kind = _id_type(len(ranks) and max(ranks.values()) + 1)
        width = np.dtype(kind).itemsize
        pack, unpack = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress, zstandard.ZstdDecompressor().decompress
        known: dict[bytes, bytes] = {}
        out = {"chunk": t["chunk"], "bucket": t["bucket"], "counts": [], "ids": []}
        for sizes, raw in zip(t["sizes"].to_pylist(), t["words"].to_pylist(), strict=True):
            ends = np.cumsum(np.frombuffer(unpack(sizes), np.uint32), dtype=np.int64).tolist()
            raw = unpack(raw)
            parts, at = [], 0
            for end in ends:
                w = raw[at:end]
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = np.array(encoder.encode_ordinary(w.decode("utf-8", "replace")), kind).tobytes()
                parts.append(ids)
                at = end
            out["counts"].append(pack(np.array([len(p) // width for p in parts], np.uint32).tobytes()))
            out["ids"].append(pack(b"".join(parts)))
        out["counts"], out["ids"] = pa.array(out["counts"], pa.binary()), pa.array(out["ids"], pa.binary())
        return pa.table(out)

    return run


def _put_together(pattern: str, n_buckets: int, table: list[bytes]):
    kind = pa.schema([("key", pa.int64()), ("copies", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(docs: pa.Table, coded: pa.Table) -> pa.Table:
        rows = _in_order(docs)
        numbers, texts = _vocabulary(rows, pattern)
        _, order, _ = _ordered(numbers, n_buckets)
        del numbers
        unpack = zstandard.ZstdDecompressor().decompress
        by = sorted(zip(coded["bucket"].to_pylist(), coded["counts"].to_pylist(), coded["ids"].to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(unpack(c), np.uint32) for _, c, _ in by]]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(unpack(i), _id_type(len(table))) for *_, i in by]])
        if len(counts) != len(order):
            raise ValueError("a chunk's words and their ids do not match")
        # of each word, by its number: where its ids begin, and how many there are
        begin, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        begin[order], many[order] = np.cumsum(counts) - counts, counts
        out = {c: [] for c in kind.names}
        for (key, _, copies), at in zip(rows, texts, strict=True):
            n = many[at]
            total = int(n.sum())
            own = ids[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(total)]
            out["key"].append(key)
            out["copies"].append(copies)
            out["n_tokens"].append(total)
            out["ids_sha256"].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decode(own.tolist(), table)).hexdigest())
        return pa.table(out, schema=kind)

    return run


def decode(ids: list[int], table: list[bytes]) -> bytes:
    """The bytes of a list of ids."""
    return b"".join(map(table.__getitem__, ids))


def byte_table(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def _chunks(docs: DataFrame, chunk_bytes: int, repeats: int) -> tuple[DataFrame, int]:
    """(key, text[, copies], chunk) and the number of chunks; copies is there if rows occur more than repeats times."""
    d, _ = collapsed(docs.select(key_of(F.col("doc_id")).alias("key"), text_or_empty(F.col("text")).alias("text")), repeats, "bpe-repeats")
    total = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    return d.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(n)).cast("long")), n


def _coded(d: DataFrame, n_chunks: int, ranks: dict[bytes, int], pattern: str) -> tuple[DataFrame, int]:
    """(chunk, bucket, counts, ids): for each chunk the ids of its words."""
    n_buckets = max(shuffle_partitions(d.sparkSession), n_chunks // 4)
    sent = d.groupBy("chunk").applyInArrow(_send_words(pattern, n_buckets), "chunk long, bucket long, sizes binary, words binary")
    return sent.groupBy("bucket").applyInArrow(_encode_bucket(ranks, pattern), "chunk long, bucket long, counts binary, ids binary"), n_buckets


def round_trip(docs: DataFrame, path: str, pattern: str, chunk_bytes: int = CHUNK_BYTES, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each document."""
    ranks = rank_table(path)
    d, n = _chunks(docs, chunk_bytes, repeats)
    coded, n_buckets = _coded(d, n, ranks, pattern)
    kind = "key long, copies long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = d.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(_put_together(pattern, n_buckets, byte_table(ranks)), kind)
    if "copies" in d.columns:
        out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(id_of(F.col("key")).alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
