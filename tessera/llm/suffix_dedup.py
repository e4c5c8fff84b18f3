"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte is removed if some LENGTH-byte string that covers it also starts
earlier: in a document of smaller id, or earlier in the same document. Only
equality through LENGTH bytes matters, so suffixes are ordered to that depth
and no further, by most-significant-digit passes; after the last pass the
groups of equal suffixes are exactly the repeated windows.

Digits. A suffix's key is its first LENGTH bytes, turned so that the digit that
best tells suffixes apart comes first: its anchor, the GRAM-byte string of
least hash in it (the leftmost of equals). Equal windows have equal anchors at
equal offsets, so the order by turned keys has the same groups. Neighbouring
windows share their anchor, so that a pass handles a run of windows at a time.

1. Pass on anchors. Each run gives (hash of its anchor, hash of the bytes its
   windows cover, id). Anchors of one occurrence drop out: their windows
   cannot be repeated. For the others: the least id, and whether all
   occurrences have equal surroundings.
2. Runs with a repeated anchor. If its surroundings are the same everywhere,
   the whole run is repeated wherever the id is not the least. The others are
   grouped by anchor and surroundings: a run is repeated as a whole if a smaller
   id has an equal one; the first of its kind stays open.
3. Pass on the rest of the window. Open runs go to their anchor, with the bytes
   that their windows cover, once and not once for each window; there windows
   are told apart by offset to the anchor and hash. An anchor with more than
   KINDS open runs would be a large group: each window of those goes by itself
   as (hash of its LENGTH bytes, id), and is repeated where a smaller id has it.

Repeats inside one document need no pass between documents: they are found
where the document is, by the same two digits.

Passes are aggregations with partial sums on the map side, so one passage in
a third of all documents is one row for each map task; the joins back to
documents are plain shuffles whose hot keys AQE can split. Hashes have 64 bits
for anchors, 128 for anchors with surroundings, for windows with their anchor
and for windows by themselves. What a pass finds is staged
in the shared folder, which ends lineage and lets shuffle files go.

Nulls: a null text is empty; a null doc_id orders first. Rows that share a
doc_id rank alike and never make each other's bytes repeated; they are told
apart by their text's hash. Texts shorter than LENGTH lose nothing. Empty tables
give empty results. Time and memory are linear in a text's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import id_of, key_of, release, stage_table, text_or_empty

LENGTH = 100
GRAM = 24
#: Bytes of text that are worked on at once.
SLAB = 2 << 20
#: Windows in a batch.
WINDOWS = 50_000
#: Open runs of an anchor that are compared in one group at most.
KINDS = 5_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of gram bytes, by doubling; the last gram - 1 places are garbage."""
    h = (b.astype(np.uint64) + np.uint64(1)) * ODD
    h ^= h >> np.uint64(29)
    total, have, done = None, 1, 0
    cur = h
    mult = np.uint64(0xD6E8FEB86659FD93)
    while True:
        if gram & have:
            if total is None:
                total, done = cur.copy(), have
            else:
                shifted = np.zeros_like(cur)
                shifted[: len(cur) - done] = cur[done:]
                total = total * (mult | np.uint64(2 * have + 1)) + shifted
                done += have
        if have * 2 > gram:
            break
        nxt = cur * (mult + np.uint64(2 * have))
        nxt[: len(cur) - have] += cur[have:]
        nxt ^= nxt >> np.uint64(31)
        cur, have = nxt, have * 2
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xC2B2AE3D27D4EB4F)
    total ^= total >> np.uint64(29)
    return total


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours; len(x) - w + 1 values."""
    cur, have = x, 1
    while have * 2 <= w:
        cur = np.minimum(cur[: len(cur) - have], cur[have:])
        have *= 2
    if have < w:
        cur = np.minimum(cur[: len(x) - w + 1], cur[w - have :])
    return cur[: len(x) - w + 1]


def runs(slab: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor, in texts laid end to end.

    Returns (document's number, first window, last window, anchor's hash,
    anchor's place); places are those of the slab.
    """
    empty = np.zeros(0, np.int64)
    if len(slab) < length:
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    h = _gram_hashes(slab, gram)
    w = length - gram + 1
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(slab), dtype=np.uint64)
    anchors = (_sliding_min(keys[: len(slab) - gram + 1], w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that lie in one text
    n = len(anchors)
    fits = np.zeros(n + 1, np.int32)
    ok = ends - starts >= length
    s, e = starts[ok], ends[ok] - length + 1
    np.add.at(fits, s, 1)
    np.add.at(fits, np.minimum(e, n), -1)
    fits = np.cumsum(fits[:n]) > 0
    first = fits.copy()
    first[1:] &= (anchors[1:] != anchors[:-1]) | ~fits[:-1]
    first[s] = True
    begin = np.flatnonzero(first)
    last = fits.copy()
    last[:-1] &= first[1:] | ~fits[1:]
    finish = np.flatnonzero(last)
    doc = np.searchsorted(starts, begin, side="right") - 1
    # empty texts share their start with the next one; the last of equals is the one with bytes
    return doc, begin, finish, h[anchors[begin]], anchors[begin]


def _slabs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """(columns, bytes, starts, ends) of about SLAB bytes; a larger text is a slab by itself."""
    held, size = [], 0

    def lay(rows: list) -> tuple:
        texts = [r[0] for r in rows]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return {c: [r[i + 1] for r in rows] for i, c in enumerate(columns)}, np.frombuffer(b"".join(texts), np.uint8), starts, ends

    for batch in batches:
        texts = batch.column("body").to_pylist()
        others = [batch.column(c).to_pylist() for c in columns]
        for row in zip(texts, *others, strict=True):
            held.append(row)
            size += len(row[0])
            if size >= SLAB:
                yield lay(held)
                held, size = [], 0
    if held:
        yield lay(held)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _digest(raw: memoryview) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def _anchor_rows(length: int, gram: int, places: bool):
    """For each run: (g, c, key[, th, run]), hashes of its anchor and of all bytes its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = xxhash.xxh3_64_intdigest
        for cols, slab, starts, ends in _slabs(batches, ["key", "th"]):
            doc, begin, finish, g, anchor = runs(slab, starts, ends, length, gram)
            if not len(doc):
                continue
            raw = memoryview(slab)
            c = np.fromiter((of(raw[a:z]) for a, z in zip(begin.tolist(), (finish + length).tolist(), strict=True)), np.uint64, len(begin))
            out = {"g": _signed(g), "c": _signed(c), "key": np.asarray(cols["key"], np.int64)[doc]}
            if places:
                out |= {"th": np.asarray(cols["th"], np.int64)[doc], "run": _packed(begin - starts[doc], finish - begin, anchor - begin)}
            yield pa.record_batch(out)

    return run


def _window_rows(length: int):
    """Hashes of the windows of the runs that are still open: (w1, w2, key, th, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def put() -> pa.RecordBatch:
            n = [len(at) for *_, at in held]
            d = np.frombuffer(b"".join(x for x, *_ in held), np.int64).reshape(-1, 2)
            key, th = (np.repeat(np.array([h[i] for h in held], np.int64), n) for i in (1, 2))
            return pa.record_batch({"w1": d[:, 0].copy(), "w2": d[:, 1].copy(), "key": key, "th": th, "at": np.concatenate([h[3] for h in held])})

        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for body, key, th, todo in zip(*[batch.column(c).to_pylist() for c in ("body", "key", "th", "open")], strict=True):
                if (key, th) in seen:  # a row that is repeated
                    continue
                seen.add((key, th))
                at, raw = _windows_of(todo), memoryview(body)
                for i in range(0, len(at), WINDOWS):
                    some = at[i : i + WINDOWS]
                    held.append((b"".join([_digest(raw[a : a + length]) for a in some.tolist()]), key, th, some))
                    size += len(some)
                    if size >= WINDOWS:
                        yield put()
                        held, size = [], 0
        if held:
            yield put()

    return run


def _packed(first: np.ndarray, more: np.ndarray, anchor: np.ndarray | int = 0) -> np.ndarray:
    """A run of windows as one number: its first window, the anchor's place from there, and how many follow."""
    return (first << 14) | (anchor << 7) | more


def _windows_of(packed: list[int] | None) -> np.ndarray:
    """The windows of packed runs, in order."""
    if not packed:
        return np.zeros(0, np.int64)
    p = np.sort(np.asarray(packed, np.int64))
    first, n = p >> 14, (p & 127) + 1
    total = int(n.sum())
    skip = np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + np.arange(total) - skip


def _context_rows(length: int):
    """(g, key, th, run, bytes) of the open runs of each document: the bytes that their windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("g", pa.int64()), ("key", pa.int64()), ("th", pa.int64()), ("run", pa.int64()), ("bytes", pa.binary())])
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = {c: [] for c in kind.names}
            for body, key, th, todo in zip(*[batch.column(c).to_pylist() for c in ("body", "key", "th", "near")], strict=True):
                if (key, th) in seen:  # a row that is repeated
                    continue
                seen.add((key, th))
                for o in todo:
                    first = o["run"] >> 14
                    out["bytes"].append(body[first : first + (o["run"] & 127) + length])
                    out["g"].append(o["g"])
                    out["run"].append(o["run"])
                    out["key"].append(key)
                    out["th"].append(th)
                if len(out["g"]) >= 20_000:
                    yield pa.record_batch(out, schema=kind)
                    out = {c: [] for c in kind.names}
            yield pa.record_batch(out, schema=kind)

    return run


def equal_windows(slab: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of length bytes: windows of one group have the same if all their bytes are equal, -1 if they are alone.

    A radix sort by digits of eight bytes, depth limited: each pass orders what
    is left by group and digit, and goes on with groups of two or more alone.
    Digits are taken from both ends inwards, since the middle, where windows of
    one group share their anchor, tells them apart last.
    """
    out = np.full(len(at), -1, np.int64)
    width = min(8, length)
    if len(slab) < width or not len(at):
        return out
    digits = np.ndarray(len(slab) - 7, np.uint64, slab, strides=(1,)) if width == 8 else sum(slab[i : len(slab) - width + 1 + i].astype(np.uint64) << np.uint64(8 * i) for i in range(width))
    ends = [*range(0, length - width, width), length - width]
    half = (len(ends) + 1) // 2
    inwards = [d for pair in zip(ends[:half], ends[::-1][:half], strict=True) for d in pair][: len(ends)]
    live = np.arange(len(at))
    for d in inwards:
        x = digits[at[live] + d]
        order = np.lexsort((x, group))
        live, x, group = live[order], x[order], group[order]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (x[1:] != x[:-1])
        number = np.cumsum(new) - 1
        several = np.bincount(number, minlength=1)[number] > 1 if len(live) else new
        live, group = live[several], number[several]
        if not len(live):
            break
    out[live] = group
    return out


def _match_rows(length: int, rows: int = 4_000):
    """(key, th, run) of windows that a smaller id has too, from rows of _context_rows in order of g."""

    def found(t: pa.Table) -> pa.RecordBatch:
        g, key, th, run = (t[c].to_numpy() for c in ("g", "key", "th", "run"))
        texts = t["bytes"].to_pylist()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        n = (run & 127) + 1
        row = np.repeat(np.arange(len(run)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(size) - size, n) + nth
        place = (np.cumsum(np.diff(g, prepend=g[:1]) != 0)[row] << 7) | (((run >> 7) & 127)[row] - nth)
        same = equal_windows(np.frombuffer(b"".join(texts), np.uint8), at, place, length)
        several = np.flatnonzero(same >= 0)
        order = several[np.argsort(same[several], kind="stable")]
        new = np.diff(same[order], prepend=-1) != 0
        least = np.minimum.reduceat(key[row[order]], np.flatnonzero(new))[np.cumsum(new) - 1] if len(order) else key[:0]
        hit = np.sort(order[key[row[order]] > least])
        begins = np.ones(len(hit), bool)
        begins[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit][1:] != row[hit][:-1])
        at = np.flatnonzero(begins)
        many = np.diff(np.append(at, len(hit)))
        r = row[hit[at]]
        return pa.record_batch({"key": key[r], "th": th[r], "run": _packed((run >> 14)[r] + nth[hit[at]], many - 1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < rows:
                continue
            t = pa.Table.from_batches(held)
            g = t["g"].to_numpy()
            whole = int(np.searchsorted(g, g[-1]))  # the last anchor's rows may go on
            if whole:
                yield found(t.slice(0, whole).combine_chunks())
            held = t.slice(whole).to_batches()
        if held and sum(map(len, held)):
            yield found(pa.Table.from_batches(held).combine_chunks())

    return run


def own_repeats(body: bytes, length: int, gram: int) -> np.ndarray:
    """Windows of one text that start earlier in it too."""
    slab = np.frombuffer(body, np.uint8)
    one = np.array([0], np.int64)
    _, begin, finish, g, _ = runs(slab, one, np.array([len(slab)], np.int64), length, gram)
    return _own(body, begin, finish, g, length)


def _own(body, begin: np.ndarray, finish: np.ndarray, g: np.ndarray, length: int) -> np.ndarray:
    if len(g) < 2:
        return np.zeros(0, np.int64)
    order = np.argsort(g, kind="stable")
    s = g[order]
    twin = np.zeros(len(s), bool)
    twin[1:] |= s[1:] == s[:-1]
    twin[:-1] |= s[1:] == s[:-1]
    again = np.sort(order[twin])
    if not len(again):
        return np.zeros(0, np.int64)
    at = _windows_of(_packed(begin[again], finish[again] - begin[again]).tolist())
    raw = memoryview(body)
    seen: set[bytes] = set()
    out = []
    for a in at.tolist():
        d = _digest(raw[a : a + length])
        if d in seen:
            out.append(a)
        else:
            seen.add(d)
    return np.asarray(out, np.int64)


def _finish(length: int, gram: int, keep_text: bool):
    """For each document: what is removed, from repeats found in other documents and its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"key": [], "th": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"kept": []} if keep_text else {})
            for body, key, th, found in zip(*[batch.column(c).to_pylist() for c in ("body", "key", "th", "runs")], strict=True):
                at = [_windows_of(found)]
                if len(body) > length:
                    at.append(own_repeats(body, length, gram))
                edges = np.zeros(len(body) + 1, np.int32)
                found = np.concatenate(at).astype(np.int64)
                found = found[found + length <= len(body)]
                np.add.at(edges, found, 1)
                np.add.at(edges, found + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                text = np.frombuffer(body, np.uint8)
                kept = text[~gone].tobytes()
                out["key"].append(key)
                out["th"].append(th)
                out["n_bytes"].append(len(body))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(gone[:1].sum() + np.count_nonzero(gone[1:] & ~gone[:-1])))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    # a code point goes only if all its bytes do
                    lead = np.flatnonzero((text & 0xC0) != 0x80)
                    if len(lead):
                        parts = np.add.reduceat((~gone).astype(np.int64), lead) > 0
                        sizes = np.diff(np.append(lead, len(text)))
                        out["kept"].append(text[np.repeat(parts, sizes)].tobytes().decode("utf-8", "replace"))
                    else:
                        out["kept"].append("")
            made = pa.record_batch(out, schema=pa.schema([(c, pa.string() if c in ("kept_sha256", "kept") else pa.int64()) for c in out]))
            yield made.append_column("doc", batch.column("doc")) if keep_text else made

    return run


def _bodies(docs: DataFrame) -> DataFrame:
    body = F.encode(text_or_empty(F.col("text")), "UTF-8")
    whole = F.struct(*docs.columns).dropFields("text") if len(docs.columns) > 1 else F.struct("doc_id")
    return docs.select(key_of(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("th"), body.alias("body"), F.struct(F.col("text").isNull().alias("none"), whole.alias("rest")).alias("doc"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, kinds_limit: int = KINDS) -> DataFrame:
    """(key, th, n_bytes, n_removed, n_spans, kept_sha256[, kept, doc]), one row for each document.

    doc: struct(none, rest), whether the text is null and the other columns, so
    that a text that was cut needs no join to find them again.
    """
    if not 0 < gram < length <= 128:
        raise ValueError("gram must be below length, and length at most 128")
    spark = docs.sparkSession
    every = _bodies(docs)
    d = every.drop("doc")
    # a text too short for a window leaves before Python sees it
    long = d.where(F.octet_length("body") >= length)

    # pass 1: anchors that occur in two documents or more
    rows = long.mapInArrow(_anchor_rows(length, gram, False), "g long, c long, key long")
    first = rows.groupBy("g").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    first = first.where("least < most").select("g", "least", (F.col("c1") != F.col("c2")).alias("mixed"))
    first = stage_table(first, "suffix-anchors")
    release(spark)

    # pass 2: runs with such an anchor; whole: repeated, open: the first of its kind, but its windows may occur elsewhere
    rows = long.mapInArrow(_anchor_rows(length, gram, True), "g long, c long, key long, th long, run long")
    hits = rows.join(first, "g").where(F.col("mixed") | (F.col("key") > F.col("least")))
    hits = stage_table(hits.select("g", "c", "key", "th", "run", "mixed"), "suffix-hits")
    release(spark)
    mixed = hits.where("mixed").select("g", "c", "key", "th", "run")
    # kinds are staged before they are joined, and the join before anything is grouped: a join of two tables can split its hot keys
    kinds = stage_table(mixed.groupBy("g", "c").agg(F.min("key").alias("least")), "suffix-least")
    release(spark)
    mixed = mixed.join(kinds, ["g", "c"]).select("g", "c", "key", "th", "run", (F.col("key") == F.col("least")).alias("open"))
    mixed = stage_table(mixed, "suffix-kinds")
    release(spark)
    whole = hits.where("not mixed").select("key", "th", "run").unionByName(mixed.where("not open").select("key", "th", "run"))
    # a later equal run of the same document is left to the search within documents
    opened = mixed.where("open").groupBy("g", "c", "key", "th").agg(F.min("run").alias("run")).select("g", "key", "th", "run")
    crowded = opened.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > kinds_limit).select("g", F.lit(True).alias("crowd"))
    opened = opened.join(crowded, "g", "left")
    by = opened.groupBy("key", "th").agg(F.collect_set(F.when(F.col("crowd").isNull(), F.struct("g", "run"))).alias("near"), F.collect_set(F.when(F.col("crowd"), F.col("run"))).alias("open"))
    by = stage_table(by, "suffix-open")
    release(spark)

    # pass 3: open runs by anchor; windows by themselves where an anchor has too many of them
    contexts = d.join(by.where(F.size("near") > 0).select("key", "th", "near"), ["key", "th"])
    contexts = contexts.mapInArrow(_context_rows(length), "g long, key long, th long, run long, bytes binary")
    near = contexts.repartition("g").sortWithinPartitions("g").mapInArrow(_match_rows(length), "key long, th long, run long")
    near = stage_table(near, "suffix-matched")
    release(spark)
    windows = d.join(by.where(F.size("open") > 0).select("key", "th", "open"), ["key", "th"])
    windows = windows.mapInArrow(_window_rows(length), "w1 long, w2 long, key long, th long, at long")
    again = windows.groupBy("w1", "w2").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("w1", "w2", "least")
    single = windows.join(again, ["w1", "w2"]).where("key > least").select("key", "th", F.shiftleft("at", 14).alias("run"))
    single = stage_table(single, "suffix-windows")
    release(spark)

    # sets: a row that occurs a million times has its runs once
    found = whole.unionByName(near).unionByName(single).groupBy("key", "th").agg(F.collect_set("run").alias("runs"))
    done = (every if keep_text else d).join(found, ["key", "th"], "left").select("key", "th", "body", "runs", *["doc"] * keep_text)
    kind = "key long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (f", kept string, doc {every.schema['doc'].dataType.simpleString()}" if keep_text else "")
    return done.mapInArrow(_finish(length, gram, keep_text), kind)


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kinds_limit: int = KINDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each document."""
    out = repeats(docs, length, gram, kinds_limit=kinds_limit)
    return out.select(id_of(F.col("key")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents in their own columns, texts without repeated bytes.

    A code point goes only if all its bytes are repeated, so texts stay valid.
    n_chars, where there is one, follows the text.
    """
    out = repeats(docs, length, gram, keep_text=True)
    new = {"text": F.when(~F.col("doc.none"), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col("doc.rest")[c].alias(c) for c in docs.columns])
