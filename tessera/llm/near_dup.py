"""Near-duplicate classes by ProbMinHash, banding, exact verification and components.

A text's weighted shingles are its runs of SHINGLE words (all its words, if it
has fewer) with the number of times each occurs; words are runs of anything but
blanks. Likeness is probability Jaccard: the sum over common shingles i of
1 / sum over j of max(a_j / a_i, b_j / b_i); for texts that repeat no shingle it
is the common Jaccard index. Texts are linked if it is THRESHOLD or more.

Signatures (ProbMinHash): every shingle sends a Poisson process of arrivals,
its rate the shingle's weight, each arrival to a random register; a register
keeps the shingle of its earliest arrival. A shingle is done as soon as its
next arrival is later than every register's, so that work is about
n + m ln m for n shingles and m registers. Two registers agree with
probability equal to the likeness.

Banding: BANDS keys of ROWS registers each; a pair of likeness 0.8 shares one
with probability over 0.999. Texts that are equal are one node from the start.
Candidates are compared in two passes. First, in each bucket PIVOTS pivots (the
least nodes in pseudo-random orders) are paired with every other member, so
pairs are in proportion to members, and each is verified on whole texts; what a
copied text has brought into a bucket becomes one component here. Then every
bucket that still holds several components is compared in full, but for pairs
within one component: members of its largest component are dealt to blocks of
bounded rows and bytes, those of the others likewise, and each pair of blocks
with other components is one group of an Arrow function that emits links alone.
Registers come first there: a pair whose registers agree more than five standard
deviations too seldom is below the threshold; all others are verified. A
bucket of k members in one component and r in others costs about k + r rows
while r is within a block, r * r / BLOCK_ROWS beyond it.

Components are made of verified links by alternating large-star and small-star
steps: all in DataFrames, a logarithmic number of steps, hubs only in
aggregations with partial sums and in joins that AQE can split.

Nulls: a null text is an empty text; a null doc_id orders first and comes back
as null. Texts without words are like none but equal ones. Repeated rows are in
one class. Nodes are 64-bit hashes of texts, so different texts would be taken
as equal with a probability of about n * n / 2^65. Empty tables give empty
results. Memory is linear in the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import id_of, key_of, release, stage_table, text_or_empty

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 7
PIVOTS = 2
#: Rows and bytes of text of a block of a bucket's members.
BLOCK_ROWS, BLOCK_BYTES = 500, 2 << 20
#: Bytes of text that are worked on at once.
SLAB = 1 << 20


def _mix(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


_PLACE = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    slab = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    gap = (slab == 32) | ((slab >= 9) & (slab <= 13))
    edge = np.diff(gap.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) > len(start):  # a blank at the very start is no end
        end = end[len(end) - len(start) :]
    ends_of_texts = np.cumsum(lengths)
    counts = np.diff(np.searchsorted(start, ends_of_texts), prepend=0)
    if not len(start):
        return np.zeros(0, np.uint64), counts
    size = end - start
    # polynomial over bytes: sum of (byte + 1) * P^i, by powers of the place in the word
    inner = np.flatnonzero(~gap)
    place = np.arange(len(inner)) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.concatenate([[1], np.full(int(size.max()), 0x5851F42D4C957F2D, np.uint64)]).astype(np.uint64))
    terms = (slab[inner].astype(np.uint64) + np.uint64(1)) * power[place]
    h = np.add.reduceat(terms, np.cumsum(size) - size)
    return _mix(h + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), counts


def shingles(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, 48-bit shingle, weight), in order of text and shingle."""
    words, counts = _word_hashes(texts)
    first = np.cumsum(counts) - counts
    many = np.maximum(counts - n + 1, 0)
    at = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    doc = np.repeat(np.arange(len(texts)), many)
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h += words[at + j] * _PLACE[j]
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        short = [sum((words[first[i] : first[i] + counts[i]] * _PLACE[: counts[i]]).tolist()) & (2**64 - 1) for i in few]
        doc, h = np.concatenate([doc, few]), np.concatenate([h, np.array(short, np.uint64)])
    key = (doc.astype(np.uint64) << np.uint64(48)) | (_mix(h) >> np.uint64(16))
    key.sort()
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.float64)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.diff(np.append(new, len(key))).astype(np.float64)
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), weight


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """ProbMinHash: for each text and register the shingle (32 bits) of the earliest arrival."""
    never = np.uint64(0xFFFFFFFFFFFFFFFF)
    reg = np.full(n_docs * m, never, np.uint64)
    ids = _mix(shingle + np.uint64(0x632BE59BD9B4E019)) & np.uint64(0xFFFFFFFF)
    t = np.zeros(len(doc), np.float64)
    live = np.arange(len(doc))
    done = 0
    while len(live):
        k = 1 if done < 2 else 8  # arrivals of each live shingle in one go
        counter = (np.arange(done + 1, done + k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        z = _mix(shingle[live][:, None] * np.uint64(0xD1342543DE82EF95) + counter)
        u = ((z >> np.uint64(32)).astype(np.float64) + 1.0) / 4294967297.0
        arrive = t[live][:, None] + np.cumsum(-np.log(u), axis=1) / weight[live][:, None]
        where = doc[live][:, None] * m + ((((z & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64))
        # a positive float32 orders as its bits do
        packed = (arrive.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | ids[live][:, None]
        np.minimum.at(reg, where.ravel(), packed.ravel())
        t[live] = arrive[:, -1]
        docs = np.unique(doc[live])
        top = np.zeros(n_docs, np.uint64)
        top[docs] = reg.reshape(n_docs, m)[docs].max(axis=1) >> np.uint64(32)
        now = t[live].astype(np.float32).view(np.uint32).astype(np.uint64)
        live = live[now <= top[doc[live]]]
        done += k
    return (reg & np.uint64(0xFFFFFFFF)).reshape(n_docs, m)


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    part = sig.reshape(len(sig), n_bands, rows)
    out = np.zeros(part.shape[:2], np.uint64)
    for j in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + part[:, :, j] + np.uint64(j + 1))
    return _mix(out + np.arange(n_bands, dtype=np.uint64)[None, :])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two lists of (sorted shingles, weights)."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    both = kb[at] == ka
    if not both.any():
        return 0.0
    x, y = wa[both], wb[at[both]]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    # in order of y / x, those before i count with a_j / a_i, those after it with b_j / b_i
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    before, after = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1.0 / ((only_a + before) / x + (only_b + after) / y)).sum())


def _slabs(batches: Iterator[pa.RecordBatch], columns: list[str], text: str, limit: int = SLAB) -> Iterator[list[tuple]]:
    held, size = [], 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in [text, *columns]], strict=True):
            held.append(row)
            size += len(row[0])
            if size >= limit or len(held) == 60_000:
                yield held
                held, size = [], 0
    if held:
        yield held


def _sign(n: int, n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _slabs(batches, ["key", "node"], "body"):
            doc, shingle, weight = shingles([r[0] for r in held], n)
            keys = bands(signatures(doc, shingle, weight, len(held), n_bands * rows), n_bands, rows)
            has = np.zeros(len(held), bool)
            has[doc] = True
            lists = [k if ok else [] for k, ok in zip(keys.view(np.int64).tolist(), has.tolist(), strict=True)]
            yield pa.record_batch({
                "key": pa.array([r[1] for r in held], pa.int64()), "node": pa.array([r[2] for r in held], pa.int64()),
                "size": pa.array([len(r[0]) for r in held], pa.int64()), "bands": pa.array(lists, pa.list_(pa.int64())),
            })

    return run


def _verify(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _slabs(batches, ["body_b", "a", "b"], "body_a"):
            texts: dict[int, bytes] = {}
            for ta, tb, a, b in held:
                texts[a], texts[b] = ta, tb
            names, out = list(texts), []
            found: dict[int, tuple] = {}
            for i in range(0, len(names), 2000):
                some = names[i : i + 2000]
                doc, shingle, weight = shingles([texts[x] for x in some], n)
                cut = np.searchsorted(doc, np.arange(len(some) + 1))
                for j, x in enumerate(some):
                    found[x] = shingle[cut[j] : cut[j + 1]], weight[cut[j] : cut[j + 1]]
            for _, _, a, b in held:
                out.append(likeness(found[a], found[b]))
            ok = [i for i, s in enumerate(out) if s >= threshold - 1e-9]
            yield pa.record_batch({"a": pa.array([held[i][2] for i in ok], pa.int64()), "b": pa.array([held[i][3] for i in ok], pa.int64()), "likeness": pa.array([out[i] for i in ok], pa.float64())})

    return run


def _compare(n: int, n_bands: int, rows: int, threshold: float):
    """Links between the roots of a group's rows of side 0 and side 1; within side 1 too, where the group is marked own."""
    m = n_bands * rows
    least = threshold - 5 * np.sqrt(threshold * (1 - threshold) / m)

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["node"].to_numpy(), t["side"].to_numpy()))
        t = t.take(pa.array(order))
        root, side = t["root"].to_pylist(), t["side"].to_numpy()
        doc, shingle, weight = shingles(t["body"].to_pylist(), n)
        sig = signatures(doc, shingle, weight, len(root), m).astype(np.uint32)
        cut = np.searchsorted(doc, np.arange(len(root) + 1))
        bag = [(shingle[a:z], weight[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        to = {r: r for r in root}

        def top(r: int) -> int:
            while to[r] != r:
                to[r] = r = to[to[r]]
            return r

        links = []
        right = np.flatnonzero(side == 1)
        first = [(i, right) for i in np.flatnonzero(side == 0).tolist()]
        if t["own"][0].as_py():
            first += [(i, right[k + 1 :]) for k, i in enumerate(right.tolist())]
        for i, others in first:
            for j in others[(sig[others] == sig[i]).mean(axis=1) >= least].tolist() if len(others) else ():
                a, b = top(root[i]), top(root[j])
                if a != b and likeness(bag[i], bag[j]) >= threshold - 1e-9:
                    to[max(a, b)] = min(a, b)
                    links.append((root[i], root[j]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def components(links: DataFrame, limit: int = 40) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of its component."""
    pairs = stage_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components", narrow=True)
    seen = None
    for _ in range(limit):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: each larger neighbour hangs on the least of the neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage_table(large, "components", narrow=True)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: each smaller neighbour, and the node itself, hangs on the least of them
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = stage_table(small, "components", narrow=True)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rest(here: DataFrame, texts: DataFrame, compare) -> DataFrame:
    """Links (a, b) between roots, from all pairs of a bucket whose members (band, node, size, root) differ in root."""
    parts = here.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.bit_xor("node").alias("x"))
    most = F.max(F.struct("n", "root", "s"))
    open_ones = parts.groupBy("band").agg(F.count("*").alias("parts"), most.alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x")).where("parts > 1")
    # of buckets with the same members, one
    open_ones = open_ones.groupBy("n", "x").agg(F.min(F.struct("band", "top", "s")).alias("o")).select("o.band", "o.top", (F.col("n") - F.col("o.top.n")).alias("n"), (F.col("o.s") - F.col("o.top.s")).alias("s"))
    blocks = lambda n, s: F.greatest(F.ceil(F.col(n) / BLOCK_ROWS), F.ceil(F.col(s) / BLOCK_BYTES)).cast("int")
    open_ones = open_ones.select("band", F.col("top.root").alias("top"), blocks("top.n", "top.s").alias("nl"), blocks("n", "s").alias("nr"))
    rows = here.join(open_ones, "band")
    left, i = F.col("root") == F.col("top"), lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    cells = F.when(left, F.transform(upto("nr"), lambda j: cell(0, i("nl"), j, F.lit(0)))).otherwise(F.concat(
        F.transform(upto("nl"), lambda k: cell(0, k, i("nr"), F.lit(1))),
        F.transform(F.filter(upto("nr"), lambda j: j != i("nr")), lambda j: cell(1, F.least(i("nr"), j), F.greatest(i("nr"), j), i("nr") > j)),
    ))
    rows = rows.select("band", "node", "root", F.explode(cells).alias("c")).select("band", "node", "root", "c.*")
    rows = rows.join(texts, "node").withColumn("own", F.expr("kind = 0 and i = 0"))
    return rows.groupBy("band", "kind", "i", "j").applyInArrow(compare, "a long, b long")


def linked(signed: DataFrame, docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, root) for the nodes of signed (key, node, size, bands) that have a verified link."""
    spark = docs.sparkSession
    reps = signed.groupBy("node").agg(F.min(F.struct("key", "size", "bands")).alias("r"))
    members = reps.select("node", "r.size", F.explode("r.bands").alias("band"))
    crowded = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = stage_table(members.join(crowded, "band"), "near-members")
    wanted = members.select("node").distinct()
    texts = docs.select(F.xxhash64("text").alias("node"), F.encode("text", "UTF-8").alias("body")).join(wanted, "node", "left_semi")
    # one row for each node; equal nodes have equal texts
    texts = stage_table(texts.groupBy("node").agg(F.first("body").alias("body")), "near-texts")
    release(spark)
    # pivots: least nodes in pseudo-random orders, which the band's own bits choose among four; an exclusive or can be undone
    salts = [F.xxhash64(F.col("band").bitwiseAND(F.lit(3)), F.lit(i)) for i in range(PIVOTS)]
    least = [F.min(F.col("node").bitwiseXOR(salt)).alias(f"p{i}") for i, salt in enumerate(salts)]
    chosen = F.array(*[F.col(f"p{i}").bitwiseXOR(salt) for i, salt in enumerate(salts)])
    pivots = members.groupBy("band").agg(*least).select("band", F.explode(F.array_distinct(chosen)).alias("pivot"))
    pairs = members.join(pivots, "band").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
    links = stage_table(two.select("a", "b", "body_a", "body_b").mapInArrow(_verify(n, threshold), "a long, b long, likeness double"), "near-links")
    comps = components(links.select("a", "b"))
    release(spark)
    here = members.join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = stage_table(_rest(stage_table(here, "near-rooted"), texts, _compare(n, n_bands, rows, threshold)), "near-more")
    if more.isEmpty():
        return comps
    up = components(more).select(F.col("node").alias("was"), F.col("root").alias("now"))
    release(spark)
    return comps.join(up, F.col("root") == F.col("was"), "full").select(F.coalesce("node", "was").alias("node"), F.coalesce("now", "root").alias("root"))


def sign(docs: DataFrame, n: int = SHINGLE, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, node, size, bands): a row for each document; size is that of the text in bytes."""
    return docs.select("key", F.xxhash64("text").alias("node"), F.encode("text", "UTF-8").alias("body")).mapInArrow(_sign(n, n_bands, rows), "key long, node long, size long, bands array<long>")


def classes(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, keep, class_size, node), one row for each document.

    class_id is the smallest doc_id of the class; keep marks that document.
    """
    d = docs.select(key_of(F.col("doc_id")).alias("key"), text_or_empty(F.col("text")).alias("text"))
    signed = stage_table(sign(d, n, n_bands, rows), "near-signed")
    comps = linked(signed, d, n, threshold, n_bands, rows)
    # copies are counted before anything is joined, so a large group of them is one row
    nodes = signed.groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("copies")).join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = stage_table(nodes, "near-nodes")
    groups = nodes.groupBy("root").agg(F.min("least").alias("class_key"), F.sum("copies").alias("class_size"), F.min(F.struct("least", "node"))["node"].alias("kept_node"))
    nodes = nodes.join(groups, "root").select("node", "least", "class_key", "class_size", "kept_node")
    out = signed.select("key", "node").join(nodes, "node")
    return out.select(
        id_of(F.col("key")).alias("doc_id"), id_of(F.col("class_key")).alias("class_id"),
        ((F.col("node") == F.col("kept_node")) & (F.col("key") == F.col("least"))).alias("keep"), "class_size", "node",
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, in its own columns; of repeated rows, one."""
    kept = classes(docs, **how).where("keep").select(key_of(F.col("doc_id")).alias("__key"), F.col("node").alias("__node")).distinct()
    # a document is one value here, so that its columns meet no others
    named = docs.select(key_of(docs["doc_id"]).alias("__key"), F.xxhash64(text_or_empty(docs["text"])).alias("__node"), F.struct(*docs.columns).alias("doc"))
    return named.join(kept, ["__key", "__node"], "left_semi").dropDuplicates(["__key", "__node"]).select("doc.*")
