"""Shards of near-equal bytes from indivisible groups, by Karmarkar-Karp differencing.

Documents of equal text form a group and stay together. A partial partition is
a list of one sum for each shard; a group starts as (bytes, 0, ..., 0). The two
partial partitions of largest spread are combined again and again, the largest
sum of one to the smallest of the other, until one is left.

One heap over all groups would be one task, so differencing goes in levels:
groups are dealt by digest into blocks of about BLOCK; each block is reduced to
one partial partition; these are again dealt into blocks of FAN, and so on
until one remains. Combining partial partitions is what differencing does with
them anyway; only the order of choice is local. The first level reduces
spreads to about a small group's size, which later levels even out further.

The placement goes back level by level as a join on (block, column), a table of
one row for each block and shard. A group larger than total / shards cannot be
divided, by contract; its shard is then larger than the others.

slot numbers a shard's rows from 0: rows are ordered by (bucket, id, digest) with
buckets of about SLOT_ROWS rows by hashed id and digest, and counts of earlier
buckets are added, so no task sorts a whole shard.

Nulls: a null text is empty (size OVERHEAD); a null doc_id is a document like
others. Repeated rows are documents of their own; they are counted before they
move and numbered one after the other. Very long texts are read once, for size
and digest. An empty table gives an empty result. Ties in size fall by digest.
Further columns are not read.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm._common import pick, stage_table, text_or_empty

OVERHEAD = 16
BLOCK = 20_000
FAN = 256
SLOT_ROWS = 5_000


def difference(items: list[list[int]], k: int) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions of k sums into one.

    Returns its sums and, for each item, the column that each of its columns
    went to.
    """
    heap = []
    for i, sums in enumerate(items):
        order = sorted(range(k), key=lambda c: (-sums[c], c))
        # parts: for each final column, in descending order of sums, the (item, column) pairs in it
        parts = [[(i, c)] for c in order]
        desc = [sums[c] for c in order]
        heap.append((desc[-1] - desc[0], i, desc, parts))
    heapq.heapify(heap)
    tie = len(items)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        joined = sorted(((a[j] + b[k - 1 - j], j) for j in range(k)), key=lambda x: (-x[0], x[1]))
        desc = [x for x, _ in joined]
        parts = []
        for _, j in joined:
            x, y = pa_[j], pb[k - 1 - j]
            if len(x) < len(y):
                x, y = y, x
            x.extend(y)
            parts.append(x)
        heapq.heappush(heap, (desc[-1] - desc[0], tie, desc, parts))
        tie += 1
    _, _, desc, parts = heap[0]
    went = [[0] * k for _ in items]
    for to, members in enumerate(parts):
        for i, c in members:
            went[i][c] = to
    return desc, went


def difference_single(sizes: list[int], k: int) -> tuple[list[int], list[int]]:
    """The same for items with a single sum: the columns that are 0 need no tracking."""
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, [s] + [0] * (k - 1), [[i]] + [None] * (k - 1)))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        parts = []
        for j in range(k):
            x, y = pa_[j], pb[k - 1 - j]
            if x is None or (y is not None and len(x) < len(y)):
                x, y = y, x
            if y is not None:
                x.extend(y)
            parts.append(x)
        sums = [a[j] + b[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda c: (-sums[c], c))
        desc = [sums[c] for c in order]
        heapq.heappush(heap, (desc[-1] - desc[0], tie, desc, [parts[c] for c in order]))
        tie += 1
    _, _, desc, parts = heap[0]
    went = [0] * len(sizes)
    for to, members in enumerate(parts):
        for i in members or ():
            went[i] = to
    return desc, went


def _first_level(groups: DataFrame, k: int) -> DataFrame:
    """(block, digest, col, sums): for each group its column in its block, sums on the block's first row."""

    def run(t: pa.Table) -> pa.Table:
        order = sorted(range(t.num_rows), key=lambda i: digests[i]) if (digests := t["digest"].to_pylist()) else []
        sizes = t["bytes"].to_pylist()
        desc, went = difference_single([sizes[i] for i in order], k)
        return pa.table({
            "block": [t["block"][0].as_py()] * len(order), "digest": [digests[i] for i in order], "col": pa.array(went, pa.int32()),
            "sums": pa.array([desc] + [None] * (len(order) - 1), pa.list_(pa.int64())),
        })

    return groups.groupBy("block").applyInArrow(run, "block long, digest binary, col int, sums array<long>")


def _next_level(parts: DataFrame, k: int) -> DataFrame:
    """(up, block, went, sums): where each column of a block goes in the block above."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["block"].to_pylist(), t["sums"].to_pylist(), strict=True))
        desc, went = difference([r[1] for r in rows], k)
        return pa.table({
            "up": [t["up"][0].as_py()] * len(rows), "block": [r[0] for r in rows], "went": pa.array(went, pa.list_(pa.int32())),
            "sums": pa.array([desc] + [None] * (len(rows) - 1), pa.list_(pa.int64())),
        })

    return parts.groupBy("up").applyInArrow(run, "up long, block long, went array<int>, sums array<long>")


def assign(groups: DataFrame, k: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(digest, shard) for groups of (digest, bytes), digest distinct."""
    n = groups.count()
    blocks = max(1, -(-n // block))
    levels = stage_table(_first_level(groups.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks))), k), "shard-groups")
    placed = levels.select("digest", "block", "col")
    parts = levels.where("sums is not null").select("block", "sums")
    ups = []
    while blocks > 1:
        blocks = -(-blocks // fan)
        up = stage_table(_next_level(parts.withColumn("up", F.pmod(F.xxhash64("block"), F.lit(blocks))), k), "shard-blocks")
        ups.append(up)
        parts = up.where("sums is not null").select(F.col("up").alias("block"), "sums")
    # from the top down: block -> where its columns end
    final = None
    for up in reversed(ups):
        step = up.select("up", "block", "went")
        if final is not None:
            above = final.select(F.col("block").alias("up"), F.col("went").alias("above"))
            step = step.join(above, "up").select("up", "block", F.transform("went", lambda c: F.get(F.col("above"), c)).alias("went"))
        final = step.select("block", "went")
    if final is None:
        return placed.select("digest", F.col("col").alias("shard"))
    return placed.join(final, "block").select("digest", F.get("went", F.col("col")).alias("shard"))


def shards(docs: DataFrame, k: int = 40, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each document."""
    d = pick(docs, doc_id="doc_id", text="text").withColumn("body", F.encode(text_or_empty(F.col("text")), "UTF-8"))
    d = d.select("doc_id", (F.octet_length("body") + OVERHEAD).cast("long").alias("size"), F.crc32("body").alias("text_crc32"), F.unhex(F.md5("body")).alias("digest"))
    d = stage_table(d, "shard-docs")
    groups = d.groupBy("digest").agg(F.sum("size").alias("bytes"))
    placed = assign(groups, k, block).withColumnRenamed("digest", "g_digest")
    n = d.count()
    buckets = max(1, -(-n // (k * SLOT_ROWS)))
    # rows equal in id and text are one row with their number until they get their slots, so that an id in many rows fills no task
    rows = d.groupBy("doc_id", "digest", "size", "text_crc32").agg(F.count("*").alias("m"))
    rows = rows.join(placed, F.col("digest") == F.col("g_digest")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
    rows = stage_table(rows.drop("g_digest"), "shard-rows")
    counts = rows.groupBy("shard", "bucket").agg(F.sum("m").alias("many"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    skips = counts.select("shard", "bucket", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("skip"))
    rows = rows.join(skips, ["shard", "bucket"]).repartition("shard", "bucket")
    upto = F.sum("m").over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("first", F.col("skip") + upto - F.col("m")).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
