"""SimHash fingerprints of whole texts, and all pairs of them within a Hamming radius.

Terms are runs of SHINGLE words (all words, where a text has fewer), weighted
by how often they occur. Each term's 64-bit hash votes on 64 signed bits; a bit
is set where more weight votes for it than against it. Votes are counted two
bits to a long, so that 32 sums carry a document; the sums are made where the
text lies and no term leaves its task.

neighbours() finds the next document without one task seeing all rows: ids are
dealt to buckets between approximate quantiles, an id in many rows to several
buckets by hash of the text; rows are ordered within a bucket, and a bucket's
last row takes the head of the next bucket that has rows.

within() finds, for fingerprints that are asked for, all others within a Hamming
radius by permuted block tables, hamming_pairs() all such pairs.

Nulls: a null text is empty; a text without words has the fingerprint of no
votes, 0. A null doc_id orders first. Repeated rows are rows of their own,
ordered by hash of the text; equal rows follow each other, and where there are
more than REPEATS of them, one goes for all. Very long texts are counted where
they lie. With one document, the next one is itself. An empty table gives an
empty result. Further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm._common import NO_ID, collapsed, id_of, key_of, shuffle_partitions, stage_table, text_or_empty, words_of

BITS = 64
SHINGLE = 3
#: Bits in which near fingerprints differ at most, and blocks more than those that a table is keyed by.
RADIUS, SPARE = 3, 3
#: Rows whose id is divisible by this number ask for all fingerprints near their own.
ASKING = 100
#: Rows equal in id and text that move as rows of their own at most.
REPEATS = 1000
LANES = 0x100000001


def with_terms(rows: DataFrame, text: str, out: str, n: int = SHINGLE) -> DataFrame:
    w = f"__{out}_words"
    rows = rows.withColumn(w, F.transform(words_of(F.col(text)), lambda x: F.xxhash64(x)))
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(n)]))
    few = F.when(F.size(w) > 0, F.array(F.xxhash64(F.col(w)))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn(out, F.when(F.size(w) >= n, runs).otherwise(few)).drop(w)


def fingerprint_rows(rows: DataFrame, keys: list[str], terms: str) -> DataFrame:
    """(keys, fingerprint) for rows of (keys, terms array); keys are unique."""
    votes = rows.select(*keys, F.explode_outer(terms).alias("h"))
    sums = votes.groupBy(*keys).agg(
        F.count("h").alias("n"),
        *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES))).alias(f"v{i}") for i in range(32)],
    )
    low = lambda i: F.coalesce(F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0))
    high = lambda i: F.coalesce(F.shiftrightunsigned(f"v{i}", 32), F.lit(0))
    fp = F.lit(0).cast("long")
    for i in range(32):
        fp = fp.bitwiseOR(F.when(2 * low(i) > F.col("n"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        bit = 1 << (i + 32)
        fp = fp.bitwiseOR(F.when(2 * high(i) > F.col("n"), F.lit(bit - (1 << 64) if bit >> 63 else bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fingerprint"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of bits that differ."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def in_buckets(rows: DataFrame, order: str, within: str, buckets: int) -> DataFrame:
    """Add bucket: rows of a lower bucket order before those of a higher one, by order and within.

    within is a 64-bit hash. A value that is several quantiles at once is in so
    many rows that it is divided, by as many ranges of hashes.
    """
    found = rows.select(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 100 * buckets).alias("q")).first()["q"] if buckets > 1 else []
    cuts = sorted(Counter(found or []).items())
    if not cuts:
        return rows.withColumn("bucket", F.lit(0))
    begins = [0]
    for _, n in cuts:
        begins.append(begins[-1] + (n + 2 if n > 1 else 1))
    part = lambda n: F.least(F.floor((F.col(within) / F.lit(2.0**64) + 0.5) * n), F.lit(n - 1)).cast("int")

    # a balanced tree of comparisons, as deep as the logarithm of the number of buckets
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            if lo == len(cuts) or cuts[lo][1] == 1:
                return F.lit(begins[lo])
            v, n = cuts[lo]
            return F.when(F.col(order) < F.lit(v), F.lit(begins[lo])).otherwise(F.lit(begins[lo] + 1) + part(n + 1))
        mid = (lo + hi) // 2
        return F.when(F.col(order) <= F.lit(cuts[mid][0]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return rows.withColumn("bucket", tree(0, len(cuts)))


def _after(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Add out: value of the next row within the bucket, of the next bucket's first row for the last one."""
    w = Window.partitionBy("bucket").orderBy("rank")
    rows = rows.withColumn("__within", F.lead(value).over(w))
    heads = rows.where("rank = 1").select(F.col("bucket"), F.col(value).alias("__head"))
    order = Window.orderBy("bucket")  # over the numbers of the buckets alone, which are a parameter
    numbers = heads.select("bucket")
    follows = numbers.select(F.col("bucket").alias("__before"), F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order)).alias("bucket"))
    heads = heads.join(follows, "bucket").select(F.col("__before").alias("bucket"), "__head")
    return rows.join(heads, "bucket").withColumn(out, F.when(F.col("__within").isNull(), F.col("__head")).otherwise(F.col("__within"))).drop("__within", "__head")


def neighbours(docs: DataFrame, buckets: int | None = None, repeats: int = REPEATS) -> DataFrame:
    """(bucket, rank, key, copies, text, next_text): each row with the text of the next, the last with that of the first.

    rank counts rows within the bucket from 1; (bucket, rank) is unique. A row
    that stands for several equal ones has their number as copies; each of
    these but the last has itself as the next.
    """
    d = docs.select(key_of(F.col("doc_id")).alias("key"), text_or_empty(F.col("text")).alias("text"))
    d, counted = collapsed(d, repeats, "fingerprints-repeats")
    d = (d if counted else d.withColumn("copies", F.lit(1).cast("long"))).withColumn("th", F.xxhash64("text"))
    d = in_buckets(d, "key", "th", buckets or 4 * shuffle_partitions(docs.sparkSession))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("key", "th", "text"))).drop("th")
    return _after(d, "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The text whose last quarter gives way to as many signs of the following one."""
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def compare_with_next(docs: DataFrame, buckets: int | None = None, repeats: int = REPEATS, asking: int = ASKING, radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_docs).

    near_docs: for rows whose id is divisible by asking, how many other
    documents have a fingerprint within the radius; null for other rows.

    The text moves once, to its bucket; terms are counted there. What remains
    of a document, two fingerprints and a digest, is staged; the next one's
    fingerprint and those within the radius are found among these.
    """
    d = neighbours(docs, buckets, repeats)
    # equal rows that go as one: the last is followed by another text, those before it by their own
    nexts = F.filter(F.array(F.struct(F.lit(True).alias("last"), F.col("next_text").alias("next_text"), F.lit(1).cast("long").alias("copies")), F.struct(F.lit(False).alias("last"), F.col("text").alias("next_text"), (F.col("copies") - 1).alias("copies"))), lambda x: x["copies"] > 0)
    d = d.select("bucket", "rank", "key", "text", F.explode(nexts).alias("x")).select("bucket", "rank", "key", "text", "x.*")
    d = d.withColumn("edited", edited(F.col("text"), F.col("next_text"))).select(
        "bucket", "rank", "key", "last", "copies", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited")).alias("which", "body"),
    )
    keys = ["bucket", "rank", "key", "last", "copies", "n_chars", "edited_sha256"]
    prints = fingerprint_rows(with_terms(d, "body", "terms").drop("body"), [*keys, "which"], "terms")
    pick_one = lambda k: F.max(F.when(F.col("which") == k, F.col("fingerprint")))
    both = stage_table(prints.groupBy(*keys).agg(pick_one(0).alias("fp"), pick_one(1).alias("edited_fp")), "fingerprints")
    near = within(both.where((F.col("key") != NO_ID) & (F.col("key") % asking == 0)).select("fp"), both.select("fp", "copies"), radius)
    rows = _after(both.where("last"), "fp", "next_fp")
    if docs_repeat := not both.where("not last").isEmpty():
        rows = rows.unionByName(both.where("not last").withColumn("next_fp", F.col("fp")))
    rows = rows.join(near, "fp", "left")
    if docs_repeat:
        rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        id_of(F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when((F.col("key") != NO_ID) & (F.col("key") % asking == 0), F.col("near") - 1).alias("near_docs"),
    )


def _blocks(radius: int, spare: int) -> list[int]:
    """Masks of the tables: each choice of spare of radius + spare blocks of bits, as a signed number."""
    n = radius + spare
    edges = [round(BITS * i / n) for i in range(n + 1)]
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(masks[i] for i in c)) for c in combinations(range(n), spare)]


def _in_tables(fps: DataFrame, masks: list[int]) -> DataFrame:
    """fps (fp, ...) once for each table, with the table's number t and the block of bits that is its key."""
    return fps.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "block"))


def within(asked: DataFrame, fps: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """(fp, near) for the fingerprints asked for: how many rows of fps (fp, copies) lie within the radius, itself included.

    Equal fingerprints are one row with their number before they enter the
    tables; a pair that several tables find counts in the first that could.
    """
    masks = _blocks(radius, spare)
    all_ones = _in_tables(fps.groupBy("fp").agg(F.sum("copies").alias("n")), masks)
    ask = _in_tables(asked.distinct(), masks).withColumnRenamed("fp", "a_fp")
    x = F.col("fp").bitwiseXOR(F.col("a_fp"))
    first = F.array_position(F.array(*[x.bitwiseAND(F.lit(m).cast("long")) == 0 for m in masks]), True) - 1
    a, b = ask.withColumnsRenamed({"t": "a_t", "block": "a_block"}), all_ones
    met = a.join(b, (F.col("a_t") == F.col("t")) & (F.col("a_block") == F.col("block")) & (F.bit_count(x) <= radius) & (F.col("t") == first))
    return met.groupBy(F.col("a_fp").alias("fp")).agg(F.sum("n").alias("near"))


def hamming_pairs(fps: DataFrame, radius: int = RADIUS, spare: int = SPARE, key: str = "id", fp: str = "fingerprint") -> DataFrame:
    """(fp_a, fp_b, distance, id_a, id_b): all pairs of distinct fingerprints within the radius.

    Each class of equal fingerprints is stood for by its smallest id; members
    follow from fps itself, so copies are never expanded into pairs. The 64
    bits form radius + spare blocks; whichever blocks differ, some choice of
    spare blocks is equal, and each choice is one table, keyed by those blocks'
    bits (about 64 * spare / (radius + spare) of them, so that random
    fingerprints seldom meet). A pair that several tables find is reported by
    the first that could. Null fingerprints take no part.
    """
    masks = _blocks(radius, spare)
    reps = fps.select(F.col(key).alias("id"), F.col(fp).alias("fp")).where("fp is not null").groupBy("fp").agg(F.min("id").alias("id"))
    tables = _in_tables(reps, masks)
    a, b = tables.select(F.col("fp").alias("fp_a"), F.col("id").alias("id_a"), "t", "block"), tables.select(F.col("fp").alias("fp_b"), F.col("id").alias("id_b"), "t", "block")
    x = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = F.array_position(F.array(*[x.bitwiseAND(F.lit(m).cast("long")) == 0 for m in masks]), True) - 1
    return (
        a.join(b, ["t", "block"]).where(F.col("fp_a") < F.col("fp_b")).withColumn("distance", F.bit_count(x))
        .where((F.col("distance") <= radius) & (F.col("t") == first)).select("fp_a", "fp_b", "distance", "id_a", "id_b")
    )
