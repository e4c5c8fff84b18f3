"""Vectors of texts, stored in generations and searched exactly."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.text import word_tokens
from tessera.operators import search
from tessera.sources.sinks import Generations, cache_lookup, upsert


class Embedder(Protocol):
    """What turns texts (key, text) into vectors (key, embedding) of dim numbers, of unit length; name tells models apart in caches."""

    name: str
    dim: int

    def embed(self, texts: DataFrame) -> DataFrame: ...


class HashEmbedder:
    """Signed feature hashing of a text's tokens: no model, no Python worker.

    A token's md5 gives its place (first four hex digits) and its sign (the
    fifth). A text without tokens is the zero vector. Keys are distinct.
    """

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"hash-{dim}"

    def embed(self, texts: DataFrame) -> DataFrame:
        toks = texts.select("key", F.explode_outer(word_tokens(F.col("text"))).alias("tok")).select("key", F.md5("tok").alias("h"))
        place = (F.conv(F.substring("h", 1, 4), 16, 10).cast("int") % self.dim).alias("place")
        sign = F.when(F.conv(F.substring("h", 5, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("sign")
        sums = toks.select("key", place, sign).groupBy("key", "place").agg(F.sum("sign").alias("x"))
        found = F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "x")))).alias("m")
        rows = sums.groupBy("key").agg(found, F.sqrt(F.sum(F.when(F.col("place").isNotNull(), F.col("x") * F.col("x")).otherwise(0.0))).alias("norm"))
        at = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
        return rows.select("key", at.alias("embedding"))


class VectorStore:
    """Vectors by key in generations; a search reads the current one. Vectors of texts that did not change are taken over."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder, keep: int = 3):
        self.spark, self.embedder, self.tables = spark, embedder, Generations(spark, root, keep)

    def _digested(self, texts: DataFrame) -> DataFrame:
        return texts.select("key", "text", F.sha2(F.concat(F.lit(self.embedder.name), F.lit("|"), F.coalesce("text", F.lit(""))), 256).alias("digest"))

    def build(self, texts: DataFrame) -> int:
        """Embed (key, text) and publish; returns the generation. A text's digest finds its vector in the generation before."""
        new = self._digested(texts)
        if self.tables.current("vectors") is None:
            return self.tables.publish("vectors", self._embedded(new))
        known = self.tables.load("vectors").select("digest", "embedding").dropDuplicates(["digest"])
        hits, misses = cache_lookup(new, known, "digest")
        return self.tables.publish("vectors", hits.select("key", "digest", "embedding").unionByName(self._embedded(misses)))

    def _embedded(self, rows: DataFrame) -> DataFrame:
        return rows.select("key", "digest").join(self.embedder.embed(rows.select("key", "text")), "key")

    def change(self, texts: DataFrame, deleted: DataFrame) -> int:
        """Publish the current generation with some keys changed or gone."""
        return self.tables.publish("vectors", upsert(self.tables.load("vectors"), self._embedded(self._digested(texts)), deleted, "key"))

    def search(self, text: str, k: int, threshold: float | None = None) -> DataFrame:
        """(key, score) of the k nearest."""
        query = self.embedder.embed(self.spark.createDataFrame([(0, text)], "key int, text string"))
        return search.nearest(self.tables.load("vectors"), query, k, threshold, key="key")
