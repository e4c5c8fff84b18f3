"""Queries over event streams replayed as tables, over sinks and over stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import sinks
from tessera.streaming import watcher


@query("watcher_batches")
def watcher_batches(spark, sf_dir):
    """Each user's events in windows of an hour that their first event opens."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("scope"), (scores.micros(F.col("ts")) / 1e6).alias("t"), F.col("event_type").alias("key"))
    return watcher.batches(e, length=3600.0, most_keys=3, burst=1800.0, most_burst=10)


@query("compact_output", """SELECT replace(replace(replace(replace(n_nationkey::VARCHAR || chr(9) || n_name, '\\', '\\\\'), chr(9), '\\t'), chr(13), '\\r'), chr(10), '\\n') AS value FROM nation""".replace("n_nationkey::VARCHAR || chr(9) || n_name", "n_name"))
def compact_output(spark, sf_dir):
    return sinks.compact(table(spark, sf_dir, "nation").select("n_name"))


@query("sarif_output", """SELECT '{"ruleId":"R1","level":"warning","message":{"text":"' || o_orderpriority || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || o_orderstatus || '"},"region":{"startLine":' || o_orderkey || '}}}]}' AS value FROM orders WHERE o_totalprice > 400000""")
def sarif_output(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    f = o.select(F.lit("R1").alias("rule"), F.lit("warning").alias("severity"), F.col("o_orderpriority").alias("message"), F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("line"))
    return sinks.sarif(f)


@query("dot_output", """SELECT '  "' || n_name || '" -> "' || r_name || '";' AS value FROM nation JOIN region ON n_regionkey = r_regionkey""")
def dot_output(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return sinks.dot(j.select(F.col("n_name").alias("src"), F.col("r_name").alias("dst")))


@query("incremental_upsert", """WITH old AS (SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'de'), new AS (SELECT doc_id, lang, n_chars + 1 AS n_chars FROM documents WHERE n_chars > 3000)
SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT * FROM new""")
def incremental_upsert(spark, sf_dir):
    """Old rows without changed and deleted ones, and the changed ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return sinks.upsert(d.where("lang <> 'de'"), d.where("n_chars > 3000").withColumn("n_chars", F.col("n_chars") + 1), gone, "doc_id")


@query("embedding_cache", "SELECT e.vec_id, d.doc_id IS NOT NULL AS hit FROM embeddings e LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON d.doc_id = e.vec_id")
def embedding_cache(spark, sf_dir):
    """Which vectors a cache of English documents holds."""
    want = table(spark, sf_dir, "embeddings").select("vec_id")
    cache = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    hits, misses = sinks.cache_lookup(want, cache, "vec_id")
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))
