"""Output forms and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.text import escape_cell


def compact(df: DataFrame) -> DataFrame:
    """One column, value: the cells of each row escaped and joined by tabs; nulls are empty."""
    return df.select(F.concat_ws("\t", *[F.coalesce(escape_cell(F.col(c).cast("string")), F.lit("")) for c in df.columns]).alias("value"))


def dot(edges: DataFrame) -> DataFrame:
    """One column, value: a line of a DOT graph for each edge."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(";")).alias("value"))


def sarif(findings: DataFrame) -> DataFrame:
    """One column, value: a SARIF result object for each of (rule, severity, message, file, line)."""
    region = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(region).alias("locations"))).alias("value"))


def cache_key(args: Column) -> Column:
    """The sha256 of a map of arguments as JSON with sorted keys, so that their order does not matter."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(args)))), 256)


class Generations:
    """Versioned tables in one folder: data first, then a manifest row; readers see only what the manifest names.

    A generation whose write fails leaves no manifest row. keep bounds how many
    generations prune() leaves.
    """

    SCHEMA = "gen long, name string, path string, digest long, active boolean, at timestamp"

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def manifest(self) -> DataFrame:
        path = f"{self.root}/manifest"
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(path)

    def _log(self, gen: int, name: str, path: str, digest: int) -> None:
        row = self.spark.createDataFrame([(gen, name, path, digest, True)], "gen long, name string, path string, digest long, active boolean")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def current(self, name: str) -> tuple[int, str] | None:
        row = self.manifest().where(F.col("name") == name).orderBy(F.desc("at"), F.desc("gen")).select("gen", "path").first()
        return (row["gen"], row["path"]) if row else None

    def publish(self, name: str, df: DataFrame) -> int:
        """Write a generation and make it current; returns its number."""
        last = self.manifest().where(F.col("name") == name).agg(F.max("gen")).first()[0]
        gen = (last or 0) + 1
        path = f"{self.root}/{name}/gen={gen}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        digest = self.spark.read.parquet(path).agg(F.bit_xor(F.xxhash64(*df.columns))).first()[0] or 0
        self._log(gen, name, path, digest)
        return gen

    def load(self, name: str) -> DataFrame:
        now = self.current(name)
        if now is None:
            raise LookupError(f"{name} has no generation")
        return self.spark.read.parquet(now[1])

    def rollback(self, name: str, gen: int) -> None:
        """Make an earlier generation current again."""
        row = self.manifest().where((F.col("name") == name) & (F.col("gen") == gen)).select("path", "digest").first()
        if row is None:
            raise LookupError(f"{name} has no generation {gen}")
        self._log(gen, name, row["path"], row["digest"])


    def prune(self, name: str) -> int:
        """Delete the files of all but the newest keep generations and the current one; returns how many went.

        The manifest keeps their rows, so numbers are never used again.
        """
        now = self.current(name)
        rows = self.manifest().where(F.col("name") == name).select("gen", "path").distinct().orderBy(F.desc("gen")).collect()  # one a generation
        jvm, gone = self.spark.sparkContext._jvm, 0
        for r in rows[self.keep :]:
            if now is None or r["path"] != now[1]:
                at = jvm.org.apache.hadoop.fs.Path(r["path"])
                gone += bool(at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))
        return gone


def upsert(old: DataFrame, changed: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """The old rows whose key neither changed nor went, and the new ones."""
    gone = changed.select(key).unionByName(deleted.select(key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(changed.select(*old.columns))


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of keys against a cache table."""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")
