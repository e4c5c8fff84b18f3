"""What the corpus operators share: safe inputs, row keys and the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The regular expression of a gap between words; a word is a run of anything else.
GAP = r"[\x20\x09-\x0D]+"
#: A null id sorts before every other one; it becomes null again in results.
NO_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, under internal names, so that further ones never clash."""
    return docs.select(*[docs[c].alias(name) for name, c in columns.items()])


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def key_of(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NO_ID))


def id_of(col: Column) -> Column:
    return F.when(col != NO_ID, col)


def words_of(text: Column) -> Column:
    """Runs of anything but blanks, in order."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session may lack it; it then gets a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = context.getCheckpointDir()
    return found


def stage_table(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there.

    narrow: the rows are few and short beside the texts that the number of
    shuffle partitions is meant for, so an eighth as many files will do. Files
    stay until drop_staged(), since lazily evaluated results may need them.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(1, shuffle_partitions(spark) // 8))
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that this process has staged and not dropped, in order.
_STAGED: list[str] = []


def staged_tables() -> list[str]:
    return list(_STAGED)


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that this process has staged, once all results that read them are written; tables of others stay."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        if path in _STAGED:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _STAGED.remove(path)


def collapsed(d: DataFrame, most: int, name: str) -> tuple[DataFrame, bool]:
    """Rows (key, text) and False; or (key, text, copies) and True if more than most rows are equal in both, of which one then stands for all.

    Rows are counted by key first, which is all that there is to do where no
    key is in so many; only the rows of such keys are told apart by digest.
    """
    keys = stage_table(d.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"), name, narrow=True)
    if keys.isEmpty():
        return d.select("key", "text"), False
    same = ["key", "digest"]
    named = d.select("key", "text", F.unhex(F.md5("text")).alias("digest"))
    many = named.select(*same).join(keys, "key", "left_semi").groupBy(*same).agg(F.count("*").alias("copies")).where(F.col("copies") > most)
    many = stage_table(many, name, narrow=True)
    if many.isEmpty():
        return d.select("key", "text"), False
    first = named.join(many, same, "left_semi").groupBy(*same).agg(F.first("text").alias("text")).join(many, same)
    alone = named.join(many, same, "left_anti").select("key", "text", F.lit(1).cast("long").alias("copies"))
    return alone.unionByName(first.select("key", "text", "copies")), True


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more: its cleaner acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == remainder
