"""Project files as a table, with the exclusions of a source walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.text import glob_to_regex

EXCLUDED = ("node_modules", ".git", "__pycache__", "target", "dist", "build", ".venv", "venv", "vendor")
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby", "kt": "kotlin", "swift": "swift", "cs": "csharp", "scala": "scala", "php": "php", "lua": "lua", "luau": "luau",
    "ex": "elixir", "exs": "elixir", "ml": "ocaml",
}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether an ignore file's lines leave a path out: the last that matches decides, ! takes back, / at the end means folders.

    A pattern with a slash inside is taken from the root, others from anywhere.
    """
    out = F.lit(False)
    for p in (x.strip() for x in patterns):
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.removeprefix("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        body = glob_to_regex(p.removeprefix("/"))[1:-1]
        begin = "^" if "/" in p else "(^|/)"
        out = F.when(path.rlike(f"{begin}{body}{'/' if folder else '(/|$)'}"), not back).otherwise(out)
    return out


def walk(spark: SparkSession, root: str, hidden: bool = False, exclude: tuple[str, ...] = (), ignore: tuple[str, ...] = EXCLUDED, most_bytes: int = 5_000_000, ignore_file: str | None = ".gitignore") -> DataFrame:
    """(path, content, language, status): files below a root, but for those that its ignore file names.

    status is ok, oversize, binary (a zero byte) or lossy (not UTF-8); content
    is null unless ok or lossy. One bad file never fails the scan.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    d = raw.select(rel.alias("path"), "length", F.col("content").alias("raw"))
    parts = F.split("path", "/")
    d = d.where(~F.exists(parts, lambda p: p.isin(*ignore)))
    if not hidden:
        d = d.where(~F.exists(parts, lambda p: p.startswith(".")))
    if ignore_file:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{ignore_file}")
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(at):  # one small file; Spark's own readers skip hidden ones
            opened = store.open(at)
            lines = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8").split("\n")
            opened.close()
            d = d.where(~ignored(F.col("path"), lines))
    for g in exclude:
        d = d.where(~F.col("path").rlike(glob_to_regex(g)))
    text = F.try_validate_utf8(F.col("raw").cast("string"))
    status = F.when(F.col("length") > most_bytes, "oversize").when(F.contains(F.col("raw"), F.unhex(F.lit("00"))), "binary").when(text.isNull(), "lossy").otherwise("ok")
    d = d.withColumn("status", status)
    content = F.when(F.col("status") == "ok", text).when(F.col("status") == "lossy", F.make_valid_utf8(F.col("raw").cast("string")))
    return d.select("path", content.alias("content"), language_of(F.col("path")).alias("language"), "status")


def tree(files: DataFrame) -> DataFrame:
    """(parent, children): the directory tree as sorted lists of names, folders with a slash."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"),
        F.concat(F.element_at(parts, i), F.when(i < F.size(parts), "/").otherwise("")).alias("name"),
    ))
    rows = files.select(F.explode(steps).alias("s")).select("s.parent", "s.name").distinct()
    return rows.groupBy("parent").agg(F.sort_array(F.collect_list("name")).alias("children"))
