"""Reports of other tools as tables: coverage, version control, diagnostics, error texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LINES = "file string, line int, hits long"


def coverage_format(content: Column) -> Column:
    return (
        F.when(content.rlike(r"<coverage[\s>]"), "cobertura").when(content.rlike(r"(?m)^SF:"), "lcov")
        .when(content.rlike(r'^\s*\{') & content.contains('"files"'), "coverage.py").otherwise("unknown")
    )


def lcov(reports: DataFrame, content: str = "content") -> DataFrame:
    """(file, line, hits) of DA records."""
    records = reports.select(F.explode(F.split(content, "end_of_record")).alias("r")).where(F.col("r").contains("SF:"))
    da = F.explode(F.regexp_extract_all("r", F.lit(r"(?m)^DA:(\d+,\d+)"), 1))
    d = records.select(F.trim(F.regexp_extract("r", r"(?m)^SF:(.*)$", 1)).alias("file"), da.alias("da"))
    return d.select("file", F.split("da", ",")[0].cast("int").alias("line"), F.split("da", ",")[1].cast("long").alias("hits"))


def cobertura(reports: DataFrame, content: str = "content") -> DataFrame:
    """(file, line, hits) of line elements within class elements."""
    classes = F.explode(F.regexp_extract_all(content, F.lit(r"(?s)(<class\b.*?</class>)"), 1))
    d = reports.select(classes.alias("c")).select(F.regexp_extract("c", r'filename="([^"]*)"', 1).alias("file"), F.explode(F.regexp_extract_all("c", F.lit(r"(<line\b[^>]*>)"), 1)).alias("l"))
    return d.select("file", F.regexp_extract("l", r'number="(\d+)"', 1).cast("int").alias("line"), F.regexp_extract("l", r'hits="(\d+)"', 1).cast("long").alias("hits")).groupBy("file", "line").agg(F.max("hits").alias("hits"))


def coverage_py(reports: DataFrame, content: str = "content") -> DataFrame:
    """(file, line, hits) of executed and missing lines."""
    kind = "files map<string, struct<executed_lines: array<int>, missing_lines: array<int>>>"
    d = reports.select(F.explode(F.from_json(content, kind)["files"]).alias("file", "f"))
    part = lambda c, n: d.select("file", F.explode(f"f.{c}").alias("line"), F.lit(n).cast("long").alias("hits"))
    return part("executed_lines", 1).unionByName(part("missing_lines", 0))


def coverage_totals(lines: DataFrame) -> DataFrame:
    """(file, lines, covered, percent)."""
    d = lines.groupBy("file").agg(F.count("*").alias("lines"), F.sum((F.col("hits") > 0).cast("long")).alias("covered"))
    return d.withColumn("percent", F.round(100.0 * F.col("covered") / F.col("lines"), 2))


def git_numstat(log: DataFrame) -> DataFrame:
    """(commit, author, date, file, added, deleted) of log (log_id, line_no, line).

    Header lines begin with 0x1E: 0x1E commit, author and date parted by 0x1F;
    numstat lines follow. Binary files count no lines. Commits of one log are
    told apart by a running count within that log.
    """
    head = F.col("line").startswith("\x1e")
    w = Window.partitionBy("log_id").orderBy("line_no")
    d = log.withColumn("c", F.sum(head.cast("int")).over(w))
    h = d.where(head).select("log_id", "c", F.split(F.substring("line", 2, 10_000), "\x1f").alias("h"))
    s = d.where(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t")).select("log_id", "c", F.split("line", "\t").alias("s"))
    number = lambda i: F.coalesce(F.expr(f"try_cast(s[{i}] as long)"), F.lit(0))
    j = s.join(h, ["log_id", "c"])
    return j.select(F.col("h")[0].alias("commit"), F.col("h")[1].alias("author"), F.to_date(F.substring(F.col("h")[2], 1, 10)).alias("date"), F.col("s")[2].alias("file"), number(0).alias("added"), number(1).alias("deleted"))


BOTS = ("[bot]", "dependabot", "renovate", "github-actions", "greenkeeper", "snyk", "depfu", "codecov", "semantic-release-bot", "pre-commit-ci", "mergify")


def is_bot(name: Column, email: Column) -> Column:
    both = F.lower(F.concat_ws(" ", name, email))
    out = F.lit(False)
    for b in BOTS:
        out = out | both.contains(b)
    return out


#: Tool: pattern of one line with groups file, line, column, severity or code, message; and the group order.
LINE_TOOLS = {
    "gcc": (r"^([^:\s]+):(\d+):(\d+): (error|warning|note): (.*)$", (1, 2, 3, 4, 5)),
    "tsc": (r"^(.+?)\((\d+),(\d+)\): (error|warning) (.*)$", (1, 2, 3, 4, 5)),
    "ruff": (r"^(.+?):(\d+):(\d+): ([A-Z]+\d+) (.*)$", (1, 2, 3, 4, 5)),
    "go": (r"^(.+?\.go):(\d+):(\d+): ()(.*)$", (1, 2, 3, 4, 5)),
    "clang": (r"^([^:\s]+):(\d+):(\d+): (?:fatal )?(error|warning|note): (.*)$", (1, 2, 3, 4, 5)),
    "mypy": (r"^(.+?):(\d+):(?:(\d+):)? (error|warning|note): (.*)$", (1, 2, 3, 4, 5)),
    "pyright": (r"^\s*(.+?):(\d+):(\d+) - (error|warning|information): (.*)$", (1, 2, 3, 4, 5)),
    "flake8": (r"^(.+?):(\d+):(\d+): ([A-Z]+\d+) (.*)$", (1, 2, 3, 4, 5)),
    "pylint": (r"^(.+?):(\d+):(\d+): ([A-Z]\d+): (.*)$", (1, 2, 3, 4, 5)),
    "eslint": (r"^(.+?): line (\d+), col (\d+), (Error|Warning) - (.*)$", (1, 2, 3, 4, 5)),
    "golangci": (r"^(.+?\.go):(\d+):(\d+): ()(.*)$", (1, 2, 3, 4, 5)),
    "cargo": (r"^(.+?\.rs):(\d+):(\d+): (error|warning|note)(?:\[\w+\])?: (.*)$", (1, 2, 3, 4, 5)),
    "javac": (r"^(.+?\.java):(\d+):() (error|warning): (.*)$", (1, 2, 3, 4, 5)),
    "kotlinc": (r"^(.+?\.kts?):(\d+):(\d+): (error|warning): (.*)$", (1, 2, 3, 4, 5)),
    "swiftc": (r"^(.+?\.swift):(\d+):(\d+): (error|warning|note): (.*)$", (1, 2, 3, 4, 5)),
    "dotnet": (r"^(.+?)\((\d+),(\d+)\): (error|warning) (.*?)(?: \[[^\]]*\])?$", (1, 2, 3, 4, 5)),
    "rubocop": (r"^(.+?):(\d+):(\d+): ([CWEFR]): (.*)$", (1, 2, 3, 4, 5)),
    "luacheck": (r"^\s*(.+?):(\d+):(\d+): (?:\()?([EW]\d+)(?:\))? (.*)$", (1, 2, 3, 4, 5)),
    "phpstan": (r"^(.+?\.php):(\d+):()()(.*)$", (1, 2, 3, 4, 5)),
    "shellcheck": (r"^(.+?):(\d+):(\d+): (error|warning|note): (.*)$", (1, 2, 3, 4, 5)),
}


def diagnostics(lines: DataFrame, tool: str) -> DataFrame:
    """(file, line, column, severity, message) of a tool's output lines (line)."""
    pattern, g = LINE_TOOLS[tool]
    d = lines.where(F.col("line").rlike(pattern))
    x = lambda i: F.regexp_extract("line", pattern, g[i])
    said = F.lower(x(3))
    severity = F.when(said.isin("error", "warning", "note"), said).when(said == "information", "note").when(x(3).rlike(r"^E|^F(\d{4})?$"), "error").when(x(3) == "", "error").otherwise("warning")
    return d.select(x(0).alias("file"), x(1).try_cast("int").alias("line_no"), x(2).try_cast("int").alias("column"), severity.alias("severity"), x(4).alias("message"))


def exit_code(found: DataFrame, strict: bool = False) -> DataFrame:
    """One row (code): 1 on any error, or on warnings if strict."""
    bad = F.col("severity") == "error"
    if strict:
        bad = bad | (F.col("severity") == "warning")
    return found.agg(F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("code"))


def parsed_error(text: Column) -> Column:
    """struct(language, type, message, file, line) of a compiler's or runtime's error text."""
    x = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    py, js, rs, ts = r'(?s).*File "([^"]+)", line (\d+).*?\n(\w+(?:Error|Exception|Interrupt)): ?([^\n]*)', r"(?s)^(\w*Error): ([^\n]*)\n\s+at .*?\(?([^\s()]+):(\d+):\d+\)?", r"(?s)^error\[(E\d+)\]: ([^\n]*)\n\s+--> ([^:]+):(\d+)", r"^(.+?)\((\d+),\d+\): error (TS\d+): (.*)$"

    def made(lang, p, kind, msg, file, line):
        return F.struct(F.lit(lang).alias("language"), x(p, kind).alias("type"), x(p, msg).alias("message"), x(p, file).alias("file"), x(p, line).cast("int").alias("line"))

    return (
        F.when(text.rlike(rs), made("rust", rs, 1, 2, 3, 4)).when(text.rlike(ts), made("typescript", ts, 3, 4, 1, 2))
        .when(text.rlike(py), made("python", py, 3, 4, 1, 2)).when(text.rlike(js), made("javascript", js, 1, 2, 3, 4))
    )
