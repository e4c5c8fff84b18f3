"""Debt, smells and habits of a code base, by rules over its facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators import graph, navigate as nav, program

#: Rule, category, minutes to mend.
DEBT = (
    ("complexity.high", "maintainability", 20), ("complexity.very_high", "maintainability", 30), ("complexity.extreme", "maintainability", 60), ("god_class", "changeability", 60), ("long_method", "maintainability", 30),
    ("long_param_list", "changeability", 15), ("deep_nesting", "maintainability", 15), ("todo_comment", "reliability", 10), ("high_coupling", "changeability", 20), ("missing_docs", "maintainability", 10),
)


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no from 1, line); a line break at the very end begins no line."""
    ls = files.select("path", F.posexplode(F.split(F.regexp_replace(F.coalesce("content", F.lit("")), r"\n\z", ""), "\n")).alias("n", "line"))
    return ls.select("path", (F.col("n") + 1).alias("line_no"), "line")


def todo_comments(files: DataFrame) -> DataFrame:
    """(path, line_no): lines whose comment holds a mark of work left undone."""
    return lines_of(files).where(F.col("line").rlike(r"(#|//|/\*|\*|--).*\b(TODO|FIXME|HACK|XXX|BUG)\b")).select("path", "line_no")


def debt_issues(files: DataFrame, f: DataFrame, coupling: int = 20, method_lines: int = 100, params: int = 5, depth: int = 4, class_methods: int = 20) -> DataFrame:
    """(path, name, rule, category, minutes): each issue once; of the three rules of complexity the strictest that holds.

    Thresholds are strictly exceeded. Coupling counts the modules that a file
    imports. Documentation is missed at public functions and classes.
    """
    fn, of = nav.functions_of(f), lambda df, rule: df.select("path", "name", F.lit(rule).alias("rule"))
    cc = F.when(F.col("complexity") > 25, "complexity.extreme").when(F.col("complexity") > 15, "complexity.very_high").when(F.col("complexity") > 10, "complexity.high")
    methods = f.where("kind = 'method'").groupBy("path", F.col("owner").alias("name")).agg(F.count("*").alias("n"))
    imports = program.imports(f).groupBy("path").agg(F.countDistinct("module").alias("n")).withColumn("name", F.lit(""))
    documented = f.where("kind = 'docstring'").select("path", "name").distinct()
    bare = program.definitions(f).where(nav.is_public(F.col("name")) & ~nav.is_test_path(F.col("path"))).join(documented, ["path", "name"], "left_anti")
    parts = [
        fn.select("path", "name", cc.alias("rule")).where("rule is not null"), of(methods.where(F.col("n") > class_methods), "god_class"), of(fn.where(F.col("end_line") - F.col("line") + 1 > method_lines), "long_method"),
        of(fn.where(F.col("params") > params), "long_param_list"), of(fn.where(F.col("nesting") > depth), "deep_nesting"), of(todo_comments(files).withColumn("name", F.col("line_no").cast("string")), "todo_comment"),
        of(imports.where(F.col("n") > coupling), "high_coupling"), of(bare, "missing_docs"),
    ]
    rules = f.sparkSession.createDataFrame(list(DEBT), "rule string, category string, minutes int")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(rules), "rule").select("path", "name", "rule", "category", "minutes")


def debt(files: DataFrame, f: DataFrame, hourly: float | None = None, **how) -> DataFrame:
    """(category, rule, issues, minutes, hours, per_kloc[, cost]): what the issues add up to."""
    issues = debt_issues(files, f, **how).groupBy("category", "rule").agg(F.count("*").alias("issues"), F.sum("minutes").alias("minutes"))
    size = lines_of(files).where("trim(line) <> ''").agg(F.count("*").alias("loc"))
    out = issues.crossJoin(F.broadcast(size)).select("category", "rule", "issues", "minutes", F.round(F.col("minutes") / 60, 4).alias("hours"), F.round(1000 * F.col("minutes") / F.col("loc"), 4).alias("per_kloc"))
    return out if hourly is None else out.withColumn("cost", F.round(F.col("hours") * hourly, 2))


def class_smells(f: DataFrame) -> DataFrame:
    """(path, name, smell, detail): data class (4 fields or more, 2 methods or fewer), lazy element (1 of each at most).

    Constructors are no methods here; a class that has bases, or others below it, is not lazy.
    """
    c = f.where("kind = 'class'").select("path", "name")
    m = f.where("kind = 'method'").select("path", F.col("owner").alias("name"), F.col("name").alias("method"))
    plain = m.where(~nav.last_part(F.col("method")).rlike("^__.*__$|^constructor$|^init$")).groupBy("path", "name").agg(F.count("*").alias("methods"))
    fields = f.where("kind = 'field'").select("path", F.col("detail").alias("name"), F.col("name").alias("field")).distinct()
    called = m.select("path", "name", nav.last_part(F.col("method")).alias("field"))
    fields = fields.join(called, ["path", "name", "field"], "left_anti").groupBy("path", "name").agg(F.count("*").alias("fields"))
    kin = f.where("kind = 'base'").select("path", F.col("owner").alias("name")).unionByName(f.where("kind = 'base'").select("path", "name")).distinct()
    j = c.join(plain, ["path", "name"], "left").join(fields, ["path", "name"], "left").fillna(0, ["methods", "fields"])
    detail = F.concat_ws("/", F.col("fields").cast("string"), F.col("methods").cast("string")).alias("detail")
    data = j.where("fields >= 4 and methods <= 2").select("path", "name", F.lit("DataClass").alias("smell"), detail)
    lazy = j.where("fields <= 1 and methods <= 1").join(kin, ["path", "name"], "left_anti").select("path", "name", F.lit("LazyElement").alias("smell"), detail)
    return data.unionByName(lazy)


def line_smells(files: DataFrame, f: DataFrame, longest: int = 3, primitives: int = 4) -> DataFrame:
    """(path, name, smell, detail): chains of more than longest calls on one line, functions with many parameters annotated by primitives."""
    links = F.regexp_extract_all("line", F.lit(r"(\.\w+\([^()]*\))+"), 0)
    length = F.array_max(F.transform(links, lambda x: F.size(F.regexp_extract_all(x, F.lit(r"\.\w+\("), 0))))
    chains = lines_of(files).withColumn("k", length).where(F.col("k") > longest)
    chains = chains.select("path", F.col("line_no").cast("string").alias("name"), F.lit("MessageChain").alias("smell"), F.col("k").cast("string").alias("detail"))
    typed = f.where("kind = 'typed' and detail in ('int', 'float', 'str', 'bool', 'bytes', 'complex')").groupBy("path", F.col("owner").alias("name")).agg(F.count("*").alias("k")).where(F.col("k") >= primitives)
    return chains.unionByName(typed.select("path", "name", F.lit("PrimitiveObsession").alias("smell"), F.col("k").cast("string").alias("detail")))


def all_smells(files: DataFrame, f: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """(path, name, smell, detail): every detector's findings, with low cohesion, dead code and high cognitive complexity."""
    own = program.code_smells(f, **how).select("path", "name", "smell", F.lit("").alias("detail"))
    members = f.where("kind = 'method'").select("path", F.col("owner").alias("cls0"), F.col("name").alias("method")).join(f.where("kind = 'field'").select("path", F.col("owner").alias("method"), F.col("name").alias("field")), ["path", "method"], "left")
    loose = graph.lcom4(members.select(F.concat_ws(":", "path", "cls0").alias("cls"), "method", "field")).where("lcom4 > 2")
    loose = loose.select(F.split("cls", ":")[0].alias("path"), F.split("cls", ":")[1].alias("name"), F.lit("LowCohesion").alias("smell"), F.col("lcom4").cast("string").alias("detail"))
    dead = nav.dead_functions(f, edges).select("path", "name", F.lit("DeadCode").alias("smell"), F.lit("").alias("detail"))
    return reduce(DataFrame.unionByName, [own, class_smells(f), line_smells(files, f), nav.call_smells(f), loose, dead])


#: Signal, category it speaks for, condition on a line.
SIGNALS = (
    ("deleted_flag", "soft_delete", r"\b(is_deleted|deleted_at|isDeleted)\b"), ("try", "error_handling", r"^\s*try\b"), ("raise", "error_handling", r"^\s*(raise|throw)\b"), ("custom_error", "error_handling", r"^\s*class \w+\((\w*Error|Exception)\)"),
    ("with", "resources", r"^\s*(async )?with\b"), ("close", "resources", r"\.close\(\)"), ("assert", "validation", r"^\s*assert\b"), ("isinstance", "validation", r"\bisinstance\("), ("guard", "validation", r"^\s*if not \w+"),
    ("test", "tests", r"^\s*(async )?def test_\w+"), ("fixture", "tests", r"@pytest\.fixture"), ("mock", "tests", r"\b(Mock|patch)\("), ("from", "imports", r"^from [\w.]+ import"), ("plain", "imports", r"^import \w+"), ("star", "imports", r"^from [\w.]+ import \*"),
    ("returns", "types", r"^\s*(async )?def .*\)\s*->"), ("annotated", "types", r"^\s*(async )?def \w+\([^)]*\w:\s*\w"), ("route", "api", r"@\w+\.(get|post|put|delete|route)\("), ("async_def", "async", r"^\s*async def\b"), ("await", "async", r"\bawait\b"),
)


def habits(files: DataFrame, f: DataFrame) -> DataFrame:
    """(category, signals, files, confidence): which habits a code base has, by how many of its files show a signal of each.

    Confidence is the share of parsed files, doubled and at most 1. Naming is a
    category of its own: the share of functions in the commonest style.
    """
    hit = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(s).alias("signal"), F.lit(c).alias("category"))) for s, c, p in SIGNALS]))
    rows = lines_of(files).select("path", F.explode(hit).alias("h")).select("path", "h.*")
    n = files.select("path").distinct().agg(F.count("*").alias("n"))
    by = rows.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"), F.countDistinct("path").alias("files"))
    by = by.crossJoin(F.broadcast(n)).select("category", "signals", "files", F.round(F.least(F.lit(1.0), 2.0 * F.col("files") / F.col("n")), 4).alias("confidence"))
    from tessera.functions.text import naming_style

    styles = nav.functions_of(f).select("path", naming_style(F.regexp_replace(nav.last_part(F.col("name")), "^_+|_+$", "")).alias("style"))
    styles = styles.select("path", F.when(F.col("style") == "lower", "snake").otherwise(F.col("style")).alias("style"))
    top = styles.groupBy("style").agg(F.count("*").alias("k"), F.countDistinct("path").alias("files"))
    best = top.agg(F.max(F.struct("k", "style", "files")).alias("b"), F.sum("k").alias("n")).where("n > 0")
    return by.unionByName(best.select(F.lit("naming").alias("category"), F.col("b.style").alias("signals"), F.col("b.files").alias("files"), F.round(F.col("b.k") / F.col("n"), 4).alias("confidence")))


def plan_chunks(files: DataFrame, f: DataFrame, budget: int, tokens: Column | None = None) -> DataFrame:
    """(path, part, first, last, size): lines of files in parts of at most budget tokens, cut between top-level definitions where that is possible.

    Neighbouring definitions share a part while they fit; one that is too large
    by itself is cut into parts of its own by lines, a line that is too large stays whole.
    A part never takes lines of two files.
    """
    count = F.size(F.regexp_extract_all("line", F.lit(r"\w+|[^\w\s]"), 0)) if tokens is None else tokens
    tops = f.where("kind in ('function', 'class') and owner is null").select("path", "line", "end_line")
    rows = lines_of(files).withColumn("size", count)
    per = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "size"))).alias("ls"))
    starts = tops.groupBy("path").agg(F.array_sort(F.collect_set("line")).alias("starts"))
    kind = "path string, part int, first int, last int, size long"

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for path, ls, begins in zip(frame["path"], frame["ls"], frame["starts"], strict=True):
                edge = set(begins) if begins is not None else set()
                pieces, piece = [], []
                for r in ls:
                    if piece and r["line_no"] in edge:
                        pieces.append(piece)
                        piece = []
                    piece.append((r["line_no"], r["size"]))
                pieces += [piece] if piece else []
                parts: list[list] = []
                whole = False
                for p in pieces:
                    size = sum(s for _, s in p)
                    if parts and whole and sum(s for _, s in parts[-1]) + size <= budget:
                        parts[-1] += p
                    elif size <= budget:
                        parts.append(list(p))
                        whole = True
                    else:
                        cut: list = []
                        for x in p:
                            if cut and sum(s for _, s in cut) + x[1] > budget:
                                parts.append(cut)
                                cut = []
                            cut.append(x)
                        parts.append(cut)
                        whole = False
                out += [(path, i, p[0][0], p[-1][0], sum(s for _, s in p)) for i, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["path", "part", "first", "last", "size"])

    return per.join(starts, "path", "left").mapInPandas(run, kind)
