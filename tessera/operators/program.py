"""Facts of source and dataflow of Python source, one Arrow batch of files at a time.

Files are a table (path, content). Parsing needs a parser, so extraction runs in
mapInPandas; a Python file that does not parse gives one row of kind "error" and
no others, files in languages with braces are read by line and bracket. What follows from facts (calls, importers, inheritance, metrics) is
relational. Dataflow is per function: the function is the unit of parallelism,
its fixpoints are small.
"""

from __future__ import annotations

import ast
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators import braces, values
from tessera.sources.files import LANGUAGES

FACTS = "path string, kind string, name string, owner string, detail string, line int, end_line int, params int, complexity int, cognitive int, nesting int"
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def cyclomatic(fn: ast.AST) -> int:
    """1, and 1 for each decision; each further operand of a boolean operator counts too."""
    n = 1
    for x in ast.walk(fn):
        n += isinstance(x, BRANCHES)
        n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
        n += len(x.cases) if isinstance(x, ast.Match) else 0
    return n


def cognitive(fn: ast.AST) -> int:
    """Structures cost 1 and their nesting; runs of one boolean operator, else and elif cost 1."""

    def walk(body: list, depth: int) -> int:
        total = 0
        for x in body:
            total += cost(x, depth)
        return total

    def cost(x: ast.AST, depth: int) -> int:
        n = 0
        if isinstance(x, ast.If):
            n += 1 + depth + cost(x.test, depth) + walk(x.body, depth + 1)
            if len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If):
                return n + cost(x.orelse[0], depth) - depth
            return n + (1 + walk(x.orelse, depth + 1) if x.orelse else 0)
        if isinstance(x, (ast.For, ast.AsyncFor, ast.While)):
            n += 1 + depth
            return n + sum(cost(c, depth + 1) for c in ast.iter_child_nodes(x))
        if isinstance(x, ast.ExceptHandler):
            return 1 + depth + walk(x.body, depth + 1)
        if isinstance(x, ast.BoolOp):
            n += 1
        inner = depth + 1 if isinstance(x, (*FUNCTIONS, ast.Lambda)) else depth
        return n + sum(cost(c, inner) for c in ast.iter_child_nodes(x))

    return walk(getattr(fn, "body", []), 0)


def nesting(node: ast.AST, depth: int = 0) -> int:
    deep = isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.Try))
    return max([depth + deep, *(nesting(c, depth + deep) for c in ast.iter_child_nodes(node))])


def dotted(x: ast.AST) -> str:
    if isinstance(x, ast.Name):
        return x.id
    if isinstance(x, ast.Attribute):
        return f"{dotted(x.value)}.{x.attr}" if dotted(x.value) else x.attr
    return ""


def file_facts(path: str, content: str) -> list[tuple]:
    """Rows of FACTS for one file."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as e:
        return [(path, "error", type(e).__name__, None, str(e), getattr(e, "lineno", None), None, None, None, None, None)]
    out = []

    def row(kind, name, owner, detail, x, *numbers):
        out.append((path, kind, name, owner, detail, getattr(x, "lineno", None), getattr(x, "end_lineno", None), *(numbers or (None,) * 4)))

    def visit(x: ast.AST, owner: str, cls: str) -> None:
        for c in ast.iter_child_nodes(x):
            name, inner = owner, cls
            if isinstance(c, FUNCTIONS):
                a = c.args
                n = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                name = f"{owner}.{c.name}" if owner else c.name
                row("method" if cls and owner == cls else "function", name, owner or None, f"({', '.join(p.arg for p in [*a.posonlyargs, *a.args, *a.kwonlyargs])})", c, n, cyclomatic(c), cognitive(c), nesting(c))
                for p in [*a.posonlyargs, *a.args, *a.kwonlyargs]:
                    if p.annotation is not None and dotted(p.annotation):
                        row("typed", p.arg, name, dotted(p.annotation), p)
                for d in c.decorator_list:
                    row("decorator", dotted(d.func if isinstance(d, ast.Call) else d), name, None, d)
                doc = ast.get_docstring(c)
                if doc:
                    row("docstring", name, owner or None, doc, c)
            elif isinstance(c, ast.ClassDef):
                name = f"{owner}.{c.name}" if owner else c.name
                inner = name
                row("class", name, owner or None, None, c)
                for b in c.bases:
                    row("base", dotted(b), name, None, b)
            elif isinstance(c, ast.Import):
                for a in c.names:
                    row("import", a.name, owner or None, a.asname, c)
            elif isinstance(c, ast.ImportFrom):
                for a in c.names:
                    row("import_from", "." * c.level + (c.module or ""), owner or None, a.name if not a.asname else f"{a.name} as {a.asname}", c)
            elif isinstance(c, ast.Call):
                row("call", dotted(c.func), owner or None, None, c)
            elif isinstance(c, ast.Name):
                row("write" if isinstance(c.ctx, ast.Store) else "read", c.id, owner or None, None, c)
            elif isinstance(c, ast.Attribute) and dotted(c.value) == "self" and cls:
                row("field", c.attr, owner, cls, c)
            elif isinstance(c, ast.Attribute) and dotted(c.value):
                row("attribute", c.attr, owner or None, dotted(c.value), c)
            elif isinstance(c, ast.Assign) and owner and len(c.targets) == 1 and isinstance(c.targets[0], ast.Name) and isinstance(c.value, ast.Call) and dotted(c.value.func):
                row("typed", c.targets[0].id, owner, dotted(c.value.func), c)
            elif isinstance(c, ast.Assign) and not owner and all(isinstance(t, ast.Name) and t.id.isupper() for t in c.targets):
                row("constant", c.targets[0].id, None, None, c)
            elif isinstance(c, ast.Assert) or (isinstance(c, ast.Raise) and owner):
                row("assertion" if isinstance(c, ast.Assert) else "raise", ast.unparse(c.test if isinstance(c, ast.Assert) else c.exc) if isinstance(c, ast.Assert) or c.exc else "", owner or None, None, c)
            visit(c, name, inner)

    visit(tree, "", "")
    return out


#: Reader of a file's facts by language; each takes (path, content).
HANDLERS = {"python": file_facts} | {x: partial(lambda language, path, content: braces.file_facts(path, content, language), x) for x in braces.LANGUAGES}


def handler_of(path: str):
    """The reader for a path's extension, Python's where there is none; None for other kinds of file."""
    _, dot, ext = path.rsplit("/", 1)[-1].rpartition(".")
    return HANDLERS.get(LANGUAGES.get(ext.lower(), "")) if dot else file_facts


def facts(files: DataFrame) -> DataFrame:
    """All facts of files (path, content), read by language."""
    names = [x.split()[0] for x in FACTS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, c in zip(frame["path"], frame["content"], strict=True) if (read := handler_of(p)) for r in read(p, c or "")]
            df = pd.DataFrame(rows, columns=names)
            for c in names[5:]:
                df[c] = df[c].astype("Int32")
            yield df

    return files.select("path", "content").mapInPandas(run, FACTS)


def definitions(f: DataFrame) -> DataFrame:
    return f.where(F.col("kind").isin("function", "method", "class")).select("path", "name", "kind", "detail", "line", "end_line", "params", "complexity", "cognitive", "nesting")


def imports(f: DataFrame) -> DataFrame:
    return f.where(F.col("kind").isin("import", "import_from")).select("path", F.col("name").alias("module"), F.col("detail").alias("names"), "line", (F.col("kind") == "import_from").alias("is_from"))


def importers(f: DataFrame, module: str) -> DataFrame:
    """(path, line): files that import a module or a part of it, by their first such line."""
    m = imports(f).where((F.col("module") == module) | F.col("module").startswith(module + "."))
    return m.groupBy("path").agg(F.min("line").alias("line"))


def module_of(path: Column) -> Column:
    """The module of a path: slashes as dots, without .py and __init__."""
    return F.regexp_replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), "/", ".")


def call_edges(f: DataFrame) -> DataFrame:
    """(src_file, src_func, dst_file, dst_func, call_type): calls resolved in their file, then through imports.

    A bare name resolves to a definition of its file; self.x to a method of the
    caller's class; a name imported by "from m import x", or m.x after "import
    m", to the definition in that module's file; v.x, where v is annotated as a
    class or bound to one's instance in the same function, to the method of that
    class or of the nearest of its bases. Others stay unresolved.
    """
    d = definitions(f).select(F.col("path").alias("dst_file"), F.col("name").alias("dst_func"))
    calls = f.where("kind = 'call' and owner is not null and name <> ''").select(F.col("path").alias("src_file"), F.col("owner").alias("src_func"), F.col("name").alias("target")).distinct()
    own = F.regexp_replace("src_func", r"\.[^.]*$", "")
    calls = calls.withColumn("local", F.when(F.col("target").rlike(r"^(self|this)\."), F.concat_ws(".", own, F.substring("target", 6, 1000))).otherwise(F.col("target")))
    intra = calls.join(d, (F.col("src_file") == F.col("dst_file")) & (F.col("local") == F.col("dst_func")))
    intra = intra.select("src_file", "src_func", "dst_file", "dst_func", F.when(F.col("target").rlike(r"^(self|this)\."), "method").otherwise("intra").alias("call_type"), "target")
    m = d.withColumn("module", module_of(F.col("dst_file")))
    named = f.where("kind = 'import_from'").select(F.col("path").alias("src_file"), F.col("name").alias("module"), F.regexp_extract("detail", r"(\w+)$", 1).alias("alias"), F.regexp_extract("detail", r"^(\w+)", 1).alias("orig"))
    # from m import x: x(...); from package import module: module.x(...)
    direct = calls.join(named, "src_file").where("target = alias").join(m, "module").where("dst_func = orig").select("src_file", "src_func", "dst_file", "dst_func", F.lit("direct").alias("call_type"), "target")
    part = named.select("src_file", F.concat_ws(".", "module", "orig").alias("module"), "alias")
    whole = f.where("kind = 'import'").select(F.col("path").alias("src_file"), F.col("name").alias("module"), F.coalesce("detail", "name").alias("alias"))
    attr = calls.join(part.unionByName(whole), "src_file").where(F.col("target").startswith(F.concat(F.col("alias"), F.lit(".")))).join(m, "module")
    attr = attr.where(F.col("target") == F.concat_ws(".", "alias", "dst_func")).select("src_file", "src_func", "dst_file", "dst_func", F.lit("attr").alias("call_type"), "target")
    return intra.unionByName(direct).unionByName(attr).drop("target").unionByName(_received(f, calls, d)).distinct()


def _classes_by_name(f: DataFrame) -> DataFrame:
    """(src_file, alias, c_file, cls): the classes that a name stands for in a file, its own before imported ones."""
    c = f.where("kind = 'class'").select(F.col("path").alias("c_file"), F.col("name").alias("cls"))
    own = c.select(F.col("c_file").alias("src_file"), F.col("cls").alias("alias"), "c_file", "cls", F.lit(0).alias("n"))
    named = f.where("kind = 'import_from'").select(F.col("path").alias("src_file"), F.col("name").alias("module"), F.regexp_extract("detail", r"(\w+)$", 1).alias("alias"), F.regexp_extract("detail", r"^(\w+)", 1).alias("cls"))
    far = named.join(c.withColumn("module", module_of(F.col("c_file"))), ["module", "cls"]).select("src_file", "alias", "c_file", "cls", F.lit(1).alias("n"))
    best = own.unionByName(far).groupBy("src_file", "alias").agg(F.min(F.struct("n", "c_file", "cls")).alias("b"))
    return best.select("src_file", "alias", "b.c_file", "b.cls")


def _received(f: DataFrame, calls: DataFrame, d: DataFrame, most_bases: int = 8) -> DataFrame:
    """Calls v.x on names of known class, looked up in the class and then in its bases, nearest first."""
    names = _classes_by_name(f)
    typed = f.where("kind = 'typed'").select(F.col("path").alias("src_file"), F.col("owner").alias("src_func"), F.col("name").alias("var"), F.col("detail").alias("alias")).distinct()
    on = calls.where(F.col("target").rlike(r"^\w+\.\w+$") & ~F.col("target").startswith("self.")).select("src_file", "src_func", F.split("target", r"\.")[0].alias("var"), F.split("target", r"\.")[1].alias("method"))
    at = on.join(typed, ["src_file", "src_func", "var"]).join(names, ["src_file", "alias"]).select("src_file", "src_func", "var", "method", "c_file", "cls")
    bases = f.where("kind = 'base'").select(F.col("path").alias("src_file"), F.col("owner").alias("sub"), F.col("name").alias("alias")).join(names, ["src_file", "alias"])
    bases = bases.select(F.col("src_file").alias("s_file"), "sub", F.col("c_file").alias("b_file"), F.col("cls").alias("b_cls"))
    found = None
    for _ in range(most_bases):
        hit = at.join(d, (F.col("c_file") == F.col("dst_file")) & (F.concat_ws(".", "cls", "method") == F.col("dst_func")))
        hit = hit.select("src_file", "src_func", "var", "method", "dst_file", "dst_func")
        found = hit if found is None else found.unionByName(hit)
        rest = at.join(hit.select("src_file", "src_func", "var", "method").distinct(), ["src_file", "src_func", "var", "method"], "left_anti")
        at = rest.join(bases, (F.col("c_file") == F.col("s_file")) & (F.col("cls") == F.col("sub"))).select("src_file", "src_func", "var", "method", F.col("b_file").alias("c_file"), F.col("b_cls").alias("cls")).distinct()
        if at.isEmpty():
            break
    return found.select("src_file", "src_func", "dst_file", "dst_func", F.lit("receiver").alias("call_type"))


def code_smells(f: DataFrame, methods: int = 20, loc: int = 50, cc: int = 10, params: int = 5, depth: int = 4) -> DataFrame:
    """(path, name, smell): strictly above thresholds; a long method by lines is not named by complexity too."""
    d = definitions(f)
    lines = F.col("end_line") - F.col("line") + 1
    fn = F.col("kind") != "class"
    per_fn = d.where(fn).select("path", "name", F.explode(F.array_compact(F.array(
        F.when(lines > loc, "LongMethod").when(F.col("complexity") > cc, "LongMethod"), F.when(F.col("params") > params, "LongParameterList"),
        F.when(F.col("cognitive") > 15, "HighCognitiveComplexity"), F.when(F.col("nesting") > depth, "DeepNesting"),
    ))).alias("smell"))
    own = f.where("kind = 'method'").groupBy("path", F.col("owner").alias("name")).agg(F.count("*").alias("n"))
    return per_fn.unionByName(own.where(F.col("n") > methods).select("path", "name", F.lit("GodClass").alias("smell")))


# --- one function's flow graph -------------------------------------------------


class Flow:
    """Statements of a function as nodes with successors, definitions and uses."""

    def __init__(self, fn: ast.AST):
        self.fn = fn
        self.stmts: list[ast.AST | None] = [None]  # 0: entry, which defines the parameters
        self.succ: dict[int, set[int]] = defaultdict(set)
        a = fn.args
        self.params = [p.arg for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]]
        self.exit = -1
        ends = self._body(fn.body, {0}, [])
        for e in ends:
            self.succ[e].add(self.exit)
        n = len(self.stmts)
        self.succ = {(n if k == -1 else k): {n if x == -1 else x for x in v} for k, v in self.succ.items()}
        self.exit = n
        self.stmts.append(None)
        self.pred: dict[int, set[int]] = defaultdict(set)
        for k, v in self.succ.items():
            for x in v:
                self.pred[x].add(k)
        self.defs = [set(self.params) if i == 0 else self._names(s, ast.Store) for i, s in enumerate(self.stmts)]
        self.uses = [self._names(s, ast.Load) for s in self.stmts]
        for i, s in enumerate(self.stmts):
            if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
                self.uses[i].add(s.target.id)

    @staticmethod
    def _head(s: ast.AST | None) -> list[ast.AST]:
        """The parts of a statement that run at its own node."""
        if s is None:
            return []
        if isinstance(s, (ast.If, ast.While)):
            return [s.test]
        if isinstance(s, (ast.For, ast.AsyncFor)):
            return [s.target, s.iter]
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return [x for i in s.items for x in (i.context_expr, i.optional_vars) if x is not None]
        if isinstance(s, (ast.Try, ast.Match, *FUNCTIONS, ast.ClassDef)):
            return [s.subject] if isinstance(s, ast.Match) else []
        return [s]

    def _names(self, s: ast.AST | None, ctx: type) -> set[str]:
        out = {x.id for h in self._head(s) for x in ast.walk(h) if isinstance(x, ast.Name) and isinstance(x.ctx, ctx)}
        return out | ({s.name} if isinstance(s, (*FUNCTIONS, ast.ClassDef)) and ctx is ast.Store else set())

    def _body(self, body: list[ast.AST], into: set[int], loops: list[tuple[int, set[int]]]) -> set[int]:
        for s in body:
            i = len(self.stmts)
            self.stmts.append(s)
            for p in into:
                self.succ[p].add(i)
            into = {i}
            if isinstance(s, ast.If):
                into = self._body(s.body, {i}, loops) | (self._body(s.orelse, {i}, loops) if s.orelse else {i})
            elif isinstance(s, (ast.For, ast.AsyncFor, ast.While)):
                breaks: set[int] = set()
                for e in self._body(s.body, {i}, [*loops, (i, breaks)]):
                    self.succ[e].add(i)
                into = (self._body(s.orelse, {i}, loops) if s.orelse else {i}) | breaks
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                into = self._body(s.body, {i}, loops)
            elif isinstance(s, ast.Try):
                first = len(self.stmts)
                done = self._body(s.body, {i}, loops)
                inside = {i, *range(first, len(self.stmts))}
                caught = set().union(*[self._body(h.body, inside, loops) for h in s.handlers]) if s.handlers else set()
                done = self._body(s.orelse, done, loops) if s.orelse else done
                into = self._body(s.finalbody, done | caught, loops) if s.finalbody else done | caught
            elif isinstance(s, ast.Match):
                into = set().union({i}, *[self._body(c.body, {i}, loops) for c in s.cases])
            elif isinstance(s, (ast.Return, ast.Raise)):
                self.succ[i].add(self.exit)
                into = set()
            elif isinstance(s, ast.Break) and loops:
                loops[-1][1].add(i)
                into = set()
            elif isinstance(s, ast.Continue) and loops:
                self.succ[i].add(loops[-1][0])
                into = set()
        return into

    def line(self, i: int) -> int:
        return getattr(self.stmts[i], "lineno", 0)

    def reaching(self) -> list[set[tuple[str, int]]]:
        """Definitions (name, node) that reach each node's start."""
        n = len(self.stmts)
        into, out = [set() for _ in range(n)], [set() for _ in range(n)]
        work = list(range(n))
        while work:
            i = work.pop(0)
            into[i] = set().union(*[out[p] for p in self.pred[i]])
            new = {(v, j) for v, j in into[i] if v not in self.defs[i]} | {(v, i) for v in self.defs[i]}
            if new != out[i]:
                out[i] = new
                work += [x for x in self.succ.get(i, ()) if x not in work]
        return into

    def live(self) -> list[set[str]]:
        """Names whose values are wanted after each node."""
        n = len(self.stmts)
        after = [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for i in reversed(range(n)):
                new = set().union(*[self.uses[x] | (after[x] - self.defs[x]) for x in self.succ.get(i, ())])
                if new != after[i]:
                    after[i], changed = new, True
        return after

    def dominators(self) -> list[set[int]]:
        n = len(self.stmts)
        dom = [{0}] + [set(range(n)) for _ in range(n - 1)]
        changed = True
        while changed:
            changed = False
            for i in range(1, n):
                p = [dom[x] for x in self.pred[i]]
                new = (set.intersection(*p) if p else set()) | {i}
                if new != dom[i]:
                    dom[i], changed = new, True
        return dom

    def idom(self) -> dict[int, int]:
        dom = self.dominators()
        return {i: max(dom[i] - {i}, key=lambda d: len(dom[d])) for i in range(1, len(self.stmts)) if self.pred[i] and len(dom[i]) > 1}

    def frontier(self) -> dict[int, set[int]]:
        up, out = self.idom(), defaultdict(set)
        for i in range(len(self.stmts)):
            if len(self.pred[i]) >= 2:
                for p in self.pred[i]:
                    r = p
                    while r != up.get(i) and r in up or r == 0 and up.get(i) != 0:
                        out[r].add(i)
                        if r == 0:
                            break
                        r = up[r]
        return out

    def phis(self) -> set[tuple[str, int]]:
        """Where minimal SSA joins versions: (name, node)."""
        df, out = self.frontier(), set()
        for v in set().union(*self.defs):
            work = [i for i, d in enumerate(self.defs) if v in d]
            while work:
                for j in df.get(work.pop(), ()):
                    if (v, j) not in out:
                        out.add((v, j))
                        work.append(j)
        return out

    def expressions(self) -> list[set[str]]:
        """Binary expressions that are available at each node, commutative operands in order."""

        def text(x: ast.AST) -> str:
            if isinstance(x, ast.BinOp):
                a, b = text(x.left), text(x.right)
                if isinstance(x.op, (ast.Add, ast.Mult, ast.BitAnd, ast.BitOr, ast.BitXor)):
                    a, b = sorted((a, b))
                return f"({a} {type(x.op).__name__} {b})"
            return ast.unparse(x)

        n = len(self.stmts)
        gen, names = [], {}
        for s in self.stmts:
            here = set()
            for h in self._head(s):
                for x in ast.walk(h):
                    if isinstance(x, ast.BinOp):
                        here.add(text(x))
                        names[text(x)] = {y.id for y in ast.walk(x) if isinstance(y, ast.Name)}
            gen.append(here)
        every = set(names)
        into, out = [set()] + [set(every) for _ in range(n - 1)], [set(every) for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for i in range(n):
                into[i] = set.intersection(*[out[p] for p in self.pred[i]]) if self.pred[i] else set()
                new = {e for e in into[i] | gen[i] if not names[e] & self.defs[i]}
                if new != out[i]:
                    out[i], changed = new, True
        return into

    def control(self) -> set[tuple[int, int]]:
        """Control dependences (branch, statement): the statements of a branch's own bodies."""
        place = {id(s): i for i, s in enumerate(self.stmts) if s is not None}
        out = set()
        for i, s in enumerate(self.stmts):
            if isinstance(s, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Match)):
                bodies = [*getattr(s, "body", []), *getattr(s, "orelse", []), *[x for c in getattr(s, "cases", []) for x in c.body]]
                out |= {(i, place[id(x)]) for x in bodies if id(x) in place}
        return out


SOURCES = ("input", "sys.stdin.read", "os.environ.get", "os.getenv", "request.args.get", "request.form.get", "open")
SINKS = {"eval": "CodeEval", "exec": "CodeExec", "os.system": "ShellExec", "subprocess.call": "ShellExec", "cursor.execute": "SqlQuery", "pickle.loads": "Deserialize", "open": "FileOpen"}
CLEANERS = ("int", "float", "shlex.quote", "html.escape")


def exposed(x: ast.AST) -> Iterator[ast.AST]:
    """The nodes under x, but for what a cleaner is called with."""
    yield x
    if not (isinstance(x, ast.Call) and dotted(x.func) in CLEANERS):
        for c in ast.iter_child_nodes(x):
            yield from exposed(c)


def taints(flow: Flow) -> list[tuple[int, int, str, str]]:
    """(source line, sink line, sink kind, name): values of sources that reach sinks without a cleaner.

    A source called inside a sink's own arguments is named by the source.
    """
    n = len(flow.stmts)
    open_nodes = [[x for h in flow._head(s) for x in exposed(h)] for s in flow.stmts]
    reads = [{x.id for x in nodes if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)} for nodes in open_nodes]
    for i, s in enumerate(flow.stmts):
        if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
            reads[i].add(s.target.id)
    has_source = [any(isinstance(x, ast.Call) and dotted(x.func) in SOURCES for x in nodes) for nodes in open_nodes]
    before: list[dict[str, set[int]]] = [{} for _ in range(n)]
    after: list[dict[str, set[int]]] = [{} for _ in range(n)]
    work = list(range(n))
    while work:
        i = work.pop(0)
        into: dict[str, set[int]] = defaultdict(set)
        for p in flow.pred[i]:
            for v, src in after[p].items():
                into[v] |= src
        before[i] = into
        found = set().union(*[into[v] for v in reads[i] if v in into], {flow.line(i)} if has_source[i] else ())
        new = {v: s for v, s in into.items() if v not in flow.defs[i]}
        if found:
            new |= {v: set(found) for v in flow.defs[i]}
        if new != after[i]:
            after[i] = new
            work += [x for x in flow.succ.get(i, ()) if x not in work]
    out = set()
    for i in range(n):
        for call in (x for h in flow._head(flow.stmts[i]) for x in ast.walk(h) if isinstance(x, ast.Call) and dotted(x.func) in SINKS):
            kind = SINKS[dotted(call.func)]
            for x in (y for a in [*call.args, *[k.value for k in call.keywords]] for y in exposed(a)):
                if isinstance(x, ast.Name):
                    out |= {(s, flow.line(i), kind, x.id) for s in before[i].get(x.id, ())}
                elif isinstance(x, ast.Call) and dotted(x.func) in SOURCES:
                    out.add((flow.line(i), flow.line(i), kind, dotted(x.func)))
    return sorted(out)


def analyse(path: str, content: str) -> list[tuple]:
    """(path, func, kind, name, line, other): every dataflow fact of every function of a file."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    out = []
    for fn in (x for x in ast.walk(tree) if isinstance(x, FUNCTIONS)):
        f = Flow(fn)

        def row(kind, name, line, other=None, fn=fn):
            out.append((path, fn.name, kind, name, line, other))

        for a, bs in f.succ.items():
            for b in bs:
                row("cfg_edge", type(f.stmts[b]).__name__ if f.stmts[b] is not None else "exit", f.line(a), f.line(b))
        reach, live = f.reaching(), f.live()
        local = set().union(*f.defs)
        for i, s in enumerate(f.stmts):
            for v in f.uses[i] & local:
                found = {j for x, j in reach[i] if x == v}
                for j in found:
                    row("def_use", v, f.line(j), f.line(i))
                if not found and f.pred[i]:
                    row("uninitialised", v, f.line(i))
            if i and s is not None:
                for v in f.defs[i] - live[i]:
                    row("dead_store", v, f.line(i))
                if not f.pred[i]:
                    row("unreachable", type(s).__name__, f.line(i))
            for v in live[i]:
                row("live", v, f.line(i))
        for i, d in f.idom().items():
            row("idom", "", f.line(i), f.line(d))
        for v, i in f.phis():
            row("phi", v, f.line(i))
        for i, es in enumerate(f.expressions()):
            for e in es:
                row("available", e, f.line(i))
        for a, b in f.control():
            row("control", "", f.line(a), f.line(b))
        for a, b, kind, v in taints(f):
            row("taint", f"{kind}:{v}", a, b)
        versions = values.Versions(f)
        for i in range(len(f.stmts)):
            for v, n in versions.uses[i].items():
                row("ssa_use", f"{v}.{n}", f.line(i))
            for v, n in versions.defs[i].items():
                row("ssa_def", f"{v}.{n}", f.line(i))
            for v, n in versions.phi[i].items():
                row("ssa_phi", f"{v}.{n} = {', '.join(f'{v}.{x}' for x in sorted(set(versions.args[i, v].values())))}", f.line(i))
        for a, b, x in values.value_numbers(f, versions):
            row("redundant", x, a, b)
        known, dead = values.constants(f, versions)
        for line, v, x in known:
            row("constant", f"{v} = {x}", line)
        for line in dead:
            row("never", "", line)
        for line, v, x in values.narrowed(f):
            row("narrowed", f"{v} {x}", line)
        for kind, v, a, b in values.resources(f, dotted):
            row(kind, v, a, b)
        for kind, x, line in values.contracts(f):
            row(kind, x, line)
        if fn.name.startswith("test"):
            for call, want, line in values.specs(fn):
                row("spec", f"{call} -> {want}", line)
    return out


def flows(files: DataFrame) -> DataFrame:
    """Dataflow facts (path, func, kind, name, line, other) of files (path, content)."""
    names = ["path", "func", "kind", "name", "line", "other"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, c in zip(frame["path"], frame["content"], strict=True) for r in analyse(p, c or "")]
            df = pd.DataFrame(rows, columns=names)
            df["line"], df["other"] = df["line"].astype("Int32"), df["other"].astype("Int32")
            yield df

    return files.select("path", "content").mapInPandas(run, "path string, func string, kind string, name string, line int, other int").distinct()


def dependences(flow_facts: DataFrame) -> DataFrame:
    """The program dependence graph (path, func, src, dst, kind, name) by lines; name: the variable of data dependences."""
    d = flow_facts.where(F.col("kind").isin("def_use", "control"))
    return d.select("path", "func", F.col("line").alias("src"), F.col("other").alias("dst"), F.when(F.col("kind") == "control", "control").otherwise("data").alias("kind"), "name")


def slices(flow_facts: DataFrame, starts: DataFrame, variable: str | None = None) -> DataFrame:
    """(path, func, start, direction, line): the lines of each slice, by traversal of the dependence graph.

    starts: (path, func, start, direction), direction forward or backward. Data
    dependences of other variables than the given one are not followed, control
    dependences always are. A start outside its function has an empty slice. Line 0, where
    a function's parameters enter, is no line of the source and is left out.
    """
    lines = flow_facts.select("path", "func", F.explode(F.array("line", "other")).alias("start")).where("start is not null").distinct()
    starts = starts.select("path", "func", F.col("start").cast("int").alias("start"), "direction").distinct().join(lines, ["path", "func", "start"], "left_semi")
    edges = dependences(flow_facts)
    if variable is not None:
        edges = edges.where((F.col("kind") == "control") | (F.col("name") == variable))
    edges = edges.groupBy("path", "func").agg(F.collect_set(F.struct("src", "dst")).alias("edges"))
    kind = "path string, func string, start int, direction string, line int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, func, start, direction, pairs in frame[["path", "func", "start", "direction", "edges"]].itertuples(index=False, name=None):
                after = defaultdict(set)
                for e in pairs if pairs is not None else ():
                    a, b = (e["src"], e["dst"]) if direction == "forward" else (e["dst"], e["src"])
                    after[a].add(b)
                seen, todo = {start}, [start]
                while todo:
                    new = after[todo.pop()] - seen
                    seen |= new
                    todo += new
                out += [(path, func, start, direction, line) for line in sorted(seen) if line > 0]
            yield pd.DataFrame(out, columns=["path", "func", "start", "direction", "line"])

    return starts.join(edges, ["path", "func"], "left").mapInPandas(run, kind)


def line_counts(files: DataFrame) -> DataFrame:
    """(path, code, comment, blank): blank first, then lines that start with # or lie in a block that a triple quote opens."""
    ls = files.select("path", F.posexplode(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")).alias("n", "line"))
    t = F.trim(F.col("line"))
    marks = F.size(F.regexp_extract_all(t, F.lit("\"\"\"|'''"), 0))
    opens = F.when(t.rlike("^(\"\"\"|''')"), marks % 2).otherwise(0)
    w = Window.partitionBy("path").orderBy("n")
    # a block is open where an odd number of opening or closing lines came before
    toggles = F.sum(F.when(t.rlike("\"\"\"|'''"), marks % 2).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = (F.coalesce(toggles, F.lit(0)) % 2 == 1) | (opens == 1) | (t.rlike("^(\"\"\"|''')") & (marks == 2))
    kind = F.when(t == "", "blank").when(inside | t.startswith("#"), "comment").otherwise("code")
    return ls.withColumn("k", kind).groupBy("path").agg(*[F.sum((F.col("k") == k).cast("int")).alias(k) for k in ("code", "comment", "blank")])
