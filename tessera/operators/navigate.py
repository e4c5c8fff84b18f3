"""Questions about a code base, answered by joins over its facts, call edges and dataflow.

Facts, call edges and flows are those of `program`. A function is known by its
file and dotted name; where it is a graph's node it is "file:name". Nothing is
collected: searches over the graph keep one row for each node that is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import triggers
from tessera.operators import graph, program

#: Chunks of this many characters at most.
CHUNK_CHARS = 4000


def node_of() -> Column:
    return F.concat_ws(":", "path", "name")


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.[A-Za-z]+$")


def last_part(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]*)$", 1)


def is_public(name: Column) -> Column:
    """No part of a dotted name begins with an underscore."""
    return ~name.rlike(r"(^|\.)_")


def functions_of(f: DataFrame) -> DataFrame:
    return program.definitions(f).where("kind <> 'class'")


def locate(f: DataFrame, name: str) -> DataFrame:
    """Definitions of that dotted name, or of that last part."""
    d = program.definitions(f)
    return d.where((F.col("name") == name) | F.col("name").endswith(f".{name}")).select("path", "name", "kind", "line", "end_line")


def function_counts(f: DataFrame) -> DataFrame:
    """(path, n): functions and methods of each file; files without any have none."""
    return functions_of(f).groupBy("path").agg(F.count("*").alias("n"))


def interface(f: DataFrame, private: bool = False) -> DataFrame:
    """(path, name, kind, signature, doc): what a file offers, with the first line of its documentation."""
    d = program.definitions(f).select("path", "name", "kind", F.coalesce("detail", F.lit("")).alias("signature"), "line")
    docs = f.where("kind = 'docstring'").select("path", "name", F.split("detail", "\n")[0].alias("doc"))
    return (d if private else d.where(is_public(F.col("name")))).join(docs, ["path", "name"], "left").select("path", "name", "kind", "signature", F.coalesce("doc", F.lit("")).alias("doc"), "line")


def surface(f: DataFrame, private: bool = False) -> DataFrame:
    """(module, name, kind, example, triggers): public entries with a call as example and the words that may lead to them."""
    s = interface(f, private)
    args = F.regexp_replace("signature", r"^\((self|cls)(, )?", "(")
    example = F.when(F.col("kind") == "class", F.concat("name", F.lit("(...)"))).otherwise(F.concat(F.col("name"), args))
    return s.select(program.module_of(F.col("path")).alias("module"), "name", "kind", example.alias("example"), F.array_join(triggers(last_part(F.col("name")), F.col("doc")), ",").alias("triggers"))


def references(f: DataFrame, symbol: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(path, line, kind): where a symbol is defined, imported, called, written or read; a call is not counted as a read too.

    A private symbol (one underscore) is looked for in its own files only.
    """
    last = last_part(F.col("name"))
    own = f.where(F.col("kind").isin("function", "method", "class", "constant") & (last == symbol)).select("path", "line", F.lit("definition").alias("kind"))
    called = f.where((F.col("kind") == "call") & (last == symbol)).select("path", "line", F.lit("call").alias("kind"))
    imported = f.where((F.col("kind") == "import_from") & F.regexp_extract("detail", r"^(\w+)", 1).eqNullSafe(symbol)).select("path", "line", F.lit("import").alias("kind"))
    plain = f.where(F.col("kind").isin("read", "write", "field", "attribute") & (F.col("name") == symbol)).select("path", "line", F.when(F.col("kind") == "write", "write").otherwise("read").alias("kind"))
    plain = plain.join(called.select("path", "line"), ["path", "line"], "left_anti").join(own.select("path", "line"), ["path", "line"], "left_anti")
    out = own.unionByName(called).unionByName(imported).unionByName(plain).distinct()
    if symbol.startswith("_") and not symbol.startswith("__"):
        out = out.join(own.select("path").distinct(), "path", "left_semi").select("path", "line", "kind")
    return out if kinds is None else out.where(F.col("kind").isin(*kinds))


def definition_of(f: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, owner, name, to_path, to_line, scope) for uses (path, owner, name): the nearest definition.

    Scopes in order: parameter, local (the first write in the owner), file,
    import, project. A use without any has none.
    """
    d = program.definitions(f)
    u = uses.select("path", "owner", "name").distinct()
    to = lambda path, line, scope, n: F.struct(F.lit(n).alias("n"), path.alias("to_path"), line.alias("to_line"), F.lit(scope).alias("scope")).alias("to")
    p = d.where("kind <> 'class'").select("path", F.col("name").alias("owner"), F.col("line").alias("at"), F.explode(F.split(F.regexp_replace("detail", r"[()\s]", ""), ",")).alias("name"))
    parameter = u.join(p, ["path", "owner", "name"]).select("path", "owner", "name", to(F.col("path"), F.col("at"), "parameter", 0))
    w = f.where("kind = 'write' and owner is not null").groupBy("path", "owner", "name").agg(F.min("line").alias("at"))
    local = u.join(w, ["path", "owner", "name"]).select("path", "owner", "name", to(F.col("path"), F.col("at"), "local", 1))
    here = d.select("path", F.col("name"), F.col("line").alias("at")).unionByName(f.where("kind = 'constant'").select("path", "name", F.col("line").alias("at")))
    in_file = u.join(here, ["path", "name"]).select("path", "owner", "name", to(F.col("path"), F.col("at"), "file", 2))
    module = here.select(program.module_of(F.col("path")).alias("module"), F.col("path").alias("m_path"), F.col("name").alias("orig"), "at")
    named = f.where("kind = 'import_from'").select("path", F.col("name").alias("module"), F.regexp_extract("detail", r"(\w+)$", 1).alias("name"), F.regexp_extract("detail", r"^(\w+)", 1).alias("orig"))
    imported = u.join(named, ["path", "name"]).join(module, ["module", "orig"]).select("path", "owner", "name", to(F.col("m_path"), F.col("at"), "import", 3))
    anywhere = u.join(here.select(F.col("path").alias("m_path"), "name", "at"), "name").select("path", "owner", "name", to(F.col("m_path"), F.col("at"), "project", 4))
    every = parameter.unionByName(local).unionByName(in_file).unionByName(imported).unionByName(anywhere)
    return every.groupBy("path", "owner", "name").agg(F.min("to").alias("to")).select("path", "owner", "name", "to.to_path", "to.to_line", "to.scope")


def call_nodes(edges: DataFrame) -> DataFrame:
    """Call edges between nodes "file:name"."""
    return edges.select(F.concat_ws(":", "src_file", "src_func").alias("src"), F.concat_ws(":", "dst_file", "dst_func").alias("dst")).distinct()


def spread(edges: DataFrame, sources: DataFrame, max_depth: int, reverse: bool = False) -> DataFrame:
    """(node, depth): least steps from any of the sources (a column node), which have depth 0."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    hop = edges.select(F.col(a).alias("at"), F.col(b).alias("node"))
    front = sources.select("node").distinct()
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        new = front.withColumnRenamed("node", "at").join(hop, "at").select("node").distinct()
        new = graph.cut(new.join(seen, "node", "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new.withColumn("depth", F.lit(depth)))
        front = new
    return seen


def change_impact(f: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 10) -> DataFrame:
    """(path, name, depth, is_test): functions of changed files (a column path) and what calls them, nearest first."""
    nodes = functions_of(f).select("path", "name", node_of().alias("node"))
    start = nodes.join(changed.select("path").distinct(), "path", "left_semi").select("node")
    return spread(call_nodes(edges), start, depth, reverse=True).join(nodes, "node").select("path", "name", "depth", is_test_path(F.col("path")).alias("is_test"))


def whatbreaks(f: DataFrame, edges: DataFrame, target: str, depth: int = 5) -> DataFrame:
    """(how, path, name, depth): what a change of a function, a file or a module reaches.

    A file's functions and their callers, and the files that import its module;
    a function's callers; a module's importers.
    """
    nodes = functions_of(f).select("path", "name", node_of().alias("node"))
    empty = F.lit(None).cast("string")
    by_import = lambda module: program.importers(f, module).select(F.lit("import").alias("how"), "path", empty.alias("name"), F.lit(1).alias("depth"))
    if target.endswith(".py"):
        module = target.removesuffix(".py").removesuffix("/__init__").replace("/", ".")
        reached = change_impact(f, edges, f.sparkSession.createDataFrame([(target,)], "path string"), depth).where("depth > 0")
        return reached.select(F.lit("call").alias("how"), "path", "name", "depth").unionByName(by_import(module))
    start = nodes.where((F.col("name") == target) | F.col("name").endswith(f".{target}")).select("node")
    if start.isEmpty():
        return by_import(target)
    reached = spread(call_nodes(edges), start, depth, reverse=True).where("depth > 0").join(nodes, "node")
    return reached.select(F.lit("call").alias("how"), "path", "name", "depth")


def chop(flow_facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(path, func, source, target, line): lines on a dependence path from source to target, both included; none if there is no path."""
    key = ["path", "func", "source", "target"]
    one = lambda c, d: program.slices(flow_facts, pairs.select("path", "func", F.col(c).cast("int").alias("start"), F.lit(d).alias("direction"))).drop("direction").withColumnRenamed("start", c)
    p = pairs.select("path", "func", *[F.col(c).cast("int").alias(c) for c in ("source", "target")]).distinct()
    ahead = p.join(one("source", "forward"), ["path", "func", "source"]).select(*key, "line")
    back = p.join(one("target", "backward"), ["path", "func", "target"]).select(*key, "line")
    return ahead.intersect(back)


def cards(f: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, name, line, complexity, signature, doc, calls, called_by): what there is to say of each function."""
    d = functions_of(f).select("path", "name", "line", "complexity", F.col("detail").alias("signature"))
    docs = f.where("kind = 'docstring'").select("path", "name", F.split("detail", "\n")[0].alias("doc"))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = edges.groupBy(F.col("src_file").alias("path"), F.col("src_func").alias("name")).agg(names("dst_func").alias("calls"))
    into = edges.groupBy(F.col("dst_file").alias("path"), F.col("dst_func").alias("name")).agg(names("src_func").alias("called_by"))
    return d.join(docs, ["path", "name"], "left").join(out, ["path", "name"], "left").join(into, ["path", "name"], "left").fillna("", ["doc", "calls", "called_by"])


def context(f: DataFrame, edges: DataFrame, entry: str, depth: int) -> DataFrame:
    """(depth, path, name, card): an entry function and what it calls, as far as depth."""
    c = cards(f, edges).withColumn("node", node_of())
    start = c.where((F.col("name") == entry) | (F.col("node") == entry)).select("node")
    card = F.concat(F.col("name"), F.col("signature"), F.when(F.col("doc") != "", F.concat(F.lit(": "), F.col("doc"))).otherwise(""), F.when(F.col("calls") != "", F.concat(F.lit(" -> "), F.col("calls"))).otherwise(""))
    return spread(call_nodes(edges), start, depth).join(c, "node").select("depth", "path", "name", card.alias("card"))


def explain(f: DataFrame, edges: DataFrame, flow_facts: DataFrame, name: str) -> DataFrame:
    """One row for each function of that name: its card, its dataflow in numbers, and whether it is pure.

    Pure: it writes no field, calls no source or sink, and raises nothing of its own.
    """
    kinds = flow_facts.groupBy("path", F.col("func").alias("short")).agg(
        *[F.sum((F.col("kind") == k).cast("int")).cast("long").alias(c) for k, c in (("def_use", "n_def_use"), ("dead_store", "n_dead_stores"), ("taint", "n_taints"))]
    )
    known = [*program.SOURCES, *program.SINKS, "print"]
    impure = f.where(((F.col("kind") == "call") & F.col("name").isin(*known)) | (F.col("kind") == "raise") | (F.col("kind") == "field_write")).select("path", F.col("owner").alias("name")).distinct().withColumn("impure", F.lit(True))
    c = cards(f, edges).where(last_part(F.col("name")) == name).withColumn("short", last_part(F.col("name")))
    c = c.join(kinds, ["path", "short"], "left").join(impure, ["path", "name"], "left").fillna(0, ["n_def_use", "n_dead_stores", "n_taints"])
    return c.select("path", "name", "signature", "doc", "complexity", "calls", "called_by", "n_def_use", "n_dead_stores", "n_taints", F.col("impure").isNull().alias("pure"))


def inheritance(f: DataFrame) -> DataFrame:
    """(src, dst, external): classes "file:name" and their bases; a base that no file defines stays a bare name."""
    classes = f.where("kind = 'class'").select(F.col("path").alias("b_path"), F.col("name").alias("base"))
    bases = f.where("kind = 'base'").select("path", F.col("owner").alias("cls"), F.col("name").alias("base"))
    own = bases.join(classes, (F.col("path") == F.col("b_path")) & (bases["base"] == classes["base"])).select("path", "cls", bases["base"], F.col("b_path").alias("to_path"), F.lit(0).alias("n"))
    module = classes.select(program.module_of(F.col("b_path")).alias("module"), F.col("b_path").alias("to_path"), F.col("base").alias("orig"))
    named = f.where("kind = 'import_from'").select("path", F.col("name").alias("module"), F.regexp_extract("detail", r"(\w+)$", 1).alias("base"), F.regexp_extract("detail", r"^(\w+)", 1).alias("orig"))
    far = bases.join(named, ["path", "base"]).join(module, ["module", "orig"]).select("path", "cls", "base", "to_path", F.lit(1).alias("n"))
    best = own.unionByName(far).groupBy("path", "cls", "base").agg(F.min(F.struct("n", "to_path"))["to_path"].alias("to_path"))
    out = bases.join(best, ["path", "cls", "base"], "left")
    return out.select(F.concat_ws(":", "path", "cls").alias("src"), F.when(F.col("to_path").isNull(), F.col("base")).otherwise(F.concat_ws(":", "to_path", "base")).alias("dst"), F.col("to_path").isNull().alias("external"))


def class_roles(f: DataFrame) -> DataFrame:
    """(path, name, is_abstract, is_mixin): abstract by a base ABC or Protocol or an abstract method, mixin by name."""
    c = f.where("kind = 'class'").select("path", "name")
    by_base = f.where("kind = 'base'").where(last_part(F.col("name")).isin("ABC", "ABCMeta", "Protocol")).select("path", F.col("owner").alias("name"))
    by_method = f.where("kind = 'decorator'").where(last_part(F.col("name")) == "abstractmethod").select("path", F.regexp_replace("owner", r"\.[^.]*$", "").alias("name"))
    abstract = by_base.unionByName(by_method).distinct().withColumn("a", F.lit(True))
    return c.join(abstract, ["path", "name"], "left").select("path", "name", F.coalesce("a", F.lit(False)).alias("is_abstract"), F.col("name").rlike("(?i)mixin$").alias("is_mixin"))


def subgraph(edges: DataFrame, node: str, depth: int) -> DataFrame:
    """Edges among a node, what it reaches and what reaches it, as far as depth."""
    one = edges.sparkSession.createDataFrame([(node,)], "node string")
    e = edges.select("src", "dst")
    near = spread(e, one, depth).select("node").union(spread(e, one, depth, reverse=True).select("node")).distinct()
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def chunks(files: DataFrame, f: DataFrame, most_chars: int = CHUNK_CHARS) -> DataFrame:
    """(path, name, part, text, digest): each function's lines, cut into parts of most_chars, with the sha256 of the part.

    A file without functions, or one that does not parse, is a chunk by itself,
    with an empty name.
    """
    d = functions_of(f).select("path", "name", "line", "end_line")
    ls = files.select("path", F.split("content", "\n").alias("ls"), "content")
    whole = ls.join(d.select("path").distinct(), "path", "left_anti").select("path", F.lit("").alias("name"), F.coalesce("content", F.lit("")).alias("body"))
    body = ls.join(d, "path").select("path", "name", F.array_join(F.slice("ls", F.col("line"), F.col("end_line") - F.col("line") + 1), "\n").alias("body")).unionByName(whole)
    n = F.greatest(F.ceil(F.length("body") / most_chars), F.lit(1)).cast("int")
    parts = body.select("path", "name", "body", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    text = F.substring(F.col("body"), F.col("part") * most_chars + 1, F.lit(most_chars))
    return parts.select("path", "name", "part", text.alias("text")).withColumn("digest", F.sha2("text", 256))


def embedding_texts(pieces: DataFrame, f: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, name, part, text, key): a chunk's text below a head of file, signature, documentation and calls; key is its sha256."""
    c = cards(f, edges).select("path", "name", "signature", "doc", "calls")
    labelled = lambda label, col: F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(col)))
    p = pieces.join(c, ["path", "name"], "left")
    head = F.concat_ws("\n", F.concat(F.lit("file: "), F.col("path")), F.when(F.col("name") != "", F.concat(F.lit("function: "), F.col("name"), F.coalesce("signature", F.lit("")))), labelled("about", "doc"), labelled("calls", "calls"))
    return p.select("path", "name", "part", F.concat_ws("\n", head, "text").alias("text")).withColumn("key", F.sha2("text", 256))


def call_smells(f: DataFrame, delegation: float = 0.6, least_methods: int = 3, usage: float = 0.33, least_inherited: int = 3, foreign: int = 4, envy: float = 2.0, least_total: int = 10, least_each: int = 3) -> DataFrame:
    """(path, name, smell, detail): middle man, refused bequest, feature envy and inappropriate intimacy.

    Middle man: of at least least_methods methods the given share does nothing
    but one call on a field. Refused bequest: of at least least_inherited
    inherited methods less than the share usage is overridden or called.
    Feature envy: a method reaches into one other object at least foreign times,
    and more than envy times as often as into its own. Inappropriate intimacy:
    two unrelated classes whose methods reach into objects of the other at least
    least_each times each way and least_total times together.
    """
    cls = F.regexp_replace("owner", r"\.[^.]*$", "")
    m = f.where("kind = 'method'").select("path", F.col("owner").alias("cls"), F.col("name").alias("method"), "complexity")
    m = m.where(~last_part(F.col("method")).rlike("^__.*__$"))
    calls = f.where("kind = 'call' and owner is not null").groupBy("path", F.col("owner").alias("method")).agg(F.count("*").alias("n"), F.sum(F.col("name").rlike(r"^self\.[^.]+\.").cast("int")).alias("on_field"))
    passes = m.join(calls, ["path", "method"], "left").withColumn("passes", F.coalesce((F.col("n") == 1) & (F.col("on_field") == 1) & (F.col("complexity") == 1), F.lit(False)))
    middle = passes.groupBy("path", F.col("cls").alias("name")).agg(F.count("*").alias("n"), F.sum(F.col("passes").cast("int")).alias("k"))
    middle = middle.where((F.col("n") >= least_methods) & (F.col("k") / F.col("n") >= delegation) & ~F.lower("name").rlike("facade|adapter|wrapper|proxy|bridge|decorator|gateway"))
    middle = middle.select("path", "name", F.lit("MiddleMan").alias("smell"), F.concat_ws("/", F.col("k").cast("string"), F.col("n").cast("string")).alias("detail"))

    up = inheritance(f).where("not external").select("src", "dst")
    named = m.select(F.concat_ws(":", "path", "cls").alias("node"), last_part(F.col("method")).alias("short"))
    used = f.where("kind = 'call' and owner is not null").where(F.col("name").rlike(r"^(self|super)\.[^.]+$")).select(F.concat_ws(":", F.col("path"), cls).alias("node"), last_part(F.col("name")).alias("short"))
    used = named.unionByName(used).distinct().withColumn("used", F.lit(1))
    given = up.join(named.select(F.col("node").alias("dst"), "short"), "dst").select(F.col("src").alias("node"), "short").distinct().join(used, ["node", "short"], "left")
    refused = given.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.coalesce("used", F.lit(0))).alias("k")).where((F.col("n") >= least_inherited) & (F.col("k") / F.col("n") < usage))
    part = lambda i: F.split(F.col("node"), ":")[i]
    refused = refused.select(part(0).alias("path"), part(1).alias("name"), F.lit("RefusedBequest").alias("smell"), F.concat_ws("/", F.col("k").cast("string"), F.col("n").cast("string")).alias("detail"))

    reach = f.where("kind = 'attribute' and owner is not null and detail rlike '^[A-Za-z_0-9]+$'").select("path", F.col("owner").alias("method"), F.col("detail").alias("object"))
    modules = f.where("kind in ('import', 'import_from')").select("path", F.regexp_extract(F.coalesce("detail", "name"), r"(\w+)$", 1).alias("object")).distinct()
    reach = reach.join(modules, ["path", "object"], "left_anti").join(m.select("path", "method"), ["path", "method"], "left_semi")
    abroad = reach.groupBy("path", "method", "object").agg(F.count("*").alias("n")).groupBy("path", "method").agg(F.max(F.struct("n", "object")).alias("top"))
    home = f.where("kind = 'field'").groupBy("path", F.col("owner").alias("method")).agg(F.count("*").alias("own"))
    envious = abroad.join(home, ["path", "method"], "left").where((F.col("top.n") >= foreign) & (F.col("top.n") > envy * F.coalesce("own", F.lit(0))))
    envious = envious.select("path", F.col("method").alias("name"), F.lit("FeatureEnvy").alias("smell"), F.concat_ws(":", "top.object", F.col("top.n").cast("string")).alias("detail"))

    typed = f.where("kind = 'typed' and owner is not null").select("path", F.col("owner").alias("method"), F.col("name").alias("object"), last_part(F.col("detail")).alias("other")).distinct()
    classes = f.where("kind = 'class'").select(F.col("name").alias("other")).distinct()
    met = reach.join(typed, ["path", "method", "object"]).join(classes, "other", "left_semi").join(m.select("path", "method", "cls"), ["path", "method"]).where("cls <> other")
    pair = met.groupBy(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).agg(F.min("path").alias("path"), F.sum((F.col("cls") < F.col("other")).cast("int")).alias("ab"), F.sum((F.col("cls") > F.col("other")).cast("int")).alias("ba"))
    kin = inheritance(f).select(F.regexp_extract("src", r"([^:.]*)$", 1).alias("x"), F.regexp_extract("dst", r"([^:.]*)$", 1).alias("y"))
    kin = kin.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    close = pair.where((F.col("ab") >= least_each) & (F.col("ba") >= least_each) & (F.col("ab") + F.col("ba") >= least_total)).join(kin, ["a", "b"], "left_anti")
    close = close.select("path", F.concat_ws("+", "a", "b").alias("name"), F.lit("InappropriateIntimacy").alias("smell"), F.concat_ws("/", F.col("ab").cast("string"), F.col("ba").cast("string")).alias("detail"))
    return middle.unionByName(refused).unionByName(envious).unionByName(close)


def dead_functions(f: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, name, line): functions that nothing calls or names; entry points, tests and dunders aside."""
    d = functions_of(f).where("kind = 'function'").where(~last_part(F.col("name")).rlike("^(main|test_.*|__.*__)$")).where(~is_test_path(F.col("path")))
    called = edges.select(F.col("dst_file").alias("path"), F.col("dst_func").alias("name")).distinct()
    decorated = f.where("kind = 'decorator'").select("path", F.col("owner").alias("name")).distinct()
    return d.join(called, ["path", "name"], "left_anti").join(decorated, ["path", "name"], "left_anti").select("path", "name", "line")


def todo(f: DataFrame, edges: DataFrame, flow_facts: DataFrame) -> DataFrame:
    """(priority, category, path, name, detail): what to do first; parts that find nothing are empty."""
    row = lambda p, c, detail: (F.lit(p).alias("priority"), F.lit(c).alias("category"), "path", "name", detail.cast("string").alias("detail"))
    dead = dead_functions(f, edges).select(*row(1, "dead", F.col("line")))
    fn = functions_of(f)
    high = fn.where("complexity > 20").select(*row(2, "complexity", F.col("complexity")))
    members = f.where("kind = 'method'").select("path", F.col("owner").alias("cls0"), F.col("name").alias("method")).join(f.where("kind = 'field'").select("path", F.col("owner").alias("method"), F.col("name").alias("field")), ["path", "method"], "left")
    loose = graph.lcom4(members.select(F.concat_ws(":", "path", "cls0").alias("cls"), "method", "field")).where("lcom4 > 2")
    loose = loose.select(F.split("cls", ":")[0].alias("path"), F.split("cls", ":")[1].alias("name"), "lcom4").select(*row(3, "cohesion", F.col("lcom4")))
    same = flow_facts.where("kind = 'redundant'").select("path", F.col("func").alias("name"), "line").select(*row(5, "equivalence", F.col("line")))
    some = fn.where("complexity > 10 and complexity <= 20").select(*row(6, "complexity", F.col("complexity")))
    return dead.unionByName(high).unionByName(loose).unionByName(same).unionByName(some)


#: Sink kind, weakness number, severity.
WEAKNESSES = (("CodeEval", "CWE-94", "critical"), ("CodeExec", "CWE-94", "critical"), ("ShellExec", "CWE-78", "critical"), ("SqlQuery", "CWE-89", "critical"), ("Deserialize", "CWE-502", "high"), ("FileOpen", "CWE-22", "high"))


def may_hold(content: Column, needles: tuple[str, ...]) -> Column:
    """Whether a text holds any of the needles, so that others need no parser."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(content, F.lit(n))
    return F.coalesce(out, F.lit(False))


def vulnerabilities(files: DataFrame) -> DataFrame:
    """(path, func, weakness, severity, name, source_line, line): tainted sinks of the files that hold a sink and a source by text."""
    holds = may_hold(F.col("content"), tuple(s.rsplit(".", 1)[-1] for s in program.SINKS)) & may_hold(F.col("content"), tuple(s.rsplit(".", 1)[-1] for s in program.SOURCES))
    found = program.flows(files.where(holds)).where("kind = 'taint'").withColumn("sink", F.split("name", ":")[0])
    known = files.sparkSession.createDataFrame(list(WEAKNESSES), "sink string, weakness string, severity string")
    return found.join(F.broadcast(known), "sink").select("path", "func", "weakness", "severity", F.split("name", ":")[1].alias("name"), F.col("line").alias("source_line"), F.col("other").alias("line"))


def secure(files: DataFrame, flow_facts: DataFrame) -> DataFrame:
    """(category, severity, n): tainted sinks, resources left open and generic handlers, by severity."""
    v = vulnerabilities(files).groupBy("severity").agg(F.count("*").alias("n")).select(F.lit("taint").alias("category"), "severity", "n")
    r = flow_facts.where("kind in ('leak', 'double_close', 'use_after_close')").groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("resource").alias("category"), F.when(F.col("kind") == "leak", "medium").otherwise("high").alias("severity"), "n")
    return v.unionByName(r.groupBy("category", "severity").agg(F.sum("n").alias("n")))


def verify(f: DataFrame, flow_facts: DataFrame) -> DataFrame:
    """(path, n_functions, n_with_contract, n_tested, coverage): functions with a pre- or postcondition, or called by a test."""
    fn = functions_of(f).where(~is_test_path(F.col("path"))).select("path", last_part(F.col("name")).alias("func")).distinct()
    c = flow_facts.where("kind in ('precondition', 'postcondition')").select("path", "func").distinct().withColumn("c", F.lit(1))
    t = f.where("kind = 'call'").where(is_test_path(F.col("path"))).select(last_part(F.col("name")).alias("func")).distinct().withColumn("t", F.lit(1))
    j = fn.join(c, ["path", "func"], "left").join(t, "func", "left").fillna(0, ["c", "t"])
    out = j.groupBy("path").agg(F.count("*").alias("n_functions"), F.sum("c").cast("long").alias("n_with_contract"), F.sum("t").cast("long").alias("n_tested"), F.round(F.avg(F.greatest("c", "t")), 6).alias("coverage"))
    return out


def packages(files: DataFrame, name: str) -> DataFrame:
    """(root, n_files): folders that a package of that name may be: itself, or below src or lib, with the files in each."""
    roots = [name.replace(".", "/"), *[f"{x}/{name.replace('.', '/')}" for x in ("src", "lib", "python")]]
    at = F.coalesce(*[F.when((F.col("path") == f"{r}.py") | F.col("path").startswith(f"{r}/"), F.lit(r)) for r in roots])
    return files.select(at.alias("root")).where("root is not null").groupBy("root").agg(F.count("*").alias("n_files"))
