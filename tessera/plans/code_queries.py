"""Queries over the sample project; the rows beside them were made once and read against the sample by eye."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tessera.functions import scores, text
from tessera.operators import graph, navigate as nav, program, quality
from tessera.plans import samples
from tessera.plans.registry import query
from tessera.plans.samples import rows_sql
from tessera.sources import files, reports


def _facts(spark) -> DataFrame:
    return program.facts(samples.files(spark))


def _edges(spark) -> DataFrame:
    return program.call_edges(_facts(spark))


def _flows(spark) -> DataFrame:
    return program.flows(samples.files(spark))


def _brace_facts(spark) -> DataFrame:
    return program.facts(samples.brace_files(spark))


def _breaks(spark) -> DataFrame:
    f, e = _facts(spark), _edges(spark)
    return reduce(DataFrame.unionByName, [nav.whatbreaks(f, e, t).withColumn("target", F.lit(t)) for t in ("shop/models.py", "load", "shop.models")]).fillna("", ["name"])


def _starts(spark) -> DataFrame:
    return spark.createDataFrame([("shop/store.py", "_old", 34, "forward"), ("shop/store.py", "_old", 39, "backward"), ("shop/store.py", "run", 20, "forward")], "path string, func string, start int, direction string")


def _pairs(spark) -> DataFrame:
    return spark.createDataFrame([("shop/api.py", "handle", 5, 9), ("shop/store.py", "_old", 34, 37), ("shop/store.py", "_old", 37, 34)], "path string, func string, source int, target int")


LINES = (
    ("gcc", "a.c:3:7: warning: unused x"), ("clang", "a.c:4:1: fatal error: no file"), ("tsc", "a.ts(3,9): error TS2304: no x"), ("ruff", "a.py:1:8: F401 unused"), ("go", "a.go:3:1: undefined: x"), ("mypy", "a.py:3: error: bad type"), ("pyright", "  a.py:3:5 - information: hint"),
    ("flake8", "a.py:2:1: W291 blank"), ("pylint", "a.py:1:0: C0114: no docstring"), ("eslint", "a.js: line 3, col 5, Warning - no-unused"), ("golangci", "a.go:9:2: unused (lint)"), ("cargo", "src/a.rs:3:5: warning: unused"), ("javac", "A.java:7: error: no symbol"), ("kotlinc", "a.kt:3:5: warning: unused"),
    ("swiftc", "a.swift:3:5: error: no x"), ("dotnet", "A.cs(3,9): error CS0103: no x [a.csproj]"), ("rubocop", "a.rb:1:1: W: unused"), ("luacheck", "  a.lua:3:5: (W211) unused"), ("phpstan", "a.php:12:no method"), ("shellcheck", "a.sh:3:5: note: quote"),
)


def _diagnostics(spark) -> DataFrame:
    one = lambda t, x: reports.diagnostics(spark.createDataFrame([(x,)], "line string"), t).select(F.lit(t).alias("tool"), "file", "line_no", F.coalesce("column", F.lit(0)).alias("col"), "severity", "message")
    return reduce(DataFrame.unionByName, [one(t, x) for t, x in LINES])


def _ignored(spark) -> DataFrame:
    paths = ("a.log", "keep.log", "x/b.log", "build/a.py", "x/build/a.py", "docs/a.md", "x/docs/a.md", "a.py")
    return spark.createDataFrame([(p,) for p in paths], "path string").select("path", files.ignored(F.col("path"), ["# no", "*.log", "!keep.log", "build/", "docs/*.md"]).alias("ignored"))


def _predicates(spark) -> DataFrame:
    rows = [("a.b.run", "run", "dependabot[bot]", 1.0, -3.0, "tests/a.py"), ("run", "a.b.run", "ann", 0.95, 0.0, "src/latest.py"), ("x::run", "run", "Codecov", 0.7, 3.0, "src/a_test.go"), ("runs", "run", "bob", 0.9, 2.0, "src/test_a.py")]
    d = spark.createDataFrame(rows, "candidate string, target string, author string, score double, delta double, path string")
    return d.select(
        "candidate", text.names_match(F.col("candidate"), F.col("target")).alias("matches"), reports.is_bot(F.col("author"), F.lit("x@y")).alias("bot"),
        scores.similarity_label(F.col("score")).alias("label"), scores.trend(F.col("delta")).alias("trend"), nav.is_test_path(F.col("path")).alias("is_test"),
    )


def _texts(spark) -> DataFrame:
    rows = [(1, "x = 1  # one", "a/b.py"), (2, "s = '# no' + \"it's\"  # yes", "gen/x.py"), (3, "käse 日本語", "src/api.pb.go"), (4, "plain", "src/latest.py")]
    d = spark.createDataFrame(rows, "id int, line string, path string")
    lines = F.lit("alpha\nbeta Gamma\ngamma beta delta\nend")
    return d.select(
        "id", text.strip_comment(F.col("line")).alias("code"), text.strip_strings(F.col("line")).alias("bare"), F.replace(text.truncate_bytes(F.col("line"), 7), F.lit(" "), F.lit("_")).alias("head"),
        F.replace(text.truncate_bytes(F.col("line"), 7, at_end=True), F.lit(" "), F.lit("_")).alias("tail"), text.is_generated(F.col("path")).alias("generated"),
        text.snippet(lines, F.array(F.lit("delta"), F.lit("gamma")))["first"].alias("first"), F.size(text.rolling_hashes(F.split("line", " "), 2)).alias("windows"),
        F.size(F.array_distinct(text.rolling_hashes(F.array(*[F.lit(x) for x in "abcabc"]), 3))).alias("distinct_windows"),
    )


@query("code_definitions", rows_sql("path VARCHAR, name VARCHAR, kind VARCHAR, detail VARCHAR, line INT, end_line INT, params INT, complexity INT, cognitive INT, nesting INT", """
shop/api.py|handle|function|(path, n)|4|9|2|2|1|1
shop/api.py|main|function|()|12|13|0|1|0|0
shop/maths.py|area|function|(a, b)|1|10|2|2|2|1
shop/maths.py|tail|function|(path)|13|18|1|1|0|0
shop/models.py|Book.total|method|(self)|18|19|1|1|0|0
shop/models.py|Book|class||17|19||||
shop/models.py|Item.__init__|method|(self, name, price)|8|10|3|1|0|0
shop/models.py|Item.total|method|(self)|13|14|1|1|0|0
shop/models.py|Item|class||7|14||||
shop/models.py|Kit|class||27|28||||
shop/models.py|Tool.total|method|(self)|23|24|1|1|0|0
shop/models.py|Tool|class||22|24||||
shop/models.py|with_tax|function|(price)|31|35|1|2|1|1
shop/store.py|_old|function|(x)|32|39|1|2|2|1
shop/store.py|load|function|(path)|5|11|1|2|1|1
shop/store.py|price_of|function|(n)|27|29|1|1|0|0
shop/store.py|run|function|(cmd)|19|24|1|1|0|0
shop/store.py|save|function|(path, rows)|14|16|2|1|0|1
shop/views.py|Bill.__init__|method|(self)|32|33|1|1|0|0
shop/views.py|Bill.draw|method|(self, page)|35|39|2|1|0|0
shop/views.py|Bill|class||31|39||||
shop/views.py|Desk.__init__|method|(self)|13|14|1|1|0|0
shop/views.py|Desk.clear|method|(self)|19|20|1|1|0|0
shop/views.py|Desk.size|method|(self)|22|23|1|1|0|0
shop/views.py|Desk.write|method|(self, text)|16|17|2|1|0|0
shop/views.py|Desk|class||12|23||||
shop/views.py|Log.clear|method|(self)|5|6|1|1|0|0
shop/views.py|Log.size|method|(self)|8|9|1|1|0|0
shop/views.py|Log.write|method|(self, text)|2|3|2|1|0|0
shop/views.py|Log|class||1|9||||
shop/views.py|Page.close|method|(self)|49|50|1|1|0|0
shop/views.py|Page.line|method|(self, n)|46|47|2|1|0|0
shop/views.py|Page.open|method|(self)|43|44|1|1|0|0
shop/views.py|Page|class||42|50||||
shop/views.py|Quiet.hush|method|(self)|27|28|1|1|0|0
shop/views.py|Quiet|class||26|28||||
tests/test_api.py|test_handle|function|()|4|5|0|2|0|0
"""))
def code_definitions(spark, sf_dir):
    """Functions, methods and classes with their metrics."""
    return program.definitions(_facts(spark)).fillna("", ["detail"])


@query("code_imports", rows_sql("path VARCHAR, module VARCHAR, names VARCHAR, line INT, is_from BOOLEAN", """
shop/api.py|shop|store|1|true
shop/models.py|abc|ABC|2|true
shop/models.py|abc|abstractmethod|2|true
shop/store.py|os||1|false
shop/store.py|shop.models|Book|2|true
shop/store.py|shop.models|with_tax|2|true
tests/test_api.py|shop.api|handle|1|true
"""))
def code_imports(spark, sf_dir):
    return program.imports(_facts(spark)).fillna("", ["names"])


@query("code_importers", rows_sql("path VARCHAR, line INT", """
shop/api.py|1
shop/store.py|2
tests/test_api.py|1
"""))
def code_importers(spark, sf_dir):
    """Files that import the package or a part of it."""
    return program.importers(_facts(spark), "shop")


@query("code_call_graph", rows_sql("src_file VARCHAR, src_func VARCHAR, dst_file VARCHAR, dst_func VARCHAR, call_type VARCHAR", """
shop/api.py|handle|shop/store.py|load|attr
shop/api.py|handle|shop/store.py|price_of|attr
shop/api.py|main|shop/api.py|handle|intra
shop/models.py|Tool.total|shop/models.py|with_tax|intra
shop/store.py|price_of|shop/models.py|Book.total|receiver
shop/store.py|price_of|shop/models.py|Book|direct
shop/store.py|price_of|shop/models.py|with_tax|direct
shop/views.py|Bill.draw|shop/views.py|Page.close|receiver
shop/views.py|Bill.draw|shop/views.py|Page.line|receiver
shop/views.py|Bill.draw|shop/views.py|Page.open|receiver
shop/views.py|Desk.__init__|shop/views.py|Log|intra
tests/test_api.py|test_handle|shop/api.py|handle|direct
"""))
def code_call_graph(spark, sf_dir):
    """Calls in a file, through imports and on receivers of known class."""
    return _edges(spark)


@query("code_dead_functions", rows_sql("path VARCHAR, name VARCHAR, line INT", """
shop/maths.py|area|1
shop/maths.py|tail|13
shop/store.py|_old|32
shop/store.py|run|19
shop/store.py|save|14
"""))
def code_dead_functions(spark, sf_dir):
    """Functions that no resolved call reaches; entry points, tests and dunders aside."""
    return nav.dead_functions(_facts(spark), _edges(spark))


@query("code_smells", rows_sql("path VARCHAR, name VARCHAR, smell VARCHAR", """
shop/api.py|handle|LongParameterList
shop/maths.py|area|LongMethod
shop/maths.py|area|LongParameterList
shop/models.py|Item.__init__|LongParameterList
shop/store.py|_old|LongMethod
shop/store.py|save|LongParameterList
shop/views.py|Bill.draw|LongParameterList
shop/views.py|Desk.write|LongParameterList
shop/views.py|Desk|GodClass
shop/views.py|Log.write|LongParameterList
shop/views.py|Log|GodClass
shop/views.py|Page.line|LongParameterList
shop/views.py|Page|GodClass
"""))
def code_smells(spark, sf_dir):
    """With thresholds as low as the sample is small."""
    return program.code_smells(_facts(spark), methods=2, loc=7, cc=2, params=1, depth=1)


@query("code_call_smells", rows_sql("path VARCHAR, name VARCHAR, smell VARCHAR, detail VARCHAR", """
shop/views.py|Bill.draw|FeatureEnvy|page:4
shop/views.py|Desk|MiddleMan|3/3
shop/views.py|Quiet|RefusedBequest|0/3
"""))
def code_call_smells(spark, sf_dir):
    """Middle man, refused bequest, feature envy."""
    return nav.call_smells(_facts(spark))


@query("code_line_counts", rows_sql("path VARCHAR, code BIGINT, comment BIGINT, blank BIGINT", """
shop/api.py|9|0|4
shop/broken.py|1|0|0
shop/maths.py|16|0|2
shop/models.py|20|3|12
shop/store.py|29|0|10
shop/views.py|34|0|16
tests/test_api.py|3|0|2
"""))
def code_line_counts(spark, sf_dir):
    return program.line_counts(samples.files(spark))


@query("code_inheritance", rows_sql("src VARCHAR, dst VARCHAR, external BOOLEAN", """
shop/models.py:Book|shop/models.py:Item|false
shop/models.py:Item|ABC|true
shop/models.py:Kit|shop/models.py:Book|false
shop/models.py:Kit|shop/models.py:Tool|false
shop/models.py:Tool|shop/models.py:Item|false
shop/views.py:Quiet|shop/views.py:Log|false
"""))
def code_inheritance(spark, sf_dir):
    """Bases, resolved in the file and through imports."""
    return nav.inheritance(_facts(spark))


@query("code_inheritance_subgraph", rows_sql("src VARCHAR, dst VARCHAR, external BOOLEAN", """
shop/models.py:Book|shop/models.py:Item|false
shop/models.py:Kit|shop/models.py:Book|false
"""))
def code_inheritance_subgraph(spark, sf_dir):
    """A class, its ancestors and descendants one step away."""
    return nav.subgraph(nav.inheritance(_facts(spark)), "shop/models.py:Book", 1)


@query("code_class_roles", rows_sql("path VARCHAR, name VARCHAR, is_abstract BOOLEAN, is_mixin BOOLEAN", """
shop/models.py|Book|false|false
shop/models.py|Item|true|false
shop/models.py|Kit|false|false
shop/models.py|Tool|false|false
shop/views.py|Bill|false|false
shop/views.py|Desk|false|false
shop/views.py|Log|false|false
shop/views.py|Page|false|false
shop/views.py|Quiet|false|false
"""))
def code_class_roles(spark, sf_dir):
    return nav.class_roles(_facts(spark))


@query("code_hubs", rows_sql("node VARCHAR, in_degree BIGINT, out_degree BIGINT", """
shop/api.py:handle|2|2
shop/api.py:main|0|1
shop/models.py:Book.total|1|0
shop/models.py:Book|1|0
shop/models.py:Tool.total|0|1
shop/models.py:with_tax|2|0
shop/store.py:load|1|0
shop/store.py:price_of|1|3
shop/views.py:Bill.draw|0|3
shop/views.py:Desk.__init__|0|1
shop/views.py:Log|1|0
shop/views.py:Page.close|1|0
shop/views.py:Page.line|1|0
shop/views.py:Page.open|1|0
tests/test_api.py:test_handle|0|1
"""))
def code_hubs(spark, sf_dir):
    """Degrees of the call graph."""
    return graph.degrees(nav.call_nodes(_edges(spark))).select("node", "in_degree", "out_degree")


@query("code_locate", rows_sql("path VARCHAR, name VARCHAR, kind VARCHAR, line INT, end_line INT", """
shop/models.py|Book.total|method|18|19
shop/models.py|Item.total|method|13|14
shop/models.py|Tool.total|method|23|24
"""))
def code_locate(spark, sf_dir):
    """Definitions of one name."""
    return nav.locate(_facts(spark), "total")


@query("code_function_counts", rows_sql("path VARCHAR, n BIGINT", """
shop/api.py|2
shop/maths.py|2
shop/models.py|5
shop/store.py|5
shop/views.py|13
tests/test_api.py|1
"""))
def code_function_counts(spark, sf_dir):
    return nav.function_counts(_facts(spark))


@query("code_interface", rows_sql("path VARCHAR, name VARCHAR, kind VARCHAR, signature VARCHAR, doc VARCHAR", """
shop/api.py|handle|function|(path, n)|
shop/api.py|main|function|()|
shop/maths.py|area|function|(a, b)|
shop/maths.py|tail|function|(path)|
shop/models.py|Book.total|method|(self)|
shop/models.py|Book|class||
shop/models.py|Item.total|method|(self)|Price with tax.
shop/models.py|Item|class||
shop/models.py|Kit|class||
shop/models.py|Tool.total|method|(self)|
shop/models.py|Tool|class||
shop/models.py|with_tax|function|(price)|Return the price plus tax.
shop/store.py|load|function|(path)|
shop/store.py|price_of|function|(n)|
shop/store.py|run|function|(cmd)|
shop/store.py|save|function|(path, rows)|
shop/views.py|Bill.draw|method|(self, page)|
shop/views.py|Bill|class||
shop/views.py|Desk.clear|method|(self)|
shop/views.py|Desk.size|method|(self)|
shop/views.py|Desk.write|method|(self, text)|
shop/views.py|Desk|class||
shop/views.py|Log.clear|method|(self)|
shop/views.py|Log.size|method|(self)|
shop/views.py|Log.write|method|(self, text)|
shop/views.py|Log|class||
shop/views.py|Page.close|method|(self)|
shop/views.py|Page.line|method|(self, n)|
shop/views.py|Page.open|method|(self)|
shop/views.py|Page|class||
shop/views.py|Quiet.hush|method|(self)|
shop/views.py|Quiet|class||
tests/test_api.py|test_handle|function|()|
"""))
def code_interface(spark, sf_dir):
    """Public functions and classes."""
    return nav.interface(_facts(spark)).select("path", "name", "kind", "signature", "doc")


@query("code_surface", rows_sql("module VARCHAR, name VARCHAR, kind VARCHAR, example VARCHAR, triggers VARCHAR", """
shop.api|handle|function|handle(path, n)|handle
shop.api|main|function|main()|main
shop.maths|area|function|area(a, b)|area
shop.maths|tail|function|tail(path)|tail
shop.models|Book.total|method|Book.total()|total
shop.models|Book|class|Book(...)|book
shop.models|Item.total|method|Item.total()|total,price,tax
shop.models|Item|class|Item(...)|item
shop.models|Kit|class|Kit(...)|kit
shop.models|Tool.total|method|Tool.total()|total
shop.models|Tool|class|Tool(...)|tool
shop.models|with_tax|function|with_tax(price)|tax,price,plus
shop.store|load|function|load(path)|load
shop.store|price_of|function|price_of(n)|price
shop.store|run|function|run(cmd)|run
shop.store|save|function|save(path, rows)|save
shop.views|Bill.draw|method|Bill.draw(page)|draw
shop.views|Bill|class|Bill(...)|bill
shop.views|Desk.clear|method|Desk.clear()|clear
shop.views|Desk.size|method|Desk.size()|size
shop.views|Desk.write|method|Desk.write(text)|write
shop.views|Desk|class|Desk(...)|desk
shop.views|Log.clear|method|Log.clear()|clear
shop.views|Log.size|method|Log.size()|size
shop.views|Log.write|method|Log.write(text)|write
shop.views|Log|class|Log(...)|log
shop.views|Page.close|method|Page.close()|close
shop.views|Page.line|method|Page.line(n)|line
shop.views|Page.open|method|Page.open()|open
shop.views|Page|class|Page(...)|page
shop.views|Quiet.hush|method|Quiet.hush()|hush
shop.views|Quiet|class|Quiet(...)|quiet
tests.test_api|test_handle|function|test_handle()|test,handle
"""))
def code_surface(spark, sf_dir):
    """Public entries with an example and trigger words."""
    return nav.surface(_facts(spark))


@query("code_references", rows_sql("path VARCHAR, line INT, kind VARCHAR", """
shop/models.py|24|call
shop/models.py|31|definition
shop/store.py|29|call
shop/store.py|2|import
"""))
def code_references(spark, sf_dir):
    """Where a name is defined, imported and called."""
    return nav.references(_facts(spark), "with_tax")


@query("code_references_filtered", rows_sql("path VARCHAR, line INT, kind VARCHAR", """
shop/models.py|24|call
shop/store.py|29|call
"""))
def code_references_filtered(spark, sf_dir):
    """Calls alone."""
    return nav.references(_facts(spark), "with_tax", ("call",))


@query("code_go_to_definition", rows_sql("path VARCHAR, owner VARCHAR, name VARCHAR, to_path VARCHAR, to_line INT, scope VARCHAR", """
shop/api.py|handle|n|shop/api.py|4|parameter
shop/api.py|handle|path|shop/api.py|4|parameter
shop/api.py|handle|rows|shop/api.py|5|local
shop/api.py|handle|total|shop/api.py|6|local
shop/api.py|main|handle|shop/api.py|4|file
shop/maths.py|area|a|shop/maths.py|1|parameter
shop/maths.py|area|base|shop/maths.py|4|local
shop/maths.py|area|b|shop/maths.py|1|parameter
shop/maths.py|area|half|shop/maths.py|5|local
shop/maths.py|area|one|shop/maths.py|2|local
shop/maths.py|area|rest|shop/maths.py|7|local
shop/maths.py|area|two|shop/maths.py|3|local
shop/maths.py|tail|f|shop/maths.py|14|local
shop/maths.py|tail|last|shop/maths.py|15|local
shop/maths.py|tail|path|shop/maths.py|13|parameter
shop/models.py|Book.total|self|shop/models.py|18|parameter
shop/models.py|Book|Item|shop/models.py|7|file
shop/models.py|Item.__init__|name|shop/models.py|8|parameter
shop/models.py|Item.__init__|price|shop/models.py|8|parameter
shop/models.py|Item.__init__|self|shop/models.py|8|parameter
shop/models.py|Kit|Book|shop/models.py|17|file
shop/models.py|Kit|Tool|shop/models.py|22|file
shop/models.py|Tool.total|self|shop/models.py|23|parameter
shop/models.py|Tool.total|with_tax|shop/models.py|31|file
shop/models.py|Tool|Item|shop/models.py|7|file
shop/models.py|with_tax|TAX|shop/models.py|4|file
shop/models.py|with_tax|price|shop/models.py|31|parameter
shop/store.py|_old|limit|shop/store.py|33|local
shop/store.py|_old|x|shop/store.py|32|parameter
shop/store.py|_old|y|shop/store.py|35|local
shop/store.py|_old|z|shop/store.py|38|local
shop/store.py|load|f|shop/store.py|6|local
shop/store.py|load|path|shop/store.py|5|parameter
shop/store.py|load|rows|shop/store.py|7|local
shop/store.py|price_of|Book|shop/models.py|17|import
shop/store.py|price_of|b|shop/store.py|28|local
shop/store.py|price_of|n|shop/store.py|27|parameter
shop/store.py|price_of|with_tax|shop/models.py|31|import
shop/store.py|run|cmd|shop/store.py|19|parameter
shop/store.py|run|name|shop/store.py|20|local
shop/store.py|save|f|shop/store.py|15|local
shop/store.py|save|path|shop/store.py|14|parameter
shop/store.py|save|rows|shop/store.py|14|parameter
shop/views.py|Bill.__init__|self|shop/views.py|32|parameter
shop/views.py|Bill.draw|Page|shop/views.py|42|file
shop/views.py|Bill.draw|page|shop/views.py|35|parameter
shop/views.py|Bill.draw|self|shop/views.py|35|parameter
shop/views.py|Desk.__init__|Log|shop/views.py|1|file
shop/views.py|Desk.__init__|self|shop/views.py|13|parameter
shop/views.py|Desk.clear|self|shop/views.py|19|parameter
shop/views.py|Desk.size|self|shop/views.py|22|parameter
shop/views.py|Desk.write|self|shop/views.py|16|parameter
shop/views.py|Desk.write|text|shop/views.py|16|parameter
shop/views.py|Quiet|Log|shop/views.py|1|file
tests/test_api.py|test_handle|handle|shop/api.py|4|import
"""))
def code_go_to_definition(spark, sf_dir):
    """Every name that a function reads, and where it comes from."""
    return nav.definition_of(_facts(spark), _facts(spark).where("kind = 'read' and owner is not null"))


@query("code_change_impact", rows_sql("path VARCHAR, name VARCHAR, depth INT, is_test BOOLEAN", """
shop/api.py|handle|2|false
shop/api.py|main|3|false
shop/models.py|Book.total|0|false
shop/models.py|Item.__init__|0|false
shop/models.py|Item.total|0|false
shop/models.py|Tool.total|0|false
shop/models.py|with_tax|0|false
shop/store.py|price_of|1|false
tests/test_api.py|test_handle|3|true
"""))
def code_change_impact(spark, sf_dir):
    """What a change of one file reaches."""
    return nav.change_impact(_facts(spark), _edges(spark), spark.createDataFrame([("shop/models.py",)], "path string"))


@query("code_whatbreaks", rows_sql("how VARCHAR, path VARCHAR, name VARCHAR, depth INT, target VARCHAR", """
call|shop/api.py|handle|1|load
call|shop/api.py|handle|2|shop/models.py
call|shop/api.py|main|2|load
call|shop/api.py|main|3|shop/models.py
call|shop/store.py|price_of|1|shop/models.py
call|tests/test_api.py|test_handle|2|load
call|tests/test_api.py|test_handle|3|shop/models.py
import|shop/store.py||1|shop.models
import|shop/store.py||1|shop/models.py
"""))
def code_whatbreaks(spark, sf_dir):
    """A file, a function and a module as targets."""
    return _breaks(spark)


@query("code_slice", rows_sql("path VARCHAR, func VARCHAR, start INT, direction VARCHAR, line INT", """
shop/store.py|_old|34|forward|34
shop/store.py|_old|34|forward|35
shop/store.py|_old|34|forward|37
shop/store.py|_old|34|forward|39
shop/store.py|_old|39|backward|33
shop/store.py|_old|39|backward|34
shop/store.py|_old|39|backward|35
shop/store.py|_old|39|backward|37
shop/store.py|_old|39|backward|38
shop/store.py|_old|39|backward|39
shop/store.py|run|20|forward|20
shop/store.py|run|20|forward|21
shop/store.py|run|20|forward|22
"""))
def code_slice(spark, sf_dir):
    """Slices of one function, forward and backward."""
    return program.slices(_flows(spark), _starts(spark))


@query("code_chop", rows_sql("path VARCHAR, func VARCHAR, source INT, target INT, line INT", """
shop/api.py|handle|5|9|5
shop/api.py|handle|5|9|7
shop/api.py|handle|5|9|8
shop/api.py|handle|5|9|9
shop/store.py|_old|34|37|34
shop/store.py|_old|34|37|37
"""))
def code_chop(spark, sf_dir):
    """Lines between two lines, for three pairs, the last of which is none."""
    return nav.chop(_flows(spark), _pairs(spark))


@query("code_context", rows_sql("depth INT, path VARCHAR, name VARCHAR, card VARCHAR", """
0|shop/api.py|handle|handle(path, n) -> load,price_of
1|shop/store.py|load|load(path)
1|shop/store.py|price_of|price_of(n) -> Book,Book.total,with_tax
2|shop/models.py|Book.total|Book.total(self)
2|shop/models.py|with_tax|with_tax(price): Return the price plus tax.
"""))
def code_context(spark, sf_dir):
    """An entry and what it calls."""
    return nav.context(_facts(spark), _edges(spark), "handle", 2)


@query("code_explain", rows_sql("path VARCHAR, name VARCHAR, signature VARCHAR, doc VARCHAR, complexity INT, calls VARCHAR, called_by VARCHAR, n_def_use BIGINT, n_dead_stores BIGINT, n_taints BIGINT, pure BOOLEAN", """
shop/models.py|with_tax|(price)|Return the price plus tax.|2||Tool.total,price_of|2|0|0|false
shop/store.py|load|(path)||2||handle|5|0|0|false
"""))
def code_explain(spark, sf_dir):
    return nav.explain(_facts(spark), _edges(spark), _flows(spark), "with_tax").unionByName(nav.explain(_facts(spark), _edges(spark), _flows(spark), "load"))


@query("code_chunks", rows_sql("path VARCHAR, name VARCHAR, part INT, n_chars INT", """
shop/api.py|handle|0|100
shop/api.py|handle|1|40
shop/api.py|main|0|37
shop/broken.py||0|6
shop/maths.py|area|0|100
shop/maths.py|area|1|61
shop/maths.py|tail|0|98
shop/models.py|Book.total|0|46
shop/models.py|Item.__init__|0|88
shop/models.py|Item.total|0|50
shop/models.py|Tool.total|0|56
shop/models.py|with_tax|0|100
shop/models.py|with_tax|1|50
shop/store.py|_old|0|100
shop/store.py|_old|1|17
shop/store.py|load|0|100
shop/store.py|load|1|27
shop/store.py|price_of|0|68
shop/store.py|run|0|100
shop/store.py|run|1|7
shop/store.py|save|0|84
shop/views.py|Bill.__init__|0|44
shop/views.py|Bill.draw|0|100
shop/views.py|Bill.draw|1|26
shop/views.py|Desk.__init__|0|48
shop/views.py|Desk.clear|0|45
shop/views.py|Desk.size|0|50
shop/views.py|Desk.write|0|55
shop/views.py|Log.clear|0|33
shop/views.py|Log.size|0|36
shop/views.py|Log.write|0|39
shop/views.py|Page.close|0|33
shop/views.py|Page.line|0|35
shop/views.py|Page.open|0|32
shop/views.py|Quiet.hush|0|36
tests/test_api.py|test_handle|0|49
"""))
def code_chunks(spark, sf_dir):
    """Texts of functions in parts of 100 characters."""
    return nav.chunks(samples.files(spark), _facts(spark), 100).select("path", "name", "part", F.length("text").alias("n_chars"))


@query("code_embedding_texts", rows_sql("line_no INT, line VARCHAR", """
0|file: shop/store.py
1|function: price_of(n)
2|calls: Book,Book.total,with_tax
3|def price_of(n):
4|    b = Book("b", n)
5|    return with_tax(b.total())
"""))
def code_embedding_texts(spark, sf_dir):
    """Lines of the text that stands for a function."""
    return nav.embedding_texts(nav.chunks(samples.files(spark), _facts(spark)).where("name = 'price_of'"), _facts(spark), _edges(spark)).select(F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("code_todo", rows_sql("priority INT, category VARCHAR, path VARCHAR, name VARCHAR, detail VARCHAR", """
1|dead|shop/maths.py|area|1
1|dead|shop/maths.py|tail|13
1|dead|shop/store.py|_old|32
1|dead|shop/store.py|run|19
1|dead|shop/store.py|save|14
3|cohesion|shop/views.py|Log|3
3|cohesion|shop/views.py|Page|3
5|equivalence|shop/maths.py|area|3
"""))
def code_todo(spark, sf_dir):
    return nav.todo(_facts(spark), _edges(spark), _flows(spark))


@query("code_vulnerabilities", rows_sql("path VARCHAR, func VARCHAR, weakness VARCHAR, severity VARCHAR, name VARCHAR, source_line INT, line INT", """
shop/store.py|run|CWE-78|critical|name|20|21
"""))
def code_vulnerabilities(spark, sf_dir):
    return nav.vulnerabilities(samples.files(spark))


@query("code_secure", rows_sql("category VARCHAR, severity VARCHAR, n BIGINT", """
resource|high|1
resource|medium|1
taint|critical|1
"""))
def code_secure(spark, sf_dir):
    return nav.secure(samples.files(spark), _flows(spark))


@query("code_verify", rows_sql("path VARCHAR, n_functions BIGINT, n_with_contract BIGINT, n_tested BIGINT, coverage DOUBLE", """
shop/api.py|2|0|1|0.5
shop/maths.py|2|0|0|0.0
shop/models.py|3|1|0|0.333333
shop/store.py|5|0|0|0.0
shop/views.py|9|0|0|0.0
"""))
def code_verify(spark, sf_dir):
    return nav.verify(_facts(spark), _flows(spark))


@query("code_packages", rows_sql("root VARCHAR, n_files BIGINT", """
shop|6
"""))
def code_packages(spark, sf_dir):
    return nav.packages(samples.files(spark), "shop")


@query("code_dataflow", rows_sql("path VARCHAR, func VARCHAR, kind VARCHAR, n BIGINT", """
shop/store.py|_old|available|3
shop/store.py|_old|cfg_edge|8
shop/store.py|_old|constant|1
shop/store.py|_old|control|2
shop/store.py|_old|def_use|6
shop/store.py|_old|idom|7
shop/store.py|_old|live|10
shop/store.py|_old|narrowed|2
shop/store.py|_old|never|1
shop/store.py|_old|phi|1
shop/store.py|_old|ssa_def|5
shop/store.py|_old|ssa_phi|1
shop/store.py|_old|ssa_use|5
shop/store.py|load|cfg_edge|8
shop/store.py|load|control|1
shop/store.py|load|def_use|5
shop/store.py|load|idom|7
shop/store.py|load|leak|1
shop/store.py|load|live|8
shop/store.py|load|narrowed|2
shop/store.py|load|ssa_def|3
shop/store.py|load|ssa_use|5
shop/store.py|price_of|cfg_edge|3
shop/store.py|price_of|def_use|2
shop/store.py|price_of|idom|3
shop/store.py|price_of|live|5
shop/store.py|price_of|ssa_def|2
shop/store.py|price_of|ssa_use|2
shop/store.py|run|cfg_edge|6
shop/store.py|run|constant|1
shop/store.py|run|dead_store|1
shop/store.py|run|def_use|3
shop/store.py|run|idom|6
shop/store.py|run|live|14
shop/store.py|run|ssa_def|3
shop/store.py|run|ssa_use|3
shop/store.py|run|taint|1
shop/store.py|save|cfg_edge|3
shop/store.py|save|def_use|3
shop/store.py|save|idom|3
shop/store.py|save|live|5
shop/store.py|save|ssa_def|3
shop/store.py|save|ssa_use|3
"""))
def code_dataflow(spark, sf_dir):
    """How many facts of each kind each function has."""
    return _flows(spark).groupBy("path", "func", "kind").agg(F.count("*").alias("n")).where("path = 'shop/store.py'")


@query("code_cfg", rows_sql("func VARCHAR, name VARCHAR, line INT, other INT", """
_old|Assign|0|33
_old|Assign|34|35
_old|Assign|34|37
_old|Assign|35|38
_old|Assign|37|38
_old|If|33|34
_old|Return|38|39
_old|exit|39|0
load|Assign|0|6
load|Assign|6|7
load|Expr|8|10
load|If|7|8
load|Return|10|11
load|Return|8|9
load|exit|11|0
load|exit|9|0
price_of|Assign|0|28
price_of|Return|28|29
price_of|exit|29|0
run|Assign|0|20
run|Assign|22|23
run|Expr|20|21
run|Expr|21|22
run|Return|23|24
run|exit|24|0
save|Expr|15|16
save|With|0|15
save|exit|16|0
"""))
def code_cfg(spark, sf_dir):
    """Edges of the control flow graph."""
    return _flows(spark).where(F.col("kind").isin("cfg_edge")).where("path = 'shop/store.py'").drop("kind", "path")


@query("code_def_use", rows_sql("path VARCHAR, func VARCHAR, name VARCHAR, line INT, other INT", """
shop/api.py|handle|n|0|8
shop/api.py|handle|path|0|5
shop/api.py|handle|rows|5|7
shop/api.py|handle|total|6|8
shop/api.py|handle|total|6|9
shop/api.py|handle|total|8|8
shop/api.py|handle|total|8|9
shop/maths.py|area|a|0|2
shop/maths.py|area|a|0|3
shop/maths.py|area|base|4|5
shop/maths.py|area|b|0|2
shop/maths.py|area|b|0|3
shop/maths.py|area|half|5|6
shop/maths.py|area|one|2|7
shop/maths.py|area|rest|7|10
shop/maths.py|area|rest|9|10
shop/maths.py|area|two|3|9
shop/maths.py|tail|f|14|15
shop/maths.py|tail|f|14|16
shop/maths.py|tail|f|14|17
shop/maths.py|tail|last|15|18
shop/maths.py|tail|path|0|14
shop/models.py|__init__|name|0|9
shop/models.py|__init__|price|0|10
shop/models.py|__init__|self|0|10
shop/models.py|__init__|self|0|9
shop/models.py|total|self|0|19
shop/models.py|total|self|0|24
shop/models.py|with_tax|price|0|33
shop/models.py|with_tax|price|0|35
shop/store.py|_old|limit|33|34
shop/store.py|_old|x|0|35
shop/store.py|_old|x|0|38
shop/store.py|_old|y|35|39
shop/store.py|_old|y|37|39
shop/store.py|_old|z|38|39
shop/store.py|load|f|6|10
shop/store.py|load|f|6|7
shop/store.py|load|path|0|6
shop/store.py|load|rows|7|11
shop/store.py|load|rows|7|8
shop/store.py|price_of|b|28|29
shop/store.py|price_of|n|0|28
shop/store.py|run|cmd|0|24
shop/store.py|run|name|20|21
shop/store.py|run|name|20|22
shop/store.py|save|f|15|16
shop/store.py|save|path|0|15
shop/store.py|save|rows|0|16
"""))
def code_def_use(spark, sf_dir):
    """Definitions and the uses they reach."""
    return _flows(spark).where(F.col("kind").isin("def_use")).where("path <> 'shop/views.py'").drop("kind")


@query("code_liveness", rows_sql("func VARCHAR, name VARCHAR, line INT", """
_old|limit|33
_old|x|0
_old|x|33
_old|x|34
_old|x|35
_old|x|37
_old|y|35
_old|y|37
_old|y|38
_old|z|38
handle|n|0
handle|n|5
handle|n|6
handle|n|7
handle|n|8
handle|path|0
handle|rows|5
handle|rows|6
handle|rows|7
handle|rows|8
handle|store|0
handle|store|5
handle|store|6
handle|store|7
handle|store|8
handle|total|6
handle|total|7
handle|total|8
"""))
def code_liveness(spark, sf_dir):
    return _flows(spark).where(F.col("kind").isin("live")).where("func in ('_old', 'handle')").drop("kind", "other", "path")


@query("code_dominators", rows_sql("func VARCHAR, line INT, other INT", """
_old|0|39
_old|33|0
_old|34|33
_old|35|34
_old|37|34
_old|38|34
_old|39|38
area|0|10
area|10|6
area|2|0
area|3|2
area|4|3
area|5|4
area|6|5
area|7|6
area|9|6
handle|0|9
handle|5|0
handle|6|5
handle|7|6
handle|8|7
handle|9|7
"""))
def code_dominators(spark, sf_dir):
    """Immediate dominators."""
    return _flows(spark).where(F.col("kind").isin("idom")).where("func in ('_old', 'handle', 'area')").drop("kind", "name", "path")


@query("code_available_expressions", rows_sql("path VARCHAR, func VARCHAR, name VARCHAR, line INT", """
shop/maths.py|area|(3 Mult base)|10
shop/maths.py|area|(3 Mult base)|6
shop/maths.py|area|(3 Mult base)|7
shop/maths.py|area|(3 Mult base)|9
shop/maths.py|area|(a Mult b)|10
shop/maths.py|area|(a Mult b)|3
shop/maths.py|area|(a Mult b)|4
shop/maths.py|area|(a Mult b)|5
shop/maths.py|area|(a Mult b)|6
shop/maths.py|area|(a Mult b)|7
shop/maths.py|area|(a Mult b)|9
shop/store.py|_old|(1 Add x)|39
"""))
def code_available_expressions(spark, sf_dir):
    return _flows(spark).where(F.col("kind").isin("available")).where("line > 0").drop("kind", "other")


@query("code_ssa", rows_sql("path VARCHAR, func VARCHAR, name VARCHAR, line INT", """
shop/api.py|handle|r.1 = r.2|7
shop/api.py|handle|total.2 = total.1, total.3|7
shop/maths.py|area|rest.3 = rest.1, rest.2|10
shop/store.py|_old|y.3 = y.1, y.2|38
"""))
def code_ssa(spark, sf_dir):
    """Joins of versions, with their arguments."""
    return _flows(spark).where(F.col("kind").isin("ssa_phi")).drop("kind", "other")


@query("code_ssa_names", rows_sql("kind VARCHAR, name VARCHAR, line INT", """
ssa_def|limit.1|33
ssa_def|x.1|0
ssa_def|y.1|35
ssa_def|y.2|37
ssa_def|z.1|38
ssa_use|limit.1|34
ssa_use|x.1|35
ssa_use|x.1|38
ssa_use|y.3|39
ssa_use|z.1|39
"""))
def code_ssa_names(spark, sf_dir):
    """Versions that one function defines and uses."""
    return _flows(spark).where(F.col("kind").isin("ssa_def", "ssa_use")).where("func = '_old'").drop("other", "path", "func")


@query("code_value_numbers", rows_sql("path VARCHAR, func VARCHAR, name VARCHAR, line INT, other INT", """
shop/maths.py|area|b * a|3|2
"""))
def code_value_numbers(spark, sf_dir):
    """Expressions whose value is there already."""
    return _flows(spark).where(F.col("kind").isin("redundant")).drop("kind")


@query("code_constants", rows_sql("path VARCHAR, func VARCHAR, kind VARCHAR, name VARCHAR, line INT", """
shop/api.py|handle|constant|total = 0|6
shop/maths.py|area|constant|base = 2|4
shop/maths.py|area|constant|half = 6|5
shop/maths.py|area|never||9
shop/store.py|_old|constant|limit = 3|33
shop/store.py|_old|never||37
shop/store.py|run|constant|unused = 1|23
"""))
def code_constants(spark, sf_dir):
    """Constant definitions, and lines that constants cut off."""
    return _flows(spark).where(F.col("kind").isin("constant", "never")).drop("other")


@query("code_narrowing", rows_sql("path VARCHAR, func VARCHAR, name VARCHAR, line INT", """
shop/maths.py|area|half <= 5|9
shop/maths.py|area|half > 5|7
shop/models.py|with_tax|price < 0|34
shop/models.py|with_tax|price >= 0|35
shop/store.py|_old|limit <= 2|37
shop/store.py|_old|limit > 2|35
shop/store.py|load|rows falsy|9
shop/store.py|load|rows truthy|10
"""))
def code_narrowing(spark, sf_dir):
    return _flows(spark).where(F.col("kind").isin("narrowed")).drop("kind", "other")


@query("code_resources", rows_sql("path VARCHAR, func VARCHAR, kind VARCHAR, name VARCHAR, line INT, other INT", """
shop/maths.py|tail|double_close|f|14|17
shop/store.py|load|leak|f|6|0
"""))
def code_resources(spark, sf_dir):
    """Resources left open or closed twice."""
    return _flows(spark).where(F.col("kind").isin("leak", "double_close", "use_after_close"))


@query("code_contracts", rows_sql("path VARCHAR, func VARCHAR, kind VARCHAR, name VARCHAR, line INT", """
shop/models.py|with_tax|precondition|price >= 0|33
"""))
def code_contracts(spark, sf_dir):
    return _flows(spark).where(F.col("kind").isin("precondition", "postcondition")).drop("other")


@query("code_test_specs", rows_sql("path VARCHAR, func VARCHAR, name VARCHAR, line INT", """
tests/test_api.py|test_handle|handle('x', 2) -> 0|5
"""))
def code_test_specs(spark, sf_dir):
    return _flows(spark).where(F.col("kind").isin("spec")).drop("kind", "other")


@query("code_taint", rows_sql("path VARCHAR, func VARCHAR, name VARCHAR, line INT, other INT", """
shop/store.py|run|ShellExec:name|20|21
"""))
def code_taint(spark, sf_dir):
    return _flows(spark).where(F.col("kind").isin("taint")).drop("kind")


@query("code_dead_stores", rows_sql("path VARCHAR, func VARCHAR, kind VARCHAR, name VARCHAR, line INT", """
shop/api.py|handle|dead_store|r|7
shop/store.py|run|dead_store|unused|23
"""))
def code_dead_stores(spark, sf_dir):
    return _flows(spark).where(F.col("kind").isin("dead_store", "uninitialised", "unreachable")).drop("other")


@query("code_control_dependence", rows_sql("path VARCHAR, func VARCHAR, line INT, other INT", """
shop/api.py|handle|7|8
shop/maths.py|area|6|7
shop/maths.py|area|6|9
shop/models.py|with_tax|33|34
shop/store.py|_old|34|35
shop/store.py|_old|34|37
shop/store.py|load|8|9
"""))
def code_control_dependence(spark, sf_dir):
    return _flows(spark).where(F.col("kind").isin("control")).drop("kind", "name")


@query("code_text_functions", rows_sql("id INT, code VARCHAR, bare VARCHAR, head VARCHAR, tail VARCHAR, generated BOOLEAN, first INT, windows INT, distinct_windows INT", """
1|x = 1|x = 1  # one|x_=_1__|__#_one|false|2|5|3
2|s = '# no' + "it's"|s = '' + ""  # yes|s_=_'#_|__#_yes|true|2|8|3
3|käse 日本語|käse 日本語|käse_|本語|true|2|1|3
4|plain|plain|plain|plain|false|2|0|3
"""))
def code_text_functions(spark, sf_dir):
    """Comments, strings, snippets, byte limits and generated paths."""
    return _texts(spark)


@query("brace_definitions", rows_sql("path VARCHAR, name VARCHAR, kind VARCHAR, detail VARCHAR, line INT, end_line INT, params INT, complexity INT, cognitive INT, nesting INT", """
lib/cart.c|add|function|(struct cart *c, int k)|6|14|2|2|1|1
lib/cart.c|cart|class||4|4||||
lib/cart.c|main|function|()|16|18|0|1|0|0
srv/Cart.java|Cart.Cart|method|(int n)|7|9|1|1|0|0
srv/Cart.java|Cart.add|method|(List k, int v)|11|14|2|2|1|1
srv/Cart.java|Cart|class||4|17||||
srv/cart.go|Cart.Add|method|(k int, v string)|11|17|2|3|1|1
srv/cart.go|Cart|class||7|9||||
srv/cart.go|main|function|()|19|23|0|1|0|0
srv/cart.rs|Cart.add|method|(k: u32)|6|11|1|1|1|1
srv/cart.rs|Cart|class||3|3||||
srv/cart.rs|main|function|()|14|18|0|1|0|0
web/cart.js|Cart.constructor|method|(items)|5|7|1|1|0|0
web/cart.js|Cart.rounded|method|(x)|19|21|1|1|0|0
web/cart.js|Cart.total|method|(tax)|9|17|1|4|3|2
web/cart.js|Cart|class||4|22||||
web/cart.js|price|function|(i)|24|26|1|2|0|0
web/cart.js|show|function|(c)|28|30|1|1|0|0
"""))
def brace_definitions(spark, sf_dir):
    """Functions, methods and classes in languages with braces."""
    return program.definitions(_brace_facts(spark)).fillna("", ["detail"])


@query("brace_imports", rows_sql("path VARCHAR, module VARCHAR, line INT", """
lib/cart.c|cart.h|2
lib/cart.c|stdio.h|1
srv/Cart.java|java.util.List|2
srv/cart.go|fmt|4
srv/cart.rs|std::fs|1
web/cart.js|./util|1
web/cart.js|fs|2
"""))
def brace_imports(spark, sf_dir):
    return program.imports(_brace_facts(spark)).select("path", "module", "line")


@query("brace_calls", rows_sql("path VARCHAR, owner VARCHAR, name VARCHAR, line INT", """
lib/cart.c|add|printf|12
lib/cart.c|main|add|17
srv/Cart.java|Cart.add|helper|13
srv/cart.go|Cart.Add|fmt.Errorf|13
srv/cart.go|main|c.Add|21
srv/cart.go|main|run|22
srv/cart.rs|main|c.add|16
srv/cart.rs|main|fs.read|17
web/cart.js|Cart.rounded|round|20
web/cart.js|Cart.total|price|13
web/cart.js|Cart.total|this.rounded|16
web/cart.js|price|round|25
web/cart.js|show|c.total|29
web/cart.js|show|console.log|29
web/cart.js||require|2
"""))
def brace_calls(spark, sf_dir):
    return _brace_facts(spark).where("kind = 'call'").select("path", F.coalesce("owner", F.lit("")).alias("owner"), "name", "line")


@query("brace_call_graph", rows_sql("src_file VARCHAR, src_func VARCHAR, dst_file VARCHAR, dst_func VARCHAR, call_type VARCHAR", """
lib/cart.c|main|lib/cart.c|add|intra
web/cart.js|Cart.total|web/cart.js|Cart.rounded|method
web/cart.js|Cart.total|web/cart.js|price|intra
"""))
def brace_call_graph(spark, sf_dir):
    """Calls that resolve in their own file."""
    return program.call_edges(_brace_facts(spark))


@query("brace_bases", rows_sql("path VARCHAR, owner VARCHAR, name VARCHAR", """
srv/Cart.java|Cart|Base
srv/Cart.java|Cart|Shown
web/cart.js|Cart|Base
"""))
def brace_bases(spark, sf_dir):
    return _brace_facts(spark).where("kind = 'base'").select("path", "owner", "name")


@query("brace_tree", rows_sql("parent VARCHAR, children VARCHAR", """
lib|cart.c
shop|api.py broken.py maths.py models.py store.py views.py
srv|Cart.java cart.go cart.rs
tests|test_api.py
web|cart.js
|lib/ notes.txt shop/ srv/ tests/ web/
"""))
def brace_tree(spark, sf_dir):
    """The folders of both samples."""
    return files.tree(samples.files(spark).unionByName(samples.brace_files(spark)).select("path")).select("parent", F.array_join("children", " ").alias("children"))


@query("brace_languages", rows_sql("language VARCHAR, n BIGINT", """
c|1
go|1
javascript|1
java|1
python|7
rust|1
|1
"""))
def brace_languages(spark, sf_dir):
    return samples.files(spark).unionByName(samples.brace_files(spark)).groupBy(F.coalesce(files.language_of(F.col("path")), F.lit("")).alias("language")).agg(F.count("*").alias("n"))


@query("code_debt", rows_sql("category VARCHAR, rule VARCHAR, issues BIGINT, minutes BIGINT, hours DOUBLE, per_kloc DOUBLE, cost DOUBLE", """
changeability|god_class|3|180|3.0|1565.2174|180.0
changeability|high_coupling|1|20|0.3333|173.913|20.0
changeability|long_param_list|1|15|0.25|130.4348|15.0
maintainability|deep_nesting|6|90|1.5|782.6087|90.0
maintainability|long_method|2|60|1.0|521.7391|60.0
maintainability|missing_docs|30|300|5.0|2608.6957|300.0
"""))
def code_debt(spark, sf_dir):
    """With thresholds as low as the sample is small."""
    return quality.debt(samples.files(spark), _facts(spark), 60.0, coupling=1, method_lines=7, params=2, depth=0, class_methods=2)


@query("code_all_smells", rows_sql("path VARCHAR, name VARCHAR, smell VARCHAR, detail VARCHAR", """
shop/api.py|handle|LongParameterList|
shop/maths.py|area|DeadCode|
shop/maths.py|area|LongMethod|
shop/maths.py|area|LongParameterList|
shop/maths.py|tail|DeadCode|
shop/models.py|Item.__init__|LongParameterList|
shop/store.py|_old|DeadCode|
shop/store.py|_old|LongMethod|
shop/store.py|run|DeadCode|
shop/store.py|save|DeadCode|
shop/store.py|save|LongParameterList|
shop/views.py|Bill.draw|FeatureEnvy|page:4
shop/views.py|Bill.draw|LongParameterList|
shop/views.py|Bill|LazyElement|1/1
shop/views.py|Desk.write|LongParameterList|
shop/views.py|Desk|GodClass|
shop/views.py|Desk|MiddleMan|3/3
shop/views.py|Log.write|LongParameterList|
shop/views.py|Log|GodClass|
shop/views.py|Log|LowCohesion|3
shop/views.py|Page.line|LongParameterList|
shop/views.py|Page|GodClass|
shop/views.py|Page|LowCohesion|3
shop/views.py|Quiet|RefusedBequest|0/3
"""))
def code_all_smells(spark, sf_dir):
    """Every detector, with thresholds as low as the sample is small."""
    return quality.all_smells(samples.files(spark), _facts(spark), _edges(spark), methods=2, loc=7, cc=2, params=1, depth=1)


@query("code_habits", rows_sql("category VARCHAR, signals VARCHAR, files BIGINT, confidence DOUBLE", """
error_handling|raise|1|0.2857
imports|from,plain|4|1.0
naming|snake|6|1.0
resources|close,with|3|0.8571
tests|test|1|0.2857
types|annotated|1|0.2857
validation|assert,guard|2|0.5714
"""))
def code_habits(spark, sf_dir):
    """Which habits the sample has."""
    return quality.habits(samples.files(spark), _facts(spark))


@query("code_plan_chunks", rows_sql("path VARCHAR, part INT, first INT, last INT, size BIGINT", """
shop/api.py|0|1|13|54
shop/broken.py|0|1|1|2
shop/maths.py|0|1|12|41
shop/maths.py|1|13|18|31
shop/models.py|0|1|6|20
shop/models.py|1|7|21|60
shop/models.py|2|22|30|28
shop/models.py|3|31|35|39
shop/store.py|0|1|13|47
shop/store.py|1|14|18|32
shop/store.py|2|19|31|56
shop/store.py|3|32|39|33
shop/views.py|0|1|11|27
shop/views.py|1|12|25|59
shop/views.py|2|26|41|60
shop/views.py|3|42|50|26
tests/test_api.py|0|1|5|23
"""))
def code_plan_chunks(spark, sf_dir):
    """Parts of 60 tokens, cut between definitions."""
    return quality.plan_chunks(samples.files(spark), _facts(spark), 60)


@query("code_prefilter", rows_sql("path VARCHAR, may_hold BOOLEAN", """
shop/api.py|false
shop/broken.py|false
shop/maths.py|true
shop/models.py|false
shop/store.py|true
shop/views.py|true
tests/test_api.py|false
"""))
def code_prefilter(spark, sf_dir):
    """Files that may hold a tainted sink, by text alone."""
    return samples.files(spark).select("path", nav.may_hold(F.col("content"), ("system", "eval", "open")).alias("may_hold"))


@query("tool_diagnostics", rows_sql("tool VARCHAR, file VARCHAR, line_no INT, col INT, severity VARCHAR, message VARCHAR", """
cargo|src/a.rs|3|5|warning|unused
clang|a.c|4|1|error|no file
dotnet|A.cs|3|9|error|CS0103: no x
eslint|a.js|3|5|warning|no-unused
flake8|a.py|2|1|warning|blank
gcc|a.c|3|7|warning|unused x
golangci|a.go|9|2|error|unused (lint)
go|a.go|3|1|error|undefined: x
javac|A.java|7|0|error|no symbol
kotlinc|a.kt|3|5|warning|unused
luacheck|a.lua|3|5|warning|unused
mypy|a.py|3|0|error|bad type
phpstan|a.php|12|0|error|no method
pylint|a.py|1|0|warning|no docstring
pyright|a.py|3|5|note|hint
rubocop|a.rb|1|1|warning|unused
ruff|a.py|1|8|warning|unused
shellcheck|a.sh|3|5|note|quote
swiftc|a.swift|3|5|error|no x
tsc|a.ts|3|9|error|TS2304: no x
"""))
def tool_diagnostics(spark, sf_dir):
    """One line of each tool that is read."""
    return _diagnostics(spark)


@query("ignore_rules", rows_sql("path VARCHAR, ignored BOOLEAN", """
a.log|true
a.py|false
build/a.py|true
docs/a.md|true
keep.log|false
x/b.log|true
x/build/a.py|true
x/docs/a.md|false
"""))
def ignore_rules(spark, sf_dir):
    """What an ignore file leaves out."""
    return _ignored(spark)


@query("name_predicates", rows_sql("candidate VARCHAR, matches BOOLEAN, bot BOOLEAN, label VARCHAR, trend VARCHAR, is_test BOOLEAN", """
a.b.run|true|true|type 1|improving|true
runs|false|false|type 2|stable|true
run|true|false|type 2|stable|false
x::run|true|true|type 3|degrading|true
"""))
def name_predicates(spark, sf_dir):
    """Names that match, bots, labels, trends, tests."""
    return _predicates(spark)
