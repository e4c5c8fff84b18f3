"""Hand-computed cases of the operators."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import graph, mining, program, relations, search
from tessera.sources import reports, sinks
from tessera.streaming import watcher


@pytest.fixture(scope="module")
def ring(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string").cache()


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_ring(ring, sorted_rows):
    d = {r["node"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(ring).collect()}
    assert d == {"a": (1, 1), "b": (1, 1), "c": (1, 2), "d": (1, 0)}
    assert sorted_rows(graph.components_strong(ring)) == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3)]
    assert ("a", "d", 3) in sorted_rows(graph.closure(ring)) and ("a", "a", 3) not in sorted_rows(graph.closure(ring))
    rank = {r["node"]: r["score"] for r in graph.pagerank(ring).collect()}
    assert max(rank.values()) == 1.0 and min(rank, key=rank.get) in "ad"
    between = {r["node"]: r["score"] for r in graph.betweenness(ring).collect()}
    assert between["d"] == 0 and between["c"] == pytest.approx((2 + 1) / 6, abs=0.2)


def strong_by_search(pairs):
    """{node: (least node of its component, size)} of components of two or more, by a search from every node."""
    follow = {}
    for a, b in pairs:
        follow.setdefault(a, set()).add(b)

    def reached(x):
        seen, todo = set(), [x]
        while todo:
            for y in follow.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    to = {x: reached(x) for p in pairs for x in p}
    own = {x: {y for y in to[x] if x in to[y]} | {x} for x in to}
    return {x: (min(c), len(c)) for x, c in own.items() if len(c) > 1}


def test_strong_components_by_brute_force(spark):
    import random

    rng = random.Random(9)
    for n, m in ((12, 16), (40, 55), (30, 20)):
        pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        pairs += [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 103), (7, 7)]
        got = {r["node"]: (r["component"], r["size"]) for r in graph.components_strong(spark.createDataFrame(pairs, "src int, dst int")).collect()}
        assert got == strong_by_search(pairs)


def test_strong_components_of_parts(spark):
    from tessera.plans import graph_queries

    sf = "/root/testdata/sf0.001"
    pairs = [tuple(r) for r in graph_queries.parts(spark, sf).collect()]
    got = {r["node"]: (r["component"], r["size"]) for r in graph_queries.graph_parts_scc(spark, sf).collect()}
    assert got == strong_by_search(pairs)


def test_single_edges(spark):
    e = spark.createDataFrame([("x", "x")], "src string, dst string")
    assert graph.degrees(e).first()["in_score"] == 0.0
    assert graph.betweenness(e).first()["score"] == 0.0
    assert graph.instability(e).first()["instability"] == 0.0
    empty = spark.createDataFrame([], "src string, dst string")
    assert graph.pagerank(empty).count() == 0


def test_percentiles(spark):
    d = spark.createDataFrame([(1,), (2,), (2,), (3,)], "v int")
    assert sorted(r["p_v"] for r in scores.with_percentiles(d, ["v"]).collect()) == [0.0, 0.5, 0.5, 1.0]
    assert scores.with_percentiles(d.limit(1), ["v"]).first()["p_v"] == 1.0


def test_formulas(spark):
    r = one(spark, half=scores.recency_weight(F.lit(10), 10), flat=scores.recency_weight(F.lit(10), 0), mi=scores.maintainability(F.lit(5.0), F.lit(1), F.lit(0)), d=scores.dice(F.lit(1), F.lit(3), F.lit(3)), e=scores.dice(F.lit(0), F.lit(0), F.lit(0)), z=scores.dice(F.lit(0), F.lit(0), F.lit(2)))
    assert r["half"] == pytest.approx(0.5) and r["flat"] == 1.0 and r["mi"] == 100.0
    assert r["d"] == pytest.approx(1 / 3) and r["e"] == 1.0 and r["z"] == 0.0


def test_identifiers(spark):
    words = lambda x: one(spark, w=text.split_identifier(F.lit(x)))["w"]
    assert words("HTTPRequest") == ["http", "request"]
    assert words("IService") == ["iservice"]
    assert words("processUserData_v2") == ["process", "user", "data", "v2"]
    assert one(spark, w=text.code_tokens(F.lit("é the x")))["w"] == ["é"]


def test_cosine_zero(spark):
    r = one(spark, c=search.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))), n=search.l2_normalise(F.array(F.lit(0.0))))
    assert r["c"] == 0.0 and r["n"] == [0.0]


def test_bigrams(spark, sorted_rows):
    s = spark.createDataFrame([("k", i, x) for i, x in enumerate("ABBAB")], "k string, i int, x string")
    assert sorted_rows(mining.bigrams(s, "k", ["i"], "x")) == [("A", "B", 2, 1.0), ("B", "A", 1, 1.0)]


def part_score(a, b):
    near = lambda x, y: 1 - abs(x - y) / max(x, y)
    return 0.3 * near(a[3], b[3]) + 0.2 * (a[2] == b[2]) + 0.3 * (a[1] == b[1]) + 0.2 * near(a[4], b[4])


def test_similar_parts_by_brute_force(spark):
    from tessera.plans import registry

    cols = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]
    parts = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(*cols).collect()]
    want = {(a[0], b[0]): round(s, 6) for a in parts for b in parts if a[0] < b[0] and (s := part_score(a, b)) >= 0.7}
    got = {(r["a"], r["b"]): r["score"] for r in registry.QUERIES["pairwise_similarity_all"](spark, "/root/testdata/sf0.001").collect()}
    assert len(want) == 297 and set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_similar_parts_at_the_edges(spark):
    from tessera.plans.relation_queries import similar_parts

    # another brand with all else equal; sizes of a ratio of 2/3; another type; null brands
    rows = [(1, "x", "t", 6, 10.0), (2, "y", "t", 6, 10.0), (3, "x", "u", 4, 10.0), (4, "x", "u", 9, 10.0), (5, "y", "t", 6, 10.5), (6, None, "t", 6, 10.0), (7, "x", None, 6, 10.0)]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and part_score(a, b[:1] + ("?" if a[1] is None else b[1],) + b[2:]) >= 0.7)
    d = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double")
    assert sorted((r["a"], r["b"]) for r in similar_parts(d).collect()) == want
    assert (1, 2) in want and (1, 3) in want and (1, 4) in want and (1, 6) in want and (2, 5) in want


def test_type3_clones_by_brute_force(spark):
    import re
    from collections import Counter

    from tessera.plans import registry

    sf = "/root/testdata/sf0.001"
    bags = {r[0]: Counter(re.findall("[a-z0-9]+", (r[1] or "").lower())) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    size = {k: sum(b.values()) for k, b in bags.items()}
    dice = {(a, b): 2.0 * sum((bags[a] & bags[b]).values()) / (size[a] + size[b]) for a in bags for b in bags if a < b and size[a] + size[b]}
    first = {b: min(a for a in bags if bags[a] == bags[b]) for b in bags}
    want = {k: round(v, 6) for k, v in dice.items() if v >= 0.7}
    assert len(want) == 27
    # of equal bags one is linked to others, and the rest to that one
    want = {(a, b): v for (a, b), v in want.items() if first[b] == a or (first[a], first[b]) == (a, b)}
    got = {(r["a"], r["b"]): r["dice"] for r in registry.QUERIES["clones_type3_all"](spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_near_clones(spark, sorted_rows):
    d = spark.createDataFrame([(1, ["x", "x", "y"]), (2, ["x", "z", "z"]), (3, ["x", "x", "y"]), (4, [])], "id int, tokens array<string>")
    assert sorted_rows(relations.near_clones(d, 0.3)) == [(1, 2, pytest.approx(1 / 3)), (1, 3, 1.0)]


def test_watcher_windows():
    b, _ = watcher.fold([0.0, 1.0, 6.0, 7.0], list("abcd"), 5.0, 200, 2.0, 1000)
    assert [(o, k) for o, _, k, _ in b] == [(0.0, ["a", "b"]), (6.0, ["c", "d"])]
    b, _ = watcher.fold([0.0, 0.1, 0.2], list("abc"), 5.0, 2, 2.0, 1000)
    assert b == [(0.0, 3, ["a", "b", "c"], True)]


def test_watcher_stream_is_the_batch(spark, tmp_path, sorted_rows):
    data = [("s", float(t), k) for t, k in zip([0, 1, 6, 7, 20], "abcda", strict=True)]
    d = spark.createDataFrame(data, "scope string, t double, key string")
    d.where("t < 6").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    # a state with a timer asks for a batch without data again and again, so that "all available" never comes
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    s = watcher.batch_stream(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in/*"), flush_after_ms=600_000)
    q = s.writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        d.where("t >= 6").coalesce(1).write.parquet(f"{tmp_path}/in/2")
        q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    whole = sorted_rows(watcher.batches(d))
    assert sorted_rows(spark.table("watched")) == [r for r in whole if r[1] < 20]


def test_lcov(spark, sorted_rows):
    t = "SF:a\nDA:1,1\nDA:2,0\nLF:2\nLH:1\nend_of_record\n"
    d = reports.lcov(spark.createDataFrame([(t,)], "content string"))
    assert sorted_rows(reports.coverage_totals(d)) == [("a", 2, 1, 50.0)]
    x = '<coverage><class filename="b"><lines><line number="3" hits="4"/></lines></class></coverage>'
    assert sorted_rows(reports.cobertura(spark.createDataFrame([(x,)], "content string"))) == [("b", 3, 4)]
    j = '{"files": {"c": {"executed_lines": [1], "missing_lines": [2]}}}'
    assert sorted_rows(reports.coverage_py(spark.createDataFrame([(j,)], "content string"))) == [("c", 1, 1), ("c", 2, 0)]
    kinds = [one(spark, k=reports.coverage_format(F.lit(v)))["k"] for v in (t, x, j, "")]
    assert kinds == ["lcov", "cobertura", "coverage.py", "unknown"]


def test_git_log(spark, sorted_rows):
    ls = ["\x1ec1\x1fann\x1f2024-01-02T00:00:00", "3\t1\tx.py", "-\t-\ty.bin", "\x1ec2\x1fbob\x1f2024-01-03", "5\t0\tx.py"]
    log = spark.createDataFrame([("l", i, x) for i, x in enumerate(ls)], "log_id string, line_no int, line string")
    got = [(r["commit"], r["file"], r["added"], r["deleted"]) for r in reports.git_numstat(log).collect()]
    assert sorted(got) == [("c1", "x.py", 3, 1), ("c1", "y.bin", 0, 0), ("c2", "x.py", 5, 0)]


def test_error_texts(spark):
    t = 'Traceback (most recent call last):\n  File "m.py", line 3, in f\n    x\nNameError: name \'x\' is not defined'
    e = one(spark, e=reports.parsed_error(F.lit(t)))["e"]
    assert (e["language"], e["type"], e["file"], e["line"]) == ("python", "NameError", "m.py", 3)
    e = one(spark, e=reports.parsed_error(F.lit("error[E0425]: no x\n  --> src/a.rs:9:5")))["e"]
    assert (e["language"], e["type"], e["file"], e["line"]) == ("rust", "E0425", "src/a.rs", 9)


def test_generations(spark, tmp_path):
    g = sinks.Generations(spark, str(tmp_path))
    assert g.publish("t", spark.range(3)) == 1 and g.publish("t", spark.range(5)) == 2
    assert g.load("t").count() == 5
    g.rollback("t", 1)
    assert g.load("t").count() == 3
    with pytest.raises(LookupError):
        g.load("none")


CODE = """
import os
from m import helper

class A:
    def go(self, x):
        return self.stop(x)

    def stop(self, x):
        return helper(x)

def f(a):
    y = 1
    if a:
        y = 2
        z = y
    return y
    w = 1

def g():
    cmd = input()
    os.system(cmd)
    os.system(int(cmd))
"""


def test_program(spark):
    files = spark.createDataFrame([("p.py", CODE), ("m.py", "def helper(x):\n    return x\n"), ("bad.py", "def :"), ("none.py", None)], "path string, content string")
    f = program.facts(files)
    assert f.where("kind = 'error'").count() == 1
    calls = {(r["src_func"], r["dst_file"], r["dst_func"], r["call_type"]) for r in program.call_edges(f).collect()}
    assert ("A.go", "p.py", "A.stop", "method") in calls and ("A.stop", "m.py", "helper", "direct") in calls
    found = {(r["func"], r["kind"], r["name"]) for r in program.flows(files).collect()}
    assert ("f", "dead_store", "z") in found and ("f", "phi", "y") in found and ("f", "unreachable", "Assign") in found
    taint = [(r["name"], r["line"], r["other"]) for r in program.flows(files).where("kind = 'taint'").collect()]
    assert taint == [("ShellExec:cmd", 21, 22)]


def test_slices_go_both_ways_and_leave_out_what_is_outside(spark, sorted_rows):
    code = "def f(a, b):\n    x = a + 1\n    y = b + 1\n    if x > 2:\n        z = x\n    w = y\n    return w\n"
    flows = program.flows(spark.createDataFrame([("p.py", code)], "path string, content string"))
    starts = spark.createDataFrame([("p.py", "f", n, d) for n, d in ((2, "forward"), (7, "backward"), (5, "backward"), (99, "forward"))], "path string, func string, start int, direction string")
    lines = lambda **how: {(s, d): {r[4] for r in got if (r[2], r[3]) == (s, d)} for got in [sorted_rows(program.slices(flows, starts, **how))] for _, _, s, d, _ in got}
    every, of_x = lines(), lines(variable="x")
    assert every[2, "forward"] == {2, 4, 5} and every[7, "backward"] - {1} == {3, 6, 7} and every[5, "backward"] - {1} == {2, 4, 5}
    assert of_x[2, "forward"] == {2, 4, 5} and of_x[7, "backward"] - {1} == {7} and (99, "forward") not in every


def test_complexity():
    import ast

    fn = ast.parse("def f(a, b):\n    if a and b:\n        for x in a:\n            pass\n    return 1").body[0]
    assert program.cyclomatic(fn) == 4 and program.nesting(fn) == 2 and program.cognitive(fn) == 1 + 1 + 2
