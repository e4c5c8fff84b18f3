"""Queries whose work must not grow with the square of a group: same results, and candidates that stay few."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import relations


def links_by_search(bags, threshold):
    first = {}
    for k in sorted(bags):
        first.setdefault(tuple(sorted(bags[k])), k)
    out = {(first[tuple(sorted(b))], k): 1.0 for k, b in bags.items() if b and first[tuple(sorted(b))] != k}
    one = {k: Counter(b) for b, k in first.items() if b}
    for a in one:
        for b in one:
            d = 2.0 * sum((one[a] & one[b]).values()) / (sum(one[a].values()) + sum(one[b].values()))
            if a < b and d >= threshold:
                out[a, b] = d
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.95])
def test_clones_in_many_blocks(spark, monkeypatch, threshold):
    """Bags of few words, of which most pairs share some, over blocks that a single size overflows."""
    rng = random.Random(4)
    bags = {i: [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.choice((1, 2, 7, 20, 20, 20, 21, 40)))] for i in range(160)}
    for i in range(160, 240):
        near = list(bags[i - 160])
        near[rng.randrange(len(near))] = "w0"
        bags[i] = near
    bags[240] = []
    monkeypatch.setattr(relations, "BLOCK_TOKENS", 200)
    blocks = relations._blocks(sorted(Counter(len(b) for b in bags.values() if b).items()))
    assert len(blocks) > 8 and any(parts > 1 for *_, parts in blocks)
    got = relations.near_clones(spark.createDataFrame(list(bags.items()), "id int, tokens array<string>"), threshold).collect()
    want = links_by_search(bags, threshold)
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
    assert all(r["dice"] == pytest.approx(want[r["a"], r["b"]]) for r in got)


def test_blocks_of_clones_add_no_shuffle(spark, monkeypatch):
    """Bags are not dealt out once for each block near them in size."""
    rng = random.Random(5)
    bags = spark.createDataFrame([(i, [f"w{rng.randrange(4000)}" for _ in range(40 + i % 3)]) for i in range(120)], "id int, tokens array<string>")
    context = spark.sparkContext._jsc.sc()

    def shuffled(tokens):
        monkeypatch.setattr(relations, "BLOCK_TOKENS", tokens)
        written = []
        for run in (lambda: None, lambda: relations.near_clones(bags, 0.7).count()):
            run()
            context.listenerBus().waitUntilEmpty(30_000)
            written.append(context.statusStore().executorList(False).apply(0).totalShuffleWrite())
        return written[1] - written[0]

    assert shuffled(600) < 1.2 * shuffled(10_000)


def test_clones_of_nothing(spark):
    assert relations.near_clones(spark.createDataFrame([(1, [])], "id string, tokens array<string>"), 0.7).count() == 0
    assert [tuple(r) for r in relations.near_clones(spark.createDataFrame([("x", ["q"]), ("y", ["q"])], "id string, tokens array<string>"), 0.7).collect()] == [("x", "y", 1.0)]


@pytest.fixture
def spied(monkeypatch):
    """How many rows each named table of intermediate results had."""
    from tessera.operators import diffs
    from tessera.plans import relation_queries

    seen = {}

    def spy(module):
        real = module.staged

        def put(df, name):
            out = real(df, name)
            seen[name] = seen.get(name, 0) + out.count()
            return out

        monkeypatch.setattr(module, "staged", put)

    for m in (diffs, relation_queries):
        spy(m)
    return seen


def test_renames_of_equal_bodies(spark, spied):
    """Of many definitions with one body, only the first on either side can be best partners; candidates are bodies."""
    from tessera.operators import diffs

    old = [("f", f"a{i:02}", 1, "return the total") for i in range(40)] + [("f", "z", 1, "x = 1\ny = 2\nz = 3\nw = 4"), ("g", "p", 1, "return the total"), ("f", "n", 1, None), ("f", "s", 1, "return the totals")]
    new = [("f", f"b{i:02}", 1, "return the total") for i in range(50)] + [("f", "q", 1, "x = 1\ny = 2\nz = 3\nw = 4\nv = 5"), ("h", "p", 1, "return the total"), ("f", "m", 1, None)]
    make = lambda rows: spark.createDataFrame(rows, "kind string, name string, line int, body string")
    got = [tuple(r) for r in diffs.structural(make(old), make(new)).collect()]
    assert sorted(r[1:3] for r in got if r[3] == "rename") == [("a00", "b00"), ("z", "q")]
    assert Counter(r[3] for r in got) == {"rename": 2, "delete": 42, "insert": 51}
    assert spied["diff-bodies"] == 5 + 4 and spied["diff-alike"] == 3


def parts_at(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_copies_of_parts(spark, tmp_path, spied):
    """All pairs where SQL asks for them, though only classes are compared; else copies are linked to their first."""
    import duckdb

    from tessera.plans import registry

    rows = [(i, "x", "t", 10, 900.0) for i in range(30)] + [(i, "x", "t", 11, 900.0) for i in range(30, 40)] + [(40, "x", "t", None, 900.0), (41, None, "t", 10, 900.0), (42, None, "t", 10, 900.0), (43, None, None, 10, 900.0), (44, "x", None, 10, 900.0), (45, "x", None, 10, 900.0)]
    sf = parts_at(spark, tmp_path, rows)
    duck = duckdb.connect()
    duck.execute(f"create view part as from '{sf}/part.parquet/*.parquet'")
    want = sorted(duck.execute(registry.ORACLES["pairwise_similarity"]).fetchall())
    got = sorted(tuple(r) for r in registry.QUERIES["pairwise_similarity"](spark, sf).collect())
    assert len(want) == 40 * 39 // 2 and [r[:2] for r in got] == [r[:2] for r in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))
    assert spied["part-links"] == 3
    got = {(r["a"], r["b"]): r["score"] for r in registry.QUERIES["pairwise_similarity_all"](spark, sf).collect()}
    between = {(0, 30): 0.972727, (0, 41): 0.7, (0, 44): 0.8, (30, 44): 0.772727}
    own = {(0, i): 1.0 for i in range(1, 30)} | {(30, i): 1.0 for i in range(31, 40)} | {(41, 42): 0.7, (44, 45): 0.8}
    assert got == pytest.approx(between | own)


def test_bursts_as_in_sql(spark, tmp_path):
    """Ties, times at the edges of slices, and events without a time, of which forty-one count each other."""
    import datetime as dt

    import duckdb

    from tessera.plans import registry

    rng, zero = random.Random(2), dt.datetime(2024, 1, 1)
    at = [dt.timedelta(minutes=15 * rng.randrange(40), microseconds=rng.choice((-1, 0, 0, 1, rng.randrange(10**9)))) for _ in range(600)]
    rows = [(i, zero + x) for i, x in enumerate(at)] + [(1000 + i, zero - dt.timedelta(days=20000)) for i in range(41)] + [(2000 + i, None) for i in range(41)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duck.execute(registry.ORACLES["rolling_burst"]).fetchall())
    got = sorted(tuple(r) for r in registry.QUERIES["rolling_burst"](spark, str(tmp_path)).collect())
    assert len(want) > 300 and want[-1] == (2040, 41) and got == want


def test_single_questions_build_no_index(spark, tmp_path):
    """A pass over the texts gives what an index would; an index that is there is used."""
    from tessera.operators import search
    from tessera.plans import registry

    texts = ["the la the und", "and", None, "", "x the_and la la tion tion tion", "the end and the tion", "words without any", "the la the und", "tion", "z9 z9 z9 a"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, "the la"), (50, "and the und tion")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    source, sf = f"{tmp_path}/documents.parquet", str(tmp_path)
    of = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, sf).collect()]
    names = ["bm25_topk", "bm25_and_regex", "identifier_counts", "refcount_rescue", "bm25_statistics"]
    before = len(search._BUILT)
    alone = {n: of(n) for n in names}
    assert len(search._BUILT) == before and not search.Index.built(spark, source)
    assert alone["bm25_topk"] and dict(alone["identifier_counts"])["tion"] == 6 and ("z9", 3) in alone["refcount_rescue"]
    at = search.Index.of(spark, source)
    assert search.Index.built(spark, source)
    assert {n: sorted(of(n)) for n in names} == {n: sorted(x) for n, x in alone.items()}
    counts = Counter()
    for _, t in rows:
        counts.update(w for w in (t or "").split() if len(w) > 1)
    assert {r["term"]: r["n"] for r in at.postings.groupBy("term").agg(F.sum("tf").alias("n")).collect()} == counts
    assert {tuple(r) for r in at.postings.where("term = 'tion'").select("doc_id", "tf", "len").collect()} == {(4, 3, 6), (5, 1, 5), (8, 1, 1), (50, 1, 4)}


@pytest.fixture
def shuffled(spark):
    """Bytes that a call shuffles, where no join is small enough to be broadcast."""
    context = spark.sparkContext._jsc.sc()
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")

    def measure(call):
        written = []
        for run in (lambda: None, lambda: call().count()):
            run()
            context.listenerBus().waitUntilEmpty(30_000)
            written.append(context.statusStore().executorList(False).apply(0).totalShuffleWrite())
        return written[1] - written[0]

    yield measure
    for k in keys:
        spark.conf.unset(k)


def dense(spark, n=300, edges=60_000):
    rng = random.Random(6)
    return spark.createDataFrame(sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(edges)}), "src long, dst long")


def test_rounds_of_ranks_leave_edges_where_they_are(spark, shuffled):
    from tessera.operators import graph

    e = dense(spark)
    once = shuffled(lambda: e.repartition(8, "dst"))
    few, more = (shuffled(lambda: graph.pagerank(e, rounds=n, epsilon=0)) for n in (1, 5))
    assert more - few < 2 * once


def test_links_of_methods_are_taken_once(spark, shuffled):
    """Rounds go over links between methods, not over members; fields and methods may be null."""
    from tessera.operators import graph

    rng = random.Random(7)
    rows = [(i % 5, i % 5 + 5 * (f % 40), f) for f, i in ((rng.randrange(8000), rng.randrange(100)) for _ in range(30_000))]
    rows += [(0, 9_000, None), (0, 9_001, None), (0, 9_000, 77_777), (0, None, 77_778), (1, 9_000, 77_777), (9, 1, None)]
    m = spark.createDataFrame(rows, "cls long, method long, field long")
    once = shuffled(lambda: m.repartition(8, "field"))
    assert shuffled(lambda: graph.lcom4(m)) < 3 * once
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for c, x, f in rows:
        if x is not None:
            up[top((c, x))] = top((c, "f", f)) if f is not None else top((c, x))
    want = {c: len({top((c, x)) for k, x, _ in rows if k == c and x is not None}) for c in {r[0] for r in rows}}
    assert {r["cls"]: r["lcom4"] for r in graph.lcom4(m).collect()} == want


def test_rounds_of_components_leave_edges_where_they_are(spark, shuffled):
    from tessera.operators import graph

    e = dense(spark)
    once = shuffled(lambda: e.repartition(8, "dst"))
    assert shuffled(lambda: graph.components_strong(e)) < 4 * once


def strong_by_kosaraju(pairs):
    """{node: (least node of its component, size)} of components of two or more."""
    out, into = {}, {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    order, seen = [], set()
    for x in out:
        todo = [] if x in seen else [(x, iter(out[x]))]
        seen.add(x)
        while todo:
            y, rest = todo[-1]
            if (z := next((z for z in rest if z not in seen), None)) is None:
                order.append(todo.pop()[0])
            else:
                seen.add(z)
                todo.append((z, iter(out.get(z, ()))))
    done, found = set(), {}
    for x in reversed(order):
        own, todo = [], [] if x in done else [x]
        done.add(x)
        while todo:
            own.append(todo.pop())
            for z in into.get(own[-1], ()):
                if z not in done:
                    done.add(z)
                    todo.append(z)
        if len(own) > 1:
            found |= {y: (min(own), len(own)) for y in own}
    return found


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_in_a_chain(spark, monkeypatch, kind):
    """Components that follow each other are told apart in few turns, however they are named; a path of single nodes between blocks drops off."""
    from tessera.operators import graph

    built = []
    real = graph.Blocks.__init__
    monkeypatch.setattr(graph.Blocks, "__init__", lambda self, edges: (built.append(1), real(self, edges))[1])
    rng = random.Random(8)
    pairs = [p for i in range(0, 200, 2) for p in ((i, i + 1), (i + 1, i), (i + 1, i + 2))] + [(i, i + 1) for i in range(300, 330)] + [(329, 0), (5, 5), (0, 1), (0, 1)]
    pairs += [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(480)] + [(-(2**63), 2**63 - 1), (2**63 - 1, -(2**63)), (-7, 2**63 - 1)]
    if kind == "string":
        pairs = [(f"n{a}", f"n{b}") for a, b in pairs]
    e = spark.createDataFrame([*pairs, (None, pairs[0][0]), (pairs[0][0], None), (None, None)], f"src {kind}, dst {kind}")
    got = graph.components_strong(e)
    want = strong_by_kosaraju([p for p in pairs if p[0] != p[1]])
    assert len(want) > 200 and sorted((r["node"], r["component"], r["size"]) for r in got.collect()) == sorted((x, *y) for x, y in want.items())
    assert len(built) <= 12


def test_components_of_narrow_and_of_no_nodes(spark):
    from tessera.operators import graph

    for kind in ("byte", "double"):
        e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 4)], "src int, dst int").select(*[F.col(c).cast(kind) for c in ("src", "dst")])
        got = graph.components_strong(e)
        assert got.schema["node"].dataType == e.schema["src"].dataType == got.schema["component"].dataType
        assert sorted(map(tuple, got.select(F.col("node").cast("double"), F.col("component").cast("double"), "size").collect())) == [(1, 1, 2), (2, 1, 2)]
        assert graph.components_strong(e.where("src >= 2")).count() == graph.components_strong(e.limit(0)).count() == 0
