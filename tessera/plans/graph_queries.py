"""Graph queries over the nations that trade, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators import graph
from tessera.plans.registry import query
from tessera.session import staged, table

TRADE_SQL = """trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_suppkey, l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
#: Of each nation, the nations that it buys more from than from the average one.
G_SQL = f"{TRADE_SQL}, cnt AS (SELECT src, dst, count(*) AS k FROM trade GROUP BY ALL), usual AS (SELECT src, avg(k) AS a FROM cnt GROUP BY src), g AS (SELECT src, dst FROM cnt JOIN usual USING (src) WHERE k > a)"
NODES_SQL = "nodes AS (SELECT src AS node FROM g UNION SELECT dst FROM g)"
RANK_ROUNDS = 12
#: Parts that follow each other in an order: a graph of as many nodes as there are parts.
PARTS_SQL = "g AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"


def trade(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    j = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), "l_suppkey", "l_orderkey")


def g(spark, sf_dir) -> DataFrame:
    """Of each nation, the nations that it buys more from than from the average one."""
    n = trade(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("k"))
    usual = F.avg("k").over(Window.partitionBy("src"))
    return staged(n.withColumn("a", usual).where("k > a").select("src", "dst"), "trade")


def followers(spark, sf_dir) -> DataFrame:
    """Parts that follow each other in an order, as often as they do."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return p.where("dst is not null and src <> dst")


def parts(spark, sf_dir) -> DataFrame:
    """Parts that follow each other in an order."""
    return staged(followers(spark, sf_dir).distinct(), "parts")


DEG_SQL = f"""{G_SQL}, {NODES_SQL}, n AS (SELECT count(*) AS n FROM nodes),
 deg AS (SELECT node, (SELECT count(*) FROM g WHERE dst = node) AS in_degree, (SELECT count(*) FROM g WHERE src = node) AS out_degree FROM nodes)"""


@query("graph_adjacency", f"""WITH {G_SQL}, {NODES_SQL}
SELECT node, coalesce((SELECT string_agg(dst::VARCHAR, ',' ORDER BY dst) FROM g WHERE src = node), '') AS callees,
 coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src) FROM g WHERE dst = node), '') AS callers FROM nodes""")
def graph_adjacency(spark, sf_dir):
    return graph.adjacency(g(spark, sf_dir))


@query("graph_degrees", f"""WITH {DEG_SQL} SELECT node, in_degree, out_degree, round(in_degree / (n - 1), 6) AS in_score, round(out_degree / (n - 1), 6) AS out_score FROM deg, n""")
def graph_degrees(spark, sf_dir):
    return graph.degrees(g(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("in_score", "out_score")})


def rank_sql(rounds: int, graph_sql: str = G_SQL) -> str:
    out = [f"{DEG_SQL.replace(G_SQL, graph_sql)}, p0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM nodes, n)"]
    for i in range(1, rounds + 1):
        out.append(f"""p{i} AS MATERIALIZED (SELECT node, 0.15 / n + 0.85 * (coalesce((SELECT sum(q.r / d.out_degree) FROM g JOIN p{i - 1} q ON q.node = g.src JOIN deg d ON d.node = g.src WHERE g.dst = nodes.node), 0)
 + coalesce((SELECT sum(q.r) FROM p{i - 1} q JOIN deg d USING (node) WHERE d.out_degree = 0), 0) / n) AS r FROM nodes, n)""")
    return ", ".join(out) + f", pr AS (SELECT node, r / max(r) OVER () AS score FROM p{rounds})"


@query("graph_pagerank", f"WITH {rank_sql(RANK_ROUNDS)} SELECT node, round(score, 6) AS score FROM pr")
def graph_pagerank(spark, sf_dir):
    return graph.pagerank(g(spark, sf_dir), rounds=RANK_ROUNDS, epsilon=0).withColumn("score", F.round("score", 6))


BETWEEN_SQL = """walk(s, v, d) AS (SELECT node, node, 0 FROM nodes UNION SELECT s, dst, d + 1 FROM walk JOIN g ON v = src WHERE d < 25),
 dist AS (SELECT s, v, min(d) AS d FROM walk GROUP BY ALL),
 path(s, v, d) AS (SELECT node, node, 0 FROM nodes UNION ALL SELECT p.s, g.dst, p.d + 1 FROM path p JOIN g ON p.v = g.src JOIN dist t ON t.s = p.s AND t.v = g.dst AND t.d = p.d + 1),
 sig AS (SELECT s, v, d, count(*)::DOUBLE AS k FROM path GROUP BY ALL),
 part AS (SELECT a.v AS node, sum(a.k * b.k / c.k) AS x FROM sig a JOIN sig b ON a.v = b.s JOIN sig c ON c.s = a.s AND c.v = b.v AND c.d = a.d + b.d
  WHERE a.s <> a.v AND b.v <> a.v AND a.s <> b.v GROUP BY 1),
 bt AS (SELECT node, coalesce(x, 0) / ((n - 1) * (n - 2)) AS score FROM nodes LEFT JOIN part USING (node), n)"""


@query("graph_betweenness", f"WITH RECURSIVE {DEG_SQL}, {BETWEEN_SQL} SELECT node, round(score, 6) AS score FROM bt")
def graph_betweenness(spark, sf_dir):
    return graph.betweenness(g(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("graph_hubs", f"""WITH RECURSIVE {rank_sql(RANK_ROUNDS)}, {BETWEEN_SQL},
 h AS (SELECT node, 0.25 * in_degree / (n - 1) + 0.25 * out_degree / (n - 1) + 0.3 * pr.score + 0.2 * bt.score AS c FROM deg JOIN pr USING (node) JOIN bt USING (node), n)
SELECT node, round(c, 6) AS composite, CASE WHEN c >= 0.8 THEN 'critical' WHEN c >= 0.6 THEN 'high' WHEN c >= 0.4 THEN 'medium' ELSE 'low' END AS risk FROM h ORDER BY c DESC, node LIMIT 10""")
def graph_hubs(spark, sf_dir):
    """The ten nodes of highest composite score."""
    h = graph.hubs(g(spark, sf_dir), rounds=RANK_ROUNDS, epsilon=0)
    return h.orderBy(F.desc("composite"), "node").limit(10).select("node", F.round("composite", 6).alias("composite"), "risk")


@query("graph_impact", f"""WITH RECURSIVE {G_SQL}, w(node, depth) AS (SELECT 7, 0 UNION SELECT src, depth + 1 FROM w JOIN g ON dst = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM w WHERE node <> 7 GROUP BY node""")
def graph_impact(spark, sf_dir):
    """Who reaches node 7 within 3 steps."""
    start = spark.createDataFrame([(7,)], "start int")
    return graph.reach(g(spark, sf_dir), start, 3, reverse=True).select("node", "depth")


CLOSURE_SQL = f"{G_SQL}, {NODES_SQL}, w(start, node, depth) AS (SELECT node, node, 0 FROM nodes UNION SELECT start, dst, depth + 1 FROM w JOIN g ON src = w.node WHERE depth < 25), c AS (SELECT start, node, min(depth) AS depth FROM w WHERE start <> node GROUP BY ALL)"


@query("graph_closure", f"WITH RECURSIVE {CLOSURE_SQL} SELECT * FROM c")
def graph_closure(spark, sf_dir):
    return graph.closure(g(spark, sf_dir))


@query("graph_two_cycles", f"WITH {G_SQL} SELECT x.src AS a, x.dst AS b FROM g x JOIN g y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def graph_two_cycles(spark, sf_dir):
    return graph.two_cycles(g(spark, sf_dir))


@query("graph_scc", f"WITH RECURSIVE {CLOSURE_SQL} SELECT x.start AS node, least(x.start, min(x.node)) AS component, count(*) + 1 AS size FROM c x JOIN c y ON x.start = y.node AND x.node = y.start GROUP BY x.start")
def graph_scc(spark, sf_dir):
    return graph.components_strong(g(spark, sf_dir))


@query("graph_collapse", f"WITH {G_SQL} SELECT DISTINCT a.n_regionkey AS src, b.n_regionkey AS dst FROM g JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey")
def graph_collapse(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("grp"))
    return graph.collapse(g(spark, sf_dir), groups)


@query("graph_layers", f"WITH {DEG_SQL} SELECT node, in_degree AS calls_in, out_degree AS calls_out, CASE WHEN in_degree = 0 OR out_degree / in_degree >= 2 THEN 'entry' WHEN out_degree / in_degree <= 0.5 THEN 'utility' ELSE 'service' END AS layer FROM deg")
def graph_layers(spark, sf_dir):
    return graph.layers(g(spark, sf_dir))


INST_SQL = "inst AS (SELECT node, (SELECT count(*) FROM g WHERE dst = node AND src <> dst) AS ca, (SELECT count(*) FROM g WHERE src = node AND src <> dst) AS ce FROM nodes)"


@query("graph_instability", f"WITH {G_SQL}, {NODES_SQL}, {INST_SQL} SELECT node, ca, ce, round(CASE WHEN ca + ce = 0 THEN 0.0 ELSE ce / (ca + ce) END, 6) AS instability FROM inst ORDER BY 4 DESC, ce DESC, node")
def graph_instability(spark, sf_dir):
    return graph.instability(g(spark, sf_dir)).withColumn("instability", F.round("instability", 6))


@query("graph_martin", f"""WITH {G_SQL}, nodes AS (SELECT n_nationkey AS node FROM nation), {INST_SQL},
 ab AS (SELECT c_nationkey AS node, avg((c_mktsegment = 'BUILDING')::INT) AS a FROM customer GROUP BY 1),
 m AS (SELECT node, ca, ce, CASE WHEN ca + ce > 0 THEN ce / (ca + ce) END AS i, a FROM inst JOIN ab USING (node)), d AS (SELECT *, abs(a + i - 1) AS d FROM m)
SELECT node, ca, ce, round(i, 6) AS instability, round(a, 6) AS abstractness, round(d, 6) AS distance,
 CASE WHEN i IS NULL THEN 'isolated' WHEN i < 0.3 AND a < 0.3 AND d > 0.5 THEN 'pain' WHEN i > 0.7 AND a > 0.7 THEN 'uselessness' WHEN d <= 0.2 THEN 'healthy' WHEN d <= 0.5 THEN 'warning' ELSE 'far' END AS zone,
 CASE WHEN d <= 0.2 THEN 'good' WHEN d <= 0.4 THEN 'fair' WHEN d IS NOT NULL THEN 'poor' END AS health FROM d""")
def graph_martin(spark, sf_dir):
    share = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.avg((F.col("c_mktsegment") == "BUILDING").cast("int")).alias("abstractness"))
    m = graph.martin(g(spark, sf_dir), share)
    return m.select("node", "ca", "ce", *[F.round(c, 6).alias(c) for c in ("instability", "abstractness", "distance")], "zone", "health")


@query("graph_coupling", f"""WITH {TRADE_SQL}, f AS (SELECT s_nationkey AS node, count(*) AS funcs FROM supplier GROUP BY 1),
 p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum((src < dst)::INT) AS a_to_b, sum((src > dst)::INT) AS b_to_a FROM trade WHERE src <> dst GROUP BY ALL)
SELECT a, b, a_to_b::BIGINT AS a_to_b, b_to_a::BIGINT AS b_to_a, round(least(1.0, (a_to_b + b_to_a) / (2.0 * (x.funcs + y.funcs))), 6) AS score FROM p JOIN f x ON a = x.node JOIN f y ON b = y.node ORDER BY 5 DESC, a, b LIMIT 20""")
def graph_coupling(spark, sf_dir):
    """The 20 most coupled pairs."""
    calls = trade(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))
    sizes = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.count("*").alias("funcs"))
    return graph.coupling(calls, sizes).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "a", "b").limit(20)


@query("graph_dependency_roles", f"WITH {DEG_SQL} SELECT node, CASE WHEN in_degree = 0 THEN 'root' WHEN out_degree = 0 THEN 'leaf' ELSE 'inner' END AS role FROM deg")
def graph_dependency_roles(spark, sf_dir):
    return graph.dependency_roles(g(spark, sf_dir))


@query("graph_diamonds", f"""WITH RECURSIVE {G_SQL}, h AS (SELECT * FROM g WHERE src < dst), w(start, node) AS (SELECT src, dst FROM h UNION SELECT start, dst FROM w JOIN h ON src = node),
 via AS (SELECT h.src, h.dst, w.node AS ancestor FROM h JOIN w ON w.start = h.dst UNION SELECT src, dst, dst FROM h)
SELECT src AS node, ancestor, count(DISTINCT dst) AS n_paths FROM via WHERE src <> ancestor GROUP BY ALL HAVING count(DISTINCT dst) >= 2""")
def graph_diamonds(spark, sf_dir):
    return graph.diamonds(g(spark, sf_dir).where("src < dst"))


@query("graph_lcom4", f"""WITH RECURSIVE {TRADE_SQL}, m AS (SELECT DISTINCT dst AS cls, l_suppkey AS method, l_orderkey AS field FROM trade),
 e AS (SELECT DISTINCT a.cls, a.method AS x, b.method AS y FROM m a JOIN m b ON a.cls = b.cls AND a.field = b.field),
 r(cls, x, y) AS (SELECT cls, x, y FROM e UNION SELECT r.cls, r.x, e.y FROM r JOIN e ON e.cls = r.cls AND e.x = r.y)
SELECT cls, count(DISTINCT lo) AS lcom4 FROM (SELECT cls, x, min(y) AS lo FROM r GROUP BY ALL) GROUP BY cls""")
def graph_lcom4(spark, sf_dir):
    """Classes are supplier nations, methods suppliers, fields the orders that they serve."""
    return graph.lcom4(trade(spark, sf_dir).select(F.col("dst").alias("cls"), F.col("l_suppkey").alias("method"), F.col("l_orderkey").alias("field")))


@query("graph_edge_diff", f"""WITH {G_SQL} SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, CASE WHEN a.src IS NULL THEN 'right' WHEN b.src IS NULL THEN 'left' ELSE 'both' END AS side FROM g a FULL JOIN g b ON a.src = b.dst AND a.dst = b.src""")
def graph_edge_diff(spark, sf_dir):
    """The graph compared with its reverse."""
    e = g(spark, sf_dir)
    return graph.edge_diff(e, e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("edge_precision_recall", """WITH p AS (SELECT quality = 1 AS truth, n_chars >= 500 AS guess FROM labels JOIN documents USING (doc_id)),
 c AS (SELECT sum((truth AND guess)::INT) AS tp, sum((guess AND NOT truth)::INT) AS fp, sum((truth AND NOT guess)::INT) AS fn FROM p)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def edge_precision_recall(spark, sf_dir):
    """Quality labels as truth, a length rule as the prediction."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    scores = graph.precision_recall(F.col("n_chars") >= 500, F.col("quality") == 1)
    return j.agg(*[F.round(v, 6).alias(k) for k, v in scores.items()])


@query("graph_parts_degrees", f"WITH {PARTS_SQL}, o AS (SELECT src AS node, count(*) AS o FROM g GROUP BY 1), i AS (SELECT dst AS node, count(*) AS i FROM g GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM o FULL JOIN i ON o.node = i.node")
def graph_parts_degrees(spark, sf_dir):
    return graph.degrees(parts(spark, sf_dir)).select("node", "in_degree", "out_degree")


def _parts_rank_sql() -> str:
    """The same rounds by joins, since this graph is too large for a subquery a node."""
    out = [f"{PARTS_SQL}, nodes AS (SELECT src AS node FROM g UNION SELECT dst FROM g), n AS (SELECT count(*)::DOUBLE AS n FROM nodes), d AS (SELECT src AS node, count(*) AS d FROM g GROUP BY 1), p0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM nodes, n)"]
    for i in range(1, RANK_ROUNDS + 1):
        out.append(f"""s{i} AS (SELECT dst AS node, sum(r / d) AS got FROM g JOIN p{i - 1} p ON p.node = g.src JOIN d ON d.node = g.src GROUP BY 1),
 l{i} AS (SELECT coalesce(sum(r), 0) AS lost FROM p{i - 1} WHERE node NOT IN (SELECT node FROM d)),
 p{i} AS MATERIALIZED (SELECT nodes.node, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS r FROM nodes LEFT JOIN s{i} USING (node), n, l{i})""")
    return ", ".join(out) + f" SELECT node, round(r / max(r) OVER (), 6) AS score FROM p{RANK_ROUNDS}"


@query("graph_parts_pagerank", f"WITH {_parts_rank_sql()}")
def graph_parts_pagerank(spark, sf_dir):
    return graph.pagerank(parts(spark, sf_dir), rounds=RANK_ROUNDS, epsilon=0).withColumn("score", F.round("score", 6))


@query("graph_parts_impact", f"WITH {PARTS_SQL}, a AS (SELECT src AS node, 1 AS depth FROM g WHERE dst = 7), b AS (SELECT g.src AS node, 2 AS depth FROM g JOIN a ON g.dst = a.node) SELECT node, min(depth) AS depth FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE node <> 7 GROUP BY node")
def graph_parts_impact(spark, sf_dir):
    """Parts that lead to part 7 within two steps."""
    return graph.reach(parts(spark, sf_dir), spark.createDataFrame([(7,)], "start int"), 2, reverse=True).select("node", "depth")


@query("graph_parts_scc")
def graph_parts_scc(spark, sf_dir):
    """Strongly connected parts. A closure of this graph is too large for SQL; the operator is tested by brute force."""
    return graph.components_strong(followers(spark, sf_dir))
