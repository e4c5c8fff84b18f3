"""Graph operators over edge tables (src, dst).

Edges are a set. Iterations keep only small state per round (a frontier or a
score for each node); each round is a table in the shared folder, so that lineage
stays short and a lost executor costs a round at most.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from tessera.session import shared_dir, staged


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in a table of the shared folder."""
    return staged(df, "graph")


#: Edges in a block of a graph, about; bits of a number that count nodes within a block.
BLOCK_EDGES, LOW_BITS = 1_000_000, 33
#: The label of none; sweeps over the edges within a block between two rounds, at most (what is left goes on in the next).
NO_LABEL, SWEEPS = np.iinfo(np.int64).max, 100
#: Rows of a partition in which the methods of a field are put in order, about.
FIELD_ROWS = 1_000_000
#: Rounds after which a state's lineage is cut in the shared folder.
CUT_ROUNDS = 20


class Blocks:
    """A graph in blocks of nodes near in order, over which values are pushed along the edges, block by block in arrays.

    Nodes are int64 numbers: the nodes themselves, where they are whole numbers and
    no edge has a null, and else numbers given to them in their order. Edges are
    moved once, to the block that they come from; a round moves a number for each
    node that a block's edges lead to. Which number stands for which node is agreed
    on beforehand. Blocks and states are persisted RDDs of one element a partition,
    and are made anew from the staged edges if an executor is lost; close() drops
    them. A state is a dict of arrays by node.
    """

    def __init__(self, edges: DataFrame):
        self.spark = edges.sparkSession
        cores = self.spark.sparkContext.defaultParallelism
        self.held: list[RDD] = []
        self.rounds = 0
        self.kind = nodes(edges).schema["node"].dataType
        self.numbered, sizes = None, {}
        count = edges.count()
        many = min(max(4, 2 * cores, count // BLOCK_EDGES), 1 << 16)
        if isinstance(self.kind, IntegralType) and edges.where("src is null or dst is null").isEmpty():
            coded = edges.select(F.col("src").cast("long").alias("s"), F.col("dst").cast("long").alias("d"))
            at = F.array(*[F.lit(i / (many // 2)) for i in range(1, many // 2)])
            cuts = coded.agg(*[F.percentile_approx(c, at, max(10_000, 4 * many)) for c in "sd"]).first() if count else ()
            self.bounds = np.array(sorted({x for c in cuts for x in c or ()}), np.int64)  # at most a number for each block
        else:
            every = nodes(edges).where("node is not null").repartitionByRange(many, "node").sortWithinPartitions("node")
            self.numbered = cut(every.select("node", F.monotonically_increasing_id().alias("number")))
            block = F.shiftright("number", LOW_BITS).cast("int")
            sizes = {r["b"]: r["c"] for r in self.numbered.groupBy(block.alias("b")).agg(F.count("*").alias("c")).collect()}  # a row for each block
            source, target = self.numbered.select(F.col("node").alias("src"), F.col("number").alias("s")), self.numbered.select(F.col("node").alias("dst"), F.col("number").alias("d"))
            coded = cut(edges.join(source, "src").join(target, "dst").select("s", "d"))
            self.bounds = np.arange(1, max(sizes, default=0) + 1, dtype=np.int64) << LOW_BITS
        self.many = len(self.bounds) + 1
        self.built = self._built(coded, sizes)
        self.n = self.built.map(lambda x: x["n"]).sum()
        self.drop(self.held[0])

    def _keep(self, rdd: RDD) -> RDD:
        self.held.append(self._one(rdd).persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def _built(self, coded: DataFrame, sizes: dict[int, int]) -> RDD:
        """The blocks. sizes: of each block whose numbers follow each other without a gap; else its nodes are those of edges."""
        many, bounds = self.many, self.bounds
        block_of = lambda x: np.searchsorted(bounds, x, "right")

        def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, count = [], 0
            for frame in itertools.chain(frames, [None]):
                if frame is not None:
                    held.append(frame.to_numpy(dtype=np.int64))
                    count += len(frame)
                if held and (frame is None or count >= BLOCK_EDGES):
                    pairs = np.concatenate(held)
                    blocks = block_of(pairs[:, 0])
                    order = np.argsort(blocks, kind="stable")
                    names, begins = np.unique(blocks[order], return_index=True)
                    yield pd.DataFrame({"b": names.astype(np.int32), "pairs": [x.tobytes() for x in np.split(pairs[order], begins[1:])]})
                    held, count = [], 0

        def block(b: int, found: Iterator) -> Iterator[dict]:
            pairs = np.concatenate([np.empty((0, 2), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 2) for _, x in found)])
            pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
            targets, begins = np.unique(pairs[:, 1], return_index=True)
            sources, source = np.unique(pairs[:, 0], return_inverse=True)
            to, cuts = np.unique(block_of(targets), return_index=True)
            yield {"b": b, "sources": sources, "source": source.astype(np.int32), "begins": begins, "to": to.tolist(), "cuts": cuts[1:], "targets": targets}

        def placed(pair: tuple[dict, dict]) -> dict:
            x, told = pair
            numbers = (x["b"] << LOW_BITS) + np.arange(sizes.get(x["b"], 0)) if sizes else np.unique(np.concatenate([x["sources"], *told.values()]))
            source = np.searchsorted(numbers, x["sources"]).astype(np.int32)[x["source"]]
            places = {b: np.searchsorted(numbers, t).astype(np.int32) for b, t in told.items()}
            return {**{k: v for k, v in x.items() if k != "sources"}, "source": source, "n": len(numbers), "numbers": numbers, "degree": np.bincount(source, minlength=len(numbers)), "places": places}

        rows = coded.mapInPandas(dealt, "b int, pairs binary").rdd.map(lambda r: (r[0], bytes(r[1])))
        dealt_out = self._keep(rows.partitionBy(many, int).mapPartitionsWithIndex(block))
        told = dealt_out.flatMap(lambda x: [(k, (x["b"], t)) for k, t in zip(x["to"], np.split(x["targets"], x["cuts"]))]).partitionBy(many, int)
        told = told.mapPartitions(lambda found: [{b: t for _, (b, t) in found}])
        return self._keep(dealt_out.zip(self._one(told)).map(placed))

    @staticmethod
    def _one(rdd: RDD) -> RDD:
        return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))

    def state(self, first: Callable[[dict], dict]) -> RDD:
        """A state made from each block: its number b, its n nodes, their numbers and their degree."""
        return self._keep(self.built.map(first))

    def push(self, state: RDD, value: Callable[[dict, dict], np.ndarray], op: np.ufunc, nothing, absorb: Callable[..., dict], back: Callable[[dict, dict], np.ndarray] | None = None) -> RDD:
        """The state after each node's value has gone along its edges, and absorb has got what op makes of those that arrive (nothing if none do).

        With back, absorb also gets what that gives for each of the block's targets, wherever they are, in their order.
        """

        def send(pair: tuple[dict, dict]) -> list[tuple]:
            x, old = pair
            out = []
            if len(x["source"]):
                out = [(k, (x["b"], 0, v)) for k, v in zip(x["to"], np.split(op.reduceat(value(x, old)[x["source"]], x["begins"]), x["cuts"]))]
            if back is not None:
                own = back(x, old)
                out += [(k, (x["b"], 1, own[at])) for k, at in x["places"].items()]
            return out

        def receive(triple: tuple) -> dict:
            (x, old), sent = triple
            got, far = np.full(x["n"], nothing), []
            for _, (b, answer, v) in sorted(sent, key=lambda m: m[1][:2]):
                if answer:
                    far.append(v)
                else:
                    at = x["places"][b]
                    got[at] = op(got[at], v)
            if back is None:
                return absorb(x, old, got)
            return absorb(x, old, got, np.concatenate(far) if far else back(x, old)[:0])

        sent = self.built.zip(state).flatMap(send).partitionBy(self.many, int).mapPartitions(lambda found: [list(found)])
        new = self._keep(self._one(self.built.zip(state)).zip(self._one(sent)).map(receive))
        self.rounds += 1
        if self.rounds % CUT_ROUNDS == 0:
            context = self.spark.sparkContext
            if not context.getCheckpointDir():
                context.setCheckpointDir(shared_dir(self.spark))
            new.checkpoint()
        return new

    def total(self, state: RDD, of: Callable[[dict], float]) -> float:
        return state.map(of).sum()

    def drop(self, state: RDD) -> None:
        state.unpersist()
        self.held.remove(state)

    def table(self, state: RDD, of: Callable[[dict, dict], tuple], schema: str) -> DataFrame:
        """The arrays that a function gives for a block and its state, as the long and double columns of the schema."""
        kinds = [c.split() for c in schema.split(", ")]

        def row(pair: tuple[dict, dict]) -> tuple:
            return tuple(bytearray(np.ascontiguousarray(v, np.float64 if kind == "double" else np.int64).tobytes()) for v, (_, kind) in zip(of(*pair), kinds))

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    yield pd.DataFrame({name: np.frombuffer(v, np.float64 if kind == "double" else np.int64) for v, (name, kind) in zip(r, kinds)})

        return self.spark.createDataFrame(self.built.zip(state).map(row), ", ".join(f"{name} binary" for name, _ in kinds)).mapInPandas(rows, schema)

    def named(self, df: DataFrame, number: str, node: str) -> DataFrame:
        """The table with nodes in place of their numbers."""
        if self.numbered is None:
            return df.withColumn(number, F.col(number).cast(self.kind)).withColumnRenamed(number, node)
        return df.join(self.numbered.select(F.col("node").alias(node), F.col("number").alias(number)), number).drop(number)

    def close(self) -> None:
        for rdd in self.held:
            rdd.unpersist()
        self.held = []


def by_maximum(df: DataFrame, column: str) -> DataFrame:
    """The column divided by its maximum, which is one row beside the table; no task sees all rows."""
    top = df.agg(F.max(column).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col("__top") > 0, F.col(column) / F.col("__top")).otherwise(F.col(column))).drop("__top")


def edge_set(*parts: DataFrame) -> DataFrame:
    """The union of edge tables, without repetitions."""
    out = parts[0].select("src", "dst")
    for p in parts[1:]:
        out = out.unionByName(p.select("src", "dst"))
    return out.distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, callees, callers) as sorted lists joined by commas."""
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x.cast("string")), ",")
    out = edges.groupBy(F.col("src").alias("node")).agg(text("dst").alias("callees"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(text("src").alias("callers"))
    return out.join(into, "node", "full").select("node", F.coalesce("callees", F.lit("")).alias("callees"), F.coalesce("callers", F.lit("")).alias("callers"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, in_score, out_score); scores are degree / (n - 1), 0 for one node."""
    both = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    d = both.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = d.agg(F.count("*").alias("n"))
    d = d.crossJoin(F.broadcast(n))  # one row
    per = lambda c: F.when(F.col("n") > 1, F.col(c) / (F.col("n") - 1)).otherwise(0.0)
    return d.select("node", "in_degree", "out_degree", per("in_degree").alias("in_score"), per("out_degree").alias("out_score"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 150, epsilon: float = 1e-5) -> DataFrame:
    """(node, score): PageRank with evenly spread dangling mass, divided by its maximum.

    Stops when no score moves by epsilon or more; epsilon 0 runs all rounds. Scores
    go along the edges in blocks.
    """
    blocks = Blocks(cut(edges.select("src", "dst")))
    n = blocks.n
    if not n:
        return nodes(edges).where("node is not null").select("node", F.lit(1.0).alias("score"))
    state = blocks.state(lambda x: {"rank": np.full(x["n"], 1.0 / n), "lost": float((x["degree"] == 0).sum()) / n, "moved": 1.0})
    for _ in range(rounds):
        lost = blocks.total(state, lambda s: s["lost"])

        def absorb(x: dict, old: dict, got: np.ndarray, lost=lost) -> dict:
            rank = (1 - damping) / n + damping * (got + lost / n)
            return {"rank": rank, "lost": float(rank[x["degree"] == 0].sum()), "moved": float(np.abs(rank - old["rank"]).max(initial=0))}

        new = blocks.push(state, lambda x, s: s["rank"] / np.maximum(x["degree"], 1), np.add, 0.0, absorb)
        moved = new.map(lambda s: s["moved"]).max()
        blocks.drop(state)
        state = new
        if epsilon and moved < epsilon:
            break
    rank = cut(blocks.table(state, lambda x, s: (x["numbers"], s["rank"]), "number long, score double"))
    blocks.close()
    return by_maximum(blocks.named(rank, "number", "node").select("node", "score"), "score")


def betweenness(edges: DataFrame, max_nodes: int = 5000, sources: int | None = None) -> DataFrame:
    """(node, score): Brandes, directed, over (n - 1)(n - 2); 0 for 2 nodes or fewer, or more than max_nodes.

    Sources are dealt out. The adjacency of max_nodes nodes goes to the executors
    as an array of the numbers of its targets, two bytes an edge, so at most
    2 * max_nodes ** 2 bytes. With sources, only so many take part, chosen by
    hash, and sums are scaled up.
    """
    every = nodes(edges)
    n = every.limit(max_nodes + 1).count()
    if n <= 2 or n > max_nodes:
        return every.select("node", F.lit(0.0).alias("score"))
    names = [r["node"] for r in every.orderBy("node").collect()]  # max_nodes at most
    numbered = cut(edges.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], f"node {edges.schema['src'].dataType.simpleString()}, i int"))
    pairs = edges.join(numbered.select(F.col("node").alias("src"), F.col("i").alias("a")), "src").join(numbered.select(F.col("node").alias("dst"), F.col("i").alias("b")), "dst")
    pairs = pairs.select(F.col("a").cast("short"), F.col("b").cast("short")).distinct().toArrow()  # below 2 ** 15
    a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    order = np.lexsort((b, a))
    begins, targets = np.searchsorted(a[order], np.arange(n + 1)), b[order]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        follow = [targets[begins[i] : begins[i + 1]].tolist() for i in range(n)]
        for frame in frames:
            total = np.zeros(n)
            for s in frame["i"].tolist():
                order, before, paths, dist = [], [[] for _ in range(n)], [0.0] * n, [-1] * n
                paths[s], dist[s] = 1.0, 0
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in follow[v]:
                        if dist[w] < 0:
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                part = [0.0] * n
                for w in reversed(order):
                    for v in before[w]:
                        part[v] += paths[v] / paths[w] * (1 + part[w])
                    if w != s:
                        total[w] += part[w]
            at = np.flatnonzero(total)
            yield pd.DataFrame({"i": at.astype(np.int32), "score": total[at]})

    chosen = numbered if sources is None or sources >= n else numbered.orderBy(F.xxhash64("node"), "node").limit(sources)
    scale = 1.0 if sources is None or sources >= n else n / sources
    cores = edges.sparkSession.sparkContext.defaultParallelism
    parts = chosen.select("i").repartition(min(n, 4 * cores)).mapInPandas(run, "i int, score double").groupBy("i").agg(F.sum("score").alias("score"))
    scaled = numbered.join(parts, "i", "left").select("node", (F.coalesce("score", F.lit(0.0)) * scale / ((n - 1) * (n - 2))).alias("score"))
    top = scaled.agg(F.max("score").alias("__top"))
    return scaled.crossJoin(F.broadcast(top)).select("node", F.when(F.col("__top") > 1, F.col("score") / F.col("__top")).otherwise(F.col("score")).alias("score"))


def hubs(edges: DataFrame, rounds: int = 150, epsilon: float = 1e-5, max_nodes: int = 5000) -> DataFrame:
    """(node, in_score, out_score, pagerank, betweenness, composite, risk), weights .25 .25 .30 .20."""
    d = degrees(edges).select("node", "in_score", "out_score")
    d = d.join(pagerank(edges, rounds=rounds, epsilon=epsilon).withColumnRenamed("score", "pagerank"), "node")
    d = d.join(betweenness(edges, max_nodes).withColumnRenamed("score", "betweenness"), "node")
    c = F.round(0.25 * F.col("in_score") + 0.25 * F.col("out_score") + 0.30 * F.col("pagerank") + 0.20 * F.col("betweenness"), 12)
    d = d.withColumn("composite", c)
    risk = F.when(c >= 0.8, "critical").when(c >= 0.6, "high").when(c >= 0.4, "medium").otherwise("low")
    return d.withColumn("risk", risk)


def reach(edges: DataFrame, starts: DataFrame, max_depth: int, reverse: bool = False) -> DataFrame:
    """(start, node, depth): breadth-first least depths from each start (a column start), the start itself left out."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    hop = edges.select(F.col(a).alias("at"), F.col(b).alias("node"))
    front = starts.select("start", F.col("start").alias("node")).distinct()
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        new = front.withColumnRenamed("node", "at").join(hop, "at").select("start", "node").distinct()
        new = cut(new.join(seen, ["start", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new.withColumn("depth", F.lit(depth)))
        front = new
    return seen.where("depth > 0")


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth) for every node that another reaches."""
    every = nodes(edges).withColumnRenamed("node", "start")
    return reach(edges, every, max_depth or max(1, every.count()))


def two_cycles(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, that depend on each other."""
    a, b = edges.select("src", "dst"), edges.select(F.col("src").alias("s"), F.col("dst").alias("d"))
    return a.join(b, (F.col("src") == F.col("d")) & (F.col("dst") == F.col("s"))).where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers from 0, one to one, in an order that has nothing to do with theirs."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _targets(x: dict) -> np.ndarray:
    """Of each edge of a block, the place of its target among the block's targets."""
    return np.repeat(np.arange(len(x["begins"])), np.diff(x["begins"], append=len(x["source"])))


def _nearer(x: dict, old: dict, got: np.ndarray, far: np.ndarray) -> dict:
    """Labels of a block after what came from all blocks, and after sweeps over the edges within it."""
    source, target = x["source"], _targets(x)
    out = np.full(x["n"], NO_LABEL)
    np.minimum.at(out, source, far[target])
    own = np.empty(0, np.int64)
    if x["b"] in x["to"]:  # the targets of a block lie side by side, and so do edges to them
        i = x["to"].index(x["b"])
        begin, end = np.searchsorted(target, [[0, *x["cuts"]][i], [*x["cuts"], len(far)][i]])
        source, own = source[begin:end], x["places"][x["b"]][target[begin:end] - target[begin]]
    else:
        source = source[:0]
    a, b = old["above"], old["below"]
    for _ in range(SWEEPS):
        above, below = got.copy(), out.copy()
        np.minimum.at(above, own, a[source])
        np.minimum.at(below, source, b[own])
        off = (above == NO_LABEL) | (below == NO_LABEL) | (a == NO_LABEL)
        above, below = np.where(off, NO_LABEL, np.minimum(a, above)), np.where(off, NO_LABEL, np.minimum(b, below))
        same = np.array_equal(a, above) and np.array_equal(b, below)
        a, b = above, below
        if same:
            break
    return {"above": a, "below": b, "moved": int(((a != old["above"]) | (b != old["below"])).sum())}


def _settled(x: dict, old: dict, got: np.ndarray, far: np.ndarray) -> dict:
    """Nodes whose component is found, and the edges between others that may be within one."""
    source, target, a, b = x["source"], _targets(x), old["above"], old["below"]
    done = (a == b) & (a != NO_LABEL)
    left = (a != b)[source] & (far[target, 0] == a[source]) & (far[target, 1] == b[source])
    return {"number": x["numbers"][done], "label": a[done], "s": x["numbers"][source[left]], "d": x["targets"][target[left]]}


def components_strong(edges: DataFrame) -> DataFrame:
    """(node, component, size) of strongly connected components of 2 nodes or more, named by their least node.

    Colouring in blocks: of labels in a mixed order, each node takes the least of
    those that reach it and the least of those that it reaches, both at once, until
    none changes; nodes without an edge in or out drop off meanwhile. Where the two
    are the same they name the component. Others are told apart by the two, and
    edges between those of which both are equal are coloured anew. State is two
    labels for each node, never a pair, and a round moves no edges.
    """
    left, first, found = cut(edges.select("src", "dst").where("src <> dst")), None, None
    for turn in itertools.count():
        if left.isEmpty():
            break
        blocks = Blocks(left)
        first = first or blocks

        def start(x: dict) -> dict:
            label = _mixed((x["b"] << LOW_BITS) + np.arange(x["n"]))
            return {"above": label, "below": label}

        state, moved = blocks.state(start), True
        while moved:
            new = blocks.push(state, lambda x, s: s["above"], np.minimum, NO_LABEL, _nearer, lambda x, s: s["below"])
            moved = blocks.total(new, lambda s: s["moved"])
            blocks.drop(state)
            state = new
        state = blocks.push(state, lambda x, s: s["above"], np.minimum, NO_LABEL, _settled, lambda x, s: np.stack([s["above"], s["below"]], 1))
        own = cut(blocks.table(state, lambda x, s: (s["number"], s["label"]), "number long, label long")).withColumn("turn", F.lit(turn))
        left = cut(blocks.table(state, lambda x, s: (s["s"], s["d"]), "src long, dst long"))
        found = own if found is None else found.unionByName(own)
        blocks.close()
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    many = found.groupBy("turn", "label").agg(F.count("*").alias("size"), F.min("number").alias("least")).where("size > 1")
    found = found.join(many, ["turn", "label"]).select("number", "least", "size")
    return first.named(first.named(found, "number", "node"), "least", "component").select("node", "component", "size")


def collapse(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between the groups (node, grp) of nodes, without loops."""
    s, d = groups.select(F.col("node").alias("src"), F.col("grp").alias("g_src")), groups.select(F.col("node").alias("dst"), F.col("grp").alias("g_dst"))
    return edges.join(s, "src").join(d, "dst").where("g_src <> g_dst").select(F.col("g_src").alias("src"), F.col("g_dst").alias("dst")).distinct()


def layers(edges: DataFrame, high: float = 2.0, low: float = 0.5) -> DataFrame:
    """(node, calls_in, calls_out, layer) by the ratio of outgoing to incoming edges."""
    d = degrees(edges).select("node", F.col("in_degree").alias("calls_in"), F.col("out_degree").alias("calls_out"))
    ratio = F.col("calls_out") / F.col("calls_in")
    kind = F.when(F.col("calls_in") == 0, "entry").when(ratio >= high, "entry").when(ratio <= low, "utility").otherwise("service")
    return d.withColumn("layer", kind)


def instability(edges: DataFrame, isolated: float | None = 0.0, modules: DataFrame | None = None) -> DataFrame:
    """(node, ca, ce, instability): distinct sources and targets without loops, ce / (ca + ce), isolated for none."""
    e = edges.where("src <> dst").distinct()
    ce = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ce"))
    ca = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ca"))
    every = nodes(edges) if modules is None else modules.select("node").distinct()
    out = every.join(ca, "node", "left").join(ce, "node", "left").fillna(0, ["ca", "ce"])
    total = F.col("ca") + F.col("ce")
    return out.select("node", "ca", "ce", F.when(total > 0, F.col("ce") / total).otherwise(F.lit(isolated).cast("double")).alias("instability"))


def martin(edges: DataFrame, abstractness: DataFrame) -> DataFrame:
    """Instability joined with (node, abstractness): distance |a + i - 1|, its zone and health."""
    m = instability(edges, None, abstractness).join(abstractness, "node")
    d = F.abs(F.col("abstractness") + F.col("instability") - 1)
    m = m.withColumn("distance", d)
    zone = (
        F.when(F.col("instability").isNull(), "isolated")
        .when((F.col("instability") < 0.3) & (F.col("abstractness") < 0.3) & (d > 0.5), "pain")
        .when((F.col("instability") > 0.7) & (F.col("abstractness") > 0.7), "uselessness")
        .when(d <= 0.2, "healthy").when(d <= 0.5, "warning").otherwise("far")
    )
    health = F.when(d <= 0.2, "good").when(d <= 0.4, "fair").when(d.isNotNull(), "poor")
    return m.withColumns({"zone": zone, "health": health})


def coupling(calls: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, a_to_b, b_to_a, score) for pairs of modules: calls over twice their functions, at most 1."""
    pair = calls.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum(F.when(F.col("src") < F.col("dst"), F.col("n")).otherwise(0)).alias("a_to_b"), F.sum(F.when(F.col("src") > F.col("dst"), F.col("n")).otherwise(0)).alias("b_to_a")
    )
    fa, fb = sizes.select(F.col("node").alias("a"), F.col("funcs").alias("fa")), sizes.select(F.col("node").alias("b"), F.col("funcs").alias("fb"))
    total = F.col("fa") + F.col("fb")
    score = F.when(total > 0, F.least(F.lit(1.0), (F.col("a_to_b") + F.col("b_to_a")) / (2.0 * total))).otherwise(0.0)
    return pair.join(fa, "a").join(fb, "b").select("a", "b", "a_to_b", "b_to_a", score.alias("score"))


def dependency_roles(edges: DataFrame) -> DataFrame:
    """(node, role): root (nothing depends on it), leaf (depends on nothing) or inner."""
    d = degrees(edges)
    role = F.when(F.col("in_degree") == 0, "root").when(F.col("out_degree") == 0, "leaf").otherwise("inner")
    return d.select("node", role.alias("role"))


def diamonds(parents: DataFrame) -> DataFrame:
    """(node, ancestor) reached through two parents or more; parents: edges (src child, dst parent)."""
    up = closure(parents).select(F.col("start").alias("dst"), F.col("node").alias("ancestor"))
    via = parents.select("src", "dst").join(up, "dst").unionByName(parents.select("src", "dst", F.col("dst").alias("ancestor")))
    return via.where("src <> ancestor").groupBy(F.col("src").alias("node"), "ancestor").agg(F.countDistinct("dst").alias("n_paths")).where("n_paths >= 2")


def lcom4(members: DataFrame) -> DataFrame:
    """(cls, lcom4) of (cls, method, field): components of a class's methods linked by a common field.

    A method without fields is a component of its own. Of the methods of a field each
    is linked to the one before it, in partitions of FIELD_ROWS, so that rows go
    past in order and only links are gathered; labels spread over those, of all
    classes at once, until none changes, halving chains by taking the label's own
    label.
    """
    m = cut(members.select("cls", "method", "field"))
    lone = F.when(F.col("field").isNull(), F.monotonically_increasing_id())
    keys = ["field", "cls", "lone"]
    many = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), m.count() // FIELD_ROWS)
    before = F.lag("method").over(Window.partitionBy(*keys).orderBy("method"))
    links = m.withColumn("lone", lone).repartition(many, *keys).select("cls", "method", before.alias("other"))
    links = cut(links.withColumn("other", F.when(F.col("other") != F.col("method"), F.col("other"))).distinct())
    lab = cut(links.select("cls", "method").distinct().withColumn("label", F.col("method")))
    links = links.where("other is not null and cls is not null")
    ends = cut(links.select("cls", "method", "other").union(links.select("cls", "other", "method")).distinct())
    while True:
        new = ends.join(lab.select("cls", F.col("method").alias("other"), "label"), ["cls", "other"]).groupBy("cls", "method").agg(F.min("label").alias("n_label"))
        step = lab.join(new, ["cls", "method"], "left").select("cls", "method", "label", F.least("label", F.coalesce("n_label", "label")).alias("new"))
        jump = step.select("cls", F.col("method").alias("new"), F.col("new").alias("far"))
        step = cut(step.join(jump, ["cls", "new"], "left").select("cls", "method", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        done = step.where("new <> label").isEmpty()
        lab = step.select("cls", "method", F.col("new").alias("label"))
        if done:
            return lab.groupBy("cls").agg(F.countDistinct("label").alias("lcom4"))


def edge_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(src, dst, side): left, right or both."""
    a, b = left.select("src", "dst").distinct().withColumn("l", F.lit(1)), right.select("src", "dst").distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, ["src", "dst"], "full").select("src", "dst", side.alias("side"))


def precision_recall(pairs: Column, truth: Column) -> dict[str, Column]:
    """Aggregates of boolean columns: precision, recall and F1, 0 where undefined."""
    tp, fp, fn = (F.sum(x.cast("int")) for x in (pairs & truth, pairs & ~truth, ~pairs & truth))
    p, r = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}
