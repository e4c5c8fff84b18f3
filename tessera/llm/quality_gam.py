"""Quality score: a generalised additive model with pairwise interactions.

Every text gets a few features; each is cut into bins at quantiles of the
training rows. Boosting goes round the features in turn: a tree of DEPTH levels
over one feature's bins, fitted to the current gradient, adds its leaves to that
feature's lookup table. Then the pairs of features whose four quadrants best
explain what is left get tables of their own, boosted in the same way. A score
is the sigmoid of a sum of lookups, for whole batches at once: bins by binary
search, then one array addition for each table.

Features come from whole texts in Arrow batches; the model is a constant of
(features * BINS + PAIRS * COARSE^2) numbers. Only learning is bounded: it takes
the SAMPLE labelled rows of least hashed id, which the driver holds; everything
else covers all rows.

Nulls: a null text is empty, and scored as such; null labels teach nothing; a
null doc_id counts as empty text in the split. Several labels of one document
are averaged and rounded up at a half. With no label to learn from, or only
one kind, every score is the share of 1 (a half, without any). Repeated rows
give equal rows. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import held_out, stage_table, text_or_empty

SAMPLE = 20_000
BINS, COARSE = 48, 8
DEPTH = 2
ROUNDS, PAIR_ROUNDS = 150, 80
RATE = 0.15
PAIRS = 6
RIDGE = 2.0
LEAST_LEAF = 8
LEARN_MOD, HELD_OUT = 5, 0
PREDICT_AT = 0.3

FEATURES = (
    "log_words", "mean_word", "upper", "symbols", "exclamations", "stops", "commas", "digits", "distinct", "commonest",
    "dup_lines", "dup_trigrams", "short_words", "line_length", "bars", "other_words", "blanks", "long_word", "marks",
)


def features(text: str) -> list[float]:
    """One number for each of FEATURES."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = len(text)
    count = text.count
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = Counter(words)
    low = sum(map(len, words))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    digits = sum(map(count, "0123456789"))
    symbols = sum(map(count, "#*$%&<>@_="))
    tri = n - 2
    return [
        math.log1p(n), low / n, upper / n, symbols / n, count("!") / n, (count(".") + count("?")) / n, count(",") / n, digits / chars,
        len(distinct) / n, max(distinct.values()) / n, 1 - len(set(lines)) / len(lines),
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / tri if tri > 0 else 0.0,
        sum(map((3).__ge__, map(len, words))) / n, math.log1p(chars / len(lines)), count("|") / n,
        sum(1 for w in distinct if not w[0].isalpha()) / len(distinct), (chars - low) / chars, math.log1p(max(map(len, words))),
        sum(map(count, "()[]{}\"'/\\:;-")) / n,
    ]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x) for x in batch.column("text").to_pylist()]
        lists = pa.array(rows, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), lists], ["doc_id", "held_out", "x"])


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x), staged, one row for each document."""
    d = docs.select("doc_id", held_out(F.col("doc_id"), LEARN_MOD, HELD_OUT).alias("held_out"), text_or_empty(F.col("text")).alias("text"))
    kind = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, x array<double>"
    return stage_table(d.mapInArrow(_feature_rows, kind), "quality-features")


def _best_cut(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins; place k puts bins below k to the left."""
    left_g, left_h, left_c = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(c)[:-1]
    all_g, all_h, all_c = g.sum(), h.sum(), c.sum()
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain[(left_c < LEAST_LEAF) | (all_c - left_c < LEAST_LEAF)] = 0.0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, c: np.ndarray, depth: int) -> np.ndarray:
    """The value that a tree of that depth over bins gives each bin."""
    gain, k = _best_cut(g, h, c) if depth else (0.0, 0)
    if gain <= 1e-12:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:k], h[:k], c[:k], depth - 1), _tree(g[k:], h[k:], c[k:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of one side of a grid and, on each side of it, of the other: its gain and the grid of values."""
    best, values = -1.0, np.full(g.shape, g.sum() / (h.sum() + RIDGE))
    for turned in (False, True):
        gg, hh, cc = (g.T, h.T, c.T) if turned else (g, h, c)
        for k in range(1, len(gg)):
            gain, out = 0.0, np.zeros(gg.shape)
            for part in (slice(0, k), slice(k, None)):
                a, b, n = gg[part].sum(0), hh[part].sum(0), cc[part].sum(0)
                if n.sum() < LEAST_LEAF:
                    gain = -1.0
                    break
                _, j = _best_cut(a, b, n)
                for side in (slice(0, j), slice(j, None)):
                    gain += a[side].sum() ** 2 / (b[side].sum() + RIDGE)
                    out[part, side] = a[side].sum() / (b[side].sum() + RIDGE)
            if gain > best:
                best, values = gain, out.T if turned else out
    return best - g.sum() ** 2 / (h.sum() + RIDGE), values


class Model:
    """Cuts and lookup tables; a score is the sigmoid of base + all lookups."""

    def __init__(self, base: float, cuts: list[np.ndarray], tables: list[np.ndarray], coarse: list[np.ndarray], pairs: list[tuple[int, int, np.ndarray]]):
        self.base, self.cuts, self.tables, self.coarse, self.pairs = base, cuts, tables, coarse, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, j], side="right")]
        for a, b, grid in self.pairs:
            total += grid[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -40, 40)))


def _cuts(v: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, n) / n, method="lower")) if len(v) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the main tables, then of the PAIRS best pairs."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Model(math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0), [], [], [], [])
    base = math.log(share / (1 - share))
    m = x.shape[1]
    cuts, coarse = [_cuts(x[:, j], BINS) for j in range(m)], [_cuts(x[:, j], COARSE) for j in range(m)]
    bins = [np.searchsorted(cuts[j], x[:, j], side="right") for j in range(m)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), base)
    for _ in range(ROUNDS):
        for j in range(m):
            if len(tables[j]) < 2:
                continue
            p = 1 / (1 + np.exp(-total))
            size = len(tables[j])
            g, h, c = (np.bincount(bins[j], w, size) for w in (y - p, p * (1 - p), None))
            step = RATE * _tree(g, h, c, DEPTH)
            tables[j] += step
            total += step[bins[j]]
    small = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(m)]
    width = [len(c) + 1 for c in coarse]

    def grid(a: int, b: int) -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        at = small[a] * width[b] + small[b]
        return [np.bincount(at, w, width[a] * width[b]).reshape(width[a], width[b]) for w in (y - p, p * (1 - p), None)]

    ranked = sorted(((-_quadrants(*grid(a, b))[0], a, b) for a in range(m) for b in range(a + 1, m) if width[a] > 1 and width[b] > 1))[:PAIRS]
    pairs = [(a, b, np.zeros((width[a], width[b]))) for _, a, b in ranked]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in pairs:
            step = RATE * _quadrants(*grid(a, b))[1]
            table += step
            total += step[small[a], small[b]]
    return Model(base, cuts, tables, coarse, pairs)


def learn(table: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit to at most sample labelled rows that are not held out."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")).withColumnRenamed("doc_id", "l_id")
    rows = table.where("not held_out").join(marks, F.col("doc_id") == F.col("l_id")).select("doc_id", "x", "y")
    # the order must be total for reruns to agree
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toArrow()
    x = np.array(found["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, found["y"].to_numpy().astype(np.float64))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
            s = pa.array(model.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), s], ["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each document."""
    table = feature_table(docs)
    model = learn(table, labels, sample)
    kind = f"doc_id {table.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double"
    return table.mapInArrow(_score(model), kind).withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
