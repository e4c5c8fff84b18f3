"""Sequence and invariant mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def bigrams(seq: DataFrame, key: str, order: list[str], item: str, min_support: int = 1, min_confidence: float = 0.0) -> DataFrame:
    """(a, b, support, confidence) of adjacent items that differ; confidence over all successors of a that differ from it."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = seq.select(F.col(item).alias("a"), F.lead(item).over(w).alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("support"))
    out = pairs.withColumn("confidence", F.col("support") / F.sum("support").over(Window.partitionBy("a")))
    return out.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))


def trigrams(seq: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """(a, b, c, support, confidence); a = b or b = c is skipped, confidence is over valid triples of (a, b)."""
    w = Window.partitionBy(key).orderBy(*order)
    t = seq.select(F.col(item).alias("a"), F.lead(item).over(w).alias("b"), F.lead(item, 2).over(w).alias("c"))
    t = t.where("c is not null and a <> b and b <> c").groupBy("a", "b", "c").agg(F.count("*").alias("support"))
    return t.withColumn("confidence", F.col("support") / F.sum("support").over(Window.partitionBy("a", "b")))


def invariants(rows: DataFrame, key: str, args: list[str]) -> DataFrame:
    """(key, subject, kind, detail, n, confidence) that hold over all observations of a key.

    non_null; then, for numbers without nulls: positive, or non_negative if a 0
    occurs; range if least and most differ; and for pairs the relation that
    always holds, < before <=.
    """
    aggs = [F.count("*").alias("n")]
    for a in args:
        aggs += [F.count(a).alias(f"{a}_c"), F.min(a).cast("double").alias(f"{a}_lo"), F.max(a).cast("double").alias(f"{a}_hi")]
    pairs = [(a, b) for i, a in enumerate(args) for b in args[i + 1 :]]
    for a, b in pairs:
        for op, c in (("lt", F.col(a) < F.col(b)), ("le", F.col(a) <= F.col(b)), ("gt", F.col(a) > F.col(b)), ("ge", F.col(a) >= F.col(b))):
            aggs.append(F.coalesce(F.every(c), F.lit(False)).alias(f"{a}_{b}_{op}"))
    s = rows.groupBy(key).agg(*aggs)
    found = []
    one = lambda subject, kind, detail, when: F.when(when, F.struct(F.lit(subject).alias("subject"), kind.alias("kind"), detail.alias("detail")))
    num = lambda c: F.round(c, 4).cast("decimal(18,4)").cast("string")
    for a in args:
        whole, lo, hi = F.col(f"{a}_c") == F.col("n"), F.col(f"{a}_lo"), F.col(f"{a}_hi")
        found.append(one(a, F.lit("non_null"), F.lit(""), whole))
        found.append(one(a, F.when(lo > 0, "positive").otherwise("non_negative"), F.lit(""), whole & ((lo > 0) | (lo == 0))))
        found.append(one(a, F.lit("range"), F.concat_ws("..", num(lo), num(hi)), whole & (lo < hi)))
    for a, b in pairs:
        p = lambda op, a=a, b=b: F.col(f"{a}_{b}_{op}")
        rel = F.when(p("lt"), "<").when(p("gt"), ">").when(p("le"), "<=").when(p("ge"), ">=")
        found.append(one(f"{a},{b}", F.lit("relation"), rel, rel.isNotNull()))
    level = F.when(F.col("n") >= 10, "high").when(F.col("n") >= 5, "medium").otherwise("low")
    out = s.select(key, "n", level.alias("confidence"), F.explode(F.array_compact(F.array(*found))).alias("f"))
    return out.select(key, "f.subject", "f.kind", "f.detail", "n", "confidence")
