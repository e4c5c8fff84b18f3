"""Formulas of metrics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import staged


def value_counts(df: DataFrame, v: str) -> DataFrame:
    """(v, ties, below, n): how often each value occurs, how many rows are below it, and how many there are.

    Values are dealt to ranges; a range adds up within itself, and ranges, which are
    as many as partitions, are added up by themselves. Nulls are left out.
    """
    c = df.where(F.col(v).isNotNull()).groupBy(v).agg(F.count("*").alias("ties"))
    c = staged(c.repartitionByRange(F.col(v)).withColumn("__range", F.spark_partition_id()), "values")
    before = lambda w: F.coalesce(F.sum("ties").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = c.groupBy("__range").agg(F.sum("ties").alias("ties"))
    ranges = ranges.select("__range", before(Window.orderBy("__range")).alias("__skip"), F.sum("ties").over(Window.partitionBy()).alias("n"))
    c = c.withColumn("below", before(Window.partitionBy("__range").orderBy(v)))
    return c.join(F.broadcast(ranges), "__range").select(v, "ties", (F.col("below") + F.col("__skip")).alias("below"), "n")


def with_percentiles(df: DataFrame, columns: list[str], prefix: str = "p_") -> DataFrame:
    """Add (average rank - 1) / (n - 1) of each column, 1 for one row; ties share their mean rank, unlike percent_rank."""
    for c in columns:
        rank = F.when(F.col("n") == 1, 1.0).otherwise((F.col("below") + (F.col("ties") - 1) / 2) / (F.col("n") - 1))
        df = df.join(value_counts(df, c).select(c, rank.alias(f"{prefix}{c}")), c, "left")
    return df


def with_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add lo_ and hi_ of each column: one row that is sent to all."""
    ends = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    return df.crossJoin(F.broadcast(ends))


def min_max(v: str) -> Column:
    """(v - lo) / (hi - lo) of with_ranges, a half if all are equal."""
    lo, hi = F.col(f"lo_{v}"), F.col(f"hi_{v}")
    return F.when(hi == lo, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(v) - lo) / (hi - lo))))


def varies(v: str) -> Column:
    return F.col(f"lo_{v}") != F.col(f"hi_{v}")


def recency_weight(age_days: Column, half_life: float) -> Column:
    return F.lit(1.0) if half_life <= 0 else F.exp(F.lit(-0.6931471805599453 / half_life) * F.greatest(age_days, F.lit(0)))


def relative_churn(changed: Column, loc: Column) -> Column:
    return changed / F.greatest(loc, F.lit(10))


def halstead(n1: Column, n2: Column, big1: Column, big2: Column) -> dict[str, Column]:
    """Vocabulary, length, volume, difficulty, effort, time and bugs from distinct and total operators and operands."""
    vocabulary, length = n1 + n2, big1 + big2
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary.cast("double"))).otherwise(1.0)
    difficulty = F.when(n2 > 0, n1 / 2 * (big2 / n2)).otherwise(n1 / 2)
    effort = volume * difficulty
    return {"vocabulary": vocabulary, "length": length, "volume": volume, "difficulty": difficulty, "effort": effort, "time_s": effort / 18, "bugs": volume / 3000}


def maintainability(volume: Column, complexity: Column, loc: Column) -> Column:
    mi = (171 - 5.2 * F.log(volume) - 0.23 * complexity - 16.2 * F.log(loc.cast("double"))) * 100 / 171
    return F.when(loc <= 0, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), mi)))


def grade(mi: Column) -> Column:
    return F.when(mi >= 85, "A").when(mi >= 65, "B").when(mi >= 45, "C").when(mi >= 25, "D").otherwise("F")


def estimated_volume(loc: Column) -> Column:
    return 5 * loc * F.log2(F.greatest(F.sqrt(loc.cast("double")), F.lit(1.0)))


def dice(common: Column, a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 1.0).when((a == 0) | (b == 0), 0.0).otherwise(2.0 * common / (a + b))


def jaccard(common: Column, a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 1.0).otherwise(common / (a + b - common))


def dice_from_jaccard(j: Column) -> Column:
    return 2 * j / (1 + j)


def similarity_label(s: Column) -> Column:
    return F.when(s >= 1.0, "type 1").when(s >= 0.9, "type 2").otherwise("type 3")


def trend(delta: Column) -> Column:
    return F.when(delta < -2, "improving").when(delta > 2, "degrading").otherwise("stable")


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean over the measures that are there, rounded to 12 places; null if none is."""
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, F.round(total / weight, 12))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
