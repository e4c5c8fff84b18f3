"""Quality rules with thresholds learned from each group's own distribution.

Every document gets counts from its whole text. For each (lang, source) and
each lang, mergeable quantile sketches (percentile_approx: partial sketches of
all rows, merged after the shuffle) give the quartiles of four ratios. A
document fails where a ratio lies beyond the quartiles by more than REACH
spreads; a floor under the spread keeps groups of equal values from rejecting
their neighbours. Groups of fewer than MIN_GROUP rows take their language's
thresholds. Texts stay in the scan: only the counts of a document move, and
the join to thresholds is on (lang, source), which AQE may split. The counts
are staged, so texts are read once for sketches and verdicts together.

Nulls: a null text is empty (no words, so base_failed); a null lang or source
is a group of its own. Repeated rows count as often as they occur and give
equal results. An empty table gives an empty result. Long texts take time in
n log n of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm._common import pick, stage_table, text_or_empty, words_of

WINDOW = 8
#: Ratio: (floor under its spread, whether low values fail too).
RATIOS = {"symbol_ratio": (0.05, False), "dup_line_ratio": (0.1, False), "repeat_ratio": (0.08, False), "mean_word": (0.75, True)}
REACH = 3.0
MIN_GROUP = 30
ACCURACY = 10_000


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines)."""
    d = pick(docs, doc_id="doc_id", lang="lang", source="source", text="text").withColumn("text", text_or_empty(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "lang", "source", words_of(F.col("text")).alias("words"), lines.alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    d = d.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    at = lambda i, k: F.get(F.col("hashes"), i + k)
    windows = F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    d = d.withColumn("windows", F.when(F.size("hashes") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("pairs", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    d = d.withColumn("starts", F.sort_array(F.transform(
        F.filter("pairs", lambda x, j: F.coalesce(F.get(F.col("pairs"), j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("pairs"), j + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"],
    )))
    covered = F.aggregate(
        F.transform("starts", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), j + 1) - x, F.lit(WINDOW))).cast("long")),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return d.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"), "n_lines",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_ratios(counted: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.withColumns({
        "symbol_ratio": per("n_symbols", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"), "mean_word": per("word_chars", "n_words"), "base_failed": base_failed(),
    })


def _bounds(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """The group's size and, for each ratio, its lower and upper bound."""
    quartiles = [F.percentile_approx(r, [0.25, 0.75], ACCURACY).alias(f"{r}_q") for r in RATIOS]
    out = rows.groupBy(*keys).agg(F.count("*").alias(f"{tag}_n"), *quartiles)
    for r, (floor, low) in RATIOS.items():
        q1, q3 = F.get(F.col(f"{r}_q"), F.lit(0)), F.get(F.col(f"{r}_q"), F.lit(1))
        spread = F.greatest(q3 - q1, F.lit(floor)) * REACH
        out = out.withColumn(f"{tag}_{r}", F.struct((q1 - spread if low else F.lit(None).cast("double")).alias("lo"), (q3 + spread).alias("hi"))).drop(f"{r}_q")
    return out


def judge(counted: DataFrame) -> DataFrame:
    """Add kept: neither base_failed nor beyond the group's thresholds."""
    # staged: else a filter on the counts would be pushed into the scan, with all their expressions nested in it
    rows = stage_table(with_ratios(counted), "rules-counts")
    good = rows.where(~F.col("base_failed"))
    small = _bounds(good, ["lang", "source"], "g").withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    large = _bounds(good, ["lang"], "l").withColumnRenamed("lang", "l_lang")
    limits = small.join(large, F.col("g_lang").eqNullSafe(F.col("l_lang")), "left")
    limits = limits.select("g_lang", "g_source", *[F.when(F.col("g_n") >= MIN_GROUP, F.col(f"g_{r}")).otherwise(F.col(f"l_{r}")).alias(f"t_{r}") for r in RATIOS])
    j = rows.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    beyond = F.lit(False)
    for r in RATIOS:
        v, t = F.col(r), F.col(f"t_{r}")
        beyond = beyond | F.coalesce((v > t["hi"]) | (v < F.coalesce(t["lo"], F.lit(float("-inf")))), F.lit(False))
    return j.withColumn("kept", ~F.col("base_failed") & ~beyond).drop("g_lang", "g_source", *[f"t_{r}" for r in RATIOS])


def apply(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their own columns, by (doc_id) of the verdicts."""
    kept = judge(counts(docs)).where("kept").select("doc_id").distinct()
    whole = docs.select(docs["doc_id"].alias("id"), F.struct(*docs.columns).alias("doc"))
    return whole.join(kept, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select("doc.*")
