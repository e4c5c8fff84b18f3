"""Mixing sources to target weights by entropy balancing.

Sizes are words. Each source's target follows from its weight; a document of
size x in source s gets the rate

    r = 2 * sigmoid(lambda_s * x / scale)        (scale: the source's mean size)

the solution of the convex problem "least relative entropy to one copy of each,
between no copy and two, with sum(r * x) over the source equal to its target":
an exponential tilt of the odds of a copy by the words it brings.
lambda_s is found by Newton steps on the dual; the gradient and the Hessian are
sums over all documents, taken over the table of (source, size, count), which
carries everything that the dual needs. A source whose target is twice its size
takes two copies of all. Steps are damped by a bracket that always holds the
root, so they cannot run away; they end when every source is within TOLERANCE.

Rates become copies cell by cell, a cell being the rows of one source and size.
Sources take their cells in order of size; a cell's rows bring floor(rate)
copies each, and so many of them one more as whole numbers lie between the
running sums of fractional parts before and after the cell. That keeps a
source's taken words within one largest document of its target; of OFFSETS
starting points of the sum each source takes the one that comes nearest. Which
rows of a cell take the further copy falls by hash of id and text: those up to
the cell's cut. So a row's copies follow from the row itself and its cell alone,
and texts are decided upon where they lie: cells are joined to them, by
broadcast while there are at most BROADCAST_CELLS of them, else by a shuffle.

No task sees a large cell: a cut is looked for among ranges of hashes first, with
rows that are equal in hash and id counted once, and then within one range.
Only where a cut falls among equal rows are these numbered, in as many parts as
they need.

Nulls: a null text has size 0; a null source is a source of its own, the last.
Documents of size 0 take nothing. Repeated rows are documents of their own. A
source without words has the target 0. Very long texts are counted where they
lie. An empty table gives an empty result. Further columns come through
apply() whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm._common import key_of, stage_table, text_or_empty, words_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
TOLERANCE = 1e-9
STEPS = 60
SALT_ROWS = 5000
OFFSETS = 64
#: Cells (of some 100 bytes) that are sent to every executor at most.
BROADCAST_CELLS = 200_000


def _keyed(docs: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, source, size, o) and what is to be kept; o orders the rows of a cell: hash, id, second hash."""
    text, key = text_or_empty(docs["text"]), key_of(docs["doc_id"])
    order = F.struct(F.shiftrightunsigned(F.xxhash64(key, text), 1).alias("h"), key.alias("key"), F.xxhash64(text, key).alias("h2"))
    return docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), F.size(words_of(text)).cast("long").alias("size"), order.alias("o"), *keep)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target), by water filling in closed form.

    With sources in order of size / weight, some first ones are full at
    most * size and the others share what remains by weight; the first source
    that would not be full under that division ends the full ones. The window
    runs over one row for each source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by = by.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights)))
    by = by.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weight_left)
    by = by.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return by.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def _rate(lam: Column, size: Column, scale: Column) -> Column:
    return F.lit(MOST) / (1.0 + F.exp(-(lam * size / scale)))


def solve(cells: DataFrame, goals: DataFrame, steps: int = STEPS) -> DataFrame:
    """goals with (lam, scale, full): the dual's solution for each source.

    cells: (source, size, n). Every step is one aggregation over the cells,
    for all sources together; only whether any source is unsettled reaches the
    driver.
    """
    stats = cells.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("words"), F.sum("n").cast("double").alias("docs"))
    state = goals.join(stats, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "source_size", "target", (F.col("words") / F.col("docs")).alias("scale"),
        (F.col("target") >= MOST * F.col("words") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"), F.lit(1.0).alias("gap"),
    )
    state = stage_table(state, "mixing-dual")
    for _ in range(steps):
        open_ones = state.where(~F.col("full") & (F.col("gap") > TOLERANCE)).select(F.col("source").alias("s"), "lam", "scale")
        joined = cells.join(open_ones, F.col("source").eqNullSafe(F.col("s")))
        r, w, x = _rate(F.col("lam"), F.col("size"), F.col("scale")), F.col("n") * F.col("size"), F.col("size") / F.col("scale")
        sums = joined.groupBy("s").agg(F.sum(w * r).alias("got"), F.sum(w * x * r * (1 - r / MOST)).alias("slope"))
        over, lam = F.col("got") - F.col("target"), F.col("lam")
        new = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumns({
            "lo": F.when(over < 0, lam).otherwise(F.col("lo")), "hi": F.when(over > 0, lam).otherwise(F.col("hi")),
            "step": lam - over / F.when(F.col("slope") > 0, F.col("slope")), "over": over,
        })
        inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        new = new.select(
            "source", "source_size", "target", "scale", "full",
            F.when(F.col("over").isNull() | (F.abs("over") <= TOLERANCE * F.col("target")), lam)
            .when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"),
            "lo", "hi", F.when(F.col("over").isNull(), F.lit(0.0)).otherwise(F.abs("over") / F.col("target")).alias("gap"),
        )
        state = stage_table(new, "mixing-dual")
        if state.where(F.col("gap") > TOLERANCE).isEmpty():
            break
    return state.select("source", "source_size", "target", "lam", "scale", "full")


def rates(sized: DataFrame, **how) -> DataFrame:
    """(source, size, n, rate, source_size, target): the rate of every document of that source and size."""
    cells = stage_table(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mixing-cells")
    solved = solve(cells, targets(sized, **how)).withColumnRenamed("source", "s")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("full"), F.lit(MOST)).otherwise(_rate(F.col("lam"), F.col("size"), F.col("scale")))
    # the last digits hang on the order in which partial sums met; reruns must agree
    return cells.join(solved, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", F.round(rate, 12).alias("rate"), "source_size", "target")


def _cut(sized: DataFrame, cells: DataFrame) -> DataFrame:
    """(source, size, cut, some, equals): of cells of which some rows take a further copy, the last such row.

    cells: (source, size, n, extra). equals rows are equal to the cut in order,
    of which some take the copy.
    """
    open_ones = cells.where("extra > 0 and extra < n").select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), "n", "extra")
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))
    rows = sized.groupBy("source", "size", "o").agg(F.count("*").alias("m")).join(open_ones, same).drop("c_source", "c_size")
    # ranges of hashes in order, so many that each has some SALT_ROWS rows
    rows = rows.withColumn("range", F.floor(F.col("o.h") / F.lit(2.0**63) * F.ceil(F.col("n") / SALT_ROWS)))
    rows = stage_table(rows, "mixing-open")
    before = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("source", "size", "range", "extra").agg(F.sum("m").alias("many")).withColumn("skip", F.coalesce(F.sum("many").over(before), F.lit(0)))
    ranges = ranges.where("skip < extra and extra <= skip + many")
    ranges = ranges.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("range").alias("c_range"), "skip")
    rows = rows.join(ranges, same & (F.col("range") == F.col("c_range")))
    within = F.col("skip") + F.sum("m").over(Window.partitionBy("source", "size").orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", within).where("upto - m < extra and extra <= upto")
    return rows.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("o").alias("cut"), (F.col("extra") - F.col("upto") + F.col("m")).alias("some"), F.col("m").alias("equals"))


def plan(sized: DataFrame, **how) -> DataFrame:
    """(source, size, n, rate, source_size, target, base, extra, cut, some, equals): for every cell, how its rows are taken."""
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    cells = rates(sized, **how)
    cells = cells.withColumn("part", F.col("rate") - F.floor("rate")).withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("part")).over(before), F.lit(0.0)))
    cells = stage_table(cells, "mixing-rates", narrow=True)
    # of OFFSETS equal places for the rounding to begin, each source takes the one that comes nearest its target
    begins = F.array(*[F.lit((i + 0.5) / OFFSETS) for i in range(OFFSETS)])
    extra = lambda u: (F.floor(F.col("start") + F.col("n") * F.col("part") + u) - F.floor(F.col("start") + u))
    tried = cells.select("*", F.explode(begins).alias("u"))
    tried = tried.groupBy("source", "target", "u").agg(F.sum(F.col("size") * (F.floor("rate") * F.col("n") + extra(F.col("u")))).alias("got"))
    begin = tried.groupBy("source").agg(F.min(F.struct(F.abs(F.col("got") - F.col("target")).alias("off"), F.col("u").alias("u")))["u"].alias("u")).withColumnRenamed("source", "u_source")
    cells = cells.join(begin, F.col("source").eqNullSafe(F.col("u_source")))
    cells = cells.select("source", "size", "n", "rate", "source_size", "target", F.floor("rate").alias("base"), extra(F.col("u")).alias("extra"))
    cells = stage_table(cells, "mixing-extra", narrow=True)
    cells = cells.join(_cut(sized, cells), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")), "left")
    return stage_table(cells.drop("c_source", "c_size"), "mixing-plan", narrow=True)


def _decided(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (source, size, o, ...) with copies and what the plan says of their cell."""
    few = cells.count() <= BROADCAST_CELLS
    ties = cells.where("some < equals")
    cells = cells.withColumnsRenamed({"source": "c_source", "size": "c_size"})
    same = F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size"))
    rows = rows.join(F.broadcast(cells) if few else cells, same).drop("c_source", "c_size")
    one_more = F.when(F.col("cut").isNull(), F.col("extra") > 0).otherwise((F.col("o") < F.col("cut")) | ((F.col("o") == F.col("cut")) & (F.col("some") == F.col("equals"))))
    sure = rows.withColumn("copies", (F.col("base") + one_more.cast("int")).cast("int"))
    if ties.isEmpty():
        return sure
    # a cut among equal rows: these are numbered; parts are written with them, so that they stay
    at_cut = F.coalesce((F.col("o") == F.col("cut")) & (F.col("some") < F.col("equals")), F.lit(False))
    tied = stage_table(rows.where(at_cut).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("equals") / SALT_ROWS))), "mixing-ties")
    cell = ["source", "size", "salt"]
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    skips = tied.groupBy(*cell).agg(F.count("*").alias("many")).select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("salt").alias("c_salt"), F.coalesce(F.sum("many").over(before), F.lit(0)).alias("skip"))
    tied = tied.join(skips, same & (F.col("salt") == F.col("c_salt")))
    number = F.col("skip") + F.row_number().over(Window.partitionBy(*cell).orderBy("salt"))
    tied = tied.withColumn("copies", (F.col("base") + (number <= F.col("some")).cast("int")).cast("int"))
    return sure.where(~at_cut).unionByName(tied.select(*sure.columns))


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source, source_size, target, rate, copies, taken), one row for each document."""
    sized = stage_table(_keyed(docs), "mixing-sizes")
    rows = _decided(sized, plan(sized, **how))
    return rows.select("doc_id", "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, in its own columns."""
    cells = plan(stage_table(_keyed(docs), "mixing-sizes"), **how)
    # a document is one value here, so that its columns meet no others
    rows = _decided(_keyed(docs, F.struct(*[docs[c] for c in docs.columns]).alias("doc")), cells)
    return rows.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
