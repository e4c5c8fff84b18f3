"""Differences between two versions of definitions, and what a finding means beside earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import staged

RENAME_AT = 0.8


def _bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring bytes, as hex."""
    h = F.hex(F.encode(c, "UTF-8"))
    many = F.greatest(F.octet_length(c) - 1, F.lit(0))
    return F.array_distinct(F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring(h, 2 * i + 1, F.lit(4)))).otherwise(F.array().cast("array<string>")))


def _jaccard(a: Column, b: Column) -> Column:
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / whole)


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the sets of lines; if that is 0 and neither has over two lines, of the sets of byte bigrams."""
    la, lb = F.array_distinct(F.split(a, "\n")), F.array_distinct(F.split(b, "\n"))
    lines = _jaccard(la, lb)
    short = (F.size(F.split(a, "\n")) <= 2) & (F.size(F.split(b, "\n")) <= 2)
    return F.when((lines == 0) & short, _jaccard(_bigrams(a), _bigrams(b))).otherwise(lines)


def structural(old: DataFrame, new: DataFrame, threshold: float = RENAME_AT) -> DataFrame:
    """(kind, old_name, new_name, change) of definitions (kind, name, line, body).

    Equal (kind, name): update where bodies differ, move where only lines do,
    else nothing. What is left over is renamed where similarity reaches the
    threshold, each definition to its best partner if they choose each other
    (ties by name); the rest was deleted or inserted. Candidates for a rename
    are distinct bodies that share a kind and a line, so neither a kind nor equal
    bodies are multiplied out; bodies of one or two lines share a byte bigram instead.
    """
    a = old.select("kind", "name", F.col("line").alias("l_line"), F.col("body").alias("l_body"))
    b = new.select("kind", "name", F.col("line").alias("r_line"), F.col("body").alias("r_body"))
    both = a.join(b, ["kind", "name"])
    change = F.when(F.col("l_body") != F.col("r_body"), "update").when(F.col("l_line") != F.col("r_line"), "move")
    same = both.select("kind", F.col("name").alias("old_name"), F.col("name").alias("new_name"), change.alias("change")).where("change is not null")
    gone = a.join(b, ["kind", "name"], "left_anti").select("kind", F.col("name").alias("old_name"), "l_body")
    come = b.join(a, ["kind", "name"], "left_anti").select("kind", F.col("name").alias("new_name"), "r_body")
    # definitions of one kind with equal bodies are alike to the same others, so bodies are compared, once each
    bodies = lambda d, body, name, first: staged(d.where(F.col(name).isNotNull()).groupBy("kind", body).agg(F.min(name).alias(first)), "diff-bodies")
    l_bodies, r_bodies = bodies(gone, "l_body", "old_name", "l_first"), bodies(come, "r_body", "new_name", "r_first")
    parts = lambda c: F.explode(F.array_distinct(F.concat(F.split(c, "\n"), F.when(F.size(F.split(c, "\n")) <= 2, _bigrams(F.col(c))).otherwise(F.array().cast("array<string>")))))
    met = l_bodies.select("kind", "l_body", parts("l_body").alias("part")).join(r_bodies.select("kind", "r_body", parts("r_body").alias("part")), ["kind", "part"]).select("kind", "l_body", "r_body").distinct()
    scored = met.withColumn("s", text_similarity(F.col("l_body"), F.col("r_body"))).where(F.col("s") >= threshold)
    scored = staged(scored.join(l_bodies, ["kind", "l_body"]).join(r_bodies, ["kind", "r_body"]), "diff-alike")
    # of the bodies most alike to its own, a definition's best partner has the one whose first name is least
    lead = lambda body, first: scored.groupBy("kind", body).agg(F.min(F.struct((-F.col("s")).alias("s"), F.col(first).alias("name"))).alias("best"))
    choose = lambda d, body, name, first, other: d.join(lead(body, first), ["kind", body]).groupBy("kind", name).agg(F.min("best")["name"].alias(other))
    l_best, r_best = choose(gone, "l_body", "old_name", "r_first", "new_name"), choose(come, "r_body", "new_name", "l_first", "old_name")
    renamed = l_best.join(r_best, ["kind", "old_name", "new_name"]).select("kind", "old_name", "new_name", F.lit("rename").alias("change"))
    none = F.lit(None).cast("string")
    out = gone.join(renamed, ["kind", "old_name"], "left_anti").select("kind", "old_name", none.alias("new_name"), F.lit("delete").alias("change"))
    into = come.join(renamed, ["kind", "new_name"], "left_anti").select("kind", none.alias("old_name"), "new_name", F.lit("insert").alias("change"))
    return same.unionByName(renamed).unionByName(out).unionByName(into)


def prioritised(findings: DataFrame, most: int = 50) -> DataFrame:
    """Findings (file, func, line, kind, severity) after suppression, the most severe first, at most `most`.

    born_dead suppresses all others of its function; taint_flow suppresses
    vulnerability at the same place; repeated ones count once.
    """
    f = findings.select("file", "func", "line", "kind", "severity").distinct()
    dead = f.where("kind = 'born_dead'").select("file", "func").distinct()
    taint = f.where("kind = 'taint_flow'").select("file", "line").distinct()
    rest = f.where("kind <> 'born_dead'").join(dead, ["file", "func"], "left_anti")
    rest = rest.where("kind <> 'vulnerability'").unionByName(rest.where("kind = 'vulnerability'").join(taint, ["file", "line"], "left_anti"))
    return f.where("kind = 'born_dead'").unionByName(rest).orderBy(F.desc("severity"), "file", "line", "func", "kind").limit(most)


def batch_windows(tokens: DataFrame, size: int, overlap: int = 16) -> DataFrame:
    """(id, nth, window) of (id, tokens): windows of `size` tokens that overlap; a short list is one window."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be below size")
    n = F.size("tokens")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - overlap) / step).cast("int") - 1, F.lit(0)))
    d = tokens.select("id", "tokens", F.posexplode(F.transform(starts, lambda i: i * step)).alias("nth", "at"))
    return d.select("id", "nth", F.slice("tokens", F.col("at") + 1, F.lit(size)).alias("window"))


def reconciled(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, anchor, revision, action): identities of chunks (chunk_id, anchor, revision) kept across an edit.

    A chunk with the same anchor keeps its id (keep, or edit if its revision
    differs); one whose anchor is new takes over the id of a vanished chunk
    with its revision (moved; ties by anchor); others are new, named by a hash
    of anchor and revision; the rest of the old ones is dropped.
    """
    o = old.select("chunk_id", "anchor", F.col("revision").alias("was"))
    kept = o.join(new.select("anchor", "revision"), "anchor")
    stay = kept.select("chunk_id", "anchor", "revision", F.when(F.col("was") == F.col("revision"), "keep").otherwise("edit").alias("action"))
    left = o.join(new.select("anchor"), "anchor", "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("was").orderBy("anchor")))
    come = new.select("anchor", "revision").join(o.select("anchor"), "anchor", "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("revision").orderBy("anchor")))
    prior = left.select("chunk_id", F.col("was").alias("revision"), "nth")
    moved = come.join(prior, ["revision", "nth"], "left")
    fresh = F.sha2(F.concat_ws("|", "anchor", "revision"), 256).substr(1, 16)
    moved = moved.select(F.coalesce("chunk_id", fresh).alias("chunk_id"), "anchor", "revision", F.when(F.col("chunk_id").isNotNull(), "moved").otherwise("add").alias("action"))
    drop = left.join(come.select(F.col("revision").alias("was"), "nth"), ["was", "nth"], "left_anti").select("chunk_id", "anchor", F.col("was").alias("revision"), F.lit("drop").alias("action"))
    return stay.unionByName(moved).unionByName(drop)


def rollout(metrics: DataFrame, least_gain: float = 0.0, most_loss: float = 0.01) -> DataFrame:
    """One row (decision) of (metric, baseline, candidate, guard): reject on a guard's loss, accept on a gain, else hold."""
    d = F.col("candidate") - F.col("baseline")
    bad, good = F.max((F.col("guard") & (d < -most_loss)).cast("int")), F.max((~F.col("guard") & (d > least_gain)).cast("int"))
    return metrics.agg(F.when(bad == 1, "reject").when(good == 1, "accept").otherwise("hold").alias("decision"))
