"""Queries over two versions of a table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import diffs
from tessera.plans.registry import query
from tessera.session import table

#: Parts as definitions: the old version lacks every 7th, the new one every 11th; every 5th changed its body, every 3rd its line.
OLD_SQL = "old AS (SELECT p_brand AS kind, p_name || p_partkey AS name, p_size AS line, p_type AS body FROM part WHERE p_partkey % 7 <> 0)"
NEW_SQL = "new AS (SELECT p_brand AS kind, p_name || p_partkey AS name, p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS line, p_type || CASE WHEN p_partkey % 5 = 0 THEN '!' ELSE '' END AS body FROM part WHERE p_partkey % 11 <> 0)"


def _versions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name, k = F.concat(F.col("p_name"), F.col("p_partkey").cast("string")), F.col("p_partkey")
    old = p.where(k % 7 != 0).select(F.col("p_brand").alias("kind"), name.alias("name"), F.col("p_size").alias("line"), F.col("p_type").alias("body"))
    new = p.where(k % 11 != 0).select(
        F.col("p_brand").alias("kind"), name.alias("name"), (F.col("p_size") + F.when(k % 3 == 0, 1).otherwise(0)).alias("line"),
        F.concat(F.col("p_type"), F.when(k % 5 == 0, "!").otherwise("")).alias("body"),
    )
    return old, new


@query("structural_diff_same", f"""WITH {OLD_SQL}, {NEW_SQL} SELECT kind, o.name, CASE WHEN o.body <> n.body THEN 'update' ELSE 'move' END AS change
FROM old o JOIN new n USING (kind, name) WHERE o.body <> n.body OR o.line <> n.line""")
def structural_diff_same(spark, sf_dir):
    """Definitions that kept their names and changed."""
    d = diffs.structural(*_versions(spark, sf_dir)).where(F.col("change").isin("update", "move"))
    return d.select("kind", F.col("old_name").alias("name"), "change")


@query("structural_diff")
def structural_diff(spark, sf_dir):
    """All changes, renames included; renames need mutual best partners, so there is no SQL beside it."""
    return diffs.structural(*_versions(spark, sf_dir))


LINES = "list_distinct(string_split({}, chr(10)))"


@query("text_similarity", f"""WITH p AS (SELECT a.doc_id, a.text AS a, b.text AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
 s AS (SELECT doc_id, len(list_intersect({LINES.format('a')}, {LINES.format('b')})) AS common, len({LINES.format('a')}) AS na, len({LINES.format('b')}) AS nb, len(string_split(a, chr(10))) AS la, len(string_split(b, chr(10))) AS lb FROM p)
SELECT doc_id, round(common / (na + nb - common), 6) AS similarity FROM s WHERE la > 2 OR lb > 2""")
def text_similarity(spark, sf_dir):
    """Documents of several lines against the next one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    lines = lambda c: F.size(F.split(c, "\n"))
    j = d.join(n, "doc_id").where((lines("text") > 2) | (lines("other") > 2))
    return j.select("doc_id", F.round(diffs.text_similarity(F.col("text"), F.col("other")), 6).alias("similarity"))


@query("finding_priority", """WITH f AS (SELECT DISTINCT event_type AS file, user_id AS func, (epoch_us(ts) // 60000000) % 40 AS line, CASE event_id % 6 WHEN 0 THEN 'taint_flow' WHEN 1 THEN 'vulnerability' WHEN 2 THEN 'smell' ELSE 'style' END AS kind, event_id % 4 AS severity FROM events
 UNION SELECT DISTINCT event_type, user_id, 0, 'born_dead', 9 FROM events WHERE value > 99),
 d AS (SELECT DISTINCT file, func FROM f WHERE kind = 'born_dead'), t AS (SELECT DISTINCT x.file, x.line FROM f x WHERE kind = 'taint_flow'),
 r AS (SELECT * FROM f WHERE kind = 'born_dead' UNION ALL SELECT f.* FROM f ANTI JOIN d ON d.file = f.file AND d.func = f.func WHERE kind <> 'born_dead' AND NOT (kind = 'vulnerability' AND EXISTS (SELECT 1 FROM t WHERE t.file = f.file AND t.line = f.line)))
SELECT file, func, line, kind, severity FROM r ORDER BY severity DESC, file, line, func, kind LIMIT 50""")
def finding_priority(spark, sf_dir):
    from tessera.functions.scores import micros

    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 6
    kind = F.when(k == 0, "taint_flow").when(k == 1, "vulnerability").when(k == 2, "smell").otherwise("style")
    line = F.floor(micros(F.col("ts")) / 60_000_000).cast("long") % 40
    f = e.select(F.col("event_type").alias("file"), F.col("user_id").alias("func"), line.alias("line"), kind.alias("kind"), (F.col("event_id") % 4).alias("severity"))
    dead = e.where("value > 99").select(F.col("event_type").alias("file"), F.col("user_id").alias("func"), F.lit(0).cast("long").alias("line"), F.lit("born_dead").alias("kind"), F.lit(9).cast("long").alias("severity"))
    return diffs.prioritised(f.unionByName(dead))


@query("token_windows", """WITH t AS (SELECT doc_id AS id, list_filter(string_split_regex(text, '[ \\n]'), lambda w: w <> '') AS toks FROM documents),
 s AS (SELECT id, toks, unnest(range(0, greatest(ceil((len(toks) - 16) / 112.0)::INT, 1))) AS nth FROM t)
SELECT id, nth::INT AS nth, array_to_string(toks[nth * 112 + 1 : nth * 112 + 128], ' ') AS part FROM s""")
def token_windows(spark, sf_dir):
    """Windows of 128 words that overlap by 16."""
    toks = F.filter(F.split("text", "[ \n]"), lambda w: w != "")
    d = diffs.batch_windows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), toks.alias("tokens")), 128)
    return d.select("id", "nth", F.array_join("window", " ").alias("part"))


@query("lineage", """WITH o AS (SELECT p_partkey::VARCHAR AS chunk_id, p_name || p_partkey AS anchor, p_partkey % 50 AS was FROM part WHERE p_partkey % 4 <> 0),
 n AS (SELECT p_name || p_partkey AS anchor, (p_partkey + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END) % 50 AS revision FROM part WHERE p_partkey % 6 <> 1),
 l AS (SELECT *, row_number() OVER (PARTITION BY was ORDER BY anchor) AS nth FROM o WHERE anchor NOT IN (SELECT anchor FROM n)),
 c AS (SELECT *, row_number() OVER (PARTITION BY revision ORDER BY anchor) AS nth FROM n WHERE anchor NOT IN (SELECT anchor FROM o))
SELECT chunk_id, anchor, CASE WHEN was = revision THEN 'keep' ELSE 'edit' END AS action FROM o JOIN n USING (anchor)
UNION ALL SELECT coalesce(chunk_id, substr(sha256(c.anchor || '|' || revision), 1, 16)), c.anchor, CASE WHEN chunk_id IS NULL THEN 'add' ELSE 'moved' END FROM c LEFT JOIN l ON l.was = c.revision AND l.nth = c.nth
UNION ALL SELECT chunk_id, l.anchor, 'drop' FROM l ANTI JOIN c ON l.was = c.revision AND l.nth = c.nth""")
def lineage(spark, sf_dir):
    """Chunk identities across two generations of parts."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    anchor = F.concat(F.col("p_name"), k.cast("string")).alias("anchor")
    old = p.where(k % 4 != 0).select(k.cast("string").alias("chunk_id"), anchor, (k % 50).alias("revision"))
    new = p.where(k % 6 != 1).select(anchor, ((k + F.when(k % 9 == 0, 1).otherwise(0)) % 50).alias("revision"))
    return diffs.reconciled(old, new).select("chunk_id", "anchor", "action")


@query("rollout_gate", """WITH m AS (SELECT lang AS metric, avg(n_chars % 7) / 7 AS baseline, avg(n_chars % 5) / 5 AS candidate, lang <> 'en' AS guard FROM documents GROUP BY lang)
SELECT CASE WHEN bool_or(guard AND candidate - baseline < -0.01) THEN 'reject' WHEN bool_or(NOT guard AND candidate - baseline > 0) THEN 'accept' ELSE 'hold' END AS decision FROM m""")
def rollout_gate(spark, sf_dir):
    n = F.col("n_chars")
    m = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("metric")).agg((F.avg(n % 7) / 7).alias("baseline"), (F.avg(n % 5) / 5).alias("candidate"))
    return diffs.rollout(m.withColumn("guard", F.col("metric") != "en"))


@query("json_cache_key", """SELECT event_id, sha256('{"type":"' || event_type || '","user":"' || user_id || '"}') AS key FROM events""")
def json_cache_key(spark, sf_dir):
    """Keys of argument maps, whatever their order."""
    from tessera.sources.sinks import cache_key

    e = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("args"))
    return e.select("event_id", cache_key(F.col("args")).alias("key"))
