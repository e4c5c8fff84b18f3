"""Files, generations, vectors and streams on small folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.session import spread, version_of
from tessera.sources import files, sinks
from tessera.streaming import watcher


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    for name, data in {
        "a.py": b"x = 1\n", "bin.py": b"\x10\x01\x00", "odd.py": b"caf\xe9", "big.py": b"#" * 3000, ".hidden.py": b"x", "node_modules/b.js": b"x", "out/c.py": b"x", "sub/d.rs": b"fn main() {}", "keep.log": b"k", "no.log": b"n", ".gitignore": b"*.log\n!keep.log\nout/\n",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)


def test_walk(spark, project):
    got = {r["path"]: (r["status"], r["language"], r["content"]) for r in files.walk(spark, project, most_bytes=2000).collect()}
    assert set(got) == {"a.py", "bin.py", "odd.py", "big.py", "sub/d.rs", "keep.log"}
    assert got["a.py"] == ("ok", "python", "x = 1\n") and got["bin.py"][0] == "binary" and got["big.py"][0] == "oversize"
    assert got["odd.py"][0] == "lossy" and got["odd.py"][2] == "caf�" and got["sub/d.rs"][1] == "rust"
    assert {r["path"] for r in files.walk(spark, project, exclude=("sub/**",), ignore_file=None).collect()} >= {"out/c.py", "no.log"}
    tree = {r["parent"]: r["children"] for r in files.tree(files.walk(spark, project)).collect()}
    assert tree["sub"] == ["d.rs"] and "sub/" in tree[""]


def test_pruned_generations(spark, tmp_path):
    g = sinks.Generations(spark, str(tmp_path), keep=2)
    for n in range(1, 5):
        g.publish("t", spark.range(n))
    g.rollback("t", 1)
    assert g.prune("t") == 1  # 2; the current one stays, and the newest two
    assert g.load("t").count() == 1
    g.rollback("t", 3)
    assert g.load("t").count() == 3 and g.publish("t", spark.range(9)) == 5


def test_vector_store(spark, tmp_path):
    store = vectors.VectorStore(spark, str(tmp_path), vectors.HashEmbedder(32))
    rows = [(1, "alpha beta gamma"), (2, "alpha beta delta"), (3, "something else here"), (4, ""), (5, None)]
    store.build(spark.createDataFrame(rows, "key long, text string"))
    got = store.search("alpha beta gamma", 2).collect()
    assert got[0]["key"] == 1 and got[0]["score"] == pytest.approx(1.0) and got[1]["key"] == 2
    e = {r["key"]: np.array(r["embedding"]) for r in store.tables.load("vectors").collect()}
    assert all(np.linalg.norm(e[k]) == pytest.approx(1.0) for k in (1, 2, 3)) and not e[4].any() and not e[5].any()
    # unchanged texts keep their vectors, changed ones and deleted ones do not
    assert store.build(spark.createDataFrame([*rows[1:], (6, "alpha beta gamma")], "key long, text string")) == 2
    assert {r["key"] for r in store.search("alpha beta gamma", 1).collect()} == {6}
    assert store.change(spark.createDataFrame([(3, "alpha beta gamma")], "key long, text string"), spark.createDataFrame([(6,)], "key long")) == 3
    assert {r["key"] for r in store.search("alpha beta gamma", 1).collect()} == {3}


def test_serial_apply_and_replay(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"s{i}", float(i), "k")], "scope string, t double, key string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []

    def run():
        q = watcher.apply_serially(watcher.replay(spark, f"{tmp_path}/in"), lambda batch, n: seen.append((n, batch.count())), f"{tmp_path}/check")
        assert q.awaitTermination(60)

    run()
    assert [n for n, _ in seen] == [0, 1, 2] and all(c == 1 for _, c in seen)
    spark.createDataFrame([("late", 9.0, "k")], "scope string, t double, key string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()  # goes on from its checkpoint
    assert seen[3:] == [(3, 1)]


def test_spread_and_versions(spark, tmp_path):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    one.write.parquet(f"{tmp_path}/t")
    before = version_of(spark, f"{tmp_path}/t")
    assert version_of(spark, f"{tmp_path}/t") == before
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/t")
    assert version_of(spark, f"{tmp_path}/t") != before


def test_index_follows_its_table(spark, tmp_path):
    from tessera.operators.search import Index

    at = f"{tmp_path}/docs"
    make = lambda rows, mode: spark.createDataFrame(rows, "doc_id long, text string").write.mode(mode).parquet(at)
    make([(1, "red green"), (2, "red red blue"), (3, None)], "overwrite")
    found = lambda *t: {r["doc_id"] for r in Index.of(spark, at).bm25(list(t)).collect()}
    assert found("red") == {1, 2} and found("blue", "none") == {2} and found("none") == set()
    assert Index.of(spark, at).stats.first()["n"] == 3
    make([(4, "red")], "append")
    assert found("red") == {1, 2, 4}
    assert Index.of(spark, at).postings.where(F.col("term") == "red").count() == 3
