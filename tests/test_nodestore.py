"""The content-addressed store of nodes, and dealing by size."""

import pytest
from pyspark.sql import functions as F

from corpuslens.sources.dealing import dealt_by_size
from corpuslens.sources.nodestore import NodeStore
from corpuslens.sources.syntax import syntax_nodes

SHAPE = "path string, content string"


def kinds(rows):
    return sorted((r.path, r.kind, r.name, r.bfs) for r in rows.select("path", "kind", "name", "bfs").collect())


def test_versions_hold_what_a_full_parse_would(spark, tmp_path):
    store = NodeStore(spark, str(tmp_path))
    assert store.versions() == [] and store.nodes().count() == 0
    one = [(f"a/{i}.py", f"def f{i % 5}():\n    x = 'SELECT'\n") for i in range(12)] + [("bad.py", "def ("), ("none.py", None), ("empty.py", "")]
    two = [("b/0.py", one[0][1]), ("a/1.py", one[1][1] + "y = 1\n"), *one[2:], ("new.py", "class K:\n    pass\n")]
    for version, files, parsed in ((0, one, 7), (1, two, 2), (2, [], 0), (3, one, 0)):
        rows = spark.createDataFrame(files, SHAPE)
        assert store.update(rows, tasks=3) == version
        assert store.blobs(version).count() == parsed
        assert kinds(store.by_path(store.nodes())) == kinds(syntax_nodes(rows.filter("content IS NOT NULL")))
        assert store.current_nodes().select("path").distinct().count() == len({c for _, c in files if c is not None})
        assert sorted(r.path for r in store.listing().collect()) == sorted(p for p, _ in files)
    assert store.versions() == [0, 1, 2, 3] and store.listing(1).count() == len(two)


def test_an_update_that_fails_is_not_read(spark, tmp_path, monkeypatch):
    store = NodeStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a.py", "x = 1\n"), ("b.py", "def f(): pass\n")], SHAPE)
    real = store._read
    store.update(rows)
    more = rows.unionByName(spark.createDataFrame([("c.py", "def g(): pass\n")], SHAPE))
    with monkeypatch.context() as m:
        m.setattr(store, "_read", lambda kind, versions, shape: (_ for _ in ()).throw(RuntimeError()) if kind == "blobs" else real(kind, versions, shape))
        with pytest.raises(RuntimeError):
            store.update(more)
    # nodes and blobs of a version without a listing
    spark.createDataFrame([("x",)], "blob string").write.parquet(str(tmp_path / "blobs" / "1"))
    assert store.versions() == [0] and store.blobs().count() == 2
    assert store.update(more) == 1 and store.blobs(1).count() == 1 and store.listing().count() == 3
    assert kinds(store.by_path(store.nodes())) == kinds(syntax_nodes(more))


@pytest.mark.parametrize("tasks", [1, 7, 16])
def test_tasks_are_of_about_equal_size(spark, tasks):
    rows = spark.range(4000).select(
        F.concat(F.lit("p"), "id").alias("path"), F.when(F.col("id") == 17, 60_000).when(F.col("id") % 400 == 3, 5_000).otherwise(F.col("id") % 90).alias("n"),
        F.lit("x").alias("size"))
    dealt = dealt_by_size(rows, "path", F.col("n"), tasks)
    loads = dealt.groupBy(F.spark_partition_id().alias("at")).agg(F.sum("n").alias("load"), F.max("n").alias("largest"), F.count("*").alias("c"),
                                                                  F.count_distinct("task").alias("t")).collect()
    total = sum(r.load for r in loads)
    assert sum(r.c for r in loads) == 4000 and all(r.t == 1 for r in loads) and len(loads) <= tasks
    slot = total / (tasks * 64)
    assert all(r.load <= total / tasks + r.largest + 8 * slot + 5_000 for r in loads)
    assert dealt.drop("task").columns == ["path", "n", "size"]


def test_dealing_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame([("a", None), (None, 3), (None, 3), ("b", 0)], "path string, n int")
    assert dealt_by_size(rows, "path", F.col("n"), 4).count() == 4
    assert dealt_by_size(rows.limit(0), "path", F.col("n"), 4).count() == 0
    assert dealt_by_size(rows.filter("n = 0"), "path", F.col("n"), 4).count() == 1


def test_dealing_follows_the_cluster(spark):
    rows = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(5).alias("n"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt_by_size(rows, "path", F.col("n"))
    assert dealt.select(F.spark_partition_id()).distinct().count() == tasks
