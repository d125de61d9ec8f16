"""Sketches that are kept: only changed buckets are made anew; and the strict SQL test."""

from pyspark.sql import functions as F

from corpuslens.operators import entities, sketches, sqltext
from corpuslens.sources.syntax import syntax_nodes


def corpus(spark, files):
    rows = spark.createDataFrame(files, "path string, content string")
    return syntax_nodes(rows), rows.select("path", F.sha2("content", 256).alias("blob"))


def counts(rows):
    return {r.metric: r["count"] for r in rows.collect()}


def test_only_changed_buckets_are_read_again(spark, tmp_path):
    script = "def f{i}():\n    y{i} = df.groupby(1)\nx = 'a/{i}.csv'\nq = 'SELECT {i} FROM t'\ndb.sql(q)\n"
    files = [(f"p{i}.py", script.format(i=i % 700)) for i in range(900)]
    folder = str(tmp_path / "s")
    assert len(sketches.update(spark, folder, *corpus(spark, files))) == 64
    assert sketches.update(spark, folder, *corpus(spark, files[::-1])) == []
    exact = counts(entities.overview(corpus(spark, files)[0]))
    got = counts(sketches.overview(sketches.read(spark, folder)))
    assert exact["Files"] == got["Files"] == 900 and exact["Transformations"] == got["Transformations"] == 1800
    assert all(abs(got[m] - exact[m]) <= sketches.BOUND * exact[m] for m in exact) and exact["Functions"] == 700
    # one file changes, one goes, one comes
    later = [("p0.py", "z = 1\n"), *files[2:], ("new.py", "def brand_new(): pass\n")]
    places = {r.path: r.b for r in spark.createDataFrame([("p0.py",), ("p1.py",), ("new.py",)], "path string").select(
        "path", sketches.bucket_of("path").alias("b")).collect()}
    nodes, listing = corpus(spark, later)
    assert sketches.update(spark, folder, nodes, listing) == sorted(set(places.values()))
    fresh = sketches.overview(sketches.bucket_sketches(nodes))
    assert counts(sketches.overview(sketches.read(spark, folder))) == counts(fresh)
    # an empty corpus
    assert len(sketches.update(spark, folder, nodes.limit(0), listing.limit(0))) == 64
    assert set(counts(sketches.overview(sketches.read(spark, folder))).values()) == {0}
    assert sketches.update(spark, folder, nodes.limit(0), listing.limit(0)) == []


def test_overview_of_nothing_has_every_metric(spark):
    nodes, _ = corpus(spark, [("a.py", "def (")])
    assert counts(entities.overview(nodes)) == dict.fromkeys(entities.OVERVIEW_METRICS, 0)


STATEMENTS = {
    "SELECT 1 FROM t": True, " select a.b, 'x; y' from t where c in (select d from e) ;": True, "SELECT FROM t": False, "SELECT a": False,
    "select (a) from (b)": True, "SELECT a FROM t; ;": True, "SELECT a FROM t; SELECT b FROM u": False, "": False, "from here": False,
    "WITH a AS (SELECT 1) SELECT * FROM a": True, "WITH a (x, y) AS (SELECT 1), b AS (SELECT 2) INSERT INTO t SELECT 1 FROM a": True, "with a select": False,
    "INSERT INTO t VALUES (1)": True, "INSERT INTO t (a) SELECT b FROM c": True, "insert t": False, "UPDATE t SET a = 1": True, "UPDATE t": False,
    "DELETE FROM t": True, "delete t": False, "CREATE TABLE t (a int)": True, "create or replace temporary table t as select 1": True, "CREATE VIEW v": False,
    "SELECT a FROM t)": False, "SELECT a) FROM t": False, "SELECT (a FROM t": False, "-- note\nSELECT a -- FROM\nFROM t": True, "SELECT `from` FROM \"t\"": True,
    "(SELECT a FROM t)": False, "SELECT 'it''s' FROM t": True, "Please update the set, from now on": False, "SELECT a FROM": False,
}


def test_strict_statement(spark):
    rows = spark.createDataFrame([(t,) for t in [None, *STATEMENTS]], "t string").select("t", sqltext.is_statement(F.col("t")).alias("s"))
    assert {r.t: r.s for r in rows.collect()} == STATEMENTS | {None: False}


def test_a_long_text_is_folded_whole(spark):
    row = spark.range(1).select(F.concat(F.lit("SELECT a FROM t WHERE b IN ("), F.repeat(F.lit("'x y', "), 100_000), F.lit("'z'")).alias("t"))
    assert [tuple(r) for r in row.select(sqltext.is_statement(F.col("t")), sqltext.is_statement(F.concat("t", F.lit(")")))).collect()] == [(False, True)]
