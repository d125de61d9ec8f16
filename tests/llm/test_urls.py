"""Url verdicts on hand-made rows, and cascade membership against plain sets."""

from pyspark.sql import functions as F

from corpuslens.llm.staging import table
from corpuslens.llm.url_queries import RULES, block_list, op8
from corpuslens.llm.urlfilter import build_cascade, host_and_path, judge_urls

listed_host = lambda host: F.array_contains(F.split(host, r"\."), "spam-farm")
SHAPE = "page_id long, url string, host string, rule string, words int"


def test_rules_edges_and_clashing_columns(spark):
    pages = spark.createDataFrame([
        (1, "http://WWW.Example.com/en/x", "h", "r", 1),
        (2, "https://a.example.com/en/?q=/fr/", None, None, 2),
        (3, "ftp://x.net/fr/a#b", None, None, 3),
        (4, "http://m.spam-farm.org/a", None, None, 4),
        (5, "http://ok.org", None, None, 5),
        (6, None, None, None, 6),
        (7, "no scheme", None, None, 7),
        (7, "no scheme", None, None, 7),
        (8, "http://x.com", None, None, 8),
        (None, "", None, None, 9),
        (9, "http://notexample.com/en/", None, None, 9),
        (10, "http://spam-farm.com/", None, None, 9),
    ], SHAPE)
    rows = judge_urls(spark, pages, RULES, listed_host).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r.rule or "-", r.verdict) for r in rows) == [
        (0, "", "", "-", "allow"),
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "x.net", "/fr/a", "net/fr/", "block"),
        (4, "m.spam-farm.org", "/a", "-", "block"),
        (5, "ok.org", "", "-", "allow"),
        (6, "", "", "-", "allow"),
        (7, "", "", "-", "allow"),
        (7, "", "", "-", "allow"),
        (8, "x.com", "", "-", "allow"),
        (9, "notexample.com", "/en/", "com/", "allow"),
        (10, "spam-farm.com", "/", "com/", "allow"),
    ]


def test_empty_table_and_empty_list(spark):
    assert judge_urls(spark, spark.createDataFrame([], SHAPE), RULES, listed_host).count() == 0
    one = spark.createDataFrame([(1, "http://spam-farm.org/", None, None, 1)], SHAPE)
    nothing = spark.createDataFrame([], "key string")
    assert judge_urls(spark, one, [], nothing).first().verdict == "allow"


def test_cascade_is_exact_in_one_and_in_many_blocks(spark):
    universe = spark.range(6000).select(
        F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed")).cache()
    for block_keys in (10_000, 100):
        cascade = build_cascade(spark, universe, block_keys)
        assert cascade.blocks == (1 if block_keys == 10_000 else 9) and len(cascade.words) > 1
        wrong = 0
        for b in range(cascade.blocks):
            mine = universe.filter(cascade.block_of(F.col("key")) == b)
            wrong += mine.filter(cascade.contains(F.col("key"), b) != F.col("listed")).count()
        assert wrong == 0


def test_pages_over_many_blocks_equal_one_block(spark):
    pages = spark.range(400).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 90, F.lit(".org/")).alias("url"))
    listed = spark.range(0, 90, 3).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("key"))
    key = lambda rows: sorted(map(tuple, rows.collect()))
    assert key(judge_urls(spark, pages, [], listed)) == key(judge_urls(spark, pages, [], listed, block_keys=7))


def test_the_list_of_whole_addresses_needs_levels_and_blocks_pages(spark):
    """On a whole table: the cascade has several levels, and rows equal a join with the list."""
    sf = "/root/testdata/sf0.1"
    pages = table(spark, sf, "pages")
    host, path = host_and_path(F.col("url"))
    keys = pages.select(F.concat(host, path).alias("key")).distinct()
    listed = block_list(pages)
    universe = keys.join(listed.withColumn("listed", F.lit(True)), "key", "left").fillna(False)
    cascade = build_cascade(spark, universe)
    n = listed.count()
    assert 100 < n < keys.count() / 2 and len(cascade.words) >= 3
    rows = op8(spark, sf)
    open_ = rows.filter("rule IS NULL").withColumn("key", F.concat("host", "path"))
    blocked = open_.join(listed, "key", "left_semi")
    assert blocked.count() == open_.filter("verdict = 'block'").count() == blocked.filter("verdict = 'block'").count() > 20
    assert open_.filter("verdict = 'allow'").count() > blocked.count()
