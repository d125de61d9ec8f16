"""Resampling against scores of all documents sorted in one list, and its defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.llm.importance import _key, features, kth_key, resample
from corpuslens.llm.staging import numbered

SHAPE = "score int, doc_id long, text string, rank string, row int, key int"


def slow_features(text, longest):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def slow_resample(docs, items, percent, least, longest):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in slow_features(t, longest)[1])
    t = Counter(bucket(f) for x in items for f in slow_features(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for i, text in docs:
        words, found = slow_features(text, longest)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    apt = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = apt[:percent * len(apt) // 100]
    return Counter([(*r, n + 1) for n, r in enumerate(drawn)]) + Counter((*r, None) for r in apt[len(drawn):]) + Counter(
        (*r, None) for r in rows if r[1] < least)


def sample():
    draw = random.Random(13)
    word = lambda: draw.choice(["a", "B", "the", "thé", "x9", "日本"] + [f"w{i}" for i in range(300)])
    docs = [(i, " ".join(word() for _ in range(draw.randrange(0, 60)))) for i in range(400)]
    docs += [(700, "w1 w2 w3 w4 " * 6)] * 90 + [(None, "w1 w2 " * 15)] * 3 + [(701, None), (702, ""), (703, "... !"), (704, "w5 " * 50_000)]
    items = [" ".join(word() for _ in range(20)) for _ in range(10)] + [None, "", "w1 W2 w3"]
    return docs, items


def given(spark, docs, items):
    d = spark.createDataFrame([(1, i, t, "x", 2, 3) for i, t in docs], SHAPE).repartition(4)
    return d, spark.createDataFrame([(1, 2, t, "x", 2, 3) for t in items], SHAPE)


@pytest.mark.parametrize("percent, least, longest", [(10, 20, 1), (37, 5, 2), (100, 0, 1), (0, 20, 1)])
def test_equal_to_brute_force(spark, percent, least, longest):
    docs, items = sample()
    d, b = given(spark, docs, items)
    rows = resample(spark, d, b, percent, least, longest)
    assert rows.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, rows.collect())) == slow_resample(docs, items, percent, least, longest)


def test_empty_tables(spark):
    d, b = given(spark, *sample())
    assert resample(spark, d.limit(0), b).collect() == []
    assert {r["rank"] for r in resample(spark, d.filter("doc_id < 3"), b).collect()} == {None}
    docs = sample()[0]
    assert Counter(map(tuple, resample(spark, d, b.limit(0)).collect())) == slow_resample(docs, [], 10, 20, 1)


def test_features_are_runs_of_words():
    assert features([b"a", b"b", b"c"], 1) == [b"a", b"b", b"c"]
    assert features([b"a", b"b", b"c"], 3) == [b"a", b"b", b"c", b"a b", b"b c", b"a b c"]
    assert features([], 2) == [] == features([], 1)


@pytest.mark.parametrize("k", [1, 2, 499, 500, 501, 999, 1000])
def test_quickselect_finds_every_place(spark, k):
    rows = spark.range(1000).select((F.col("id") % 7).alias("score"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("doc_id"), F.col("id").alias("row"))
    order = sorted(rows.collect(), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0, r.row))
    keyed = rows.withColumn("key", _key())
    found = keyed.filter(F.col("key") == kth_key(spark, keyed.select("key"), k, pivots=3)).collect()
    assert [r.row for r in found] == [order[k - 1].row]


def test_numbers_follow_the_order(spark):
    rows = spark.range(2000, numPartitions=9).select((F.col("id") * 7919 % 2000).alias("x"), F.lit("n").alias("_range"))
    found = numbered(spark, rows, [F.desc("x")], "numbered").collect()
    assert sorted((r.number, r.x) for r in found) == [(i, 1999 - i) for i in range(2000)]
