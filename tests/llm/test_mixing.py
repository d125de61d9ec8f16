"""The mix against its SQL, its targets, its tree, and its defined cases."""

import random
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm.mixing import Mixture, _split, block_draws, mixed, shard_quotas, source_targets, words_of

SHAPE = "target int, doc_id long, text string, source string, shard int, hash string, block int"


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    """Excess is reshared by weight until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and most * sizes[s] < left * weight[s] / open_}
        if not over:
            return {s: most * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        full |= over


def corpus(spark, n=1500):
    draw = random.Random(4)
    names = ["hot"] * 12 + ["b", "é", None, "z", "a", "tiny"]
    rows = [(1, i, " \n".join("w" for _ in range(int(draw.paretovariate(1.2) * 8))), names[draw.randrange(len(names))], 7, "x", 3) for i in range(n)]
    rows += [(1, 5, "same row twice", "b", 7, "x", 3)] * 2 + [(1, None, "no id", "b", 7, "x", 3), (1, 90_000, None, "b", 7, "x", 3),
             (1, 90_001, "", "nothing", 7, "x", 3), (1, 90_002, "one " * 30_000, "hot", 7, "x", 3)]
    return spark.createDataFrame(rows, SHAPE).repartition(5)


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 1000}, {"a": 1, "b": 1, "c": 100, "d": 2, None: 50},
    {"a": 0, "b": 7}, {"a": 0}, {"x": 5}, {chr(97 + i): 2 ** i for i in range(12)}])
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in source_targets(spark, rows).collect()}
    assert found == pytest.approx(slow_targets(sizes))


def test_mix_comes_near_its_targets_and_its_files_hold_what_it_says(spark, tmp_path):
    docs = corpus(spark)
    folder = str(tmp_path / "mix")
    rows = mixed(spark, docs, folder, shard_words=4000).collect()
    assert len(rows) == docs.count()
    for source in {r.source for r in rows}:
        of = [r for r in rows if r.source == source]
        taken, target = sum(r.taken for r in of), of[0].target
        assert of[0].source_size == sum(r.size for r in of)
        assert abs(taken - target) <= max(0.01 * target, 10)
    assert all(r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in rows)
    files = spark.read.parquet(folder)
    words = files.withColumn("n", words_of(files.text)).groupBy("shard").sum("n").collect()
    assert sum(r[1] for r in words) == sum(r.taken for r in rows) and len(words) > 10
    again = mixed(spark, docs, str(tmp_path / "again"), shard_words=4000).collect()
    assert Counter(again) == Counter(rows)
    kept = lambda path: sorted(map(str, spark.read.parquet(path).select("shard", "place", "pass", "doc_id", "text").collect()))
    assert kept(folder) == kept(str(tmp_path / "again"))


def test_shards_are_shuffled_and_balanced_in_blocks(spark, tmp_path):
    mix = Mixture(spark, corpus(spark), shard_words=4000)
    mix.write(str(tmp_path / "mix"))
    blocks = Counter(c.shard for r in mix.plan.collect() for c in r.copies)
    assert set(blocks) == set(range(mix.shards)) and max(blocks.values()) - min(blocks.values()) <= 1
    for shard in range(3):
        places = [r.place for r in spark.read.parquet(str(tmp_path / "mix" / f"shard={shard}")).select("place").collect()]
        assert places == sorted(places)


def test_blocks_drawn_are_whole_passes_and_the_rest(spark):
    blocks = spark.createDataFrame([(0, b, w) for b, w in enumerate([10, 20, 5, 40, 7])] + [(1, 0, 4)], "number long, block long, words long")
    sources = spark.createDataFrame([(0, 82, 82.0 + 43.0), (1, 4, 12.0)], "number long, source_size long, target double")
    times = {(r.number, r.block): r.times for r in block_draws(blocks, sources).collect()}
    # one pass; 10 + 20 + 5 fit in 43, then 7 comes nearest to the 8 left
    assert times == {(0, 0): 2, (0, 1): 2, (0, 2): 2, (0, 3): 1, (0, 4): 2, (1, 0): 3}


def test_tree_deals_every_draw_once_whoever_walks_it(spark):
    quota = {3: 1000, 5: 1, 6: 77, 9: 0, 11: 5000}
    rows = [tuple(r) for r in shard_quotas(spark, quota, 37, 1).collect()]
    held = np.array([quota[n] for n in sorted(quota)])
    whole = [(s, n, f, c) for s, first, count in _split(held, 37, 1, range(37))
             for n, f, c in zip(sorted(quota), first.tolist(), count.tolist()) if c]
    assert sorted(rows) == sorted(whole)
    for n, q in quota.items():
        runs = sorted((f, c) for _, m, f, c in rows if m == n)
        assert [f for f, _ in runs] == [sum(c for _, c in runs[:i]) for i in range(len(runs))] and sum(c for _, c in runs) == q
    per_shard = Counter()
    for s, _, _, c in rows:
        per_shard[s] += c
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


def test_tree_draws_have_the_mean_and_spread_of_the_distribution():
    quota = np.array([600, 300, 100])
    first = np.array([next(_split(quota, 4, seed, range(1)))[2] for seed in range(800)])
    assert first.sum(1).tolist() == [250] * 800
    share = quota / 1000
    assert np.allclose(first.mean(0), 250 * share, atol=1.0)
    assert np.allclose(first.var(0), 250 * share * (1 - share) * 750 / 999, rtol=0.2)


def test_empty_tables(spark):
    docs = corpus(spark, 10)
    assert mixed(spark, docs.limit(0)).collect() == []
    rows = mixed(spark, docs.filter("text IS NULL OR text = ''")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in rows) == [(90_000, 0, 0.0, 0), (90_001, 0, 0.0, 0)]
