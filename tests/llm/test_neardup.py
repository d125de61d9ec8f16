"""Near duplicates against all pairs compared one by one, sketch statistics, defined cases."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from corpuslens.llm import neardup as nd

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def weights(text):
    w = words(text)
    counts = Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {k: 1 + math.log(n) for k, n in counts.items()}


def slow_similarity(x, y):
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total


def slow_classes(texts):
    """Smallest index of each component of pairs at 0.8 or more; only pairs that share a shingle can be."""
    sets = [weights(t) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for k in s:
            holders.setdefault(k, []).append(i)
    shared = Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for (i, j), n in shared.items():
        if n >= 0.5 * max(len(sets[i]), len(sets[j])) and slow_similarity(sets[i], sets[j]) >= 0.8 - 1e-9:
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_similarity_equals_the_formula():
    draw = random.Random(0)
    for _ in range(300):
        x, y = ({k: 1 + math.log(draw.randrange(1, 5)) for k in draw.sample(range(20), draw.randrange(1, 15))} for _ in range(2))
        as_set = lambda s: (np.array(sorted(s), np.uint64), np.array([s[k] for k in sorted(s)]))
        assert math.isclose(nd.similarity(as_set(x), as_set(y)), slow_similarity(x, y), abs_tol=1e-12)


def test_registers_agree_as_often_as_the_similarity():
    draw = np.random.default_rng(0)
    elements = draw.integers(0, 2 ** 63, 300).astype(np.uint64)
    for cut in (0, 30, 100):
        a, b = np.sort(elements[:250]), np.sort(elements[cut:])
        x, y = (a, 1 + np.log(draw.integers(1, 4, len(a)))), (b, 1 + np.log(draw.integers(1, 4, len(b))))
        own = nd.signatures([x, y], 4000)
        assert abs((own[0] == own[1]).mean() - nd.similarity(x, y)) < 0.035
    one = (np.array([7], np.uint64), np.ones(1))
    assert (nd.signatures([one, (np.zeros(0, np.uint64), np.zeros(0))])[0] == 7).all()


def near(draw, text, share):
    w = text.split()
    return " ".join(f"x{draw.randrange(10 ** 6)}" if draw.random() < share else t for t in w)


def group(seed, n=240):
    """Many near copies at all distances, copies of copies, and others."""
    draw = random.Random(seed)
    base = " ".join(f"w{draw.randrange(3000)}" for _ in range(180))
    texts = [base]
    for _ in range(n):
        texts.append(near(draw, draw.choice(texts), draw.choice([0, 0.004, 0.01, 0.02, 0.04, 0.08])))
    return texts + [" ".join(f"w{draw.randrange(3000)}" for _ in range(40)) for _ in range(40)] + ["same words again here now"] * 5 + ["one two"] * 3


def check(spark, texts, partitions=6):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    got = {r.doc_id: r for r in nd.near_duplicates(spark, rows).collect()}
    want = slow_classes(texts)
    size = Counter(want)
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(want))
    assert all(r.class_size == size[r.class_id] for r in got.values())
    return want


def test_a_large_near_group_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 50)  # several blocks in a bucket
    monkeypatch.setattr(nd, "BLOCK_WORDS", 4000)  # and sets that are forgotten
    want = check(spark, group(1))
    assert 5 < len(set(want)) < len(want)


def test_given_table_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    check(spark, [r.text for r in rows])


def test_nulls_repeats_and_empty_table(spark):
    text = "a b c d e f g h"
    shape = "doc_id long, text string, id long, bands int"
    rows = spark.createDataFrame(
        [(5, text, 1, 1), (5, text, 1, 1), (5, "other words here", 2, 2), (7, text.upper(), 0, 0), (None, "x y z", 1, 1), (None, "x y z", 1, 1),
         (None, text + "!", 1, 1), (8, None, 1, 1), (9, None, 1, 1), (10, "", 1, 1), (11, "...", 1, 1), (12, "q " * 40_000, 1, 1)], shape)
    got = sorted((r.doc_id or -1, r.class_id or -1, r.class_size) for r in nd.near_duplicates(spark, rows).collect())
    assert got == sorted([(5, 5, 4), (5, 5, 4), (5, 5, 1), (7, 5, 4), (-1, -1, 2), (-1, -1, 2), (-1, 5, 4), (8, 8, 1), (9, 9, 1), (10, 10, 1),
                          (11, 11, 1), (12, 12, 1)])
    assert nd.near_duplicates(spark, rows.limit(0)).count() == 0
