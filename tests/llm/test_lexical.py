"""Ranked search against the scores of all documents, and its defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpuslens.llm import lexical
from corpuslens.llm.lexical import Segment, build_index, search


def slow_terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in found]


def slow_ranks(docs, items, k=20):
    rows = [(i, Counter(slow_terms(t))) for i, t in docs]
    rows = [(i, c) for i, c in rows if c]
    n_docs, length = len(rows), sum(c.total() for _, c in rows)
    out = []
    for item, text in items:
        scored = []
        for i, c in rows:
            m = 75 + (25 * c.total() * n_docs) // length
            score = 0
            for t in slow_terms(text):
                df = sum(t in other for _, other in rows)
                if df:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i, score))
        out += [(item, r + 1, s[3], s[4]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def sample():
    draw = random.Random(11)
    words = ["a", "B", "an", "the", "thé", "x9", "日本", "rare1", "rare2"] + [f"w{i}" for i in range(40)]
    word = lambda: words[min(int(draw.expovariate(0.15)), len(words) - 1)]
    text = lambda n: draw.choice([" ", "\n", " -- "]).join(word() for _ in range(n))
    docs = [(draw.randrange(0, 200), text(draw.randrange(0, 60))) for _ in range(150)]
    docs += [(7, "same text rare1")] * 30 + [(None, "same text rare1")] * 3 + [(8, None), (None, None), (9, ""), (9, "... !")]
    docs += [(500, " ".join(["a the w3"] * 5000))]
    items = [(i, text(draw.randrange(1, 30))) for i in range(12)] + [(3, "same SAME text"), (None, "rare1 rare2"), (99, None), (98, "unknown"), (97, "")]
    return docs, items


def given(spark, docs, items):
    d = spark.createDataFrame([(t, i, "x", 1) for i, t in docs], "text string, doc_id long, query string, score int").repartition(3)
    b = spark.createDataFrame([(t, i, "x", 1) for i, t in items], "text string, item_id long, term string, rank int")
    return d, b


def rows(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


@pytest.mark.parametrize("postings, segment, terms", [(200_000, 2_000_000, 200_000), (40, 60, 15)])
def test_equal_to_brute_force_in_one_block_and_in_many(spark, monkeypatch, postings, segment, terms):
    docs, items = sample()
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", segment)
    monkeypatch.setattr(lexical, "QUERY_TERMS", terms)
    d, b = given(spark, docs, items)
    index = build_index(spark, d)
    assert rows(search(spark, index, b)) == slow_ranks(docs, items)
    assert rows(search(spark, index, b, k=3)) == slow_ranks(docs, items, k=3)


def test_empty_tables(spark):
    d, b = given(spark, *sample())
    assert rows(search(spark, build_index(spark, d.limit(0)), b)) == []
    assert rows(search(spark, build_index(spark, d.filter("text IS NULL")), b)) == []
    assert rows(search(spark, build_index(spark, d), b.limit(0))) == []


def one_block(n_docs, lists):
    return {
        "term": np.concatenate([np.full(len(x), t) for t, x in enumerate(lists)]), "docs": np.concatenate(lists).astype(np.int64),
        "counts": np.concatenate([np.arange(len(x), 0, -1) for x in lists]), "lengths": np.full(n_docs, 1000, np.int64),
        "doc_ids": np.arange(n_docs, dtype=np.int64), "no_id": np.zeros(n_docs, bool)}


def test_search_stops_before_the_ends_of_its_lists(monkeypatch):
    n = 50_000
    seen = []
    merged = Segment._merged
    monkeypatch.setattr(Segment, "_merged", lambda self, top, score, docs, k: seen.extend(docs) or merged(self, top, score, docs, k))
    both = np.arange(n)
    segment = Segment([one_block(n, [both, both])], np.array([700, 700]), n, 1000 * n)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    scores, ids, _ = segment.best(np.array([0, 1]), np.array([1, 1]), 5, none)
    assert ids.tolist() == [0, 1, 2, 3, 4] and len(seen) < n // 10


def test_random_segments_equal_all_scores():
    draw = np.random.default_rng(3)
    for _ in range(60):
        n = int(draw.integers(1, 300))
        lists = [np.sort(draw.choice(n, int(draw.integers(0, n + 1)), replace=False)) for _ in range(4)]
        block = one_block(n, lists)
        block["counts"] = draw.integers(1, 4, len(block["counts"]))
        weights = draw.integers(0, 5, 4) * 100
        segment = Segment([block], weights, n, 1000 * n)
        times = draw.integers(1, 3, 4)
        total = np.zeros(n, np.int64)
        for t, d, c in zip(block["term"], block["docs"], block["counts"]):
            total[d] += times[t] * weights[t] * ((10**9 * c) // (1000 * c + 12 * 100))
        want = sorted((-s, i) for i, s in enumerate(total.tolist()) if s > 0)[:20]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        scores, ids, _ = segment.best(np.arange(4), times, 20, none)
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == want


def test_few_blocks_are_held_together(spark, monkeypatch):
    """Readers hold a row group; one of hundreds of blocks is more than an executor has."""
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 40)
    monkeypatch.setattr(lexical, "BLOCKS_TOGETHER", 2)
    import pyarrow.parquet as pq

    index = build_index(spark, given(spark, *sample())[0].coalesce(1))
    (file,) = [f.removeprefix("file:") for f in index.blocks.inputFiles()]
    groups = pq.ParquetFile(file).metadata
    sizes = [groups.row_group(i).num_rows for i in range(groups.num_row_groups)]
    assert index.blocks.count() == sum(sizes) > 10 and max(sizes) == 2
