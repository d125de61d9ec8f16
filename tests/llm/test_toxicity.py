"""Factorization machine: pair formula, held-out accuracy, a pure interaction, defined cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import toxicity as t
from corpuslens.llm.staging import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    documents, labels = tables
    model = t.fit(spark, documents, labels)
    rows = t.toxicity_scores(documents, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 50 and sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.97
    assert all(r.predicted == 0 for r in rows if r.toxic == 0)


def test_score_is_the_sum_over_pairs(spark, tables):
    model = t.fit(spark, *tables)
    scorer = t.Scorer(model)
    for row in tables[0].limit(40).collect():
        at = scorer.present(row.text)
        z = model.bias + sum(model.weights[i] for i in at)
        z += sum(float(model.factors[i] @ model.factors[j]) for i, j in itertools.combinations(at, 2))
        assert math.isclose(scorer.score(row.text), 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-6, abs_tol=1e-9)
        assert at == sorted(model.terms.tolist().index(b) for b in t.text_buckets(row.text) if b in model.terms)


def test_pairs_without_single_effects_are_learned():
    rows = [(int(a ^ b), [0] * a + [1] * b) for a, b in itertools.product((0, 1), repeat=2) for _ in range(50)]
    doc = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
    bias, w, v = t._fit(2, np.array([y for y, _ in rows]), doc, np.array([i for _, x in rows for i in x]))
    score = lambda at: bias + sum(w[i] for i in at) + sum(float(v[i] @ v[j]) for i, j in itertools.combinations(at, 2))
    assert score([]) < 0 < score([0]) and score([1]) > 0 > score([0, 1])


def test_pure_interactions_are_learned_by_fit(spark):
    filler = "the quick brown fox jumps over lazy dogs while rain falls on green hills".split()
    pick = np.random.default_rng(0)
    texts = [(int(a ^ b), ["gruppe"] * a + ["harmlos"] * b + [w for w in filler if pick.random() < 0.5])
             for a, b in itertools.product((0, 1), repeat=2) for _ in range(150)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, (_, x) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(texts)], "doc_id long, toxic int")
    model = t.fit(spark, docs, labels)
    assert set(t.word_buckets("gruppe") + t.word_buckets("harmlos")) <= set(model.terms.tolist())
    rows = t.toxicity_scores(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert len(rows) > 60 and all(r.predicted == r.toxic for r in rows)


def test_fit_in_steps_equals_fit_at_once(monkeypatch):
    draw = np.random.default_rng(5)
    y = draw.integers(0, 2, 60)
    doc = np.sort(draw.integers(0, 60, 500))
    term = draw.integers(0, 12, 500)
    whole = t._fit(12, y, doc, term)
    monkeypatch.setattr(t, "FIT_ENTRIES", 37)
    parts = t._fit(12, y, doc, term)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(whole, parts))


def slow_pairs(items, doc, toxic, expected):
    """Numbers of all clear pairs, pair by pair."""
    of = {}
    for i, d in zip(items.tolist(), doc.tolist()):
        of.setdefault(i, set()).add(d)
    found = set()
    for a, b in itertools.combinations(sorted(of), 2):
        both = sorted(of[a] & of[b])
        n, seen, want = len(both), float(toxic[both].sum()), float(expected[both].astype(float).sum())
        if n >= t.MIN_DOCS:
            part = lambda x, e: x * math.log(x / e) if x > 0 else 0.0
            if 2 * (part(seen, want) + part(n - seen, n - want)) >= t.MIN_PAIR_Z ** 2:
                found |= {a, b}
    return sorted(found)


def test_pairs_equal_all_pairs_one_by_one(spark):
    draw = np.random.default_rng(7)
    some = 0
    for turn in range(4):
        rows = [np.flatnonzero(draw.random(40) < draw.uniform(0.1, 0.6)) for _ in range(250)]
        toxic = np.array([float((3 in r) != (8 in r)) if turn % 2 else float(3 in r and 8 in r and draw.random() < 0.9) for r in rows], np.float32)
        expected = np.clip(draw.uniform(0, 0.5, 250), *t.SURE).astype(np.float32)
        items = np.concatenate(rows).astype(np.int32)
        doc = np.repeat(np.arange(250, dtype=np.int32), [len(r) for r in rows])
        got = t._pair_terms(spark, items, doc, toxic, expected, 40)
        assert got == slow_pairs(items, doc, toxic, expected)
        some += len(got)
    assert some >= 4


def test_sample_is_bounded_in_texts_and_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 30, f"w{i} " + " ".join(f"x{i}y{j}" for j in range(i % 7))) for i in range(300)] + [(1, "same text")] * 200, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    rows = t._sample(spark, docs, labels, 1000).collect()
    assert sum(r.buckets == t.text_buckets("same text") for r in rows) == 1 and len(rows) > 200
    assert len(t._sample(spark, docs, labels, 50).collect()) == 50
    monkeypatch.setattr(t, "TRAIN_TERMS", 400)
    few = t._sample(spark, docs, labels, 1000).collect()
    assert 0 < sum(len(r.buckets) for r in few) <= 400


def test_nulls_repeats_and_empty_tables(spark):
    shape = "doc_id long, text string, score string, toxic int"
    rows = [(None, "x", "", 1), (1, None, "", 0), (1, None, "", 0), (2, "", None, 1), (3, "word " * 60_000, None, None)]
    docs = spark.createDataFrame(rows, shape)
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, toxic int")
    scored = t.toxicity_scores(docs, t.fit(spark, docs, labels)).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    model = t.fit(spark, docs.limit(0), labels.limit(0))
    assert [r.predicted for r in t.toxicity_scores(docs, model).collect()] == [0] * 5
    assert t.toxicity_scores(docs.limit(0), model).count() == 0
