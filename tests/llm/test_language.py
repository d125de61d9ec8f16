"""Language identification: every segmentation listed one by one, held-out accuracy, defined cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import language as lg
from corpuslens.llm.language_queries import op2
from corpuslens.llm.staging import held_out

SF = "/root/testdata/sf0.01"
PIECES = sorted(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "é"])


def segmentations(word, p):
    """Sum over segmentations, and expected pieces, by listing them."""
    number = {x: i for i, x in enumerate(PIECES, 1)}
    every = []

    def go(rest, used):
        if not rest:
            every.append(used)
        for n in range(1, len(rest) + 1):
            i = number.get(rest[:n], 0 if n == 1 else None)
            if i is not None:
                go(rest[n:], used + [i])

    go("▁" + word, [])
    weights = [np.prod(p[s], 0) for s in every]
    total = sum(weights)
    counts = np.zeros_like(p)
    for s, w in zip(every, weights):
        for i in s:
            counts[i] += w / total
    return total, counts


@pytest.fixture(scope="module")
def setting():
    draw = np.random.default_rng(0)
    p = draw.random((len(PIECES) + 1, 3))
    pick = random.Random(0)
    return lg.Lattice(PIECES), p / p.sum(0), ["".join(pick.choice("aabbéx") for _ in range(pick.randrange(1, 9))) for _ in range(60)]


def test_forward_sums_all_segmentations(setting):
    lattice, p, words = setting
    want = np.array([np.log(segmentations(w, p)[0]) for w in words])
    assert np.allclose(lattice.log_words(words, p), want)
    assert np.allclose([lattice.log_long(w, p) for w in words], want)


def test_expected_counts(setting):
    lattice, p, words = setting
    counts = np.random.default_rng(1).integers(0, 5, (len(words), 3)).astype(float)
    want = sum(segmentations(w, p)[1] * c for w, c in zip(words, counts))
    assert np.allclose(lattice.expected(words, counts, p), want)


def test_long_words_do_not_underflow(setting):
    lattice, p, _ = setting
    for n in (40, 60, 30_000):
        assert np.isfinite(lattice.log_words(["ab" * n], p)).all()


def test_rare_letters_do_not_underflow(setting):
    lattice, p, _ = setting
    p = p.copy()
    p[0] = 1e-9
    for n in (40, 48, 60):
        assert np.isfinite(lattice.log_words(["z" * n, "ab"], p)).all()
    for n in (48, 5000):
        found = lattice.expected(["z" * n], np.ones((1, 3)), p)
        assert np.allclose(found[0], n) and np.isfinite(found).all()


def test_languages_of_long_runs_are_learned(spark):
    rows = [(i, "ab" * 300 if i % 2 else "éé" * 300, "xx" if i % 2 else "yy") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lg.fit(spark, docs, PIECES)
    assert model.languages == ["xx", "yy"]
    got = {r.doc_id: r for r in lg.languages(docs, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.99 for i, _, lang in rows)
    rare = spark.createDataFrame([(1, "é é é é é é " + "z" * 46)], "doc_id long, text string")
    row = lg.languages(rare, model).first()
    assert row.lang_pred == "yy" and 0 <= row.score <= 1


def test_held_out_accuracy(spark):
    rows = op2(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_repeats_and_empty_tables(spark):
    shape = "doc_id long, text string, lang string, word string, n int"
    docs = spark.createDataFrame(
        [(i, t, x, None, 1) for i, t, x in [(1, "der die das", "de"), (1, "der die das", "de"), (4, "the of and", "en"), (5, None, "en"),
         (None, "the of", None), (6, "123 -", "fr"), (9, "x" * 70_000, None), (10, "", "de")]], shape)
    assert docs.filter(~held_out(F.col("doc_id"))).count() >= 4
    model = lg.fit(spark, docs, PIECES)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in lg.languages(docs, model).collect())
    assert len(got) == 8 and (5, "und") in got and (6, "und") in got and (10, "und") in got
    none = lg.fit(spark, docs.limit(0), PIECES)
    assert {r.lang_pred for r in lg.languages(docs, none).collect()} == {"und"}
    assert lg.languages(docs.limit(0), model).count() == 0


def test_numerals_are_no_letters(spark):
    assert lg.words_of("½ ² ① ⅷ 3 _ 四") == ["四"] and lg.words_of("x²y Ab①") == ["x", "y", "ab"]
    model = lg.Model(["en"], PIECES, np.full((len(PIECES) + 1, 1), 0.1))
    docs = spark.createDataFrame([(1, "½ ² ① ⅷ"), (2, "½ a"), (3, "12 _ 3")], "doc_id long, text string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in lg.languages(docs, model).collect()} == {1: ("und", 0.0), 2: ("en", 1.0), 3: ("und", 0.0)}
