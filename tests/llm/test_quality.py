"""Quality rules: counts and cutoffs against plain versions, the exact tail, defined cases."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import quality as q

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def slow_counts(text):
    text = text or ""
    word = lambda s: re.findall(r"[^\x20\x09-\x0D]+", s)
    w = word(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if word(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    draw = random.Random(0)
    yield from [None, "", " \n\t", "a", "a b", "a b c a b c", "x\x0by\x0cz\x85é\xa0ü\n\n", "l\nl\n l\nl", "#|<>&%$*", "a " * 3000]
    for _ in range(150):
        yield "".join(draw.choice(["a", "b", "ab", "é", "日", "|", "%", "!"]) + draw.choice([" ", " ", "\n", "\t", "  "]) for _ in range(draw.randrange(0, 90)))


@pytest.mark.parametrize("bits", [24, 60])
def test_counts_equal_plain_counting(spark, monkeypatch, bits):
    monkeypatch.setattr(q, "_POSITION_BITS", bits)  # with 60 bits for places, windows share the few bits of their hash
    want = list(texts())
    rows = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in q.text_counts(rows).collect()}
    assert got == {i: slow_counts(t) for i, t in enumerate(want)}


def exact_tail(n, k, p):
    return sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))


def test_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 2, 10, 299, 500, 1000) for k in range(0, 12) if k <= n]
    rows = spark.createDataFrame(cases, "n long, k long").select("n", "k", q.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("t")).collect()
    for r in rows:
        want = 1.0 if r.k >= r.n * 0.01 else exact_tail(r.n, r.k, 0.01)
        assert math.isclose(r.t, want, rel_tol=1e-8)
    large = spark.createDataFrame([(10 ** 9, 10 ** 7 - 3 * 10 ** 4)], "n long, k long").select(q.binomial_tail(F.col("n"), F.col("k"), 0.01)).first()[0]
    z = (3 * 10 ** 4 - 0.5) / math.sqrt(1e9 * 0.01 * 0.99)
    assert abs(large / (0.5 * math.erfc(z / math.sqrt(2))) - 1) < 0.05


def holdout(draw):
    for stratum, n in (("a", 3000), ("b", 900), (None, 700), ("few", 60)):
        for _ in range(n):
            good = draw.random() < 0.8
            yield stratum, int(abs(draw.gauss(200 if good else 1500, 200))), good


def test_cutoffs_equal_a_plain_search_and_hold_the_risk(spark):
    rows = list(holdout(random.Random(3)))
    got = {r.stratum: r.cutoff for r in q.certified_cutoffs(spark.createDataFrame(rows, "stratum string, badness long, good boolean")).collect()}
    strata = {s for s, _, _ in rows}
    want = {}
    for s in strata:
        good = [b for x, b, g in rows if x == s and g]
        bad = [b for x, b, g in rows if x == s and not g]
        best = None
        for c in range(q.BINS):
            over = lambda values: sum(min(b // q.BIN, q.BINS) > c for b in values)
            k = over(good)
            if k < len(good) * q.RISK and exact_tail(len(good), k, q.RISK) <= q.DELTA / len(strata):
                gain = round(over(bad) / max(len(bad), 1) - k / max(len(good), 1), 9)
                if best is None or gain >= best[0]:
                    best = gain, c
        if best:
            want[s] = best[1]
            assert sum(min(b // q.BIN, q.BINS) > best[1] for b in good) / len(good) <= q.RISK
    assert got == want and "few" not in got and len(got) == 3


def test_copies_certify_nothing(spark):
    """Ten good texts in 100 copies each are ten trials; 1000 different ones certify a cutoff."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    labels = lambda n: spark.createDataFrame([(i, 1) for i in range(n)], "doc_id long, quality int")
    rows = lambda texts: spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    cutoffs = lambda docs: {r.cutoff for r in q.quality_verdicts(spark, docs, labels(1000)).collect()}
    assert cutoffs(rows([text(i % 10) for i in range(1000)])) == {q.BINS}
    assert max(cutoffs(rows([text(i) for i in range(1000)]))) < q.BINS


def test_cutoffs_reject_bad_documents_and_few_good_ones(spark):
    """A whole run in which the method, and not the base rules, rejects."""
    shout = lambda i: " ".join(f"W{i}X{j}" for j in range(60))
    calm = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    docs = spark.createDataFrame([(i, shout(i) if i % 4 == 0 else calm(i), "en") for i in range(2000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(1500)], "doc_id long, quality int")
    rows = q.quality_verdicts(spark, docs, labels).collect()
    assert not any(r.base_failed for r in rows) and all(r.kept == (r.doc_id % 4 > 0) for r in rows)


def test_nulls_repeats_and_empty_tables(spark):
    shape = "doc_id long, text string, lang string, n_words int, cutoff string"
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", 5, "x"), (1, text, "en", 5, "x"), (None, text, None, 1, None), (2, None, "en", 0, ""),
                                  (3, "a b c " * 30_000, None, 0, "")], shape)
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None), (None, 1), (9, 0)], "doc_id long, quality int")
    rows = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept, r.cutoff) for r in q.quality_verdicts(spark, docs, labels).collect())
    last = q.BINS
    assert rows == [(0, 60, False, True, last), (1, 60, False, True, last), (1, 60, False, True, last), (2, 0, True, False, last),
                    (3, 90_000, True, False, last)]
    assert q.quality_verdicts(spark, docs.limit(0), labels).count() == 0
    assert q.quality_verdicts(spark, docs, labels.limit(0)).filter("kept").count() == 3
