"""Quality rules whose cutoff is chosen with a guarantee on false rejection.

Counts per document come from array functions over the words and lines of its
whole text.  They give one integer `badness`: the largest of several ratios,
each divided by its scale, in thousandths.  For every stratum the labelled
documents are the holdout: a cutoff is certified when the exact binomial tail
P(Bin(n, risk) <= k) of its k rejected good documents among n is at most
delta / (number of strata).  Cutoffs are tested from the most lenient one on
(fixed sequence), so within a stratum no further correction is needed, and the
tail grows with k, so the certified cutoffs are exactly those above the first
failure.  Of the certified ones the cutoff with the best difference of rejection
rates (bad less good) is taken, the more lenient one on ties.  With probability
1 - delta no stratum rejects more than the share `risk` of its good documents.

DataFrame functions only.  The texts are read once; afterwards only counts move,
as partial sums of at most strata x bins rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.staging import written

RISK = 0.01       # share of good documents that may be rejected in a stratum
DELTA = 0.05      # probability that some stratum exceeds it
BIN = 25          # cutoffs lie on a fixed grid of this many thousandths ...
BINS = 400        # ... up to this many steps; more badness counts as the last step
MIN_WORDS = 50

# --- fixed values: white space that parts words, symbols, and the scale of each ratio in thousandths
WHITE_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SCALES = {"symbols": 100, "dup_lines": 300, "repeats": 500, "capitals": 300, "marks": 300}

_POSITION_BITS = 24
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _same_trigram(words: Column, p: Column, q: Column) -> Column:
    at = lambda i, k: F.get(words, i + k)
    return (at(p, 0) == at(q, 0)) & (at(p, 1) == at(q, 1)) & (at(p, 2) == at(q, 2))


def _covered(positions: Column) -> Column:
    """Words inside the windows of three that start at the ascending `positions`."""
    steps = F.zip_with(F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0))),
                       F.slice(positions, 1, F.greatest(F.size(positions) - 1, F.lit(0))),
                       lambda b, a: F.least(F.lit(3).cast("long"), b - a))
    return F.when(F.size(positions) > 0, F.aggregate(steps, F.lit(3).cast("long"), lambda s, x: s + x)).otherwise(0)


def text_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_marks.

    Windows of three words are compared by sorting one long each: 40 bits of a
    hash and the position.  Neighbours are confirmed by their words; a text in
    which two different windows share the 40 bits, or with more than 2^24 words,
    is sorted by the words themselves, so the count is exact.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in rows.columns if c != text]
    trimmed = F.btrim(t, F.lit(WHITE_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0b\f\r]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE_SPACE)) != "")
    counted = rows.select(
        *kept, words.alias("_words"), lines.alias("_lines"),
        _without(t, SYMBOLS).cast("long").alias("n_symbols"), _without(t, _UPPER).cast("long").alias("n_capitals"),
        _without(t, "!?").cast("long").alias("n_marks"))
    w = F.col("_words")
    n = F.size(w)
    hashed = F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.shiftleft(
        F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), _POSITION_BITS).bitwiseOR(i.cast("long")))
    counted = counted.select(
        *kept, "_words", "n_symbols", "n_capitals", "n_marks",
        n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(hashed).alias("_sorted"))
    s = F.col("_sorted")
    high = lambda x: F.shiftright(x, _POSITION_BITS)
    place = lambda x: x.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).cast("int")
    beside = lambda x, i, k: high(x) == high(F.get(s, i + k))
    alike = F.filter(s, lambda x, i: beside(x, i, 1) | F.coalesce(beside(x, i, -1), F.lit(False)))
    counted = counted.select(*[c for c in counted.columns if c != "_sorted"], alike.alias("_alike"))
    a = F.col("_alike")
    clash = F.exists(F.transform(a, lambda x, i: F.coalesce(
        (high(x) == high(F.get(a, i + 1))) & ~_same_trigram(w, place(x), place(F.get(a, i + 1))), F.lit(False))), lambda x: x)
    quick = F.sort_array(F.transform(a, lambda x: place(x).cast("long")))
    counted = counted.select(
        *[c for c in counted.columns if c != "_alike"], quick.alias("_starts"),
        ((F.col("n_words") >= (1 << _POSITION_BITS)) | clash).alias("_exact"))
    by_words = F.array_sort(F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct(
        x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("at"))))
    counted = counted.select(
        *[c for c in counted.columns if c not in ("_words", "_exact")],
        F.when(F.col("_exact"), by_words).alias("_slow"))
    slow = F.col("_slow")
    same = lambda x, i, k: (F.get(slow, i + k)["a"] == x["a"]) & (F.get(slow, i + k)["b"] == x["b"]) & (F.get(slow, i + k)["c"] == x["c"])
    slow_starts = F.sort_array(F.transform(F.filter(slow, lambda x, i: F.coalesce(same(x, i, 1), F.lit(False)) | F.coalesce(
        same(x, i, -1), F.lit(False))), lambda x: x["at"]))
    counted = counted.withColumn("_starts", F.coalesce(slow_starts, F.col("_starts")))
    return counted.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        _covered(F.col("_starts")).cast("long").alias("n_repeat_words"), "n_capitals", "n_marks")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def badness() -> Column:
    """The worst ratio over its scale, in thousandths; 1000 is a ratio at its scale."""
    part = lambda top, below, name: F.expr(f"(1000000 * {top}) div (greatest({below}, 1) * {SCALES[name]})")
    return F.greatest(
        part("n_symbols", "word_chars", "symbols"), part("n_dup_lines", "n_lines", "dup_lines"),
        part("n_repeat_words", "n_words", "repeats"), part("n_capitals", "word_chars", "capitals"),
        part("n_marks", "n_words", "marks"))


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: eight steps of the recurrence, then Stirling's series."""
    y = x + 8
    shift = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below the mean, 1 from the mean on.

    Terms are summed from k downwards, where they shrink; those further than 40
    standard deviations away are below the precision of a double.
    """
    n, k = n.cast("double"), k.cast("double")
    first = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 200).cast("int")
    sums = F.aggregate(
        F.sequence(F.lit(0), terms), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda s, i: F.struct(
            (s["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"), (s["total"] + s["term"]).alias("total")),
        lambda s: s["total"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.exp(first) * sums, F.lit(1.0)))


def certified_cutoffs(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, cutoff, of holdout(stratum, badness, good BOOLEAN); strata without a certified cutoff have no row.

    A document is rejected when its step of the grid is above `cutoff`.  All
    labelled documents count; the steps and the test are the same at every size.
    """
    step = F.least(F.floor(F.col("badness") / BIN), F.lit(BINS)).cast("int")
    bins = holdout.groupBy("stratum", step.alias("step")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # every step of the grid, also those without a document; a union, as a null stratum joins with nothing
    zeros = bins.select("stratum").distinct().select(
        "stratum", F.explode(F.sequence(F.lit(-1), F.lit(BINS - 1))).alias("cutoff"), F.lit(0).alias("good"), F.lit(0).alias("bad"))
    grid = bins.select("stratum", (F.col("step") - 1).alias("cutoff"), "good", "bad").unionByName(zeros).groupBy("stratum", "cutoff").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    # one row for each stratum and step: at most BINS + 1 rows in a window
    above, whole = W.partitionBy("stratum").orderBy(F.col("cutoff").desc()), W.partitionBy("stratum")
    counts = grid.select(
        "stratum", "cutoff", F.sum("good").over(whole).alias("n"), F.sum("bad").over(whole).alias("n_bad"),
        F.sum("good").over(above).alias("k"), F.sum("bad").over(above).alias("k_bad"))
    strata = bins.select("stratum").distinct()
    n_strata = F.greatest(strata.agg(F.count("*").alias("n_strata")).scalar(), F.lit(1))
    passed = counts.filter("cutoff >= 0").withColumn("p_value", binomial_tail(F.col("n"), F.col("k"), risk)).filter(
        F.col("p_value") <= delta / n_strata)
    gain = F.col("k_bad") / F.greatest("n_bad", F.lit(1)) - F.col("k") / F.greatest("n", F.lit(1))
    best = W.partitionBy("stratum").orderBy(F.round(gain, 9).desc(), F.col("cutoff").desc())
    return passed.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("stratum", "cutoff")


def quality_verdicts(
    spark: SparkSession, documents: DataFrame, labels: DataFrame, stratum: str = "lang",
    risk: float = RISK, delta: float = DELTA,
) -> DataFrame:
    """doc_id, the counts, base_failed, badness, cutoff and kept, a row for each document.

    The cutoff is the last step, which rejects nothing, where none is certified.

    labels(doc_id, quality): a document is good if any of its labels is 1, bad
    if all are 0; null labels and ids count as none.

    The bound needs independent trials, so a text counts once in a stratum's holdout
    however many copies it has; it is good if one of them is.

    Defined cases: a null or empty text has no words and fails the base rule; a
    null stratum is a stratum of its own; repeated rows each give a row (and
    are one trial of the holdout); empty tables give no rows or no cutoffs; of
    extra columns none is read.
    """
    rows = documents.select("doc_id", F.col(stratum).cast("string").alias("stratum"), F.xxhash64("text").alias("content"), "text")
    counts = written(spark, text_counts(rows).withColumn("badness", badness()).withColumn("base_failed", base_failed()), "counts")
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    holdout = counts.filter("NOT base_failed").join(good, "doc_id").groupBy("stratum", "content").agg(
        F.max("badness").alias("badness"), F.bool_or("good").alias("good"))
    cutoffs = written(spark, certified_cutoffs(holdout, risk, delta), "cutoffs")
    step = F.least(F.floor(F.col("badness") / BIN), F.lit(BINS))
    judged = counts.join(cutoffs.select(F.col("stratum").alias("of"), "cutoff"), F.col("stratum").eqNullSafe(F.col("of")), "left")
    cutoff = F.coalesce("cutoff", F.lit(BINS))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (step <= cutoff)).alias("kept"), "badness", cutoff.alias("cutoff"))
