"""Resampling of documents by their likeness to a target distribution.

Features are the runs of 1 to `LONGEST` words of a text, hashed into 10,000
buckets.  The logarithm of how much more frequent a bucket is in the target than
in the documents is its gain: an array of one number for each bucket, which goes
to the tasks.  A document weighs the sum of the gains of its features.  Gumbel
noise, drawn from its id, makes taking the highest scores a draw without
replacement in which heavier documents are likelier.

The highest k scores are found by distributed quickselect: a few rows of the range
that holds the k-th key are drawn as pivots, one aggregate counts the rows before,
at and after each of them, and the range shrinks to the part between two pivots
until one of them is the k-th.  Rows of that part are written for the next round,
so the rounds read less and less.  Keys are (score, doc_id, row), so every row has
its own place.  Only the winners are sorted, by ranges, and ranked.
"""

from __future__ import annotations

import hashlib
import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.decontamination import normal_words
from corpuslens.llm.staging import numbered, written

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS, PERCENT = 20, 10
PIVOTS = 15
CACHED_FEATURES = 300_000


class _Bucket(dict):
    """Bucket of a feature; remembers a bounded number of them."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHED_FEATURES:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % BUCKETS
        return bucket


def features(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to `longest` words, joined by one space."""
    if longest == 1:
        return words
    return [b" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _buckets(known: _Bucket, found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def bucket_counts(rows: DataFrame, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts in each bucket; a task gives one row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Bucket(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total += np.bincount(_buckets(known, features(normal_words(text.as_py()), longest)), minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    total = np.zeros(BUCKETS, np.int64)
    # at most BUCKETS rows
    for r in rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much likelier a bucket is in the target), one added to every count."""
    of_corpus, of_target = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * of_corpus / ((float(s) + 1) * of_target)))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    drawn = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def scores(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Bucket()
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column("text"):
                words = normal_words(text.as_py())
                found = features(words, longest)
                n_words.append(len(words))
                n_features.append(len(found))
                weight.append(int(gain[_buckets(known, found)].sum()))
            total = [w + noise(i, seed) for w, i in zip(weight, batch.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, total))],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    return documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def _key() -> Column:
    return F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("row").alias("d"))


def kth_key(spark: SparkSession, rows: DataFrame, k: int, pivots: int = PIVOTS) -> Column:
    """Literal of the k-th smallest `key`, k from 1 to the number of rows; keys are distinct."""
    kind = rows.schema["key"].dataType
    literal = lambda key: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind.fields)))
    before, turn = 0, 0
    while True:
        drawn = [r.key for r in rows.orderBy(F.xxhash64("key.d", F.lit(turn)), "key.d").limit(pivots).select("key").collect()]
        at = [literal(key) for key in drawn]
        counts = rows.agg(*(F.count_if(F.col("key") < p).alias(f"n{i}") for i, p in enumerate(at))).first()
        # rows before it, the row itself, rows after it
        places = sorted((before + counts[i] + 1, i) for i in range(len(at)))
        lower = [x for x in places if x[0] < k]
        upper = [x for x in places if x[0] > k]
        if len(lower) + len(upper) < len(places):
            return next(at[i] for place, i in places if place == k)
        if lower:
            before = lower[-1][0]
            rows = rows.filter(F.col("key") > at[lower[-1][1]])
        if upper:
            rows = rows.filter(F.col("key") < at[upper[0][1]])
        rows, turn = written(spark, rows, "select-range"), turn + 1


def resample(
    spark: SparkSession, documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    longest: int = LONGEST, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null: not drawn) of every document.

    Of the documents with at least `least_words` words, `percent` of a hundred are drawn.

    Defined cases: a null or empty text has no features and weighs 0; a null doc_id
    draws noise like the id "null" and comes last among ties; repeated rows are drawn
    each for itself; an empty target gives gains by the documents alone; a text of any
    length is read whole; empty documents give no rows; further columns are not read.
    """
    gain = gains(bucket_counts(documents, longest), bucket_counts(target, longest))
    rows = scores(documents, gain, longest, seed).withColumn("row", F.monotonically_increasing_id())
    rows = written(spark, rows, "scored")
    apt = rows.filter(F.col("n_words") >= least_words).withColumn("key", _key())
    k = percent * apt.count() // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if not k:
        return rows.select(*columns, no_rank)
    last = kth_key(spark, apt.select("key"), k)
    drawn = (F.col("n_words") >= least_words) & (_key() <= last)
    ranked = numbered(spark, rows.filter(drawn), [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")], "winners")
    return ranked.select(*columns, (F.col("number") + 1).alias("rank")).unionByName(rows.filter(~drawn).select(*columns, no_rank))
