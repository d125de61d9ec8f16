"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words and of their first four and five
characters, hashed into 2^18 buckets.  The model is w0 + sum w_i + sum of
<v_i, v_j> over all pairs of present terms, so that two terms together (an
insult and a group that is mentioned) can weigh more, or less, than their sum;
the pair sum costs one pass: (|sum v|^2 - sum |v|^2) / 2.

Fitting uses a bounded sample of different labelled texts, by the smallest hashes of
their ids: at most `TRAIN_DOCS` texts with at most `TRAIN_TERMS` terms together.  Their
terms are counted by Spark per bucket; buckets whose rates differ clearly between
the labels (|z| >= MIN_Z, at least MIN_DOCS documents) become terms of the model.  So do
both buckets of every pair whose documents are clearly more, or less, toxic than a
first model of the terms so far expects (MIN_PAIR_Z, higher since there are up to
billions of pairs).  No pair's likelihood ratio can exceed that of its documents one by
one, so a bucket whose documents together do not surprise the first model enough is in
no such pair; all pairs of the other buckets that share at least MIN_DOCS documents are
tested, over as much of the sample as has `TRAIN_PAIRS` pairs, in tasks that each take a
part of the buckets.  The driver holds the sample's bucket numbers, no texts, and fits
by full-batch Adam, some documents at a time.  Scoring is a map over all documents.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.staging import held_out, written

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 18
TRAIN_DOCS, TRAIN_TERMS, TRAIN_PAIRS = 20_000, 5_000_000, 2_000_000_000
MIN_Z, MIN_DOCS = 5.0, 4
MIN_PAIR_Z = 6.5
FIT_ENTRIES = 200_000       # terms of documents in one step of the fit
SURE = 0.02, 0.98
FACTORS, STEPS, RATE, DECAY = 8, 200, 0.05, 1e-4
CACHED_WORDS = 300_000

_words = re.compile(r"\w+").findall


@dataclass
class Model:
    terms: np.ndarray    # buckets, ascending
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # one row for each term


def word_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word, of its first four and of its first five characters."""
    crc = zlib.crc32
    forms = {b"w" + word.encode("utf-8", "surrogatepass")}
    forms.update(b"%d" % n + word[:n].encode("utf-8", "surrogatepass") for n in (4, 5) if len(word) >= n)
    return tuple(crc(f) % BUCKETS for f in forms)


def text_buckets(text: str | None) -> list[int]:
    found: set[int] = set()
    for word in set(_words((text or "").lower())):
        found.update(word_buckets(word))
    return sorted(found)


def _sample(spark: SparkSession, documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """place, toxic, buckets of the texts to learn from, at most `most` rows and `TRAIN_TERMS` buckets."""
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    place = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.orderBy(*place).limit(most)
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # an id may stand for many rows: again at most `most` different texts.  Both tables are small by that parameter
    keys = texts.select("doc_id", "text_hash").join(F.broadcast(chosen), "doc_id").distinct().orderBy(*place, "text_hash").limit(most)
    keys = written(spark, keys, "toxic-keys")
    held = texts.join(F.broadcast(keys), ["doc_id", "text_hash"]).select(place[0].alias("place"), "text_hash", "toxic", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = [text_buckets(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("text_hash"), batch.column("toxic"), pa.array(buckets, pa.list_(pa.int32()))],
                ["place", "text_hash", "toxic", "buckets"])

    found = held.mapInArrow(hashed, "place long, text_hash long, toxic int, buckets array<int>")
    # equal rows are one
    sample = written(spark, found.groupBy("place", "text_hash").agg(F.max("toxic").alias("toxic"), F.first("buckets").alias("buckets")), "toxic-sample")
    sizes = sample.select("place", F.size("buckets").alias("n")).toArrow()
    order = np.argsort(sizes.column("place").to_numpy(), kind="stable")
    fits = np.cumsum(sizes.column("n").to_numpy()[order]) <= TRAIN_TERMS
    if fits.all():
        return sample
    return sample.filter(F.col("place") < int(sizes.column("place").to_numpy()[order][int(np.argmin(fits))]))


def _fit(n_terms: int, y: np.ndarray, doc: np.ndarray, term: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors that minimise the logistic loss with weight decay.

    `doc`, ascending, and `term` have an entry for each term of each document; `y` are the labels.
    """
    y = np.asarray(y, float)
    ends = np.searchsorted(doc, np.arange(len(y) + 1))
    cuts = [0]
    while cuts[-1] < len(y):
        # at least one document, and as many as have so many entries
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + FIT_ENTRIES, "right")) - 1))
    cuts[-1] = len(y)
    draw = np.random.default_rng(0)
    base = (y.sum() + 0.5) / (len(y) + 1)
    bias, w, v = np.array([np.log(base / (1 - base))]), np.zeros(n_terms), draw.normal(0, 0.05, (n_terms, FACTORS))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (bias, w, v)]
    for step in range(1, STEPS + 1):
        gradients = [np.zeros(1), DECAY * w, DECAY * v]
        for a, b in zip(cuts, cuts[1:]):
            t, d, n = term[ends[a]:ends[b]], doc[ends[a]:ends[b]] - a, b - a
            vt = v[t]
            sums = np.stack([np.bincount(d, vt[:, f], n) for f in range(FACTORS)], 1)
            z = bias[0] + np.bincount(d, w[t], n) + 0.5 * ((sums ** 2).sum(1) - np.bincount(d, (vt ** 2).sum(1), n))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]) / len(y)
            to_term = error[d]
            pair = to_term[:, None] * (sums[d] - vt)
            gradients[0] += error.sum()
            gradients[1] += np.bincount(t, to_term, n_terms)
            for f in range(FACTORS):
                gradients[2][:, f] += np.bincount(t, pair[:, f], n_terms)
        for x, g, (m, s) in zip((bias, w, v), gradients, state):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            x -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return float(bias[0]), w, v


def _clear_partners(at: int, indptr: np.ndarray, items: np.ndarray, places: np.ndarray, doc: np.ndarray, toxic: np.ndarray,
                    expected: np.ndarray, terms: int) -> np.ndarray:
    """Numbers after `at` whose documents together with it are not as toxic as expected.

    `items` has the numbers of each document in ascending order, `doc` the document of each place in it,
    `places` those of `at`; `toxic` and `expected` are the label and its expectation for each document.
    """
    size = indptr[doc[places] + 1] - places - 1
    ends = np.cumsum(size)
    after = items[np.repeat(places + 1 - ends + size, size) + np.arange(ends[-1])]
    if len(after) < terms // 8:
        found, after = np.unique(after, return_inverse=True)
        n = np.bincount(after)
    else:
        n = np.bincount(after, minlength=terms)
        found = np.arange(terms)
    enough = n >= MIN_DOCS
    if not enough.any():
        return found[:0]
    total = lambda x: np.bincount(after, np.repeat(x[doc[places]], size), len(n))[enough]
    n, seen, want = n[enough], total(toxic), total(expected)
    # likelihood ratio, also right for few documents
    parts = lambda a, e: a * np.log(np.maximum(a, 1e-9) / e)
    ratio = 2 * (parts(seen, want) + parts(n - seen, n - want))
    return found[enough][ratio >= MIN_PAIR_Z ** 2]


def _surprising(items: np.ndarray, doc: np.ndarray, toxic: np.ndarray, expected: np.ndarray, terms: int) -> np.ndarray:
    """Numbers whose documents, one by one, are together as unlikely as a clear pair must be.

    A group's ratio is at most the sum of its documents' (relative entropy is convex), and a
    pair's documents are a part of its bucket's.
    """
    each = -2 * np.log(np.where(toxic > 0, expected, 1 - expected))
    return np.flatnonzero(np.bincount(items, each[doc], terms) >= MIN_PAIR_Z ** 2 - 1e-3)


def _pair_terms(spark: SparkSession, items: np.ndarray, doc: np.ndarray, toxic: np.ndarray, expected: np.ndarray, terms: int) -> list[int]:
    """Numbers of all pairs whose documents differ clearly from what is expected."""
    able = _surprising(items, doc, toxic, expected, terms)
    number = np.full(terms, -1, np.int32)
    number[able] = np.arange(len(able))
    kept = number[items] >= 0
    items, doc = number[items[kept]], doc[kept]
    # as many documents as the pairs allow
    size = np.bincount(doc, minlength=len(toxic)).astype(np.int64)
    within = int(np.searchsorted(np.cumsum(size * (size - 1) // 2), TRAIN_PAIRS, "right"))
    if within < len(toxic):
        items, doc = items[doc < within], doc[doc < within]
    if not len(items):
        return []
    shared = spark.sparkContext.broadcast((items, doc, toxic, expected))
    tasks, count = 4 * spark.sparkContext.defaultParallelism, len(able)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, doc, toxic, expected = shared.value
        indptr = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(toxic)))])
        n = np.bincount(items, minlength=count)
        places, ends = np.argsort(items, kind="stable"), np.cumsum(n)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                clear: set[int] = set()
                for at in range(part, count, tasks):
                    if n[at] < MIN_DOCS:
                        continue
                    partners = _clear_partners(at, indptr, items, places[ends[at] - n[at]:ends[at]], doc, toxic, expected, count)
                    if len(partners):
                        clear.add(at)
                        clear.update(partners.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(sorted(clear), pa.int32())], ["term"])

    found = spark.range(0, tasks, 1, tasks).mapInArrow(search, "term int").distinct().collect()
    shared.unpersist()
    return sorted(int(able[r.term]) for r in found)


def fit(spark: SparkSession, documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Model of `labels(doc_id, toxic)`; without both labels, or clear terms, it only knows the base rate.

    A document with several labels is toxic if one says so; equal rows are one.
    """
    sample = _sample(spark, documents, labels, most)
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    if not n_pos + n_neg:
        return Model(np.zeros(0, int), -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    per_bucket = sample.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    rate = F.col("n") / (n_pos + n_neg + 1e-9)
    spread = F.sqrt(rate * (1 - rate) * (1 / max(n_pos, 1) + 1 / max(n_neg, 1)) + 1e-12)
    z = F.abs(pos / max(n_pos, 1) - neg / max(n_neg, 1)) / spread
    # at most as many rows as buckets
    common = per_bucket.filter(F.col("n") >= MIN_DOCS).select("bucket", (z >= MIN_Z).alias("clear")).orderBy("bucket").limit(
        BUCKETS if n_pos and n_neg else 0).toArrow()
    bucket = common.column("bucket").to_numpy().astype(int)
    chosen = np.flatnonzero(common.column("clear").to_numpy())
    number = np.full(BUCKETS, -1, np.int32)
    number[bucket] = np.arange(len(bucket))

    # the bucket numbers of the sample, as two flat arrays, in an order of their own
    rows = sample.orderBy("place", "text_hash").select("toxic", "buckets").toArrow()
    toxic = rows.column("toxic").to_numpy().astype(np.float32)
    size = pc.list_value_length(rows.column("buckets")).to_numpy()
    items = number[pc.list_flatten(rows.column("buckets")).to_numpy()]
    doc = np.repeat(np.arange(len(toxic), dtype=np.int32), size)[items >= 0]
    items = items[items >= 0]
    del rows

    def fitted(terms: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
        place = np.full(len(bucket), -1, np.int32)
        place[terms] = np.arange(len(terms))
        at = place[items]
        own, of = at[at >= 0], doc[at >= 0]
        return Model(bucket[terms], *_fit(len(terms), toxic, of, own)), of, own

    model, of, own = fitted(chosen)
    if len(bucket):
        scorer = Scorer(model)
        ends = np.searchsorted(of, np.arange(len(toxic) + 1))
        # an expectation without doubt would make a single document a clear difference
        expected = np.clip([scorer.of_terms(own[a:b]) for a, b in zip(ends, ends[1:])], *SURE).astype(np.float32)
        terms = np.union1d(chosen, np.array(_pair_terms(spark, items, doc, toxic, expected, len(bucket)), int))
        if len(terms) > len(chosen):
            model = fitted(terms)[0]
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.index = {int(b): i for i, b in enumerate(model.terms)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def present(self, text: str | None) -> list[int]:
        """Numbers of the model's terms in a text."""
        seen, found = self.seen, set()
        if len(seen) > CACHED_WORDS:
            seen.clear()
        for word in set(_words((text or "").lower())):
            terms = seen.get(word)
            if terms is None:
                terms = tuple(self.index[b] for b in word_buckets(word) if b in self.index)
                if len(word) <= 64:
                    seen[word] = terms
            if terms:
                found.update(terms)
        return sorted(found)

    def score(self, text: str | None) -> float:
        return self.of_terms(self.present(text))

    def of_terms(self, at: list[int] | np.ndarray) -> float:
        z = self.model.bias
        if len(at):
            v = self.model.factors[at]
            total = v.sum(0)
            z += float(self.model.weights[at].sum() + 0.5 * (total @ total - (v * v).sum()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity_scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every document.

    Defined cases: a null or empty text has no terms and scores the bias; a text of any
    length is read whole; repeated rows each give a row; an empty table gives none; other columns are not read.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            score = np.array([scorer.score(t.as_py()) for t in batch.column("text")], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {id_type}, score double, predicted int")


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, that the model does not predict as toxic: a map, nothing is moved."""
    at = documents.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return documents.mapInArrow(kept, documents.schema)
