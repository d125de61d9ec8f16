"""Ranked lexical search by the Best Position Algorithm over impact lists.

`build_index` writes the documents as blocks: the terms of the block and, for each,
the places of its documents and how often it occurs there.  A block is a row; it
is closed by the document that reaches `BLOCK_POSTINGS`, so a row stays small.  The
index knows nothing of the queries and can be searched many times.

`search` takes the queries in blocks of at most `QUERY_TERMS` terms.  Tasks read the
index once for each such block, put rows together to segments of about
`SEGMENT_POSTINGS` and turn the lists of the terms they need into impact lists: the
documents of a term by falling share of the score.  (A share depends on the number
and the mean length of all documents, so lists are ordered when they are searched.)

A query then goes down its lists together.  The smallest unseen positions of every
list are accessed directly; each document found is scored at once by looking it up
in all other lists, and its positions there count as seen.  The best position of a
list is the last one with only seen positions before it.  No unseen document can
score more than the shares at the best positions together; the query stops when
that sum is strictly below the k-th score, so ties are all found.  Best positions
pass over whatever look-ups have seen, so the bound falls faster than by what was
read.  A task keeps the k-th score of a query from segment to segment, and gives
k documents for each query; windows, first by groups of tasks, then by query, take
the k best of them.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslens.llm.decontamination import normal_words
from corpuslens.llm.staging import written

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_POSTINGS = 200_000
BLOCKS_TOGETHER = 8   # readers and writers of columns hold the rows of a row group, some MB each
SEGMENT_POSTINGS = 2_000_000
QUERY_TERMS = 200_000
TASK_GROUPS = 64
LONGEST_STEP = 4096

_BLOCK = ("terms array<binary>, sizes array<int>, docs array<int>, counts array<int>, "
          "doc_ids array<long>, lengths array<long>")
_FOUND = "query long, part int, doc_id long, score long"


@dataclass
class Index:
    blocks: DataFrame   # written rows of _BLOCK
    documents: int      # with at least one term
    length: int         # terms of all documents, with repeats


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number: dict[bytes, int] = {}
    terms: list[int] = []
    counts: list[int] = []
    sizes: list[int] = []
    ids: list[int | None] = []
    lengths: list[int] = []

    def block() -> pa.RecordBatch:
        term = np.array(terms, np.int32)
        order = np.argsort(term, kind="stable")
        docs = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
        row = (list(number), np.bincount(term, minlength=len(number)).astype(np.int32), docs, np.array(counts, np.int32)[order], ids, lengths)
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.list_(k)) for x, k in zip(row, kinds)], ["terms", "sizes", "docs", "counts", "doc_ids", "lengths"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            found = Counter(normal_words(text.as_py()))
            if not found:
                continue
            terms.extend([number.setdefault(t, len(number)) for t in found])
            counts.extend(found.values())
            sizes.append(len(found))
            ids.append(doc_id)
            lengths.append(found.total())
            if len(terms) >= BLOCK_POSTINGS:
                yield block()
                for x in (number, terms, counts, sizes, ids, lengths):
                    x.clear()
    if ids:
        yield block()


def build_index(spark: SparkSession, documents: DataFrame) -> Index:
    """Index of documents(doc_id, text); doc_id is read as a long.

    Defined cases: a null text, or one without a term, is no document of the index;
    repeated rows are documents of their own; a null doc_id comes last among ties;
    further columns are not read; a long text is one document of one block.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = written(spark, rows.mapInArrow(_blocks, _BLOCK), "lexical-index", BLOCKS_TOGETHER)
    total = blocks.agg(
        F.sum(F.size("doc_ids")).alias("documents"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("length")).first()
    return Index(blocks, total.documents or 0, total.length or 0)


class Segment:
    """Impact lists of some blocks, for the terms with the given weights."""

    def __init__(self, blocks: list[dict], weights: np.ndarray, documents: int, length: int):
        firsts = np.concatenate([[0], np.cumsum([len(b["lengths"]) for b in blocks])]).astype(np.int64)
        self.n_docs = int(firsts[-1])
        lengths = np.concatenate([b["lengths"] for b in blocks])
        self.doc_ids = np.concatenate([b["doc_ids"] for b in blocks])
        self.no_id = np.concatenate([b["no_id"] for b in blocks])
        # a posting's key holds its term and its document: the lists of all terms in one ascending array
        keys = np.concatenate([b["term"].astype(np.int64) * self.n_docs + b["docs"] + first for b, first in zip(blocks, firsts)])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        tf = np.concatenate([b["counts"] for b in blocks])[order].astype(np.int64)
        del keys, order
        term, doc = (x.astype(np.int32) for x in np.divmod(self.keys, max(self.n_docs, 1)))
        norm = 75 + (25 * lengths * documents) // length
        self.impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[doc]))
        del tf
        self.size = np.bincount(term, minlength=len(weights))
        self.start = np.cumsum(self.size) - self.size
        by_impact = np.lexsort((-self.impact, term))
        self.listed = doc[by_impact]                  # documents of each list by falling impact
        self.falling = self.impact[by_impact]
        self.place = np.empty(len(by_impact), np.int32)   # place in that order of each posting
        self.place[by_impact] = np.arange(len(by_impact), dtype=np.int32)

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, top: tuple) -> tuple:
        """The k best of `top` (scores, ids, no_ids; best first) and this segment's documents."""
        here = self.size[terms] > 0
        terms, times = terms[here], times[here]
        if not len(terms):
            return top
        start, size = self.start[terms], self.size[terms]
        base = np.cumsum(size) - size
        shift = base - start
        seen = np.zeros(int(size.sum()), bool)
        front = np.zeros(len(terms), np.int64)        # best positions
        step = k
        while True:
            fresh = []
            for i in np.flatnonzero(front < size):
                a, b = front[i], min(front[i] + step, size[i])
                fresh.append(self.listed[start[i] + a:start[i] + b][~seen[base[i] + a:base[i] + b]])
            if not fresh:
                return top
            docs = np.unique(np.concatenate(fresh))
            wanted = (terms[:, None] * self.n_docs + docs).ravel()
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            share = np.where(hit, self.impact[at], 0).reshape(len(terms), -1)
            seen[(self.place[at].reshape(len(terms), -1) + shift[:, None]).ravel()[hit]] = True
            top = self._merged(top, (times[:, None] * share).sum(0), docs, k)
            bound = 0
            for i in np.flatnonzero(front < size):
                rest = seen[base[i] + front[i]:base[i] + size[i]]
                ahead = int(rest.argmin())
                front[i] = size[i] if rest[ahead] else front[i] + ahead
                if front[i] < size[i]:
                    # the list goes on after its best position; a list seen whole gives an unseen document nothing
                    bound += int(times[i]) * int(self.falling[start[i] + max(front[i] - 1, 0)])
            if bound == 0 or len(top[0]) == k and bound < top[0][-1]:
                return top
            step = min(2 * step, LONGEST_STEP)

    def _merged(self, top: tuple, score: np.ndarray, docs: np.ndarray, k: int) -> tuple:
        least = top[0][-1] if len(top[0]) == k else 1
        good = np.flatnonzero(score >= least)
        if not len(good):
            return top
        scores = np.concatenate([top[0], score[good]])
        ids = np.concatenate([top[1], self.doc_ids[docs[good]]])
        no_ids = np.concatenate([top[2], self.no_id[docs[good]]])
        order = np.lexsort((ids, no_ids, -scores))[:k]
        return scores[order], ids[order], no_ids[order]


def _searcher(vocabulary: list[bytes], weights: np.ndarray, queries: list[tuple[int, list[int], list[int]]], k: int, documents: int, length: int):
    def read(row: dict, wanted: pa.Array) -> dict:
        """A block's postings of the wanted terms, as arrays."""
        number = pc.index_in(row["terms"].values, wanted)
        sizes = row["sizes"].values.to_numpy()
        term = np.repeat(number.fill_null(-1).to_numpy().astype(np.int32), sizes)
        ours = term >= 0
        ids = row["doc_ids"].values
        return {
            "term": term[ours], "docs": row["docs"].values.to_numpy()[ours],
            "counts": row["counts"].values.to_numpy()[ours], "lengths": row["lengths"].values.to_numpy().astype(np.int64),
            "doc_ids": ids.fill_null(0).to_numpy(), "no_id": ids.is_null().to_numpy(zero_copy_only=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.binary())
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        tops = [none] * len(queries)
        asked = [(np.array(t, np.int64), np.array(c, np.int64)) for _, t, c in queries]
        held: list[dict] = []

        def answer() -> None:
            segment = Segment(held, weights, documents, length)
            held.clear()
            for i, (terms, times) in enumerate(asked):
                tops[i] = segment.best(terms, times, k, tops[i])

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(read({n: batch.column(n)[i] for n in batch.schema.names}, wanted))
                if sum(len(b["term"]) for b in held) >= SEGMENT_POSTINGS:
                    answer()
        if held:
            answer()
        part = TaskContext.get().partitionId() % TASK_GROUPS
        for (query, _, _), (scores, ids, no_ids) in zip(queries, tops):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), query)), pa.array(np.full(len(scores), part, np.int32)),
                     pa.array(ids, mask=no_ids), pa.array(scores)], ["query", "part", "doc_id", "score"])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for query, text in zip(batch.column("query").to_pylist(), batch.column("text")):
            found = Counter(normal_words(text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([query] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                ["query", "term", "times"])


def search(spark: SparkSession, index: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every row of items(item_id, text).

    Defined cases: a null text, and a term that no document holds, finds nothing; rows
    with one item_id are searched each for itself; fewer than k documents are all
    given; equal scores rank by ascending doc_id, null last; further columns are not read.
    """
    numbered = written(spark, items.select("item_id", "text").withColumn("query", F.monotonically_increasing_id()), "queries")
    asked = written(spark, numbered.select("query", "text").mapInArrow(_query_terms, "query long, term binary, times long"), "query-terms")
    # sizes are those of the queries, not of the corpus: Spark broadcasts them or not by their written size
    frequency = index.blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).select("t.terms", "t.sizes").join(
        asked.select(F.col("term").alias("terms")).distinct(), "terms", "left_semi").groupBy("terms").agg(F.sum("sizes").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = written(spark, asked.join(frequency.select(F.col("terms").alias("term"), weight.alias("weight")), "term"), "weighed-terms")
    blocks = max(1, math.ceil(weighed.count() / QUERY_TERMS))
    parts = []
    for block in range(blocks):
        # about QUERY_TERMS rows; a single query is never cut
        rows = weighed.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()
        number: dict[bytes, int] = {}
        weights: list[int] = []
        queries: dict[int, tuple[list[int], list[int]]] = {}
        for r in rows:
            term = bytes(r.term)
            if term not in number:
                number[term] = len(number)
                weights.append(r.weight)
            terms, times = queries.setdefault(r["query"], ([], []))
            terms.append(number[term])
            times.append(r.times)
        asks = []
        for q, (t, c) in sorted(queries.items()):
            by_term = sorted(zip(t, c))
            asks.append((q, [x for x, _ in by_term], [x for _, x in by_term]))
        parts.append(index.blocks.mapInArrow(
            _searcher(list(number), np.array(weights, np.int64), asks, k, index.documents, index.length), _FOUND))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(
        W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
    ranked = best(best(found, "query", "part").drop("rank"), "query")
    return ranked.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
