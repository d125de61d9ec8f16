"""Benchmark passages in documents, by Wu-Manber multi-pattern search.

Texts become lower-cased words joined by single spaces, with a space at both
ends, so that a window of words is one byte string and occurs exactly where its
words do.  The windows of the benchmark are searched together: a table of byte
blocks tells how far the search may jump without passing a window, blocks that
end the compared prefix of a window lead to a bucket of windows, and those are
compared directly.

The documents are read once, by map tasks, for every block of `BLOCK_WINDOWS`
different benchmark windows; only that many windows are ever sent to the tasks at
once, each with a number, however many items hold it.  A usual benchmark is one
block.  The hits of several blocks are united per document, and found numbers are
joined with the items that hold them.
"""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.staging import written

# executors need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
BLOCK_WINDOWS = 200_000

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, parted by everything in ASCII but letters and digits."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Byte strings of all windows; fewer words than `size`, but not none, are one window."""
    if not words:
        return []
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


class WuManber:
    """Search tables over byte strings whose lengths differ by less than a factor of two."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        # long enough that most blocks of a text do not occur in the patterns, at some two bits a byte
        self.block = block = min(m, max(2, math.ceil(math.log(2 * m * len(patterns), 4))))
        self.jump = m - block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(block, m + 1):
                piece = p[end - block:end]
                if self.shift.get(piece, self.jump) > m - end:
                    self.shift[piece] = m - end
            self.bucket[p[m - block:m]].append(p)

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(position, pattern) of every occurrence, by ascending position."""
        m, block, jump, shift, bucket = self.m, self.block, self.jump, self.shift.get, self.bucket
        end, n = m, len(text)
        while end <= n:
            step = shift(text[end - block:end], jump)
            if step:
                end += step
                continue
            at = end - m
            for p in bucket[text[end - block:end]]:
                if text.startswith(p, at):
                    yield at, p
            end += 1


class Searcher:
    """Wu-Manber tables by length class: one short pattern does not shorten the jumps of the others."""

    def __init__(self, patterns: Iterable[bytes]):
        classes = defaultdict(list)
        for p in set(patterns):
            classes[len(p).bit_length()].append(p)
        self.tables = [WuManber(sorted(c)) for c in classes.values()]

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        for t in self.tables:
            yield from t.find(text)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending [start, end) spans with the same union."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def word_spans(text: bytes, found: Iterable[tuple[int, bytes]]) -> list[tuple[int, int]]:
    """Word ranges of occurrences in a joined text."""
    spans, at, word = [], 0, 0
    for start, end in merged((a, a + len(p)) for a, p in found):
        word += text.count(b" ", at, start)
        at = start
        spans.append((word, word + text.count(b" ", start, end) - 1))
    return merged(spans)


def _item_windows(size: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text")):
                found = list(set(windows(normal_words(text.as_py()), size)))
                for i in range(0, len(found), 10_000):
                    part = found[i:i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], ["item", "win"])

    return split


_HITS = "doc_id {id}, n_words long, spans array<struct<start: int, end: int>>, found array<long>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(patterns: dict[bytes, int]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(patterns)
        for batch in batches:
            n_words, spans, numbers = [], [], []
            for text in batch.column("text"):
                words = normal_words(text.as_py())
                joined = b" " + b" ".join(words) + b" "
                found = list(searcher.find(joined)) if words else []
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in word_spans(joined, found)])
                numbers.append(sorted({patterns[p] for _, p in found}))
            more = [c for c in batch.schema.names if c not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(numbers, pa.list_(pa.int64())),
                 *(batch.column(c) for c in more)], ["doc_id", "n_words", "spans", "found", *more])

    return search


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in merged((s["start"], s["end"]) for s in row)] for row in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(spans, _SPANS), batch.column("found")],
            ["doc_id", "n_words", "spans", "found"])


def benchmark_hits(
    spark: SparkSession, documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """doc_id, n_words, spans (disjoint ranges of hit words), items (ids as strings, sorted) of every document.

    Defined cases: a null text has no words; an item without words has no
    window; a null item_id is called "null"; rows with one item_id are one item;
    repeated documents each give a row; an empty benchmark hits nothing; an
    empty table gives no rows; a text of any length is searched whole; further
    columns are not read.
    """
    id_type = documents.schema["doc_id"].dataType
    shape = _HITS.format(id=id_type.simpleString())
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    wins = written(spark, items.mapInArrow(_item_windows(size), "item string, win binary").distinct(), "windows")
    numbered = written(spark, wins.select("win").distinct().withColumn("number", F.monotonically_increasing_id()), "window-numbers")
    n_blocks = max(1, math.ceil(numbered.count() / block_windows))
    texts = documents.select("doc_id", "text")
    parts = []
    for block in range(n_blocks):
        # about block_windows rows: the hash spreads different windows evenly
        rows = numbered.filter(F.pmod(F.xxhash64("win"), F.lit(n_blocks)) == block).collect()
        search = _search({bytes(r.win): r.number for r in rows})
        if n_blocks == 1:
            parts.append(texts.mapInArrow(search, shape))
            break
        marked = texts.withColumn("text_hash", F.xxhash64("text")).mapInArrow(search, shape + ", text_hash long")
        # equal rows are one before blocks meet, and are given back below
        parts.append(marked.groupBy("doc_id", "text_hash").agg(
            F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("found").alias("found"), F.count("*").alias("n")))
    hits = parts[0]
    if n_blocks > 1:
        # a row of each block for a document
        grouped = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_hash").agg(
            F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("found")).alias("found"),
            F.max("n").alias("n"))
        copies = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        hits = copies.select("doc_id", "n_words", "spans", "found").mapInArrow(_united, shape)
    hits = written(spark, hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    # the items of the windows that were found; of a document each item once
    named = wins.join(numbered, "win").select("number", "item")
    items = hits.select("row", F.explode("found").alias("number")).join(named, "number").groupBy("row").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    return hits.join(items, "row", "left").select(
        "doc_id", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(hits: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: a twentieth of the words or more are hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return hits.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
